"""A corpus pipeline of four stages over `documents`: language, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Defined cases: a null, empty or letterless text goes with the first stage, which keeps all others where no row says its language; a document without id is judged like others; repeated rows and rows of one id
are judged each, and of copies one row stays, so that different texts of one id both stay; of a group of copies the smallest id stays, and a row without
one only if none has; texts of any length count whole; an empty table gives no pieces; extra columns pass all filters unchanged, whatever their names, and the last stage drops them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import language, ngram_join, packing, quality
from trackspark.llm.common import free_name, table, written

#: A language that the model is less sure of is no language to keep.
LEAST_SURE = 0.25


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters and very unsure ones go. Where no language can be learned, all texts with letters stay."""
    lang, sure = free_name(docs, "_lang_pred"), free_name(docs, "_sure")
    model = language.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs, model, lang_pred=lang, score=sure)
    return found.where((F.col(lang) != language.UNKNOWN) & (F.col(sure) >= LEAST_SURE)).select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model, score = quality.fit(docs, table(spark, sf_dir, "labels")), free_name(docs, "_quality")
    return quality.score(docs, model, out=score).where(F.col(score) >= quality.CUT).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id."""
    return ngram_join.one_of_each(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 tokens, mixed by source."""
    pieces = packing.pack(packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


STAGES = [
    ("language ID", keep_languages),
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("packing", pack_windows),
]
#: Trained classifiers and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
