"""The pipeline end to end on planted documents, against a plain version of what must stay and how it is packed."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from trackspark.llm.word_tokens import WordTokens  # noqa: E402

VOC = {
    "en": "the and of with house river mountain garden walked over under where they have been seen before morning light".split(),
    "de": "der und nicht schule wasser straße über durch gegangen haben werden können dieser jene abend licht morgen wir".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, _row int"


def planted():
    """Rows with what becomes of each: stays, goes, or a copy of a row."""
    rnd = random.Random(3)
    rows, stay = [], []

    def add(doc_id, text, lang, kept):
        rows.append((doc_id, text, lang, "web" if rnd.random() < 0.6 else None, len(text or ""), -5.0, "xx", 7))
        stay.append(kept)

    for i in range(120):
        lang = "en" if i % 3 else "de"
        add(i, " ".join(rnd.choice(VOC[lang]) for _ in range(rnd.randint(30, 90))).capitalize() + ".", lang, True)
    for i in range(120, 160):  # junk
        add(i, " ".join(rnd.choice(VOC["en"]).upper() + "!!" for _ in range(40)), "en", False)
    for k, i in enumerate(range(200, 220)):  # near copies of rows 0..19
        words = rows[k][1].split()
        add(i, " ".join([*words[:-1], "changed"]), rows[k][2], False)
    add(300, rows[1][1], rows[1][2], False)  # an exact copy
    add(1, "An altogether different text of the same id that was seen before and over the river with the garden light.", "en", True)
    add(None, "No id here but the house and the river have been seen under the mountain where they walked before morning.", "en", True)
    add(None, rows[2][1], rows[2][2], False)
    for text in (None, "", "   ", "1234 !!! 5678"):
        add(400 + len(rows), text, "en", False)
    add(500, " ".join(rnd.choice(VOC["en"]) for _ in range(30_000)), "en", True)
    return rows, stay


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("planted")
    rows, stay = planted()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{folder}/documents.parquet")
    labels = [(i, int(i < 120), 0) for i in range(160)] + [(3, None, 0), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return str(folder), rows, stay


def test_pipeline_keeps_what_a_plain_version_keeps(spark, tables):
    folder, rows, stay = tables
    words = WordTokens.load(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    want = collections.Counter()
    for row, kept in zip(rows, stay, strict=True):
        if kept:
            ids = words.encode(row[1], add_special_tokens=False).ids + [2]
            want[row[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    pieces = corpus_pipeline.run(spark, folder).collect()
    whole = collections.Counter((r.doc_id, r.length, r.ids_crc32) for r in pieces if r.length == r.doc_tokens)
    cut = collections.Counter()
    for r in pieces:
        if r.length < r.doc_tokens:
            cut[r.doc_id, r.doc_tokens] += r.length
    assert all(n == doc_tokens for (_, doc_tokens), n in cut.items())
    assert not whole - want
    assert collections.Counter((i, n) for i, n in cut) == collections.Counter((i, n) for (i, n, _), k in (want - whole).items() for _ in range(k))
    windows = collections.defaultdict(list)
    for r in pieces:
        windows[r.sequence_id].append((r.offset, r.length))
    for w, found in windows.items():
        ends = [0] + [o + n for o, n in sorted(found)]
        assert [o for o, _ in sorted(found)] == ends[:-1] and (ends[-1] == 4096 or w == max(windows))


def test_filters_leave_columns_alone(spark, tables):
    folder, rows, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() < docs.count()
        assert out.where((F.col("score") != -5.0) | (F.col("lang_pred") != "xx") | (F.col("_row") != 7)).count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_documents_stay_where_no_language_is_known(spark, tables):
    folder, rows, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.keep_languages(spark, docs, folder)
    assert kept.columns == docs.columns
    assert kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in rows) > 150
