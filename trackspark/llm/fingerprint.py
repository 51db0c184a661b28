"""Document fingerprints: bottom-k sketches of 5-word shingle hashes.

A sketch is the ascending array of the k smallest distinct shingle hashes of a text (all of them, if fewer). Sketches merge by
union and cut, so parts of a document, or documents of a group, can be sketched apart and merged later. From two sketches
follow estimates of resemblance and containment, and from one the number of distinct shingles; all are exact while a
sketch holds fewer than k hashes.

Defined cases: a null text counts as empty; an empty text, or one without words, has an empty sketch; two empty sketches have
resemblance 1, an empty and another one 0. Equal texts have equal sketches, however long. Of documents in order, rows without an id come first, rows of one
id follow each other by text, repeated rows one after the other, and the last row's successor is the first; an empty table gives no rows. sketch()
keeps extra columns, except one of the name of the result, which the result replaces; fingerprint_with_edits() ignores them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import map_batches, range_cuts, range_of
from .shingles import shingle_sets

K = 128
WIDTH = 5
#: Rows of documents between two boundaries of the order, about.
ROWS_A_RANGE = 20_000


def _signed(h: np.ndarray) -> np.ndarray:
    """Keeps the order: 0 becomes the smallest long."""
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def bottom_k(texts: pa.Array, k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    return [h[:k] for h in shingle_sets(texts, width)]


def sketch(df: DataFrame, text: str = "text", out: str = "sketch", k: int = K, width: int = WIDTH) -> DataFrame:
    """df with the sketch of column `text` as array<bigint>."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_signed(h) for h in bottom_k(batch.column(text), k, width)]
        at = np.concatenate([[0], np.cumsum([len(h) for h in found])]).astype(np.int32)
        values = pa.array(np.concatenate(found) if found else np.empty(0, np.int64), pa.int64())
        columns = [batch.column(c) for c in kept]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(at), values)], names=[*kept, out])

    kept = [c for c in df.columns if c != out]
    return map_batches(df, run, StructType([*[df.schema[c] for c in kept], StructField(out, ArrayType(LongType()))]))


def merge_sketches(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K, salt: int = 16) -> DataFrame:
    """One sketch for each key from many: the k smallest distinct hashes, cut first within salted parts of a key, then over its parts."""
    h = df.select(*keys, F.explode(sketch).alias("_h"), F.spark_partition_id().alias("_p")).withColumn("_salt", F.pmod("_p", F.lit(salt)))

    def smallest(x: DataFrame, by: list[str]) -> DataFrame:
        return x.dropDuplicates([*by, "_h"]).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_n") <= k).drop("_n")

    few = smallest(smallest(h.select(*keys, "_salt", "_h"), [*keys, "_salt"]).select(*keys, "_h"), keys)
    found = few.groupBy(*keys).agg(F.array_sort(F.collect_list("_h")).alias(sketch))
    all_keys = df.select(*keys).distinct()
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    joined = all_keys.alias("a").join(found.alias("b"), on=same, how="left")
    return joined.select(*[F.col(f"a.{c}") for c in keys], F.coalesce(F.col(f"b.{sketch}"), F.array().cast("array<bigint>")).alias(sketch))


def _union_cut(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.concat(a, b))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard similarity: the share of both among the k smallest of the union."""
    u = _union_cut(a, b, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles: (k-1) over the k-th smallest hash as a share of all hashes."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63) + 1) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has: |a and b| = J / (1 + J) * (|a| + |b|), over |a|."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / na))


def alike(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """resemblance() for two sorted arrays."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    first = np.concatenate([[True], ~twice])
    # position of each distinct hash in the union; those that occur twice count if they are among the k smallest
    rank = np.cumsum(first)
    return float(np.count_nonzero(twice & (rank[1:] <= k)) / min(k, int(rank[-1])))


def followed(docs: DataFrame, rows: int = ROWS_A_RANGE) -> DataFrame:
    """docs (doc_id, text) dealt into ranges of ascending doc_id, each sorted, with columns _range and _kind.

    Each range ends with a row of _kind 1: a copy of the first row of the next range (of the first range, after the last), so
    that every row finds its successor in its own partition. Nulls come first; rows of one doc_id are ordered by text.
    The texts are shuffled once; the first rows of the ranges are found by an aggregate of one row a range.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = range_cuts(docs, "doc_id", rows)
    dealt = docs.withColumn("_range", range_of("doc_id", cuts)).withColumn("_kind", F.lit(0))
    firsts = dealt.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first"))  # a null id comes first
    w = Window.orderBy("_range")  # one row a range
    ends = firsts.select("_range", F.lead("first").over(w).alias("next"), F.lead("_range").over(w).alias("more"), F.first("first").over(w).alias("first"))
    ends = ends.select("_range", F.when(F.col("more").isNull(), F.col("first.doc_id")).otherwise(F.col("next.doc_id")).alias("of"))
    if cuts:
        ends = docs.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("of")))
        ends = ends.groupBy("_range").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    else:
        ends = docs.orderBy(F.col("doc_id").asc_nulls_first(), "text").limit(1).withColumn("_range", F.lit(0))
    ends = ends.select("doc_id", "text", "_range", F.lit(1).alias("_kind"))
    return dealt.unionByName(ends).repartitionById(len(cuts) + 1, F.col("_range")).sortWithinPartitions("_range", "_kind", F.col("doc_id").asc_nulls_first(), "text")


def fingerprint_with_edits(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """For each document, in the order of doc_id: doc_id, n_chars, edited_sha256, the sketches of its text and of its edited text, and their likenesses.

    The edited text has its last quarter (floor) of code points replaced by the first as many code points of the next document.
    """

    schema = "doc_id long, n_chars long, edited_sha256 string, sketch array<long>, edited_sketch array<long>, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, str, np.ndarray] | None = None
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids, texts, kinds = part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("_kind").to_pylist()
                sketches = bottom_k(part.column("text"), k, width)
                rows, edited = [], []
                for doc_id, text, kind, own in zip(ids, texts, kinds, sketches, strict=True):
                    if held is not None:
                        n = len(held[1])
                        q = n // 4
                        changed = held[1][: n - q] + text[:q] if q else held[1]
                        edited.append(changed)
                        rows.append((held[0], n, hashlib.sha256(changed.encode()).hexdigest(), held[2], alike(held[2], own, k)))
                    held = None if kind else (doc_id, text, own)
                if rows:
                    others = bottom_k(pa.array(edited, pa.large_string()), k, width)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[0] for r in rows], pa.int64()),
                            pa.array([r[1] for r in rows], pa.int64()),
                            pa.array([r[2] for r in rows], pa.string()),
                            pa.array([_signed(r[3]) for r in rows], pa.list_(pa.int64())),
                            pa.array([_signed(x) for x in others], pa.list_(pa.int64())),
                            pa.array([alike(r[3], x, k) for r, x in zip(rows, others, strict=True)], pa.float64()),
                            pa.array([r[4] for r in rows], pa.float64()),
                        ],
                        names=[x.split()[0] for x in schema.split(", ")],
                    )

    return followed(docs).mapInArrow(run, schema)


def as_text(sketch: Column) -> Column:
    """A sketch as hexadecimal text, 16 digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")
