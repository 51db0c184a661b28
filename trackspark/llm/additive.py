"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of one codeword from each of M codebooks, all of full dimension. Codebooks start as residual
k-means and are then refitted together by least squares; codes come from a beam search over the codebooks. A row keeps its
M codes and the squared norm of its approximation, so that a query scores it by M table look-ups:
|q - x|^2 ~ |q|^2 - 2 sum_m <q, c_m> + |x~|^2. The best `rerank` rows of each block are ranked again by exact distance in double precision.

The codebooks are fitted on a bounded sample (`SAMPLE` rows, those of smallest hash of the id); every row is encoded and
searched. Rows and queries meet in blocks of bounded size, so memory doesn't grow with the table; of a query and a block of rows
only k rows are kept. A row is sent once for each block of queries, with its vector in the precision of the column. All codes are scored: lists around coarse
centroids would lose neighbours (the README has figures).

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another length than most take no
part, neither as queries nor as candidates; rows of one id are one query, and never candidates for it; with fewer than k
candidates all are returned; ties go to the smaller id; an empty table has no results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BOOKS, WORDS, BEAM = 16, 256, 4
SAMPLE, ROUNDS = 16_384, 8
#: Rows of a block, queries of a block, and rows of a block that are ranked exactly for a query.
ROWS, QUERIES, RERANK = 20_000, 8192, 512


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(axis=1) - 2 * (x @ words.T)).argmin(axis=1)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), size=k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = _nearest(x, words)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, at, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
        if (lost := np.flatnonzero(n == 0)).size:
            words[lost] = x[rng.choice(len(x), size=len(lost))]
    return words


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, M) and squared norms of the approximations, by beam search through the codebooks."""
    m, k, d = books.shape
    n = len(x)
    rest, codes, width = x[:, None, :].astype(np.float32), np.zeros((n, 1, m), np.uint8), 1
    for j in range(m):
        norms = (books[j] * books[j]).sum(axis=1)
        cost = (rest * rest).sum(axis=2)[:, :, None] + norms - 2 * (rest.reshape(-1, d) @ books[j].T).reshape(n, width, k)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
        parent, word = best // k, best % k
        rows = np.arange(n)[:, None]
        codes = codes[rows, parent]
        codes[:, :, j] = word
        rest = rest[rows, parent] - books[j][word]
        width = keep
    end = (rest * rest).sum(axis=2).argmin(axis=1)
    near = x - rest[np.arange(n), end]
    return codes[np.arange(n), end], (near * near).sum(axis=1)


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Codebooks (M, K, d): residual k-means, then one least-squares refit of all codewords to the beam-search codes."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    rest, found = x.copy(), []
    for _ in range(books):
        found.append(_means(rest, words, rounds, rng))
        rest -= found[-1][_nearest(rest, found[-1])]
    c = np.stack(found)
    codes = np.concatenate([encode(x[i : i + 1024], c)[0] for i in range(0, len(x), 1024)])
    at = codes.astype(np.int64) + np.arange(books) * words
    gram = np.zeros((books * words, books * words))
    for i in range(books):
        for j in range(books):
            np.add.at(gram, (at[:, i], at[:, j]), 1.0)
    right = np.zeros((books * words, x.shape[1]))
    for i in range(books):
        np.add.at(right, at[:, i], x)
    start = c.reshape(books * words, -1).astype(np.float64)
    ridge = 0.1
    solved = np.linalg.solve(gram + ridge * np.eye(len(gram)), right + ridge * start)
    return solved.reshape(c.shape).astype(np.float32)


def usable(df: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """vec_id and embedding of the rows that take part, as an array of floats where the column is one, else of doubles, and their dimension."""
    single = df.schema[embedding].dataType.simpleString() == "array<float>"
    v: Column = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return rows.where(F.size("embedding") == d), d


def index(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, vector (its numbers packed), codes and norm of every row, written to shared storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = part.column("embedding").flatten().to_numpy().reshape(part.num_rows, -1)
                codes, norms = encode(x.astype(np.float32), books)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(norms.astype(np.float64))],
                    names=["vec_id", "vector", "codes", "norm"],
                )

    return written(rows.mapInArrow(run, "vec_id long, vector binary, codes binary, norm double"))


def _search(q_id: np.ndarray, q: np.ndarray, r_id: np.ndarray, r: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray, k: int, rerank: int):
    """The k rows nearest to each query among the rerank best by look-up: query, row and distance, flat."""
    order = np.argsort(r_id, kind="stable")
    r_id, r, codes, norms = r_id[order], r[order], codes[order], norms[order]
    out_q, out_r, out_d = [], [], []
    flat = codes.astype(np.int64) + np.arange(codes.shape[1]) * books.shape[1]
    for i in range(0, len(q), 64):
        part = q[i : i + 64]
        tables = part.astype(np.float32) @ books.reshape(-1, books.shape[2]).T
        near = np.tile(norms.astype(np.float32), (len(part), 1))
        for j in range(flat.shape[1]):
            near -= 2 * tables[:, flat[:, j]]
        for a in range(len(part)):
            score = np.where(r_id == q_id[i + a], np.inf, near[a])
            n = min(rerank, len(score))
            # stable by id: of equal scores at the border the smaller ids stay
            cut = np.partition(score, n - 1)[n - 1]
            best = np.concatenate([np.flatnonzero(score < cut), np.flatnonzero(score == cut)])[:n]
            best = best[r_id[best] != q_id[i + a]]
            d = np.sqrt(((r[best] - part[a]) ** 2).sum(axis=1))
            top = np.lexsort((r_id[best], d))[:k]
            out_q.append(np.full(len(top), q_id[i + a]))
            out_r.append(r_id[best[top]])
            out_d.append(d[top])
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_d)


def search(df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", rerank: int = RERANK, rows: int = ROWS, queries: int = QUERIES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row for which is_query holds."""
    spark = df.sparkSession
    use, d = usable(df, vec_id, embedding)
    few = use.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()
    schema = "query_id long, vec_id long, score double"
    if not len(few):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = fit(np.stack(few["embedding"].to_numpy()).astype(np.float64))
    table = index(use, books)
    kind = "f4" if use.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    n = table.count()
    asked = table.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks, asks = max(1, -(-n // rows)), max(1, -(-asked.count() // queries))
    by = ["row_block", "query_block"]
    left = table.withColumn("row_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    right = asked.withColumn("query_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(asks)).cast("int")).withColumn("row_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(r: pa.Table, q: pa.Table) -> pa.Table:
        if not r.num_rows or not q.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

        def matrix(x: pa.Table, name: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(x.column(name).to_pylist()), kind).reshape(x.num_rows, -1)

        queries, vectors = (matrix(x, "vector", kind).astype(np.float64) for x in (q, r))
        found = _search(q.column("vec_id").to_numpy(), queries, r.column("vec_id").to_numpy(), vectors, matrix(r, "codes", "u1"), r.column("norm").to_numpy(), books, k, rerank)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
