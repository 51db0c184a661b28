"""Mixture-controlled packing of token streams into windows by deficit round-robin.

Each source is a queue of documents, served in turns of `quantum` tokens (the last turn of a queue is what is left). A queue of weight W is owed W*v tokens at
virtual time v; its deficit is what it is owed less what it got. A turn is served as soon as the deficit reaches a fixed share of the turn, a digest of the source's
name between 0 and 1, so that queues of one turn spread over the whole sequence. Deficits thus stay within a quantum at any time, and are carried over windows and
partitions, as a turn's time depends on its place in its queue alone. A queue that is empty drops out and the others share its place. The turns in order of
time (then source) form one stream, of which each `window` tokens are a window; in a window the turns of one source stand together, so a document is cut only where its source's part of a
window ends or, among very many sources, where a turn does. Every window but the last is full.

Steps: tokens are written once, with a running count a source within each partition; an aggregate (a row for each partition and source) gives where each
partition's part of a queue starts. Each document names the turns that begin in it; these slim rows are sorted by ranges of time, and running sums of their lengths give
windows. Turns then meet the documents they touch by their number, and the places found are joined back to the ids. Sources may be as many as documents: none is listed in one place, and
no row count depends on their number. Given weights are a table of parameters and are broadcast; of ranges only one number each comes to the driver.

Defined cases: a null text is empty and gives the end token only; a null source is a queue of its own, and null ids are kept; repeated rows are
packed each; a text of any length is cut into as many pieces as it needs; an empty table gives no pieces; columns beside id, text and source are ignored, whatever
their names. Weights must be positive; sources without a given weight raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, slices, written
from .word_tokens import WordTokens

WINDOW = 4096
END_ID = 2
#: Tokens that a queue gives in a turn: small beside a window, so that windows keep the proportions, and large enough that many sources don't shred documents.
QUANTUM = 256
#: Documents that are cut at once, and bytes of text that are tokenized at once: that takes some 25 times as much memory.
TOGETHER, BYTES_TOGETHER = 2000, 1 << 21


def tokenize(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", end_id: int = END_ID) -> DataFrame:
    """doc_id, source, part, row, before, n, ids (little-endian unsigned 32-bit, with the end token), written to shared storage.

    part numbers the partition, row the row in it, and before counts the tokens of the same source earlier in it.
    """
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens.load(path)
        part = TaskContext.get().partitionId()
        seen: dict[str | None, int] = {}
        done = 0
        for batch in batches:
            for rows in slices(batch, "text", BYTES_TOGETHER):
                flat, at = words.encode(rows.column("text"))
                length = np.diff(at) + 1
                ends = np.cumsum(length)
                out = np.empty(int(ends[-1]) if len(ends) else 0, "<u4")
                mask = np.ones(len(out), dtype=bool)
                mask[ends - 1] = False
                out[mask] = flat
                out[ends - 1] = end_id
                sources = rows.column("source").to_pylist()
                before = []
                for s, n in zip(sources, length.tolist(), strict=True):
                    before.append(seen.get(s, 0))
                    seen[s] = before[-1] + n
                offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32).tobytes())
                ids = pa.BinaryArray.from_buffers(pa.binary(), rows.num_rows, [None, offsets, pa.py_buffer(out.tobytes())])
                names = ["doc_id", "source", "part", "row", "before", "n", "ids"]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("source"), pa.array(np.full(rows.num_rows, part), pa.int32()), pa.array(np.arange(done, done + rows.num_rows)), pa.array(before, pa.int64()), pa.array(length, pa.int64()), ids], names=names)
                done += rows.num_rows
            give_back()

    return written(chosen.mapInArrow(run, "doc_id long, source string, part int, row long, before long, n long, ids binary"))


def _queues(tokens: DataFrame, weights: dict[str | None, float] | None) -> DataFrame:
    """_s, _p, base, total, weight: where the tokens of a source in a partition start in its queue, and the queue's length and weight."""
    sums = tokens.groupBy(F.col("source").alias("_s"), F.col("part").alias("_p")).agg(F.sum("n").alias("m"))
    queue = Window.partitionBy("_s")
    base = sums.withColumns({"base": F.sum("m").over(queue.orderBy("_p")) - F.col("m"), "total": F.sum("m").over(queue)}).drop("m")
    if weights is None:
        return base.withColumn("weight", F.col("total").cast("double"))
    given = tokens.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "_w string, weight double")
    missing = sums.join(F.broadcast(given.where("weight > 0")), F.col("_s").eqNullSafe(F.col("_w")), "left_anti").select("_s").distinct().limit(10).collect()
    if missing:
        raise ValueError(f"no weight for {[r['_s'] for r in missing]}")
    return base.join(F.broadcast(given), F.col("_s").eqNullSafe(F.col("_w"))).drop("_w")


def _in_order(turns: DataFrame) -> DataFrame:
    """Turns (source, turn, length, due) with `at`, their place in the stream of all turns by due, source and turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            length = batch.column("length").to_numpy()
            ends = seen + np.cumsum(length)
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("turn"), batch.column("length"), pa.array(np.full(len(length), part), pa.int32()), pa.array(ends - length)], names=["source", "turn", "length", "range", "before"])
            seen = int(ends[-1]) if len(ends) else seen

    order = ["due", "source", "turn"]
    ranged = written(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "source string, turn long, length long, range int, before long"))
    starts, seen = [], 0
    for r in ranged.groupBy("range").agg(F.sum("length").alias("m")).orderBy("range").collect():  # a row a range
        starts.append((r["range"], seen))
        seen += r["m"]
    base = turns.sparkSession.createDataFrame(starts, "range int, ahead long")
    return ranged.join(F.broadcast(base), "range").select("source", "turn", "length", (F.col("ahead") + F.col("before")).alias("at"))


def _parts(turns: DataFrame, window: int, quantum: int) -> DataFrame:
    """source, turn, a, m, w, o: each turn in order, cut at windows: tokens a to a + m of its queue are in window w from place o on."""
    last = F.expr(f"(at + length - 1) div {window}")
    cut = turns.withColumn("w", F.explode(F.sequence(F.expr(f"at div {window}"), last)))
    begin, end = F.greatest("at", F.col("w") * window), F.least(F.col("at") + F.col("length"), (F.col("w") + 1) * window)
    cut = cut.select("source", "turn", "w", (F.col("turn") * quantum + begin - F.col("at")).alias("a"), (end - begin).alias("m"))
    inside = Window.partitionBy("w").orderBy("source", "turn").rowsBetween(Window.unboundedPreceding, 0)  # at most a row a token of a window
    return cut.withColumn("o", F.sum("m").over(inside) - F.col("m"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of documents; what a document has in one window is contiguous, in its queue and there, and becomes one piece."""
    for batch in batches:
        for begin in range(0, batch.num_rows, TOGETHER):
            rows = batch.slice(begin, TOGETHER)
            places = rows.column("places")
            count = np.diff(places.offsets.to_numpy()).astype(np.int64)
            flat = places.flatten()
            start, length, w, offset = (flat.field(k).to_numpy() for k in range(4))
            doc = np.repeat(np.arange(rows.num_rows), count)
            order = np.lexsort((start, doc))
            doc, start, length, w, offset = doc[order], start[order], length[order], w[order], offset[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (w[1:] != w[:-1])])) if len(doc) else np.empty(0, np.int64)
            length = np.add.reduceat(length, first) if len(first) else length
            doc, start, w, offset = doc[first], start[first], w[first], offset[first]
            views = [x.as_buffer() for x in rows.column("ids")]
            cut = [views[d][4 * s : 4 * (s + m)].to_pybytes() for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(take), rows.column("source").take(take), pa.array(start), pa.array(length), rows.column("n").take(take), pa.array(w), pa.array(offset), pa.array(cut, pa.binary())],
                names=["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )


def pack(tokens: DataFrame, window: int = WINDOW, weights: dict[str | None, float] | None = None, quantum: int = QUANTUM) -> DataFrame:
    """Pieces of the documents of tokenize(): doc_id, source, start, length, doc_tokens, sequence_id, offset, ids (of the piece).

    weights: target proportions of tokens by source; None takes the proportions of the table, so that all queues end together.
    quantum: tokens of a turn. Smaller ones hold proportions closer, larger ones cut documents of small sources less.
    """
    same = (F.col("part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))
    docs = tokens.select("source", "part", "row", "before", "n").join(_queues(tokens, weights), same)
    docs = docs.select("source", "part", "row", (F.col("base") + F.col("before")).alias("begin"), "n", "total", "weight")

    # the turns that begin in a document, and when they are due
    first, behind = F.expr(f"(begin + {quantum - 1}) div {quantum}"), F.expr(f"(begin + n + {quantum - 1}) div {quantum}")
    begun = docs.where(behind > first).withColumn("turn", F.explode(F.sequence(first, behind - 1)))
    begun = begun.withColumn("length", F.least(F.lit(quantum), F.col("total") - F.col("turn") * quantum))
    phase = (F.crc32(F.coalesce("source", F.lit("")).cast("binary")) + 0.5) / float(1 << 32)
    due = ((F.col("turn") * quantum).cast("double") + phase * F.col("length")) / F.col("weight")
    parts = _parts(_in_order(begun.select("source", "turn", "length", due.alias("due"))), window, quantum)

    # turns meet the documents that they touch: at most `quantum`, as each document has a token
    touched = docs.withColumn("_t", F.explode(F.sequence(F.expr(f"begin div {quantum}"), F.expr(f"(begin + n - 1) div {quantum}")))).select(F.col("source").alias("_s"), "_t", "part", "row", "begin", "n")
    met = touched.join(parts, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_t") == F.col("turn")))
    a, b = F.greatest("begin", "a"), F.least(F.col("begin") + F.col("n"), F.col("a") + F.col("m"))
    place = F.struct((a - F.col("begin")).alias("start"), (b - a).alias("length"), "w", (F.col("o") + a - F.col("a")).alias("offset"))
    places = met.where(b > a).groupBy(F.col("part").alias("_p"), F.col("row").alias("_r")).agg(F.collect_list(place).alias("places"))
    found = tokens.join(places, (F.col("part") == F.col("_p")) & (F.col("row") == F.col("_r"))).select("doc_id", "source", "n", "ids", "places")
    return found.mapInArrow(_cut, "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
