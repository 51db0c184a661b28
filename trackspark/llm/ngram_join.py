"""N-gram Jaccard join by T-occurrence search, for near-duplicate groups.

Documents are sets of distinct 5-word shingle hashes; two link when 100 * intersection >= 75 * union. The result is exact: every
linked pair is found, whatever the sizes of groups. Linked pairs of n and m shingles share at least T = ceil(3 (n + m) / 7).

1. Equal sets are one class, known by the hash of the set; all else works on classes, and the text of one row stands for each.
2. A class lists the n - ceil(3n/4) + l smallest of its hashes, l = ceil(n * SPARE). Two linked classes have at least
   l (of the larger) of these in common, whichever ends first. Hashes that no other class lists drop out; a class left with
   fewer than l of them has no partner. Of the others the l - 1 most frequent are set aside (the long lists): in the order of
   frequency, the first common hash of a linked pair is never among them. Classes that have hot hashes left (passages that very many documents
   share, or large groups of copies) are tied by the rarest hashes of their whole sets in place of those: of a set of n, the n - ceil(3n/4) + 1 rarest. So a
   passage joins nothing by itself, unless it is three quarters of a document.
3. Each remaining hash has a smallest class; a class is at home with the smallest of these. Classes of one home are cut into
   blocks of bounded size. First every block is searched by itself, together with its home, and homes of several blocks once more, dealt
   otherwise: this connects most of any group of copies at the cost of two visits a class. Then classes are dealt into blocks that hold one
   connected group each, or small groups whole, and a class visits the blocks in which a class that isn't yet connected with it lists
   one of its hashes: links that connect anything new never lead elsewhere, and large groups don't visit themselves.
4. Two blocks that visit each other are a cell. In a cell the shingles of one block's visitors are inverted lists, and every set of the
   other's is a query by DivideSkip: the short lists are merged by a heap that skips rows which can't reach T - L, the L longest are
   probed by binary search for the rows that have T - L. Rows that are connected with the query already take no part. A cell returns,
   for each class, one class it is connected to, not all pairs.
5. Connected components of these over classes give the groups.

Cells are searched together up to SHINGLES_TOGETHER shingles; a class of any size fits. Of passages that make three quarters of many documents that
don't link, the visits grow as documents times their blocks.

Defined cases: a null or wordless text has no shingles and links with nothing, not even with another empty one; a text of
fewer than five words is one shingle, its whole sequence; repeated rows are copies; rows of one id with different texts are different documents;
rows without id link like others, but name a group only if no row of it has an id (then null); an empty table gives no rows. near_duplicates() ignores
extra columns; one_of_each() keeps them, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import free_name, map_batches, written
from .components import connected_components
from .shingles import set_id, shingle_sets

WIDTH = 5
#: Share of a set's size by which its list is longer than a single common hash needs.
SPARE = 0.08
#: Classes and shingles of a block, and shingles of the cells that one call of the search takes together, about.
BLOCK, BLOCK_SHINGLES, SHINGLES_TOGETHER = 256, 1 << 20, 1 << 19
#: Hashes that more classes list are hot: classes with one are tied by the rarest hashes of their whole sets instead.
HOT = 256
#: Slots into which hashes are counted before they are shuffled, and how many times the mean, and rows at least, make a slot crowded.
SLOTS, CROWDED, CROWDED_ROWS = 1 << 16, 4, 10_000
#: Parts into which the classes of one hash in a crowded slot are dealt.
SALTS = 64
#: Cost of a step of the heap against one of a binary search: the larger, the fewer lists are long.
MU = 0.01


def listed(n: int) -> tuple[int, int]:
    """How many hashes a set of n lists, and how many of them two linked sets have in common at least."""
    spare = max(1, int(np.ceil(n * SPARE)))
    return min(n, n - (3 * n + 3) // 4 + spare), spare


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: set[int] = set()
        for at in range(0, batch.num_rows, 2000):
            hashes, classes, sizes = [], [], []
            for s in shingle_sets(batch.column("text").slice(at, 2000), WIDTH):
                c = set_id(s)
                if len(s) and c not in seen:
                    seen.add(c)
                    k = listed(len(s))[0]
                    hashes.append(s[:k])
                    classes.append(np.full(k, c))
                    sizes.append(np.full(k, len(s), np.int32))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(sizes))], names=["h", "c", "n"])


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int64)
    for lists in _lists(batches):
        counts += np.bincount(lists.column("h").to_numpy() % SLOTS, minlength=SLOTS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["slot", "m"])


def _crowded(texts: DataFrame, rows: int) -> list[int]:
    """The slots of hashes that are listed much more often than others: at most SLOTS / CROWDED numbers, at any size of the table."""
    counts = texts.mapInArrow(_slot_counts, "slot long, m long").groupBy("slot").agg(F.sum("m").alias("m")).collect()  # a row a slot
    mean = sum(r["m"] for r in counts) / SLOTS
    return sorted(r["slot"] for r in counts if r["m"] > max(CROWDED * mean, rows))


def _shared_lists(texts: DataFrame, rows: int = CROWDED_ROWS) -> DataFrame:
    """h, c, n, df: the hashes that at least two classes list, and how many do.

    The classes of a hash in a crowded slot are dealt into parts, which are counted by themselves and then added up, so that no hash is one task's work.
    """
    lists, crowded = texts.mapInArrow(_lists, "h long, c long, n int"), _crowded(texts, rows)
    if not crowded:
        return lists.repartition("h").dropDuplicates(["h", "c"]).withColumn("df", F.count("*").over(Window.partitionBy("h"))).where("df > 1")
    slots = texts.sparkSession.createDataFrame([(k,) for k in crowded], "slot long")
    dealt = lists.join(F.broadcast(slots), F.pmod("h", F.lit(SLOTS)) == F.col("slot"), "left")
    dealt = dealt.select("h", "c", "n", F.when(F.col("slot").isNotNull(), F.pmod(F.xxhash64("c"), F.lit(SALTS))).otherwise(-1).alias("salt"))
    own = dealt.repartition("h", "salt").dropDuplicates(["h", "salt", "c"]).withColumn("df", F.count("*").over(Window.partitionBy("h", "salt")))
    own = written(own.where("df > 1 or salt >= 0"))
    parts = own.where("salt >= 0").drop("df")
    whole = parts.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    return own.where("salt < 0").select("h", "c", "n", "df").union(parts.join(whole, "h").select("h", "c", "n", "df"))


def _rare_lists(docs: DataFrame) -> DataFrame:
    """h, c, df: the hashes by which classes are tied, after step 2, and how many classes list them."""
    shared = _shared_lists(docs.select("text"))
    spare = F.greatest(F.lit(1), F.ceil(F.col("n") * SPARE))
    of = Window.partitionBy("c")
    # a class lists a share of its own text, so its partition is bounded by the text
    ranked = shared.withColumns({"m": F.count("*").over(of), "rank": F.row_number().over(of.orderBy("df", "h"))})
    return ranked.where((F.col("m") >= spare) & (F.col("rank") <= F.col("m") - spare + 1)).select("h", "c", "df")


def _rarest(sets: DataFrame) -> DataFrame:
    """h, c: of each set (c, shingles) the n - ceil(3n/4) + 1 hashes that fewest of the sets have, without those that only one has.

    Two linked sets have one of these in common, because they share at least three quarters of either.
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("shingles")]
                sizes = np.array([len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(part.column("c").to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes).astype(np.int32))], names=["h", "c", "n"])

    each = written(sets.mapInArrow(lists, "h long, c long, n int"))
    many = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")  # counted before the shuffle, so that no hash is one task's work
    of = Window.partitionBy("c")
    ranked = each.join(many, "h").withColumns({"m": F.count("*").over(of), "rank": F.row_number().over(of.orderBy("df", "h"))})
    return ranked.where(F.col("rank") <= F.col("m") - F.ceil(3 * F.col("n") / 4) + 1).select("h", "c")


def merge_skip(columns: list[list[int]], least: int) -> tuple[list[int], list[int]]:
    """The rows that at least so many of the ascending columns have, and how many, by a heap of the columns' heads.

    A row too few heads show can't be one; then enough others are popped that no row before the next head can be, and all skip to it.
    """
    heap = [(column[0], k, 0) for k, column in enumerate(columns) if column]
    heapify(heap)
    rows, counts = [], []
    while len(heap) >= least:
        row = heap[0][0]
        popped = []
        while heap and heap[0][0] == row:
            popped.append(heappop(heap))
        if len(popped) >= least:
            rows.append(row)
            counts.append(len(popped))
            for _, k, i in popped:
                if i + 1 < len(columns[k]):
                    heappush(heap, (columns[k][i + 1], k, i + 1))
            continue
        while heap and len(popped) < least - 1:
            popped.append(heappop(heap))
        if not heap:
            break
        ahead = max(heap[0][0], row + 1)
        for _, k, i in popped:
            column = columns[k]
            i = bisect_left(column, ahead, i)
            if i < len(column):
                heappush(heap, (column[i], k, i))
    return rows, counts


class _Lists:
    """Inverted lists of sets: for each hash, the rows that have it, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        rows = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.rows = rows[order]
        self.hashes, self.starts = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(flat))

    def search(self, query: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """Rows (of those marked in among) whose Jaccard similarity with the query is at least 0.75, by DivideSkip."""
        n = len(query)
        fit = (4 * self.sizes >= 3 * n) & (3 * self.sizes <= 4 * n)
        if among is not None:
            fit &= among
        if not fit.any():
            return np.empty(0, np.int64)
        need = -(-3 * (n + self.sizes) // 7)
        least = int(need[fit].min())
        at = np.minimum(np.searchsorted(self.hashes, query), len(self.hashes) - 1)
        at = at[self.hashes[at] == query]
        if len(at) < least:
            return np.empty(0, np.int64)
        starts, lengths = self.starts[at], self.ends[at] - self.starts[at]
        order = np.argsort(lengths, kind="stable")
        aside = min(least - 1, int(least / (MU * np.log2(max(2, int(lengths.max()))) + 1)))
        short, long = order[: len(order) - aside], order[len(order) - aside :]
        ends = np.cumsum(lengths[short])
        take = np.arange(int(ends[-1])) + np.repeat(starts[short] - (ends - lengths[short]), lengths[short])
        found = self.rows[take]
        keep = fit[found]
        sizes = np.bincount(np.repeat(np.arange(len(short)), lengths[short])[keep], minlength=len(short))
        flat, cuts = found[keep].tolist(), np.cumsum(sizes).tolist()
        columns = [flat[b - k : b] for b, k in zip(cuts, sizes.tolist(), strict=True) if k]
        some, counts = merge_skip(columns, least - aside)
        rows, got = np.array(some, np.int64), np.array(counts, np.int64)
        rows, got = rows[got >= need[rows] - aside], got[got >= need[rows] - aside]
        for k in long if len(rows) else ():
            column = self.rows[starts[k] : starts[k] + lengths[k]]
            p = np.searchsorted(column, rows)
            got += (p < len(column)) & (column[np.minimum(p, len(column) - 1)] == rows)
        return rows[100 * got >= 75 * (n + self.sizes[rows] - got)]


def _search(rows: pa.Table) -> pa.Table:
    """For each class of each cell, a class that the links of the cell connect it with."""
    order = pa.compute.sort_indices(rows, [("low", "ascending"), ("high", "ascending"), ("c", "ascending")])
    rows = rows.take(order).combine_chunks()
    ids, block, low, high, known = (rows.column(c).to_numpy() for c in ("c", "block", "low", "high", "known"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles").combine_chunks()]
    cuts = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True]]))
    found: list[tuple[int, int]] = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = np.arange(a, b)
        index_of, queries = (own, own) if low[a] == high[a] else (own[block[a:b] == high[a]], own[block[a:b] == low[a]])
        if len(index_of) and len(queries) and len(own) > 1:
            found += _links(ids, known, sets, index_of, queries)
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _links(ids: np.ndarray, known: np.ndarray, sets: list[np.ndarray], index_of: np.ndarray, queries: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what wasn't: known is the group that a class is in already."""
    group_of: dict[int, int] = {}
    for k in np.concatenate([index_of, queries]).tolist():
        group_of[k] = int(known[k])
    members: dict[int, list[int]] = {}
    for k, g in group_of.items():
        members.setdefault(g, []).append(k)
    groups = np.array([group_of[k] for k in index_of.tolist()])
    places = {k: i for i, k in enumerate(index_of.tolist())}
    lists = _Lists([sets[k] for k in index_of])
    found = []
    for q in queries.tolist():
        apart = groups != group_of[q]
        if not apart.any():
            continue
        for y in index_of[lists.search(sets[q], apart)].tolist():
            into, old = group_of[q], group_of[y]
            if into == old:
                continue
            found.append((int(ids[q]), int(ids[y])))
            if len(members[into]) < len(members[old]):
                into, old = old, into
            for k in members.pop(old):
                group_of[k] = into
                members[into].append(k)
                if k in places:
                    groups[places[k]] = into
    return found


def _linked(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of the links found in cells (c, block, other, known, n), with the sets (c, shingles) of their classes."""
    shingles = cells.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-shingles // SHINGLES_TOGETHER))
    rows = sets.hint("merge").join(cells.drop("n").hint("merge"), "c")
    rows = rows.select("c", "known", "block", "shingles", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return rows.withColumn("g", F.pmod(F.xxhash64("low", "high"), F.lit(groups))).groupBy("g").applyInArrow(_search, "a long, b long")


def _groups(rows: DataFrame) -> DataFrame:
    """c, component of every class that links with another; rows: row, text, n, c."""
    classes = rows.where("n > 0").groupBy("c").agg(F.min("row").alias("row"), F.min("n").alias("n"))
    listed_ = written(_rare_lists(rows))

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [s.tobytes() for s in shingle_sets(batch.column("text"), WIDTH)]
        return pa.RecordBatch.from_arrays([batch.column("c"), pa.array(found, pa.binary())], names=["c", "shingles"])

    asked = listed_.select("c").distinct().join(classes, "c").select(F.col("row").alias("_row"))
    texts = rows.select("row", "c", "text").hint("merge").join(asked, F.col("row") == F.col("_row")).select("c", "text")
    sets = written(map_batches(texts, shingles, "c long, shingles binary"))

    hot = listed_.where(F.col("df") > HOT).select("c").distinct()
    rare = written(listed_.where(F.col("df") <= HOT).select("h", "c").union(_rarest(sets.join(hot, "c"))).distinct())
    homes = rare.join(rare.groupBy("h").agg(F.min("c").alias("first")), "h").groupBy("c").agg(F.min("first").alias("home"))
    homes = written(homes.join(classes.drop("row"), "c"))
    sizes = homes.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    blocks = homes.join(sizes, "home")

    # each block by itself, with its home as a guest; homes of several blocks once more, dealt otherwise, so that large groups become connected
    once = blocks.select("c", "n", "home", F.xxhash64("home", F.pmod(F.xxhash64("c"), F.col("parts"))).alias("block"))
    again = blocks.where("parts > 1").select("c", "n", "home", F.xxhash64("home", F.pmod(F.xxhash64("c", F.lit(2)), F.col("parts")), F.lit(2)).alias("block"))
    dealt = written(once.union(again))
    guests = dealt.select("home", "block").distinct().join(homes.select(F.col("c").alias("home"), "n"), "home").select(F.col("home").alias("c"), "n", "block")
    within = dealt.select("c", "n", "block").union(guests).distinct()
    known = written(connected_components(written(_linked(within.withColumns({"other": F.col("block"), "known": F.col("c")}), sets))))

    # then blocks against each other, where something isn't connected yet; these blocks hold one large group each, or small ones whole
    of = homes.join(known, F.col("c") == F.col("node"), "left").select("c", "n", "home", F.coalesce("component", "c").alias("known"))
    parts = F.greatest(F.ceil(F.sum("m") / BLOCK), F.ceil(F.sum("s") / BLOCK_SHINGLES)).alias("parts")
    each = written(of.groupBy("home", "known").agg(F.count("*").alias("m"), F.sum("n").alias("s")).withColumn("large", F.col("m") > BLOCK // 4))
    large = each.where("large").groupBy("home", "known").agg(parts)
    small = each.where("not large").groupBy("home").agg(parts)
    split = F.xxhash64("home", "known", F.pmod(F.xxhash64("c"), F.col("parts")), F.lit(3))
    shared = F.xxhash64("home", F.pmod(F.xxhash64("known"), F.col("parts")), F.lit(4))
    alone = of.join(large.select("home", "known"), ["home", "known"], "left_anti").join(small, "home").select("c", "n", "known", shared.alias("block"))
    of = written(of.join(large, ["home", "known"]).select("c", "n", "known", split.alias("block")).union(alone))
    listed_by = rare.join(of.select("c", "block", "known"), "c")
    open_ = listed_by.groupBy("h").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo <> hi").select("h")
    listed_by = written(listed_by.join(open_, "h"))
    there = listed_by.groupBy("h", "block").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).withColumnRenamed("block", "other")
    visits = listed_by.join(there, "h").where("lo <> known OR hi <> known").select("c", "other").distinct()
    far = written(_linked(written(visits.join(of, "c")), sets))
    if not far.isEmpty():
        known = written(connected_components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(far)))
    return known.withColumnRenamed("node", "c")


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, tuple[str, str, str], DataFrame]:
    """docs with a number, the size and the class of each row, written; the names of these; and c, component_id and the row to keep of each class."""
    names = tuple(free_name(docs, x) for x in ("_row", "_n", "_class"))
    schema = StructType([*docs.schema.fields, *[StructField(x, LongType()) for x in names]])

    def profile(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(text), WIDTH)
        out = batch.append_column(names[1], pa.array([len(s) for s in sets], pa.int64()))
        return out.append_column(names[2], pa.array([set_id(s) for s in sets], pa.int64()))

    rows = written(map_batches(docs.withColumn(names[0], F.monotonically_increasing_id()), profile, schema))
    slim = rows.select(*[F.col(x).alias(y) for x, y in zip((*names, doc_id), ("row", "n", "c", "doc_id"), strict=True)], F.col(text).alias("text"))
    found = _groups(slim)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long").alias("id"), "row")).alias("first")
    classes = slim.where("n > 0").groupBy("c").agg(first).join(found, "c", "left").withColumn("component", F.coalesce("component", "c"))
    best = classes.groupBy("component").agg(F.min("first").alias("best"))
    return rows, names, classes.join(best, "component").select("c", F.col("best.id").alias("component_id"), F.col("best.row").alias("keep"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; a row without shingles is its own component."""
    rows, (_, n, c), classes = _grouped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    named = rows.select("doc_id", F.col(n).alias("n_shingles"), F.when(F.col(n) > 0, F.col(c)).alias("c")).join(classes, "c", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group: that of the smallest id, or of any if none has one; rows without shingles all stay."""
    rows, (row, n, _), classes = _grouped(docs, doc_id, text)
    kept = classes.select("keep").distinct().withColumnRenamed("keep", free_name(rows, "_keep"))
    whole = rows.where(F.col(n) > 0).join(kept, F.col(row) == F.col(kept.columns[0]), "left_semi")
    return whole.unionByName(rows.where(F.col(n) == 0)).select(docs.columns)
