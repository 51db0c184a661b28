"""Repair of conversations by a generalised LR parse with edits.

The initials of the roles of a repaired conversation are a sentence of a grammar (by default: nothing, or a system turn at most and then turns of user and assistant by
turns). The rows of a conversation are read once. The stacks of an LR(0) automaton of the grammar are one graph: a node is a state on top of a node below
it and equal ones are the same node, so stacks share what they have in common, and of two ways to the same top only the one with the least
(cost, audit) goes on. Each row is kept, gets another role, or goes; rows may be put in anywhere. Reductions cost nothing.

Rows come by one exchange on the conversation, sorted, and are streamed: the parse holds the open tops and the rows on which they don't agree yet, not the
conversation. What all tops have in common is settled, and goes into the digest at once.

Costs: keep 0, another role 1, delete 2, put in an empty turn 5; a truncated row that isn't deleted adds 5. Blank and duplicate rows must be deleted. The audit
is the edits' initials in order (K, R, D, I); of equal costs the least audit counts.

Defined cases: a null role or text is one space, which is blank as a text and no role of the grammar; rows without a conversation id are one conversation; null turns
come first; rows of one turn are in order of role, then text; repeated rows are duplicates; a conversation of which no row is there has zeros, an empty
audit and the digest of the empty string; texts of any length count whole; an empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: (s?(ua)+)? as productions, the start symbol first; small letters are initials of roles.
GRAMMAR = (("C", ""), ("C", "P"), ("P", "Ua"), ("U", "u"), ("U", "su"), ("U", "Pu"))
#: Roles that a row may get, and that may be put in.
ROLES = ("user", "assistant")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What any top of the default grammar costs more at most than another in what follows: two turns put in, and a system turn deleted that the other keeps. A top that is
#: dearer than that beyond the cheapest is never part of the cheapest repair.
SLACK = 2 * INSERT + DELETE
SPACE = " \t\n\x0b\f\r"


class Automaton:
    """LR(0) states of a grammar: go[state][symbol] is a state, ends[state] the productions that are complete in it."""

    def __init__(self, grammar: Sequence[tuple[str, str]]):
        rules = [("", grammar[0][0]), *grammar]

        def closed(items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            todo, done = list(items), set(items)
            while todo:
                r, dot = todo.pop()
                for k, (head, body) in enumerate(rules):
                    if dot < len(rules[r][1]) and rules[r][1][dot] == head and (k, 0) not in done:
                        done.add((k, 0))
                        todo.append((k, 0))
            return frozenset(done)

        self.start = grammar[0][0]
        self.slack = SLACK if tuple(grammar) == GRAMMAR else None
        states, self.go, self.ends = [closed({(0, 0)})], [], []
        for state in states:
            moves: dict[str, set[tuple[int, int]]] = {}
            for r, dot in state:
                if dot < len(rules[r][1]):
                    moves.setdefault(rules[r][1][dot], set()).add((r, dot + 1))
            self.go.append({})
            for symbol, items in sorted(moves.items()):
                target = closed(items)
                if target not in states:
                    states.append(target)
                self.go[-1][symbol] = states.index(target)
            self.ends.append([(rules[r][0], len(rules[r][1])) for r, dot in sorted(state) if dot == len(rules[r][1])])


class Parse:
    """One conversation: rows are pushed, settled edits come out as (action, role, text) of the turns that stay."""

    def __init__(self, automaton: Automaton):
        self.auto = automaton
        self.nodes: dict[tuple, tuple] = {}
        root = self._node(0, None)
        #: Open tops, each with (cost, audit since what is settled, edits as (edits before, (action, row, role))).
        self.tops: dict[tuple, tuple] = self._reduced({root: (0, "", None)})
        self.rows: dict[int, tuple[str, str]] = {}
        self.n, self.settled, self.next_look = 0, "", 64

    def _node(self, state: int, below: tuple | None) -> tuple:
        key = (state, id(below))
        if key not in self.nodes:
            self.nodes[key] = (state, below)
        return self.nodes[key]

    def _put(self, tops: dict, node: tuple, path: tuple) -> bool:
        old = tops.get(node)
        if old is None or path[:2] < old[:2]:
            tops[node] = path
            return True
        return False

    def _reduced(self, tops: dict) -> dict:
        """The tops, and those that reductions lead to."""
        todo = list(tops)
        while todo:
            node = todo.pop()
            for head, n in self.auto.ends[node[0]]:
                if not head:
                    continue
                below = node
                for _ in range(n):
                    below = below[1]
                made = self._node(self.auto.go[below[0]][head], below)
                if self._put(tops, made, tops[node]):
                    todo.append(made)
        return tops

    def _shifted(self, tops: dict, out: dict, initial: str, cost: int, edit: tuple) -> bool:
        new = {}
        for node, (spent, audit, before) in tops.items():
            target = self.auto.go[node[0]].get(initial)
            if target is not None:
                self._put(new, self._node(target, node), (spent + cost, audit + edit[0], (before, edit)))
        better = False
        for node, path in self._reduced(new).items():
            better |= self._put(out, node, path)
        return better

    def _inserted(self) -> None:
        """Tops after any number of turns put in; each way to a top costs more the longer it is, so this ends."""
        fresh = dict(self.tops)
        while fresh:
            before = dict(self.tops)
            for role in ROLES:
                self._shifted(fresh, self.tops, role[0], INSERT, ("I", -1, role))
            fresh = {k: v for k, v in self.tops.items() if before.get(k) is not v}

    def push(self, role: str, text: str, doomed: bool, truncated: bool) -> list[tuple[str, str, str]]:
        self._inserted()
        i, more = self.n, TRUNCATED if truncated else 0
        self.n += 1
        new = {node: (cost + DELETE, audit + "D", (before, ("D", i, None))) for node, (cost, audit, before) in self.tops.items()}
        if not doomed:
            self.rows[i] = (role, text)
            if role:
                self._shifted(self.tops, new, role[0], more, ("K", i, role))
            for other in ROLES:
                self._shifted(self.tops, new, other[0], REROLE + more, ("R", i, other))
        if self.auto.slack is not None:
            most = min(p[0] for p in new.values()) + self.auto.slack
            new = {node: p for node, p in new.items() if p[0] <= most}
        self.tops = new
        if self.n < self.next_look:
            return []
        done = self._settle()
        self.next_look = self.n + max(64, *(len(p[1]) for p in self.tops.values()))
        return done

    def _settle(self) -> list[tuple[str, str, str]]:
        """Edits that all open tops share."""
        paths = []
        for _, _, edits in self.tops.values():
            way = []
            while edits is not None:
                edits, edit = edits
                way.append(edit)
            paths.append(way[::-1])
        same = 0
        while all(len(p) > same and p[same] == paths[0][same] for p in paths):
            same += 1
        done = self._turns(paths[0][:same])
        self.settled += "".join(e[0] for e in paths[0][:same])
        for (node, (cost, audit, _)), way in zip(list(self.tops.items()), paths, strict=True):
            edits = None
            for e in way[same:]:
                edits = (edits, e)
            self.tops[node] = (cost, audit[same:], edits)
        kept = {e[1] for p in paths for e in p[same:]}
        self.rows = {i: r for i, r in self.rows.items() if i in kept}
        return done

    def _turns(self, edits: list[tuple]) -> list[tuple[str, str, str]]:
        return [(a, role, "" if a == "I" else self.rows[i][1]) for a, i, role in edits if a != "D"]

    def finish(self) -> tuple[int, str, list[tuple[str, str, str]]]:
        """Cost, audit, and the edits not settled before."""
        self._inserted()
        # a complete sentence is the start symbol on the root
        whole = self.auto.go[0][self.auto.start]
        cost, audit, edits = min((p for node, p in self.tops.items() if node[1] is not None and node[1][1] is None and node[0] == whole), key=lambda p: p[:2])
        self.tops = {None: (cost, audit, edits)}
        return cost, self.settled + audit, self._settle()


def _faults(rows: DataFrame) -> DataFrame:
    """rows with blank, duplicate, truncated (the first fault counts) and illegal: the row before and this one don't follow each other."""
    order = [F.col("_turn").asc_nulls_first(), "_role", "_text"]
    end = F.rtrim(F.col("_text"), F.lit(SPACE))
    seen = F.row_number().over(Window.partitionBy("_conv", "_there", "_role", "_text").orderBy(F.col("_turn").asc_nulls_first())) > 1
    blank = end == ""
    d = rows.withColumns({"_blank": blank, "_seen": seen})
    pair = F.concat(F.lag(F.substring("_role", 1, 1)).over(Window.partitionBy("_conv", "_there").orderBy(*order)), F.substring("_role", 1, 1))
    return d.withColumns({
        "_duplicate": ~F.col("_blank") & F.col("_seen"),
        "_truncated": ~F.col("_blank") & ~F.col("_seen") & ~F.substring(end, -1, 1).isin(".", "!", "?"),
        "_illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)),
    })


RESULT = [("gaps", LongType()), ("blank", LongType()), ("duplicate", LongType()), ("truncated", LongType()), ("illegal", LongType()), ("cost", LongType()), ("audit", StringType()), ("repaired_sha256", StringType())]


def _ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str, there: str | Column | None) -> DataFrame:
    exists = F.lit(True) if there is None else F.coalesce(F.col(there) if isinstance(there, str) else there, F.lit(False))
    rows = turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(role, F.lit(" ")).alias("_role"), F.coalesce(text, F.lit(" ")).alias("_text"), exists.alias("_there"))
    d = _faults(rows.repartition("_conv"))
    return d.sortWithinPartitions(F.col("_conv").asc_nulls_first(), F.col("_turn").asc_nulls_first(), "_role", "_text")


def _parsed(batches: Iterator[pa.RecordBatch], automaton: Automaton) -> Iterator[tuple]:
    """For each row of sorted rows: (conversation's value, its first row or not, settled turns, row); at the end of a conversation (value, totals)."""
    parse, value, new = None, None, True
    for batch in batches:
        ids, columns = batch.column("_conv"), [batch.column(c).to_pylist() for c in ("_turn", "_role", "_text", "_there", "_blank", "_duplicate", "_truncated", "_illegal")]
        for k, row in zip(ids, zip(*columns, strict=True), strict=True):
            k = k.as_py()
            if new or k != value:
                if parse is not None:
                    yield value, None, parse.finish()
                parse, value, new = Parse(automaton), k, False
            _, role, text, there, blank, duplicate, truncated, _ = row
            yield value, row, parse.push(role, text, blank or duplicate, truncated) if there else []
    if parse is not None:
        yield value, None, parse.finish()


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str | Column | None = None, grammar: Sequence[tuple[str, str]] = GRAMMAR) -> DataFrame:
    """One row a conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of its turns as `role:text`, joined by newlines.

    there: a boolean, false for rows that are lost, which count for nothing but that their conversation has a result.
    """
    d = _ordered(turns, conv, turn, role, text, there)
    schema = StructType([StructField(conv, d.schema["_conv"].dataType), *[StructField(n, t) for n, t in RESULT]])
    kind = d.schema["_conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        automaton, out = Automaton(grammar), []
        fresh = lambda: (hashlib.sha256(), [0] * 4, [None, None, 0, None], [0])
        digest, counts, span, written = fresh()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * (1 + len(RESULT))
            kinds = [to_arrow_type(kind), *[to_arrow_type(t) for _, t in RESULT]]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

        def add(turns_: list[tuple[str, str, str]]) -> None:
            for _, r, t in turns_:
                digest.update(("\n" if written[0] else "").encode() + f"{r}:{t}".encode())
                written[0] += 1

        for value, row, made in _parsed(batches, automaton):
            if row is not None:
                add(made)
                at, _, _, exists, *flags = row
                if exists:
                    for i, flag in enumerate(flags):
                        counts[i] += flag
                    if at is not None and at != span[3]:  # turns are sorted: a new one
                        span[:] = [at if span[0] is None else span[0], at, span[2] + 1, at]
                continue
            cost, audit, rest = made
            add(rest)
            gaps = span[1] - span[0] + 1 - span[2] if span[2] else 0
            out.append((value, gaps, *counts, cost, audit, digest.hexdigest()))
            digest, counts, span, written = fresh()
            if len(out) >= 2000:
                yield batch()
                out.clear()
        yield batch()

    return d.mapInArrow(run, schema)


def repaired_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str | Column | None = None, grammar: Sequence[tuple[str, str]] = GRAMMAR) -> DataFrame:
    """The repaired conversations: conv, turn (from 0), role, text, action (K, R or I), a row a turn that stays or was put in."""
    d = _ordered(turns, conv, turn, role, text, there)
    schema = StructType([StructField(conv, d.schema["_conv"].dataType), StructField(turn, LongType()), StructField(role, StringType()), StructField(text, StringType()), StructField("action", StringType())])
    kind = d.schema["_conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        automaton, n, out = Automaton(grammar), 0, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

        for value, row, made in _parsed(batches, automaton):
            for action, r, t in made if row is not None else made[2]:
                out.append((value, n, r, t, action))
                n += 1
            if row is None:
                n = 0
            if len(out) >= 2000:
                yield batch()
                out.clear()
        yield batch()

    return d.mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: rows damaged by crc32(conv_id:turn) % 20, nulls as one space in it.

    0 drops the row (there is false), 1 empties the text, 2 takes its . ! ? away, 3 repeats the row, 4 sets the role user.
    """
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    d = turns.select("conv_id", "turn", words[2].alias("role"), words[3].alias("text"), (F.crc32(F.concat_ws(":", words[0], words[1]).cast("binary")) % 20).alias("_h"))
    h = F.col("_h")
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (h != 0).alias("there"), copies.alias("_copy")).drop("_copy")
