"""The cheapest repair is that of an exhaustive search, and of the SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from trackspark.llm import conversation_repair as C
from trackspark.llm.queries import ORACLE_SQL, QUERIES


def exhaustive(rows):
    """rows of (role, text, doomed, truncated): least (cost, audit), and its turns, over all edit sequences with up to two turns put in at a place."""
    best = None
    n = len(rows)
    inserts = [()] + [(a,) for a in ("user", "assistant")] + [(a, b) for a in ("user", "assistant") for b in ("user", "assistant")]
    for puts in itertools.product(inserts, repeat=n + 1):
        if sum(map(len, puts)) > 2:
            continue
        for acts in itertools.product(("D", "K", "u", "a"), repeat=n):
            cost, audit, out = 0, "", []
            for k in range(n + 1):
                for r in puts[k]:
                    cost, audit, out = cost + 5, audit + "I", [*out, (r, "")]
                if k == n:
                    break
                role, text, doomed, cut = rows[k]
                if acts[k] == "D":
                    cost, audit = cost + 2, audit + "D"
                    continue
                if doomed:
                    cost = 10**9
                    break
                new = {"K": role, "u": "user", "a": "assistant"}[acts[k]]
                cost, audit, out = cost + (acts[k] != "K") + 5 * cut, audit + ("K" if acts[k] == "K" else "R"), [*out, (new, text)]
            if cost < 10**9 and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def parsed(rows, grammar=C.GRAMMAR, look=None):
    p, out = C.Parse(C.Automaton(grammar)), []
    if look:
        p.next_look = look
    for r in rows:
        out += p.push(*r)
        if look:
            p.next_look = p.n + look
    cost, audit, rest = p.finish()
    return cost, audit, [(r, t) for _, r, t in out + rest]


@pytest.mark.parametrize("look", [None, 1])
def test_least_repair_by_exhaustive_search(look):
    rnd = random.Random(4)
    for _ in range(25):
        rows = [(rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", " "]), f"t{i}", rnd.random() < 0.2, rnd.random() < 0.3) for i in range(rnd.randint(0, 4))]
        assert parsed(rows, look=look) == exhaustive(rows)


def by_states(rows):
    """A plain dynamic program over the four states of the pattern, for longer conversations."""
    go = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    tops = {0: (0, "", ())}

    def put(d, k, v):
        if k not in d or v[:2] < d[k][:2]:
            d[k] = v

    def filled(d):
        for _ in range(3):
            for s, (c, a, o) in list(d.items()):
                for r in ("user", "assistant"):
                    if (t := go.get((s, r[0]))) is not None:
                        put(d, t, (c + 5, a + "I", (*o, (r, ""))))
        return d

    for role, text, doomed, cut in rows:
        new = {}
        for s, (c, a, o) in filled(tops).items():
            put(new, s, (c + 2, a + "D", o))
            if not doomed:
                for edit, r, more in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if (t := go.get((s, r[:1]))) is not None:
                        put(new, t, (c + more + 5 * cut, a + edit, (*o, (r, text))))
        tops = new
    c, a, o = min((v for s, v in filled(tops).items() if s in (0, 3)), key=lambda v: v[:2])
    return c, a, list(o)


@pytest.mark.parametrize("look", [None, 1, 7])
def test_long_conversations(look):
    rnd = random.Random(8)
    for _ in range(30):
        rows = [(rnd.choice(["user", "assistant", "system", "tool"]), f"t{i}", rnd.random() < 0.1, rnd.random() < 0.3) for i in range(rnd.randint(0, 200))]
        assert parsed(rows, look=look) == by_states(rows)


def test_the_parse_holds_little():
    p = C.Parse(C.Automaton(C.GRAMMAR))
    for i in range(20_000):
        p.push(("user", "assistant")[i % 2] if i % 11 else "system", "x", False, False)
    assert len(p.rows) < 2000 and len(p.tops) <= 10 and max(len(x[1]) for x in p.tops.values()) < 2000


def test_another_grammar():
    only = (("C", ""), ("C", "Cu"))
    assert parsed([("user", "a", False, False), ("assistant", "b", False, False), ("user", "c", True, False)], only) == (3, "KRD", [("user", "a"), ("user", "b")])


WHITE = " \t\n\x0b\f\r"


def answers(rows):
    """The query's rows for (conv_id, turn, role, text), by hand."""
    out = {}
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        out.setdefault(c, []).extend([] if h == 0 else [(t, "user" if h == 4 else r, x)] * (2 if h == 3 else 1))
    for c, got in out.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, n, listed = set(), [0, 0, 0], []
        for _, r, x in got:
            end = x.rstrip(WHITE)
            fault = 0 if not end else 1 if (r, x) in seen else 2 if end[-1] not in ".!?" else None
            seen.add((r, x))
            if fault is not None:
                n[fault] += 1
            listed.append((r, x, fault in (0, 1), fault == 2))
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(got))
        turns = {t for t, _, _ in got if t is not None}
        cost, audit, said = by_states(listed)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        yield (c, gaps, *n, bad, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest())


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("d", ["sf0.001", "sf0.01"])
def test_query_sql_and_plain_rows_agree(spark, d):
    d = f"/root/testdata/{d}"
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = QUERIES["op13_conversation_repair"](spark, d)
    assert got.columns == COLUMNS
    found = sorted(tuple(r) for r in got.collect())
    assert found == sorted(answers([tuple(r) for r in rows.collect()]))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    c = con.execute(ORACLE_SQL["op13_conversation_repair"])
    assert [x[0] for x in c.description] == COLUMNS and sorted(c.fetchall()) == found


def test_odd_rows(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "", "tool"]), rnd.choice(["Yes.", "no", None, "", " \n", "What?\t", "x" * 5000 + "!"])) for c in [*range(40), None] for t in [None, 1, 1, 2, 3, 5, 9]]
    rows += [(100, 3, "user", "only one that goes.")] + rows[:20]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, _turn int, Audit string").repartition(5)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(answers(rows), key=key)
    assert sorted(map(tuple, got), key=key) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(ORACLE_SQL["op13_conversation_repair"]).fetchall(), key=key) == want
    turns = C.repaired_turns(C.damaged(df), there="there").collect()
    by = {}
    for r in sorted(turns, key=lambda r: r.turn):
        by.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(by.get(w[0], [])).encode()).hexdigest() == w[8] for w in want)
    assert C.repair(df.limit(0)).count() == 0 and C.repaired_turns(df.limit(0)).count() == 0
    assert [tuple(r)[1:8] for r in C.repair(df.limit(1).selectExpr("'k' AS conv_id", "turn", "role", "text", "false AS here"), there="here").collect()] == [(0, 0, 0, 0, 0, 0, "")]
