"""Near duplicates where ids repeat or are missing, and the merge of inverted lists."""

import random

import numpy as np
import pytest

from trackspark.llm import ngram_join

WORDS = [f"w{i}" for i in range(40)]
A = " ".join(WORDS)
B = " ".join(reversed(WORDS))


def near(text, *places):
    w = text.split()
    for p in places:
        w[p] = f"other{p}"
    return " ".join(w)


def test_ids_that_repeat_keep_their_links(spark):
    rows = [(1, A), (1, B), (2, near(A, 0)), (3, near(B, 0)), (4, "alone in the world of words here")]
    got = sorted(map(tuple, ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 36, 1), (1, 36, 1), (2, 36, 1), (3, 36, 1), (4, 3, 4)]


def test_rows_without_id_carry_links(spark):
    chain = [A, near(A, 0, 1, 2), near(A, 0, 1, 2, 37, 38, 39)]  # only neighbours link
    for ids, want in (([5, None, 9], [5, 5, 5]), ([None, None, None], [None] * 3)):
        rows = list(zip(ids, chain, strict=True)) + [(None, ""), (77, None)]
        got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted((str(r.component_id) for r in got if r.n_shingles), key=str) == sorted(map(str, want))
        assert {r.component_id for r in got if not r.n_shingles} == {None, 77}


def test_one_of_each_keeps_other_texts_and_columns(spark):
    rows = [(1, A, -5.0, 1, 2), (1, B, 6.0, 1, 2), (2, near(A, 0), 7.0, 1, 2), (None, near(B, 0), 8.0, 1, 2), (None, "", 9.0, 1, 2), (4, "", 9.5, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, _row long, _class int")
    got = sorted(map(tuple, ngram_join.one_of_each(docs).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[4], rows[5]], key=str)
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0
    only = spark.createDataFrame([(None, A), (None, A), (None, near(A, 3))], "doc_id long, text string")
    assert ngram_join.one_of_each(only).count() == 1


@pytest.mark.parametrize("seed", range(30))
def test_heap_merge_counts_like_a_full_count(seed):
    rnd = random.Random(seed)
    columns = [sorted(rnd.sample(range(60), rnd.randint(0, 40))) for _ in range(rnd.randint(1, 12))]
    for least in range(1, len(columns) + 1):
        want = {r: n for r in range(60) if (n := sum(r in c for c in columns)) >= least}
        assert dict(zip(*ngram_join.merge_skip(columns, least), strict=True)) == want


def test_search_equals_brute_force():
    rnd = np.random.default_rng(1)
    base = [np.unique(rnd.integers(0, 1 << 60, 200).astype(np.uint64)) for _ in range(3)]
    sets = []
    for k in range(120):
        b = base[k % 3]
        keep = b[rnd.random(len(b)) > rnd.choice([0.02, 0.1, 0.2])]
        sets.append(np.unique(np.concatenate([keep, rnd.integers(0, 1 << 60, int(rnd.integers(0, 30))).astype(np.uint64)])))
    lists = ngram_join._Lists(sets)
    some = rnd.random(len(sets)) < 0.5
    for q in sets:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))]
        assert sorted(lists.search(q).tolist()) == want
        assert sorted(lists.search(q, some).tolist()) == [i for i in want if some[i]]


def test_large_groups_of_near_copies_are_connected(spark):
    rnd = random.Random(2)
    rows = [(i, near(A, *rnd.sample(range(40), rnd.choice([0, 1])))) for i in range(900)] + [(1000 + i, near(A, i % 40) + f" tail{i} end{i}") for i in range(700)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_hashes_of_crowded_slots_are_counted_in_parts(spark):
    rng = random.Random(3)
    rows = [(" ".join(WORDS[:20]) + " " + " ".join(f"v{rng.randrange(300)}" for _ in range(12)),) for _ in range(400)]
    texts = spark.createDataFrame(rows + rows[:50] + [(None,), ("",)], "text string").repartition(4)
    plain = ngram_join._shared_lists(texts)
    want = sorted(map(tuple, plain.collect()))
    assert max(r[3] for r in want) > 100 and len(ngram_join._crowded(texts, 100)) < 40
    for rows in (100, 0):  # the shared passage's slots, then every slot
        dealt = ngram_join._shared_lists(texts, rows)
        assert "salt" in dealt._jdf.queryExecution().toString() and "salt" not in plain._jdf.queryExecution().toString()
        assert sorted(map(tuple, dealt.collect())) == want
    assert ngram_join._shared_lists(texts.limit(0), 0).count() == 0


def test_groups_are_the_same_when_slots_are_crowded(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, near(A, *rng.sample(range(40), rng.randrange(4)))) for i in range(120)] + [(200 + i, near(B, i % 40)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(map(tuple, ngram_join.near_duplicates(docs).collect()))
    monkeypatch.setattr(ngram_join._shared_lists, "__defaults__", (0,))
    assert sorted(map(tuple, ngram_join.near_duplicates(docs).collect())) == want
