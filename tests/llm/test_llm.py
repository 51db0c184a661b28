"""The operators for training corpora against brute force, round trips and planted cases, with the awkward inputs each must take."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("trackspark.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from trackspark.llm import additive, byte_bpe, chat, components, fingerprint, html_extract, labelled_pages, language, ngram_join, packing, quality, queries, warc  # noqa: E402
from trackspark.llm.shingles import set_id, shingle_sets  # noqa: E402
from trackspark.llm.word_tokens import WordTokens  # noqa: E402

TIK, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORD = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   ", "a", "one two", "A b\tC d\n e f", "x" * 300_000, "word " * 40_000, "日本語 テキスト é", "it's 'tis I'LL", "a b", "&&& ###"]


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if i % 3 == 0 else "s", 0) for i, t in enumerate(ODD)] + [(3, "a", "en", "s", 0), (None, "no id here at all", None, "s", 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# shingles
def test_shingles_are_sets_of_words():
    sets = shingle_sets(pa.array(ODD))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in ODD]
    assert set_id(shingle_sets(pa.array(["a  B c"]))[0]) == set_id(shingle_sets(pa.array(["A b C"]))[0]) != set_id(shingle_sets(pa.array(["a b"]))[0])


# 1
def test_html_held_out_pages():
    field = html_extract.train(400)
    right = total = 0
    for page, truth in labelled_pages.labelled_pages(60, 77):
        got = field.extract(page)
        for text, article in truth:
            shown = " ".join(text.replace("&amp;", "&").split())
            if len(shown) > 40:
                total += 1
                right += (shown in got) == article
    assert right / total > 0.95
    assert field.extract(None) == field.extract("") == field.extract("<nav><a href=x>Home</a></nav>") == ""
    assert "x y" in field.extract("<body><article><p>A paragraph with <b>bold</b> words, x&nbsp;y &amp; more of it.</p><p>Next one is cut <a hre")


def test_html_keeps_rows(spark):
    d = spark.createDataFrame([(1, "u", None, 5), (1, "u", None, 5), (2, None, "<article><p>Some words of an article, here.</p></article>", 6)], "page_id long, url string, html string, text_length int")
    out = html_extract.extract(d, html_extract.train(200)).collect()
    assert sorted(r.text for r in out) == ["", "", "Some words of an article, here."] and out[0].text_length == 5


# 2
def test_packing_covers_every_token(spark, odd, empty):
    tokens = packing.tokenize(odd, WORD)
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    tok = WordTokens.load(WORD).tokenizer
    want = collections.Counter((i, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in texts)
    assert collections.Counter((r.doc_id, zlib.crc32(bytes(r.ids))) for r in tokens.collect()) == want
    pieces = packing.pack(tokens, 128, {None: 1.0, "s": 3.0}).collect()
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in pieces) == tokens.agg(F.sum("n")).first()[0]
    for k, v in by.items():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at == 128 or k == max(by)
    assert packing.pack(packing.tokenize(empty, WORD)).count() == 0


# 3
def test_bpe_is_that_of_the_whole_text(spark, odd, empty):
    import tiktoken

    with open(TIK, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBpe.load(TIK, PATTERN)
    rnd = random.Random(5)
    parts = ["abc", "The ", " ", "  ", "\n", "'s", "'ll", "日本語", "é", "123", "...", "\t", "a", "x" * 40, " \n ", "🙂", "_"]
    for _ in range(400):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))
        for leaf in (1, 5, 17):
            assert bpe.encode(t, leaf) == enc.encode_ordinary(t)
    for t in ("ab" * 20_000, " " * 9000 + "x", "".join(rnd.choice("etaoin") for _ in range(30_000))):
        assert bpe.encode(t, 512) == enc.encode_ordinary(t)
    back = byte_bpe.decode(byte_bpe.encode(odd, TIK, PATTERN), TIK, PATTERN)
    assert collections.Counter((r.doc_id, bytes(r.bytes)) for r in back.collect()) == collections.Counter((r.doc_id, (r.text or "").encode()) for r in odd.collect())
    assert byte_bpe.encode(empty, TIK, PATTERN).count() == 0


# 4
def test_warc_round_trip(spark):
    body = "<p>" + "long enough to be revisited " * 9 + "</p>"
    rows = [(5, "u5", body), (2, "u2", body), (9, None, body), (9, None, body), (1, "u\r\nx", "short"), (3, "u3", "short"), (4, "u", None), (None, "n", body), (7, "é", "é" * 80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages).collect()), key=str)
    want = [(5, "revisit", 2, len(body)), (2, "response", None, len(body)), (9, "revisit", 2, len(body)), (9, "revisit", 2, len(body)), (1, "response", None, 5), (3, "response", None, 5), (4, "response", None, 0), (None, "response", None, len(body)), (7, "response", None, 160)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_files_repeat_and_roll(spark, tmp_path):
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), F.sha2(F.col("id").cast("string"), 512), F.lit("</p>")).alias("html"))
    a = warc.write_archives(pages, f"file://{tmp_path}/a", file_bytes=4000, rows=25).orderBy("file").collect()
    b = warc.write_archives(pages.repartition(3), f"file://{tmp_path}/b", file_bytes=4000, rows=25).orderBy("file").collect()
    assert a == b and len(a) > 3 and sum(r.records for r in a) == 60


# 5
def test_language_learns_families_then_members(spark, empty):
    rnd = random.Random(2)
    voc = {"en": "the and of with house river", "de": "der und nicht schule wasser straße", "fr": "le une être école rivière très", "es": "el una niño río está mañana", "fi": "ja on talo vesi joki ehkä"}
    rows = [(i, " ".join(rnd.choice(voc[c].split()) for _ in range(30)), c, "s", 0) for i, c in enumerate(sorted(voc) * 30)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[i].lang_pred == c and 0 <= got[i].score <= 1 for i, _, c, _, _ in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "River Of The HOUSE")], "doc_id long, text string")
    assert [r.lang_pred for r in language.identify(odd, model).orderBy("doc_id").collect()] == ["und", "und", "und", "en"]
    assert language.fit(empty) is None and language.identify(odd, None).where("lang_pred <> 'und'").count() == 0


# 6
def test_quality_ranks(spark, empty, odd):
    rnd = random.Random(4)
    good = [" ".join(rnd.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) for _ in range(rnd.randint(5, 60))) + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in t.split()) for t in good[:30]]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(good + bad)], DOCS)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(180)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((got[i] >= quality.CUT) == (i < 150) for i in got)
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    assert quality.score(odd, quality.fit(empty, labels)).select("score").distinct().count() == 1


# 7
def brute_components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    up = {k: k for k in range(len(sets))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 75 * len(x | y):
                up[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        groups[root(k)].append(i)
    return sorted((i, len(shingles(t)), min(groups[root(k)])) for k, (i, t) in enumerate(docs))


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(8)
    voc = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(voc) for _ in range(50)]
    docs = []
    for g in range(25):
        base = [rnd.choice(voc) for _ in range(rnd.choice([4, 6, 12, 40, 120, 300]))]
        for _ in range(rnd.choice([1, 2, 6, 14])):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                k = rnd.randrange(len(w))
                w[k : k + rnd.choice([1, 1, 2])] = [rnd.choice(voc)] * rnd.choice([0, 1, 1, 2])
            if rnd.random() < 0.2:
                w = w[: rnd.randint(len(w) * 3 // 4, len(w))] + passage[: rnd.randint(0, 50)]
            docs.append(" ".join(w))
    docs += [" ".join([rnd.choice(voc) for _ in range(rnd.randint(8, 30))] + passage) for _ in range(40)]
    docs += [docs[0]] * 30 + ["", "", None, "A b", "a  B"]
    rows = list(enumerate(docs))
    rnd.shuffle(rows)
    got = ngram_join.near_duplicates(spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_components(sorted(rows, key=lambda r: r[0]))


def test_lists_guarantee_a_common_hash():
    for n in range(1, 250):
        for m in range(-(-3 * n // 4), n + 1):
            need = -(-3 * (n + m) // 7)
            (pn, ln), (pm, lm) = ngram_join.listed(n), ngram_join.listed(m)
            assert need > m or min(need - (n - pn), need - (m - pm)) >= max(ln, lm)


def test_near_duplicates_take_odd_rows(spark, odd, empty):
    assert ngram_join.near_duplicates(odd).count() == odd.count()
    assert ngram_join.near_duplicates(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(e).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[100 + k] == 100 for k in range(50))


# 8
def test_chat_perspectives(spark):
    rows = [(1, 2, "bob", "hi"), (1, 1, "ann", "yo"), (1, 0, "system", "rules"), (1, 3, None, None), (2, 0, "system", "alone"), (None, 0, "ann", "x")]
    got = {(r.conversation, r.speaker): r for r in chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    r = got[1, "ann"]
    assert r.rendered.startswith("<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user name=bob\nhi")
    assert [r.rendered[s.start : s.end] for s in r.mask_spans] == ["yo<|im_end|>"] and r.trained_chars == 12


# 9
def test_search_recall_and_exact_scores(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(1500, 16)).astype(float)
    x[700:720] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (5400, [1.0])]
    got = additive.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, rows=400, queries=4).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 100))
    hits = 0
    for q, v in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        hits += len(set(best) & {i for _, i, _ in v})
        assert all(abs(d[i] - s) < 1e-12 for _, i, s in v) and [k for k, _, _ in sorted(v)] == list(range(1, 11))
    assert hits / (10 * len(by)) >= 0.9
    assert [i for _, i, _ in sorted(by[0])] == list(range(700, 710))
    small = additive.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in small][0][0] == 1 and len(small) == 2
    assert additive.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


# 10
def test_fingerprints_follow_the_contract(spark):
    texts = {4: "a b c d e f g h", 7: None, 9: "x y z " * 50, 12: "", 15: "é" * 10}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprint_with_edits(docs).collect()}
    ids = sorted(texts)
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        t, other = texts[i] or "", texts[nxt] or ""
        q = len(t) // 4
        changed = t[: len(t) - q] + other[:q] if q else t
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = shingles(t), shingles(changed), shingles(other)
        assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert got[i].near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
    ranged = fingerprint.followed(docs, 2).count()
    assert ranged > len(texts)
    assert fingerprint.fingerprint_with_edits(docs.limit(0)).count() == 0


def test_sketches_merge_and_estimate(spark):
    rnd = random.Random(1)
    w = [f"t{i}" for i in range(3000)]
    a = " ".join(rnd.choice(w) for _ in range(2000))
    b = " ".join(a.split()[:1000] + [rnd.choice(w) for _ in range(1000)])
    d = fingerprint.sketch(spark.createDataFrame([(1, a), (1, b), (2, None)], "g int, text string"))
    m = {r.g: r.sketch for r in fingerprint.merge_sketches(d, ["g"]).collect()}
    union = sorted(set().union(*[r.sketch for r in d.where("g = 1").collect()]))[: fingerprint.K]
    assert m[1] == union and m[2] == []
    s = d.where("g = 1").select("text", "sketch").collect()
    pair = spark.createDataFrame([(s[0].sketch, s[1].sketch)], "a array<long>, b array<long>")
    r = pair.select(fingerprint.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.distinct_shingles(F.col("a")).alias("n")).first()
    x, y = shingles(s[0].text), shingles(s[1].text)
    assert abs(r.j - len(x & y) / len(x | y)) < 0.15 and abs(r.c - len(x & y) / len(x)) < 0.2 and abs(r.n / len(x) - 1) < 0.3


def test_range_followers_across_partitions(spark):
    docs = spark.range(500).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text")).repartition(7)
    got = fingerprint.fingerprint_with_edits(docs)
    assert got.count() == 500
    rows = {r.doc_id: r for r in got.collect()}
    for i in range(500):
        t, o = f"text number {i}", f"text number {(i + 1) % 500}"
        q = len(t) // 4
        assert rows[i * 3].edited_sha256 == hashlib.sha256((t[: len(t) - q] + o[:q]).encode()).hexdigest()


def test_queries_have_names_of_their_operators():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
