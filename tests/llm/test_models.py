"""The trained operators against plain versions of their parts, their bounds, and the awkward inputs they must take."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackspark.llm import folds, html_extract, labelled_pages, language, quality
from trackspark.llm.html_blocks import leaf_blocks

ODD = [None, "", "  ", "a", "ÄÖÜ äöü ß", "Tabs\tand\nlines\nand\nlines", "A B a b", "| x | y |", "日本語 テキスト", "x" * 70_000, "the cat sat. " * 9_000, "1234 5678"]


# 1
def test_viterbi_finds_the_best_of_all_labels():
    rnd = random.Random(1)
    for _ in range(60):
        field = html_extract.Field({}, np.array([[rnd.gauss(0, 2) for _ in "ab"] for _ in "ab"]), rnd.gauss(0, 2))
        scores = [rnd.gauss(0, 2) for _ in range(rnd.randint(1, 8))]

        def worth(labels, field=field, scores=scores):
            return field.start * labels[0] + sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(field.pairs[a, b] for a, b in itertools.pairwise(labels))

        best = max(worth(y) for y in itertools.product((0, 1), repeat=len(scores)))
        assert worth(field.decode(scores)) == pytest.approx(best)


def test_fit_raises_the_likelihood_of_the_labels():
    """The probability of the labels among all labelings, by enumeration, on pages of a few blocks."""
    pages = [p for p in labelled_pages.labelled_pages(300, 5) if 1 < len(leaf_blocks(p[0])) < 11]
    fitted, barely = html_extract.fit(pages, rounds=120), html_extract.fit(pages, rounds=1)

    def log_likelihood(field):
        total = 0.0
        for page, truth in pages[:12]:
            blocks = leaf_blocks(page)
            weigh = lambda x: field.weights.get(x, 0.0)
            scores, previous = [], 0
            for b in blocks:
                from trackspark.llm.html_blocks import names_of

                scores.append(sum(map(weigh, names_of(b, previous))))
                previous = b[0].count(" ") + 1
            marks = {" ".join(t.replace("&amp;", "&").split()): int(a) for t, a in truth}
            labels = tuple(marks.get(b[0], 0) for b in blocks)
            worth = {y: field.start * y[0] + sum(s for s, k in zip(scores, y, strict=True) if k) + sum(field.pairs[a, b] for a, b in itertools.pairwise(y)) for y in itertools.product((0, 1), repeat=len(blocks))}
            top = max(worth.values())
            total += worth[labels] - top - math.log(sum(math.exp(v - top) for v in worth.values()))
        return total

    assert log_likelihood(fitted) > log_likelihood(barely) + 5 and log_likelihood(fitted) > -3


def test_pages_give_the_text_of_their_article(spark, sf):
    """The pages of the tables have one article element, without anything foreign in it but comments and notices."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    field = html_extract.train(600)
    seen = same = 0
    for p in pages:
        m = re.findall(r"<article[^>]*>(.*?)</article>", p.html or "", re.S)
        if len(m) != 1 or re.search(r"<(nav|aside|form|script|style|div|section|footer)", m[0]):
            continue
        seen += 1
        same += field.extract(p.html) == " ".join(b[0] for b in leaf_blocks(m[0]))
    assert not seen or same / seen > 0.99


def test_html_takes_long_empty_and_clashing_tables(spark):
    body = "<article>" + "<p>Some words of a long article, which go on and on.</p>" * 20_000 + "</article>"
    d = spark.createDataFrame([(1, "mine", body), (1, None, body), (None, "x", None)], "page_id long, text string, html string")
    field = html_extract.train(200)
    out = html_extract.extract(d, field).orderBy("page_id").collect()
    assert [len(r.text) for r in out] == [0, 20_000 * 50 - 1, 20_000 * 50 - 1] and out[0].asDict().keys() == {"page_id", "text"}
    assert html_extract.extract(d, field, out="found").columns == ["page_id", "text", "found"]
    assert html_extract.extract(d.limit(0), field).count() == 0


# 5
def plain_trigrams(text):
    """Buckets of the trigrams of the folded text, one byte at a time."""
    raw, folded = (text or "").encode(), []
    for i, b in enumerate(raw):
        upper = i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97
        c = b + 32 if 65 <= b <= 90 or upper else b if 97 <= b <= 122 or b >= 128 else 32
        if c != 32 or not folded or folded[-1] != 32:
            folded.append(c)
    count = collections.Counter()
    for x, y, z in zip(folded, folded[1:], folded[2:]):
        code = (x << 16) | (y << 8) | z
        count[((code * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - 13)] += 1
    return count


def test_language_features_are_those_of_a_plain_count():
    got = language.features(pa.array(ODD))
    for text, row in zip(ODD, got, strict=True):
        count = plain_trigrams(text)
        want = np.zeros(language.BUCKETS)
        for k, n in count.items():
            want[k] = math.sqrt(n)
        want /= max(1e-9, math.sqrt((want**2).sum()))
        assert np.allclose(row, want, atol=1e-5)


def test_language_prediction_is_that_of_plain_votes():
    rnd = np.random.default_rng(2)
    names = ["en", "de", "nl", "fr", "es", "fi"] * 20
    learn = rnd.random((120, 40)).astype(np.float32)
    model = language.Model(learn / np.linalg.norm(learn, axis=1, keepdims=True), names)
    x = rnd.random((30, 40)).astype(np.float32)
    for row, (said, score) in zip(x, model.predict(x), strict=True):
        margins = [float(row @ model.w[:, c] + model.b[c]) for c in range(model.w.shape[1])]
        family = max(range(len(model.families)), key=lambda f: margins[f])
        votes, sums = collections.Counter(), collections.Counter()
        for (i, j), v in zip(model.pairs, margins[len(model.families) :], strict=True):
            if i in model.members[family]:
                votes[i if v >= 0 else j] += 1
                sums[i] += v
                sums[j] -= v
        best = max(model.members[family], key=lambda i: (votes[i], sums[i], -i))
        assert said == model.languages[best] and 0 <= score <= 1


def test_svm_reaches_the_least_loss():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(80, 5)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.3 * rnd.normal(size=80) > 0, 1, -1).astype(np.float32)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def loss(w, b):
        return (weight * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum() + 1e-4 / 2 * (w**2).sum()

    w, b = language.svm(x, y, rounds=4000)
    for _ in range(300):
        assert loss(w, b) <= loss(w + rnd.normal(size=5) * 0.05, b + rnd.normal() * 0.05) + 1e-6


def test_language_sample_is_bounded_by_rows(spark):
    rows = [(1, f"same id text {i} here", "en") for i in range(800)] + [(2, "always the same text", "de")] * 500 + [(i, f"wörter und {i}", "de") for i in range(3, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_h", F.xxhash64("doc_id", "text"))
    got = {r.lang: r.n for r in folds.sample_by(docs, "lang", 100, "_h").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert got == {"en": 100, "de": 100}
    keys = sorted(r._h for r in docs.where("lang = 'de'").select("_h").distinct().collect())[:100]
    assert sorted(r._h for r in folds.sample_by(docs, "lang", 100, "_h").where("lang = 'de'").collect()) == keys


def test_language_fit_is_bounded_in_languages_and_repeats(spark, monkeypatch):
    rows = [(i * 500 + k, f"{c * 5} text {k} {c}", c) for i, c in enumerate("abcdefgh") for k in range(200 - 24 * i)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "LANGUAGES", 5)
    a = language.fit(docs.repartition(3), total=20)
    b = language.fit(docs.repartition(7), total=20)
    assert a.languages == list("abcde") and np.array_equal(a.w, b.w) and np.array_equal(a.b, b.b)


def test_models_take_empty_long_and_clashing_tables(spark):
    d = spark.createDataFrame([(i, t, "en", -5.0) for i, t in enumerate(ODD)] + [(None, "no id", "en", -5.0), (3, "a", "en", -5.0)], "doc_id long, text string, lang_pred string, score double")
    learn = spark.createDataFrame([(i, " ".join(random.Random(i).choices("the cat sat on that mat".split() if i % 2 else "die katze saß auf der matte".split(), k=20)), "en" if i % 2 else "de") for i in range(80)], "doc_id long, text string, lang string")
    model = language.fit(learn)
    got = language.identify(d, model).collect()
    assert len(got) == d.count() and {r.lang_pred for r in got} <= {"en", "de", "und"} and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" for r in got if not any(c.isalpha() for c in r.text or ""))
    assert language.identify(d, model, lang_pred="l", score="s").columns == [*d.columns, "l", "s"]
    assert language.identify(d.limit(0), model).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    ranks = quality.fit(learn, labels)
    got = quality.score(d, ranks).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.text == "a"}) == 1
    assert quality.score(d, ranks, out="q").columns == [*d.columns, "q"] and quality.score(d.limit(0), ranks).count() == 0


# 6
def plain_shares(text):
    raw = (text or "").encode()
    words = raw.lower().split()
    letters = sum(1 for b in raw if 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC3)
    upper = sum(1 for i, b in enumerate(raw) if 65 <= b <= 90 or i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E)
    n, w = max(1, len(raw)), max(1, len(words))
    shingles = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    lines = raw.split(b"\n")
    return [
        upper / max(1, letters),
        sum(raw.count(c.encode()) for c in "#$%&*@^~<>{}[]\\=+_/") / n,
        raw.count(b"|") / w,
        raw.count(b"!") / n,
        sum(48 <= b < 58 for b in raw) / n,
        min(0.25, (raw.count(b".") + raw.count(b",")) / w),
        sum(a == b for a, b in itertools.pairwise(words)) / w,
        1 - len(shingles) / (len(words) - 4) if len(words) > 4 else 0,
        1 - len(set(lines)) / len(lines) if len(lines) > 1 else 0,
        min(20, sum(map(len, words)) / w) / 10,
        sum(len(x) > 20 for x in words) / w,
    ]


def test_quality_shares_are_those_of_a_plain_count():
    got = quality.features(pa.array(ODD))
    for text, row in zip(ODD, got, strict=True):
        assert np.allclose(row, plain_shares(text) if text else 0, atol=1e-9), text


def test_quality_learns_from_words_alone(spark):
    rnd = random.Random(9)
    good, bad = "river house garden window morning".split(), "filler mumble chatter blather jumble".split()
    plain = "and with over from into that this then".split()
    rows = [(i, " ".join(rnd.choice(plain + (good if i % 3 else bad)) for _ in range(40)) + ".", i % 3 > 0) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(q)) for i, _, q in rows], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).withColumn("out", folds.held_out()).where("out").collect()
    right = sum((r.score >= quality.CUT) == (r.doc_id % 3 > 0) for r in got)
    assert right / len(got) > 0.95


def test_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    said = language.identify(docs, language.fit(docs)).where(folds.held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    assert said.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    scored = quality.score(docs, quality.fit(docs, labels)).where(folds.held_out()).join(labels.where("quality is not null"), "doc_id")
    assert scored.agg(F.avg(((F.col("score") >= quality.CUT).cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.95
