"""Nothing is dropped: markup that closes late or never, unusual rows, labels beyond the samples."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackspark.llm import quality
from trackspark.llm.html_blocks import leaf_blocks


def words(page):
    return " ".join(b[0] for b in leaf_blocks(page))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<!doctype html><html><head><title>t</title><meta charset=u><p>One<p>Two", "One Two"),
        ("<head><title>t</title><style>p{}</style>\n<h1>One</h1><p>Two", "One Two"),
        ("<head><script>x</script>One", "One"),
        ("<head><noscript><link href=x></noscript><title>t</title></head><body><p>One", "One"),
        ("<p>One</p><datalist><option>a<option>b</datalist><p>Two", "One a b Two"),
        *[(f"<div><p>One</p><{t}>in</div><p>Two", "One in Two") for t in ("svg", "object", "video", "audio", "canvas", "math", "noscript", "select")],
        ("<div><svg><path d=x><g></div><p>Two", "Two"),
        ("<svg><g><p>One<p>Two", "One Two"),
        ("<div>One<template><p>no<div>no</div></div><p>Two", "One Two"),
        ("<p>One <template><b>no</b></template>two</p>", "One two"),
        ("<p>sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is</p>", "sum x+1 is"),
        ("<p>so<svg><title>t</title><text>A</text><text>B</text></svg>on", "so t A B on"),
        ("<p>a<svg><path d=x></path><path d=y /></svg>b</p>", "ab"),
        ("<p>a <select><option>x</option><option>y</select> b", "a x y b"),
        ("<noscript><p>One</noscript>Two<object><p>Three</object>Four", "One Two Three Four"),
        ("<p>One<script>no</p><p>no", "One"),
        ("<p>One</p><p data-a=it's>Two</p><p>It isn't three</p>", "One Two It isn't three"),
        ('<p>One</p><p data-a = "it\'s > 2" class=\'a"b>c\'>Two</p>Three', "One Two Three"),
        ('x <a href="u>one', "x one"),
        ("x <a href='u>one</a> two", "x one two"),
        ('<p "a>One</p><p a=>Two</p><p a= >Three</p><p a=b=c">Four</p>', "One Two Three Four"),
        ("<p>One<!-- no <p>no", "One"),
        ("<p>One <!-- a > b --> two <b", "One two"),
        ("<p title=a/b>One</p>a < b > c", "One a < b > c"),
    ],
)
def test_html_text_reaches_the_field(page, text):
    assert words(page) == text


def test_threshold_is_over_all_labels(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 90}" + "!" * ((i * j) % 11 % (3 if i % 10 else 9)) for j in range(30))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(600)], "doc_id long, quality int")
    model = quality.fit(docs, labels, 20)  # a sample of as many bad as good ones; 10 % of all are bad
    known = {r[0] for r in labels.where(~quality.held_out()).collect()}
    s = np.sort(model.strength(quality.all_features(pa.array([t for i, t in rows if i in known]))).round(9))
    first, last = quality.near_ranks(sum(i % 10 == 0 for i in known), len(known))
    gaps = s[first : last + 1] - s[first - 1 : last]
    k = first + int(np.argmax(gaps))
    assert model.threshold == pytest.approx((s[k - 1] + s[k]) / 2, abs=1e-7)
    low = quality.score(docs, model).join(labels.where(~quality.held_out()), "doc_id").where(F.col("score") < quality.CUT).count()
    assert first <= low <= last


def test_pages_without_tag_ends_take_linear_time():
    import time

    began = time.time()
    assert words("<p>One " + "<a " * 300_000).startswith("One")
    assert words("<p>One " + "<a b='" * 100_000 + ">Two").endswith("Two")
    assert time.time() - began < 10


def test_threshold_of_equal_strengths(spark):
    docs = spark.createDataFrame([(i, "the same words") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, labels)).select("score").distinct().count() == 1
