"""Scalar expressions, statistics and driver-side pieces."""

import datetime
import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import score, stats
from tallyloom.functions import text as X
from tallyloom.graph import connected_components


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], names) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("hello\n    world  ", "hello world"), ("a b c", "a b c"), ("\x1fa\x1c", "a"), ("", ""), ("  ", ""), ("a b", "a b"), ("\tx\r\ny", "x y")])
def test_whitespace(spark, raw, want):
    assert one(spark, X.normalize_whitespace(F.col("t")), t=raw) == want
    assert one(spark, X.normalize_whitespace(F.col("t")), t=want) == want


def test_dates(spark):
    f = ["%d %B %Y", "%Y-%m-%d"]
    p = lambda s: one(spark, X.parse_date(F.col("t"), f), t=s)
    assert p("30 December 2024") == datetime.date(2024, 12, 30) and p(" 2024-02-29 ") == datetime.date(2024, 2, 29)
    assert [p(s) for s in ("Dec 30 2024", "2023-02-29", "soon", "", "30/12/2024")] == [None] * 5
    with pytest.raises(ValueError):
        X.java_pattern("%q")


def test_flags(spark):
    t = F.col("t")
    assert [one(spark, X.is_truncated(t), t="x" * n) for n in (500, 496, 495, 494, 300)] == [True, True, True, False, False]
    assert [one(spark, X.no_terminal_punct(t), t=s) for s in ("a.", "a", "a!", 'a"', "", "a)")] == [False, True, False, False, False, False]
    for f in (X.has_non_latin, X.has_non_latin_exact):
        assert [one(spark, f(t), t=s) for s in ("plain", "1+1 = !", "नमस्ते", "", "Straße")] == [False, False, True, False, False]
    assert [one(spark, X.word_count(t), t=s) for s in ("", " a  b ", "x")] == [0, 2, 1]


def test_review_id(spark):
    base = dict(p="a", d="2024-01-01", r=5, t="x")
    ids = {one(spark, X.review_id(F.col("p"), F.col("d"), F.col("r"), F.col("t")), **(base | c)) for c in ({}, {"p": "b"}, {"d": "2024-01-02"}, {"r": 4}, {"t": "y"})}
    assert len(ids) == 5 and all(len(i) == 16 for i in ids)


def test_grounding(spark):
    df = spark.createDataFrame([("The “Quick”  fox", ['the "quick" fox', "slow"]), ("x", []), ("ﬁne", ["fine"])], "t string, s array<string>")
    assert [r.x for r in df.select(X.grounding(F.col("t"), F.col("s")).alias("x")).collect()] == [0.5, 1.0, 0.0]
    assert df.where("t = 'ﬁne'").select(X.grounding(F.col("t"), F.col("s"), exact=True).alias("x")).first().x == 1.0
    assert unicodedata.normalize("NFKC", "ﬁne") == "fine"


def test_formats(spark):
    assert one(spark, X.format_rate(F.lit(0.851), F.lit(0.832), F.lit(0.866))) == "85.1% (83.2–86.6)"
    assert one(spark, X.format_rate(F.lit(None).cast("double"), F.lit(0.1), F.lit(0.2))) == "—"
    assert one(spark, X.first_percent(F.lit("over 12.5% of it"))) == 0.125 and one(spark, X.first_percent(F.lit("no rule"))) == 0.10
    assert one(spark, X.cut(F.lit("a" * 300))) == "a" * 220 + "..."
    assert one(spark, X.outermost_json(F.lit('Sure: {"a": [1]} ok'))) == '{"a": [1]}' and one(spark, X.outermost_json(F.lit("```json\n[1]\n```"))) == "[1]"


@pytest.mark.parametrize("h,n", [(0, 10), (1, 1000), (10, 10), (0, 1), (3, 5), (50, 200)])
def test_wilson(spark, h, n):
    lo, hi = (one(spark, c) for c in stats.wilson(F.lit(h), F.lit(n)))
    assert 0 <= lo <= h / n + 1e-12 and h / n - 1e-12 <= hi <= 1
    assert [one(spark, c) for c in stats.wilson(F.lit(0), F.lit(0))] == [0.0, 0.0]


def test_two_proportions(spark):
    t = lambda *a, exact=False: [one(spark, c) for c in stats.two_proportions(*map(F.lit, a), exact=exact)]
    assert t(50, 100, 100, 200) == [0.0, pytest.approx(1, abs=1e-6)]
    assert t(90, 100, 10, 100, exact=True)[1] < 1e-10 and t(4, 5, 2, 5)[1] > 0.05 and t(0, 0, 1, 5) == [0.0, 1.0] and t(5, 5, 5, 5) == [0.0, 1.0]
    for z in (0.1, 1.0, 1.96, 3.5):
        assert one(spark, stats.upper_tail(F.lit(z))) == pytest.approx(math.erfc(z / math.sqrt(2)), abs=2e-7)


@pytest.mark.parametrize("p,want", [([0.02, 0.03, 0.90], [True, True, False]), ([0.0001, 0.0002, 0.60, 0.75, 0.90], [True, True, False, False, False]), ([0.5], [False])])
def test_bh(spark, p, want):
    df = spark.createDataFrame(list(enumerate(p)), "i int, p_value double")
    assert [r.significant for r in stats.benjamini_hochberg(df).orderBy("i").collect()] == want


def test_sample_size(spark):
    assert 4000 <= one(spark, stats.sample_per_arm(F.lit(0.5))) <= 4600
    assert one(spark, stats.target_rate(F.lit(0.02))) == pytest.approx(0.05) and one(spark, stats.sample_per_arm(F.lit(1.5))) is None
    with pytest.raises(ValueError):
        stats.sample_per_arm(F.lit(0.5), 0)


def test_impact(spark):
    f = lambda *a: one(spark, score.impact_label(score.impact_step(*map(F.lit, a))))
    assert [f(3.6, 0.0, 0.0), f(3.6, 0.5, 0.0), f(3.0, 0.02, 0.0), f(1.0, 0.0, 0.5), f(2.5, 0.0, 0.9), f(2.0, 0.0, 0.0)] == ["massive", "massive", "massive", "low", "medium", "low"]


def test_jaccard(spark):
    df = spark.createDataFrame([(["x", "y"], ["x", "z"]), ([], [])], "a array<string>, b array<string>")
    assert [round(r.x, 4) for r in df.select(stats.jaccard(F.col("a"), F.col("b")).alias("x")).collect()] == [0.3333, 1.0]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (100, 101)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u int, v int")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_components_match_union_find(spark):
    import random

    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u int, v int")).collect()}
    assert got == {x: find(x) for p in pairs for x in p if p[0] != p[1]} | {x: find(x) for x in got}
