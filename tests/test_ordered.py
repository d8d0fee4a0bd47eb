"""Numbers, selection by rank and samples over range partitions, against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom import ordered
from tallyloom.functions.stats import floor_percentile
from tallyloom.operators import clean, labels, profile


@pytest.fixture(scope="module")
def hot(spark):
    """6,000 rows: one key has a third of them, null is a key, others are small."""
    rng = random.Random(1)
    keys = ["hot"] * 2000 + [None] * 700 + [f"k{rng.randrange(900)}" for _ in range(3300)]
    rng.shuffle(keys)
    rows = [(i, k, rng.choice([None, rng.randrange(50), rng.randrange(10**9)])) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "i long, k string, v long"), rows


def test_numbers_within(spark, hot):
    df, rows = hot
    want, seen = {}, {}
    for i, k, _ in rows:
        seen[k] = want[i] = seen.get(k, 0) + 1
    got = ordered.numbers_within(df, ["k"], ["i"], "n")
    assert {r.i: r.n for r in got.collect()} == want
    collided = clean.number_collisions(df.select("i", F.col("k").alias("base_id")), order="i").collect()
    assert {r.i: r.review_id for r in collided} == {i: k if want[i] == 1 or k is None else f"{k}-{want[i] - 1}" for i, k, _ in rows}
    assert {r.i: r.is_first for r in clean.first_seen(df, ["k"], ["i"]).collect()} == {i: n == 1 for i, n in want.items()}
    assert ordered.numbers_within(df.limit(0), ["k"], ["i"], "n").count() == 0


def test_a_key_with_many_rows_is_numbered_by_many_tasks(spark, hot):
    df, _ = hot
    one = df.withColumn("k", F.lit("same"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.numbers_within(one, ["k"], ["i"], "n")
        assert [r.n for r in got.orderBy("i").collect()] == list(range(1, 6001))
        ranged = ordered._ranged(one, ["k", "i"], "test").groupBy("_part").count().collect()
        assert len(ranged) == 8 and max(r["count"] for r in ranged) < 2 * 6000 / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_percentiles(spark, hot):
    df, rows = hot
    values = {}
    for _, k, v in rows:
        if v is not None:
            values.setdefault(k, []).append(v)
    got = {r.k: r for r in profile.describe(df, "v", ["k"]).collect()}
    assert set(got) == {k for _, k, _ in rows}
    for k, r in got.items():
        if k not in values:
            assert r.p10 is r.median is r.p99 is None
            continue
        assert [r.p10, r.median, r.p90, r.p99] == pytest.approx(np.quantile(values[k], [0.1, 0.5, 0.9, 0.99]).tolist(), rel=1e-12)
    every = sorted(v for vs in values.values() for v in vs)
    r = profile.describe(df, "v").first()
    assert [r.p10, r.median, r.p90, r.p99] == pytest.approx(np.quantile(every, [0.1, 0.5, 0.9, 0.99]).tolist()) and (r.min, r.max) == (every[0], every[-1])
    low = {r.k: r for r in floor_percentile(df, "v", [0.1, 0.99], ["k"]).collect()}
    for k, vs in values.items():
        assert [low[k].p10, low[k].p99] == [sorted(vs)[min(int(len(vs) * f), len(vs) - 1)] for f in (0.1, 0.99)]
    assert floor_percentile(df, "v", [0.5]).first().p50 == every[len(every) // 2]
    assert profile.describe(df.limit(0), "v").first().median is None and floor_percentile(df.limit(0), "v", [0.5]).count() == 0


def test_running_counts_have_no_window_over_all_rows(spark, hot):
    plan = ordered.running_counts(hot[0], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan
    run = ordered.running_counts(hot[0], "v").orderBy("_v").collect()
    assert [r._to for r in run] == np.cumsum([r._n for r in run]).tolist() and {r._m for r in run} == {run[-1]._to}


def test_hash_sample(spark, hot):
    df, rows = hot
    h = lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest()
    quota = {"hot": 37, None: 1, "k1": 0, "k2": 10**6}
    quota["k2"] = sum(k == "k2" for _, k, _ in rows)
    want = set()
    for k, q in quota.items():
        want |= set(sorted((i for i, x, _ in rows if x == k), key=lambda i: (h(i), i))[:q])
    got = ordered.hash_sample(df, spark.createDataFrame([(k, float(q)) for k, q in quota.items()], "k string, _q double"), ["k"], "i", 5)
    assert got.columns == df.columns and sorted(r.i for r in got.collect()) == sorted(want)


def test_stratified_sample_is_in_proportion(spark, hot):
    df, rows = hot
    got = labels.stratified_sample(df.withColumn("s", F.when(F.col("k") == "hot", "a").when(F.col("k").isNull(), F.lit(None)).otherwise("b")), 60, ["s"], "i")
    n = {r.s: r["count"] for r in got.groupBy("s").count().collect()}
    assert n == {"a": 20, None: 7, "b": 33}
    again = labels.stratified_sample(df.withColumn("s", F.when(F.col("k") == "hot", "a").when(F.col("k").isNull(), F.lit(None)).otherwise("b")).repartition(3), 60, ["s"], "i")
    assert [r.i for r in got.collect()] == [r.i for r in again.collect()]
