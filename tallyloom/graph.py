"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.storage import Workspace


def _least(df: DataFrame) -> DataFrame:
    return df.groupBy("u").agg(F.min("v").alias("m"))


def _state(df: DataFrame) -> tuple:
    return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    edges: any columns named u and v of one orderable type, in any direction; repeats, self loops and rows with a
    null end are allowed and add nothing. No edge: an empty table. A hub's neighbours never meet in one task: each round is a
    map-side combined minimum and two equi-joins, whose skew AQE can split. Raises if max_rounds rounds don't
    settle (a round at least halves the height of the trees, so 60 is far beyond any real table).
    """
    spark = edges.sparkSession
    ws = Workspace(spark, "components")
    now = ws.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    before = _state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = ws.cut(large)
        small = large.join(_least(large), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(_least(large).select("u", F.col("m").alias("v"))).where("u > v").distinct()
        small = ws.cut(small)
        ws.drop(now, large)
        now, after = small, _state(small)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"connected_components: not settled after {max_rounds} rounds")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
