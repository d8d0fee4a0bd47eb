"""Order without one task that holds it: numbers, running counts and selection by rank over range partitions, samples in hash order.

Rows are dealt by range, so that one partition's rows all stand before the next one's, also where a single key has many of them. What is counted within a
partition is corrected by what the partitions before it hold, which is a row or two for each partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.storage import Workspace


def _ranged(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    return Workspace(df.sparkSession, name).cut(df.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id()))


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & a[c].eqNullSafe(b[c])
    return on


def dense_numbers(df: DataFrame, order: str, out: str) -> DataFrame:
    """0, 1, 2, ... in the order of a unique column, without a single-task window: a range sort, then an offset for each range.

    The offsets are one row for each range partition, which bounds what is broadcast.
    """
    ranged = _ranged(df, [order], "numbers")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offset = sizes.select("_part", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn("_row", local).join(F.broadcast(offset), "_part").withColumn(out, (F.col("_offset") + F.col("_row") - 1).cast("long")).drop("_part", "_row", "_offset")


def numbers_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """df with 1, 2, ... within the rows of each key, in the order of columns that are unique there; nulls are a key, and stand first in an order.

    A key with many rows lies in many ranges, each of which is numbered by itself. Only the first key of a range can go on from ranges
    before, so that at most one offset for each range is broadcast.
    """
    ranged = _ranged(df, [*keys, *order], "within")
    sizes = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = sizes.withColumn("_before", before).where("_before > 0").select(F.col("_part"), F.struct(*keys).alias("_key"), "_before")
    local = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    joined = ranged.withColumn("_row", local).join(F.broadcast(ahead), "_part", "left")
    goes_on = F.struct(*keys).eqNullSafe(F.col("_key"))
    return joined.withColumn(out, (F.col("_row") + F.when(goes_on, F.col("_before")).otherwise(0)).cast("long")).drop("_part", "_row", "_key", "_before")


def running_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., _v, _n, _to, _m): each distinct value of a group, its rows, the rows up to it, and the group's rows; nulls aren't values."""
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    counts = _ranged(d.groupBy(*by, "_v").agg(F.count("*").alias("_n")), [*by, "_v"], "running")
    parts = counts.groupBy(*by, "_part").agg(F.sum("_n").alias("_k"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_k").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_before": before, "_m": F.sum("_k").over(group)}).drop("_k").withColumnsRenamed({c: f"_by_{i}" for i, c in enumerate(by)}).withColumnRenamed("_part", "_in")
    on = F.col("_part") == F.col("_in")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    to = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v"))
    return counts.withColumn("_local", to).join(parts, on).select(*by, "_v", "_n", (F.col("_before") + F.col("_local")).alias("_to"), "_m")


def at_ranks(df: DataFrame, value: str, ranks: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by..., name...): the sorted values at some ranks, from 0; a rank is an expression over _m, the number of values of a group."""
    run = running_counts(df, value, by).withColumn("_all", F.lit(0))
    held = lambda r: (F.col("_to") > r) & (F.col("_to") - F.col("_n") <= r)
    return run.groupBy(*by, "_all").agg(*[F.min(F.when(held(r), F.col("_v"))).alias(name) for name, r in ranks.items()], F.max("_m").alias("_m")).drop("_all")


def linear_percentiles(df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., name...): percentiles with linear interpolation between the two nearest ranks, as doubles."""
    place = {name: (F.col("_m") - 1) * F.lit(float(f)) for name, f in shares.items()}
    ranks = {f"_lo_{n}": F.floor(p) for n, p in place.items()} | {f"_hi_{n}": F.ceil(p) for n, p in place.items()}
    found = at_ranks(df, value, ranks, by)

    def between(n: str, p: Column) -> Column:
        lo, hi = F.col(f"_lo_{n}").cast("double"), F.col(f"_hi_{n}").cast("double")
        return F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi).alias(n)

    return found.select(*by, *[between(n, p) for n, p in place.items()])


def hash_order(id_col: str, seed: int) -> Column:
    """A hash of the seed and an id, the same in any engine: md5 of `seed:id`, in hex."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))


def hash_sample(df: DataFrame, quota: DataFrame, by: Sequence[str], id_col: str, seed: int) -> DataFrame:
    """The first rows of each stratum in hash order (ties by id), as many as quota (by..., _q) says; null is a stratum.

    A histogram of the first 16 bits of the hashes says up to which of its 65,536 steps a stratum is taken whole; only rows on the step where
    its quota ends are put in order.
    """
    d = df.withColumn("_h", hash_order(id_col, seed)).withColumn("_step", F.conv(F.left("_h", F.lit(4)), 16, 10).cast("int"))
    named = {c: f"_by_{i}" for i, c in enumerate(by)}
    steps = d.groupBy(*by, "_step").agg(F.count("*").alias("_n"))
    to = F.sum("_n").over(Window.partitionBy(*by).orderBy("_step"))
    steps = steps.withColumn("_below", to - F.col("_n"))
    ends = steps.join(quota, _same(steps, quota, by)).where((F.col("_below") < F.col("_q")) & (F.col("_below") + F.col("_n") >= F.col("_q")))
    ends = ends.select(*[steps[c].alias(named[c]) for c in by], F.col("_step").alias("_end"), (F.col("_q") - F.col("_below")).alias("_left"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(named[c]))
    near = d.join(ends, on & (F.col("_step") <= F.col("_end"))).drop(*named.values())
    last = near.where("_step = _end").withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", id_col))).where("_r <= _left").drop("_r")
    return near.where("_step < _end").unionByName(last).drop("_h", "_step", "_end", "_left")
