"""Profiles: scalars, percentiles, completeness, histograms, quality flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.stats import floor_percentile, ratio
from tallyloom.ordered import linear_percentiles

SENTINELS = ["nan", "null", "none", "na", "n/a"]


def dataset_profile(r: DataFrame) -> DataFrame:
    """One row of corpus scalars."""
    return r.agg(
        F.count("*").alias("reviews"), F.count_distinct("platform").alias("platforms"), F.avg("rating").alias("mean_rating"), F.avg("char_len").alias("mean_chars"),
        (F.avg((F.col("rating") <= 2).cast("double")) * 100).alias("pct_negative"), (F.avg((F.col("rating") == 3).cast("double")) * 100).alias("pct_neutral"), (F.avg((F.col("rating") >= 4).cast("double")) * 100).alias("pct_positive"),
        F.min("review_date").alias("first_date"), F.max("review_date").alias("last_date"), F.date_diff(F.max("review_date"), F.min("review_date")).alias("span_days"), (F.avg(F.col("is_truncated").cast("double")) * 100).alias("pct_truncated"),
    )


def describe(r: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Min, p10, median, mean, p90, p99, max with linear interpolation; a group without values has nulls."""
    by, v = by or [], F.col(value)
    ends = r.groupBy(*by).agg(F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"))
    found = linear_percentiles(r, value, {"p10": 0.1, "median": 0.5, "p90": 0.9, "p99": 0.99}, by)
    found = found.withColumnsRenamed({c: f"_by_{i}" for i, c in enumerate(by)})
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    return ends.join(found, on, "left").select(*by, "min", "p10", "median", "mean", "p90", "p99", "max")


def describe_floor(r: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Floor-index percentiles (see functions.stats.floor_percentile)."""
    return floor_percentile(r, value, [0.1, 0.5, 0.9, 0.99], by)


def completeness(r: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, n_distinct, n_blank, n_sentinel), from one scan."""
    stats = [
        F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_distinct(F.col(c)).alias("n_distinct"), F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias("n_blank"), F.count_if(F.lower(F.trim(F.col(c).cast("string"))).isin(SENTINELS)).alias("n_sentinel"))
        for c in columns
    ]
    return r.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def distribution(r: DataFrame, column: str) -> DataFrame:
    """(value, n, share)."""
    counted = r.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("_t"))
    return counted.crossJoin(F.broadcast(total)).select("value", "n", ratio(F.col("n"), F.col("_t")).alias("share"))


def length_bands(r: DataFrame, value: str, bands: list[tuple[int, int]]) -> DataFrame:
    """(low, high, n) of each band, both ends included; low = high: a single length."""
    counts = [F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.count_if(F.col(value).between(a, b)).alias("n")) for a, b in bands]
    return r.agg(F.array(*counts).alias("s")).select(F.inline("s"))


def quality_flags(r: DataFrame, text: str) -> DataFrame:
    """Exact duplicates with and without case, blank texts, line breaks, terminal punctuation."""
    t = F.col(text)
    return r.agg(
        (F.count("*") - F.count_distinct(F.lower(t))).alias("folded_duplicates"), (F.count("*") - F.count_distinct(t)).alias("exact_duplicates"), F.count_if(F.trim(t) == "").alias("blank"),
        F.count_if(F.contains(t, F.lit("\n"))).alias("multi_line"), F.count_if(~F.right(t, F.lit(1)).isin(list(".!?\"')")) & (F.char_length(t) > 0)).alias("no_terminal_punct"),
    )
