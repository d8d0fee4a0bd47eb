"""Statistics as Column expressions and windows."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.ordered import at_ranks
from pyspark.sql import types as T

ALPHA = 0.05


def z_of(alpha: float) -> float:
    """The two-sided normal quantile."""
    return NormalDist().inv_cdf(1 - alpha / 2)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(hits: Column, total: Column, alpha: float = ALPHA) -> tuple[Column, Column]:
    """(low, high) of the Wilson score interval; (0, 0) without observations."""
    z = z_of(alpha)
    n = F.when(total > 0, total.cast("double"))
    p = hits / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    some = total > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - margin)).otherwise(0.0), F.when(some, F.least(F.lit(1.0), centre + margin)).otherwise(0.0)


def upper_tail(z: Column) -> Column:
    """Two-sided normal p-value of |z|, by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


@F.pandas_udf(T.DoubleType())
def upper_tail_exact(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value of |z| with full relative accuracy."""
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def two_proportions(hits_a: Column, n_a: Column, hits_b: Column, n_b: Column, exact: bool = False) -> tuple[Column, Column]:
    """(difference a - b, two-sided p): pooled z-test; (0, 1) if a group is empty, p = 1 without variation."""
    ok = (n_a > 0) & (n_b > 0)
    na, nb = F.when(ok, n_a.cast("double")), F.when(ok, n_b.cast("double"))
    diff = hits_a / na - hits_b / nb
    pooled = (hits_a + hits_b) / (na + nb)
    se = F.sqrt(pooled * (1 - pooled) * (1 / na + 1 / nb))
    p = (upper_tail_exact if exact else upper_tail)(F.try_divide(diff, se))
    return F.coalesce(diff, F.lit(0.0)), F.when(ok & (se > 0), p).otherwise(1.0)


def benjamini_hochberg(df: DataFrame, p_col: str = "p_value", out: str = "significant", alpha: float = ALPHA, by: list[str] | None = None) -> DataFrame:
    """df with the step-up decision: all p up to the largest that is at most alpha * rank / n.

    Equal p-values share a decision, so ranks need no tie-break: the counts of each distinct p are summed first, and only
    those (one row for each p-value of a family) are ordered.
    """
    by = by or []
    fam = Window.partitionBy(*by, "_fam") if by else Window.partitionBy("_fam")
    order = fam.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_fam", F.lit(0)).withColumn("_p", F.col(p_col))
    counts = d.groupBy(*by, "_fam", "_p").agg(F.count("*").alias("_n"))
    cuts = counts.withColumn("_r", F.sum("_n").over(order)).withColumn("_m", F.sum("_n").over(fam))
    cuts = cuts.groupBy(*by, "_fam").agg(F.max(F.when(F.col("_p") <= alpha * F.col("_r") / F.col("_m"), F.col("_p"))).alias("_cut"))
    return d.join(cuts, [*by, "_fam"], "left").withColumn(out, F.coalesce(F.col("_p") <= F.col("_cut"), F.lit(False))).drop("_fam", "_p", "_cut")


def sample_per_arm(baseline: Column, mde_pp: float = 3.0, alpha: float = ALPHA, power: float = 0.8) -> Column:
    """Sample size of an arm to see a move of mde_pp points, two-sided; down, or up where down isn't possible. Null outside (0, 1)."""
    if mde_pp <= 0:
        raise ValueError("mde_pp must be positive")
    d = mde_pp / 100
    za, zb = z_of(alpha), NormalDist().inv_cdf(power)
    p1 = F.when((baseline > 0) & (baseline < 1), baseline)
    p2 = target_rate(p1, mde_pp)
    p2 = F.when((p2 > 0) & (p2 < 1), p2)
    pooled = (p1 + p2) / 2
    num = F.pow(za * F.sqrt(2 * pooled * (1 - pooled)) + zb * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2)), F.lit(2.0))
    return F.ceil(num / (d * d)).cast("long")


def target_rate(baseline: Column, mde_pp: float = 3.0) -> Column:
    d = mde_pp / 100
    return F.when(baseline - d > 0, baseline - d).otherwise(baseline + d)


def months_needed(total: Column, monthly: Column) -> Column:
    return F.when(monthly > 0, total / monthly).otherwise(F.lit(float("inf")))


def floor_percentile(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """The sorted values at positions min(int(n * f), n - 1), by running counts over range partitions (see ordered.at_ranks)."""
    at = {f"p{round(f * 100):02d}": F.least(F.floor(F.col("_m") * F.lit(f)), F.col("_m") - 1) for f in shares}
    return at_ranks(df, value, at, by or []).drop("_m")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.when(union > 0, union))


def l2_normalise(v: Column) -> Column:
    """A vector divided by its norm, which counts as 1e-12 at least."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-12))))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
