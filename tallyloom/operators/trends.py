"""Group comparisons: rates with intervals, pairwise tests, over-indexing, guarded change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.stats import ALPHA, benjamini_hochberg, ratio, two_proportions, wilson
from tallyloom.operators.painpoints import issues_of

MIN_MONTHS = 6

#: Name -> (label, predicate, whether higher is worse).
METRICS: dict[str, tuple[str, Column, bool]] = {}


def metrics() -> dict[str, tuple[str, Column, bool]]:
    """The metric registry (Column objects need a session, so it is filled on first use)."""
    if not METRICS:
        METRICS.update({
            "negative_share": ("Negative sentiment", F.col("sentiment") == "negative", True),
            "severe_share": ("High or critical severity", F.col("severity").isin("high", "critical"), True),
            "escalation_rate": ("Drove a support contact", F.col("support_escalation"), True),
            "churn_share": ("Stated intent to leave", F.col("customer_intent") == "churn_warning", True),
            "praise_share": ("Praise", F.col("customer_intent") == "praise", False),
        })
    return METRICS


def metric_counts(reviews: DataFrame, by: list[str]) -> DataFrame:
    """(by..., metric, label, higher_is_worse, reviews, hits): all metrics from one aggregate."""
    m = metrics()
    g = reviews.groupBy(*by).agg(F.count("*").alias("reviews"), *[F.count_if(p).alias(f"_{k}") for k, (_, p, _) in m.items()])
    cells = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(label).alias("label"), F.lit(worse).alias("higher_is_worse"), F.col(f"_{k}").alias("hits")) for k, (label, _, worse) in m.items()])
    return g.select(*by, "reviews", F.inline(cells))


def with_interval(d: DataFrame, hits: str = "hits", total: str = "reviews", alpha: float = ALPHA) -> DataFrame:
    low, high = wilson(F.col(hits), F.col(total), alpha)
    return d.withColumns({"rate": F.coalesce(ratio(F.col(hits), F.col(total)), F.lit(0.0)), "ci_low": low, "ci_high": high})


def platform_metrics(reviews: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """A30."""
    return with_interval(metric_counts(reviews, ["platform"]), alpha=alpha)


def compare_platforms(reviews: DataFrame, alpha: float = ALPHA, exact: bool = False) -> DataFrame:
    """All pairs of platforms on every metric, with the false discovery rate controlled over the whole table."""
    m = metric_counts(reviews, ["platform"])
    a = m.select("metric", "label", F.col("platform").alias("platform_a"), F.col("reviews").alias("_na"), F.col("hits").alias("_ha"))
    b = m.select("metric", F.col("platform").alias("platform_b"), F.col("reviews").alias("_nb"), F.col("hits").alias("_hb"))
    d = a.join(b, "metric").where("platform_a < platform_b")
    diff, p = two_proportions(F.col("_ha"), F.col("_na"), F.col("_hb"), F.col("_nb"), exact)
    d = d.select("metric", "label", "platform_a", "platform_b", ratio(F.col("_ha"), F.col("_na")).alias("rate_a"), ratio(F.col("_hb"), F.col("_nb")).alias("rate_b"), diff.alias("difference"), p.alias("p_value"))
    return benjamini_hochberg(d, alpha=alpha)


def area_rates(labels: DataFrame, reviews: DataFrame, min_mentions: int = 30, alpha: float = ALPHA, exact: bool = False) -> DataFrame:
    """Each area's share of each platform's reviews, tested against the other platforms pooled."""
    totals = reviews.groupBy("platform").agg(F.count("*").alias("reviews"))
    n_all = totals.agg(F.sum("reviews").alias("_n"))
    cells = issues_of(labels).groupBy("product_area", "platform").agg(F.count_distinct("review_id").alias("mentions"))
    cells = cells.join(F.broadcast(totals.select("platform")), "platform", "left_semi")
    areas = cells.groupBy("product_area").agg(F.sum("mentions").alias("_m")).where(F.col("_m") >= min_mentions)
    grid = areas.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(n_all))  # areas x platforms: both are vocabularies
    d = grid.join(cells, ["product_area", "platform"], "left").na.fill(0, ["mentions"])
    _, p = two_proportions(F.col("mentions"), F.col("reviews"), F.col("_m") - F.col("mentions"), F.col("_n") - F.col("reviews"), exact)
    d = with_interval(d, "mentions", "reviews", alpha).withColumn("corpus_rate", ratio(F.col("_m"), F.col("_n"))).withColumn("p_value", p)
    d = d.withColumn("lift", F.try_divide(F.col("rate"), F.nullif(F.col("corpus_rate"), F.lit(0.0)))).drop("_m", "_n")
    return benjamini_hochberg(d, alpha=alpha)


def trend_verdict(reviews: DataFrame, min_months: int = MIN_MONTHS) -> DataFrame:
    """One row: comparable months, whether a trend may be described."""
    n = F.count_distinct(F.when(F.col("in_comparable_window"), F.col("year_month")))
    return reviews.agg(n.alias("months"), (n >= min_months).alias("computable"), F.when(n < min_months, F.concat(n.cast("string"), F.lit(f" comparable month(s), {min_months} needed"))).otherwise("").alias("reason"))


def monthly_rates(reviews: DataFrame, min_reviews: int = 50, alpha: float = ALPHA) -> DataFrame:
    """Rates of each platform-month with at least min_reviews."""
    return with_interval(metric_counts(reviews.where("year_month is not null"), ["platform", "year_month"]).where(F.col("reviews") >= min_reviews), alpha=alpha)


def change(monthly: DataFrame) -> DataFrame:
    """First to last month of each platform and metric. Callers ask trend_verdict first."""
    cols = F.struct("year_month", "rate", "ci_low", "ci_high", "label")
    g = monthly.groupBy("platform", "metric").agg(F.min_by(cols, "year_month").alias("a"), F.max_by(cols, "year_month").alias("b"))
    apart = (F.col("b.ci_low") > F.col("a.ci_high")) | (F.col("b.ci_high") < F.col("a.ci_low"))
    return g.select("platform", "metric", F.col("a.label").alias("label"), F.col("a.year_month").alias("from_month"), F.col("b.year_month").alias("to_month"), F.col("a.rate").alias("rate_from"), F.col("b.rate").alias("rate_to"), (F.col("b.rate") - F.col("a.rate")).alias("change"), apart.alias("intervals_disjoint"))


def month_over_month(reviews: DataFrame, min_reviews: int = 50, min_months: int = MIN_MONTHS) -> DataFrame | None:
    """The change table, or None where the months don't carry a trend."""
    if not trend_verdict(reviews, min_months).first().computable:
        return None
    return change(monthly_rates(reviews, min_reviews))


def ordered_rates(rates: DataFrame) -> DataFrame:
    """Area rates by area, the highest rate first; then by platform."""
    return rates.orderBy(F.asc("product_area"), F.desc_nulls_last("rate"), F.asc("platform"))
