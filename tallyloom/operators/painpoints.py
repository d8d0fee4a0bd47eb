"""Pain points: label aggregates, composite score, guarded trend, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.score import SCORE_WEIGHTS, min_max, severity_rank

KEYS = ["product_area", "issue_type"]


def issues_of(labels: DataFrame) -> DataFrame:
    """P05, without labels that lack a key."""
    return labels.where("polarity = 'issue' and product_area is not null and issue_type is not null")


def pain_points(labels: DataFrame, reviews: DataFrame, min_volume: int = 15, representative_only: str | None = None) -> DataFrame:
    """Issue labels by (area, issue), scored after the volume floor and ranked; ties of score by key."""
    facts = reviews.where(representative_only) if representative_only else reviews
    facts = facts.select("review_id", severity_rank(F.col("severity")).alias("_sev"), F.col("support_escalation").cast("double").alias("_esc"), F.coalesce(F.col("customer_intent") == "churn_warning", F.lit(False)).cast("double").alias("_churn"), F.coalesce(F.col("sentiment") == "negative", F.lit(False)).cast("double").alias("_neg"))
    d = issues_of(labels).join(facts, "review_id", "inner" if representative_only else "left").na.fill(0.0, ["_churn", "_neg"])
    g = d.groupBy(*KEYS).agg(
        F.count_distinct("review_id").alias("volume"), F.avg("_sev").alias("mean_severity"), F.avg("_esc").alias("escalation_rate"), F.avg("_churn").alias("churn_rate"), F.avg("_neg").alias("negative_share"), F.avg("confidence").alias("mean_confidence"), F.count_distinct("platform").alias("platforms"),
    )
    by_platform = d.where("platform is not null").groupBy(*KEYS, "platform").agg(F.count("*").alias("_n")).groupBy(*KEYS).agg(F.min_by("platform", F.struct(-F.col("_n"), F.col("platform"))).alias("top_platform"))
    g = g.where(F.col("volume") >= min_volume).join(by_platform, KEYS, "left")
    ends = g.agg(*[f(c).alias(f"_{n}_{c}") for c in ("volume", "mean_severity", "churn_rate") for n, f in (("lo", F.min), ("hi", F.max))])
    mm = lambda c: min_max(F.col(c).cast("double"), F.col(f"_lo_{c}").cast("double"), F.col(f"_hi_{c}").cast("double"))
    w = SCORE_WEIGHTS
    score = w["volume"] * mm("volume") + w["severity"] * mm("mean_severity") + w["escalation"] * F.col("escalation_rate") + w["churn"] * mm("churn_rate") + w["negativity"] * F.col("negative_share")
    d = g.crossJoin(F.broadcast(ends)).withColumn("score", F.round(score, 4)).drop(*ends.columns)
    d = d.withColumns({c: F.round(c, 4) for c in ("mean_severity", "escalation_rate", "churn_rate", "negative_share", "mean_confidence")})
    # a row for each kind of pain point: the taxonomy bounds it, not the data
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc_nulls_last(), *KEYS)))


def trend(labels: DataFrame, recent_months: int = 3, min_prior: int = 3) -> DataFrame | None:
    """(area, issue, trend_ratio), reviews a month in the recent months against the earlier; None if too few months are comparable.

    The months (a few dozen) are fetched for the guard, which is the point of the operator.
    """
    d = issues_of(labels).where("in_comparable_window and year_month is not null")
    months = sorted(r.year_month for r in d.select("year_month").distinct().collect())
    prior = len(months) - recent_months
    if prior < min_prior:
        return None
    late = F.col("year_month") >= months[-recent_months]
    g = d.groupBy(*KEYS).agg(F.count_distinct(F.when(late, F.col("review_id"))).alias("recent"), F.count_distinct(F.when(~late, F.col("review_id"))).alias("before"))
    return g.select(*KEYS, F.round(F.try_divide(F.col("recent") / recent_months, F.nullif(F.col("before") / prior, F.lit(0.0))), 2).alias("trend_ratio"))


def evidence(labels: DataFrame, n: int = 3, cut: int = 200) -> DataFrame:
    """The n most confident spans of each pain point, as rows with their rank; ties by review id, then label."""
    order = Window.partitionBy(*KEYS).orderBy(F.desc_nulls_last("confidence"), "review_id", "label_no")
    d = issues_of(labels).withColumn("evidence_rank", F.row_number().over(order)).where(F.col("evidence_rank") <= n)
    return d.select(*KEYS, "evidence_rank", "review_id", F.left("evidence_span", F.lit(cut)).alias("quote"))


def packed_evidence(rows: DataFrame) -> DataFrame:
    """Evidence rows as arrays, in rank order."""
    packed = F.array_sort(F.collect_list(F.struct("evidence_rank", "review_id", "quote")))
    return rows.groupBy(*KEYS).agg(packed.alias("_e")).select(*KEYS, F.transform("_e", lambda x: x.review_id).alias("evidence_review_ids"), F.transform("_e", lambda x: x.quote).alias("evidence_quotes"))
