"""Keyword probes: hits, shares, lift, co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.stats import ratio
from tallyloom.functions.text import probe


def probe_columns(r: DataFrame, probes: dict[str, str], text: str = "review_text") -> DataFrame:
    """r with a boolean column hit_<area> for each probe."""
    return r.withColumns({f"hit_{a}": probe(F.col(text), p) for a, p in probes.items()})


def long_hits(r: DataFrame, probes: dict[str, str], keep: list[str], text: str = "review_text") -> DataFrame:
    """(keep..., area, hit): a row for each review and area, the text searched once for each probe."""
    cells = F.array(*[F.struct(F.lit(a).alias("area"), probe(F.col(text), p).alias("hit")) for a, p in probes.items()])
    return r.select(*keep, F.inline(cells))


def area_statistics(r: DataFrame, probes: dict[str, str], support_area: str, text: str = "review_text", representative: str | None = None) -> DataFrame:
    """A24, per area: matches, shares, pos:neg ratio, platform spread, support lift, near-dup inflation. Two aggregates over one scan."""
    d = r.withColumn("_rep", F.col(representative) if representative else F.lit(True)).withColumn("_support", probe(F.col(text), probes[support_area]))
    h = long_hits(d, probes, ["platform", "rating", "_rep", "_support"], text)
    hit = F.col("hit").cast("double")
    x = F.col("rating")
    # partial sums by area and platform carry every later aggregate
    cells = h.groupBy("area", "platform").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("m"), F.count_if(x <= 2).alias("nn"), F.count_if((x <= 2) & F.col("hit")).alias("mn"), F.count_if(x >= 4).alias("np"), F.count_if((x >= 4) & F.col("hit")).alias("mp"),
        F.count_if("_rep").alias("nr"), F.count_if(F.col("_rep") & F.col("hit")).alias("mr"), F.count_if("_support").alias("ns"), F.count_if(F.col("_support") & F.col("hit")).alias("ms"), F.avg(hit * 100).alias("share"),
    )
    s = F.sum
    neg, pos = ratio(s("mn"), s("nn")) * 100, ratio(s("mp"), s("np")) * 100
    neg, pos = F.coalesce(neg, F.lit(0.0)), F.coalesce(pos, F.lit(0.0))
    share, rep = ratio(s("m"), s("n")) * 100, ratio(s("mr"), s("nr")) * 100
    lift = F.coalesce(F.try_divide(ratio(s("ms"), s("m")), F.nullif(ratio(s("ns"), s("n")), F.lit(0.0))), F.lit(0.0))
    return cells.groupBy("area").agg(
        s("m").alias("matched"), share.alias("share_pct"), neg.alias("share_negative_pct"), pos.alias("share_positive_pct"), F.when(neg > 0, F.try_divide(pos, neg)).otherwise(F.lit(float("inf"))).alias("pos_neg_ratio"),
        F.try_divide(F.max("share"), F.greatest(F.min("share"), F.lit(0.1))).alias("platform_spread"), lift.alias("support_lift"), rep.alias("representative_share_pct"), (share - rep).alias("near_dup_inflation_pp"),
    )


def areas_per_review(r: DataFrame, probes: dict[str, str], text: str = "review_text") -> DataFrame:
    """(areas, reviews, mean_rating)."""
    n = sum((probe(F.col(text), p).cast("int") for p in probes.values()), F.lit(0))
    return r.select(n.alias("areas"), "rating").groupBy("areas").agg(F.count("*").alias("reviews"), F.avg("rating").alias("mean_rating"))


def cooccurrence(r: DataFrame, probes: dict[str, str], text: str = "review_text") -> DataFrame:
    """(area_a, area_b, both, jaccard) for a < b; 0 where neither occurs. One aggregate of k(k+1)/2 counts, no join."""
    d = probe_columns(r, probes, text)
    names = sorted(probes)
    one = {a: F.count_if(f"hit_{a}") for a in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    cells = []
    for a, b in pairs:
        both = F.count_if(F.col(f"hit_{a}") & F.col(f"hit_{b}"))
        cells.append(F.struct(F.lit(a).alias("area_a"), F.lit(b).alias("area_b"), both.alias("both"), F.coalesce(ratio(both, one[a] + one[b] - both), F.lit(0.0)).alias("jaccard")))
    return d.agg(F.array(*cells).alias("s")).select(F.inline("s"))


def theme_shares(r: DataFrame, probes: dict[str, str], in_window, text: str = "review_text") -> DataFrame:
    """Share of each area by platform and over all ('all'), whole corpus and window, and the shift."""
    h = long_hits(r.withColumn("_w", F.coalesce(in_window, F.lit(False))), probes, ["platform", "_w"], text)
    hit = F.col("hit").cast("double") * 100
    g = h.groupingSets([["area", "platform"], ["area"]], "area", "platform").agg(F.avg(hit).alias("share_full"), F.avg(F.when(F.col("_w"), hit)).alias("share_window"), F.grouping("platform").alias("_all"))
    return g.select("area", F.when(F.col("_all") == 1, "all").otherwise(F.col("platform")).alias("platform"), "share_full", "share_window", (F.col("share_window") - F.col("share_full")).alias("shift"))


def theme_classes(shares: DataFrame) -> DataFrame:
    """Shared (spread below 1.5) and platform-specific (2 or more) areas, by the window's shares."""
    p = shares.where("platform <> 'all'")
    g = p.groupBy("area").agg((F.max("share_window") / F.greatest(F.min("share_window"), F.lit(0.1))).alias("spread"), F.min_by("platform", F.struct(-F.col("share_window"), F.col("platform"))).alias("leader"))
    kind = F.when(F.col("spread") < 1.5, "shared").when(F.col("spread") >= 2.0, "specific").otherwise("between")
    return g.select("area", "spread", kind.alias("kind"), F.when(kind == "specific", F.col("leader")).alias("leader"))
