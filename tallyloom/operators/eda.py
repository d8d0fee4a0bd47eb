"""Exploration with sampling bias in view: shares, comparison windows, confound checks, themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import ratio
from tallyloom.ordered import linear_percentiles

#: Words of text analysis that say nothing about a subject; a fixed list, of two or more letters.
# Words that are no terms, unless a caller brings a list.
STOPWORDS = """
    a an the and or but if of to in on at for with is are was were be been being it its
    i my me we our you your they them their he she this that these those have has had do does
    did not no so very just too also can could would should will shall may might must am as by
    from about into over under again then than there here when where what which who whom how
    why all any both each more most other some such only own same now app get got getting use
    using used one two because after before while during out up down off ive dont didnt cant
    im theyre thats wont
""".split()


def pivot_counts(r: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row x column, zero-filled, with a total."""
    made = r.groupBy(row).pivot(column, values).count().na.fill(0)
    return made.withColumn("total", sum((F.col(f"`{v}`") for v in values), F.lit(0)))


def date_ranges(r: DataFrame) -> DataFrame:
    """A06."""
    return r.groupBy("platform").agg(F.min("review_date").alias("first_date"), F.max("review_date").alias("last_date"))


def month_share(r: DataFrame, month: str) -> DataFrame:
    """One month's share of the corpus."""
    return r.agg(F.count_if(F.col("year_month") == month).alias("n"), ratio(F.count_if(F.col("year_month") == month), F.count("*")).alias("share"))


def monthly_negative(r: DataFrame) -> DataFrame:
    """A08."""
    return r.groupBy("year_month").agg(F.count("*").alias("reviews"), (F.avg((F.col("rating") <= 2).cast("double")) * 100).alias("pct_negative"))


def comparable_months(r: DataFrame, least: int = 50, platforms: int | None = None) -> DataFrame:
    """Months in which every platform of the corpus has at least `least` reviews."""
    cells = r.groupBy("year_month", "platform").agg(F.count("*").alias("n"))
    every = cells.agg(F.count_distinct("platform").alias("_k"))
    months = cells.groupBy("year_month").agg(F.min("n").alias("least"), F.count("*").alias("k"), F.sum("n").alias("reviews"))
    want = F.lit(platforms) if platforms else F.col("_k")
    return months.crossJoin(F.broadcast(every)).where((F.col("least") >= least) & (F.col("k") == want)).select("year_month", "reviews")


def comparison_window(r: DataFrame, least: int = 50) -> DataFrame:
    """One row: number of comparable months, first and last date, reviews and share (null dates: no such month)."""
    ok = F.broadcast(comparable_months(r, least).select("year_month", F.lit(True).alias("_in")))  # a row for each month
    d = r.join(ok, "year_month", "left")
    day = F.when(F.col("_in"), F.col("review_date"))
    return d.agg(F.count_distinct(F.when(F.col("_in"), F.col("year_month"))).alias("months"), F.min(day).alias("start"), F.max(day).alias("end"), F.count_if("_in").alias("reviews"), ratio(F.count_if("_in"), F.count("*")).alias("share"))


def rating_profile(r: DataFrame) -> DataFrame:
    """A11."""
    pct = lambda c: F.avg(c.cast("double")) * 100
    x = F.col("rating")
    return r.groupBy("platform").agg(F.count("*").alias("n"), F.avg(x).alias("mean_rating"), pct(x <= 2).alias("pct_negative"), pct(x == 3).alias("pct_neutral"), pct(x >= 4).alias("pct_positive"))


def mean_over_time(r: DataFrame, least: int = 0) -> DataFrame:
    """Mean rating of month x platform; null in cells of fewer than `least` reviews."""
    return r.groupBy("year_month", "platform").agg(F.when(F.count("*") >= least, F.avg("rating")).alias("mean_rating"), F.count("*").alias("n"))


def average_rank(value: Column, over: Window) -> Column:
    """Descending rank, ties get their mean rank."""
    return F.rank().over(over.orderBy(value.desc_nulls_last())) + (F.count("*").over(over.partitionBy(value)) - 1) / 2


def confound_check(r: DataFrame, in_window: Column) -> DataFrame:
    """Means in the whole corpus and in the window, shift, ranks, whether the rank moves. One row for each platform."""
    m = r.groupBy("platform").agg(F.avg("rating").alias("mean_full"), F.avg(F.when(in_window, F.col("rating"))).alias("mean_window"), F.count("*").alias("n_full"), F.count_if(in_window).alias("n_window"))
    m = m.withColumn("shift", F.col("mean_window") - F.col("mean_full"))
    for name in ("full", "window"):  # over one row a platform
        v = F.round(f"mean_{name}", 12)
        one = Window.partitionBy(F.lit(0))
        m = m.withColumn(f"rank_{name}", F.rank().over(one.orderBy(v.desc_nulls_last())) + (F.count("*").over(Window.partitionBy(v)) - 1) / 2)
    return m.withColumn("reordered", ~F.col("rank_full").eqNullSafe(F.col("rank_window")))


def top_terms(r: DataFrame, text: str, n: int = 25, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """Document frequency of terms of over two characters that aren't stop words; ties by term."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0)))
    terms = r.select(F.explode(F.filter(found, lambda w: (F.char_length(w) > 2) & ~w.isin(stopwords))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)


def length_stats(r: DataFrame) -> DataFrame:
    """A15."""
    means = r.groupBy("platform").agg(F.avg("char_len").alias("mean_chars"), (F.avg(F.col("is_truncated").cast("double")) * 100).alias("pct_truncated"))
    median = linear_percentiles(r, "char_len", {"median_chars": 0.5}, ["platform"]).withColumnRenamed("platform", "_p")
    return means.join(median, F.col("platform").eqNullSafe(F.col("_p")), "left").select("platform", "median_chars", "mean_chars", "pct_truncated")


def length_tails(r: DataFrame) -> DataFrame:
    """P10: rows at or below the 5th, or at or above the 95th percentile of length, with `tail`."""
    cut = linear_percentiles(r, "char_len", {"_lo": 0.05, "_hi": 0.95})
    tail = F.when(F.col("char_len") <= F.col("_lo"), "short").when(F.col("char_len") >= F.col("_hi"), "long")
    return r.crossJoin(F.broadcast(cut)).withColumn("tail", tail).where("tail is not null").drop("_lo", "_hi")


def truncation_comparison(r: DataFrame) -> DataFrame:
    """A16."""
    neg = (F.col("rating") <= 2).cast("double")
    t = F.col("is_truncated")
    return r.agg(F.count_if(t).alias("truncated_n"), F.avg(F.when(t, F.col("rating"))).alias("truncated_mean_rating"), F.avg(F.when(~t, F.col("rating"))).alias("intact_mean_rating"), (F.avg(F.when(t, neg)) * 100).alias("truncated_pct_negative"), (F.avg(F.when(~t, neg)) * 100).alias("intact_pct_negative"))


def template_groups(r: DataFrame) -> DataFrame:
    """Of each near-duplicate group its members, platforms, mean rating and a sample of its first text."""
    return r.where("near_dup_group_id >= 0").groupBy("near_dup_group_id").agg(
        F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set("platform")), ", ").alias("platforms"), F.avg("rating").alias("mean_rating"), F.left(F.min_by("review_text", "source_row_index"), F.lit(110)).alias("sample"),
    )


def crosstab_percent(r: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row x column as percent of the row."""
    made = pivot_counts(r, row, column, values)
    return made.select(row, *[(ratio(F.col(f"`{v}`"), F.col("total")) * 100).alias(f"pct_{v}") for v in values])


def sparse_tail(r: DataFrame, before: str, column: str, values: list) -> DataFrame:
    """All months before a cut as one row of the month pivot."""
    month = F.when(F.col("year_month") < before, F.concat(F.lit("before "), F.lit(before))).otherwise(F.col("year_month"))
    return pivot_counts(r.withColumn("year_month", month), "year_month", column, values)


def reconcile(r: DataFrame, report: DataFrame) -> DataFrame:
    """(check_name, seen, reported, ok): a table against the cleaning report that came with it, a row of scalars; what isn't reported isn't ok."""
    c = F.col
    seen = r.agg(
        F.count("*").alias("rows_out"), F.count_if("is_truncated").alias("truncated"), F.count_if(c("near_dup_group_id") >= 0).alias("near_dup_members"),
        F.count_distinct(F.when(c("near_dup_group_id") >= 0, c("near_dup_group_id"))).alias("near_dup_groups"), F.count_if("in_comparable_window").alias("in_window"),
        F.min("review_date").alias("first_date"), F.max("review_date").alias("last_date"), F.count_distinct("review_id").alias("ids"),
    )
    names = ("rows_out", "truncated", "near_dup_members", "near_dup_groups", "in_window", "first_date", "last_date")
    told = report.select(*[(c(k) if k in report.columns else F.lit(None)).cast("string").alias(f"reported_{k}") for k in names])
    check = lambda name, a, b: F.struct(F.lit(name).alias("check_name"), a.cast("string").alias("seen"), b.cast("string").alias("reported"))
    rows = F.array(*[check(k, c(k), c(f"reported_{k}")) for k in names], check("ids_unique", c("ids"), c("rows_out")))
    return seen.crossJoin(F.broadcast(told)).select(F.inline(rows)).withColumn("ok", c("seen").eqNullSafe(c("reported")) & c("reported").isNotNull())  # one row each


def corpus_summary(r: DataFrame) -> DataFrame:
    """Reviews, platforms and months of a corpus, in one row."""
    window = F.when(F.col("in_comparable_window"), F.col("year_month"))
    return r.agg(F.count("*").alias("reviews"), F.count_distinct("platform").alias("platforms"), F.count_distinct("year_month").alias("months"), F.count_distinct(window).alias("comparable_months"))
