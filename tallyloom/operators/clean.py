"""Cleaning: annotate, and drop only what is structurally unusable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.ordered import numbers_within

CLEAN_COLUMNS = [
    "review_id", "source_row_index", "platform", "rating", "rating_bucket", "review_date", "year", "month", "year_month", "review_raw",
    "review_text", "char_len", "word_count", "is_truncated", "ends_without_terminal_punct", "has_non_latin", "near_dup_group_id",
    "near_dup_group_size", "is_near_dup_representative", "in_comparable_window",
]


def contract_errors(raw: DataFrame, platforms: Sequence[str]) -> DataFrame:
    """raw with `errors`, the names of the checks that a row fails (S04): rating 1..5, date, review, known platform."""
    rating = F.trim("rating").try_cast("int")
    known = F.lower(F.trim("platform")).isin(list(platforms))
    checks = {
        "rating": F.coalesce(rating.between(1, 5), F.lit(False)),
        "date": F.coalesce(F.char_length("date") >= 1, F.lit(False)),
        "review": F.coalesce(F.char_length("review") >= 1, F.lit(False)),
        "platform": F.coalesce(known, F.lit(False)),
    }
    return raw.withColumn("errors", F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()])))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with messages)."""
    valid = checked.where(F.size("errors") == 0).drop("errors")
    valid = valid.withColumns({"platform": F.lower(F.trim("platform")), "rating": F.trim("rating").cast("int")})
    bad = checked.where(F.size("errors") > 0)
    return valid, bad.withColumn("messages", F.transform("errors", lambda e: F.concat(F.lit("row "), F.col("source_row_index").cast("string"), F.lit(": "), e, F.lit(": invalid"))))


def ingest_report(checked: DataFrame, examples: int = 20) -> DataFrame:
    """One row: rows read, valid, rejected, and the first messages."""
    bad = F.when(F.size("errors") > 0, F.struct("source_row_index", F.array_join("errors", ",").alias("errors")))
    kept = checked.where(F.size("errors") > 0).orderBy("source_row_index").limit(examples).agg(F.array_sort(F.collect_list(bad)).alias("examples"))
    return checked.agg(F.count("*").alias("rows_read"), F.count_if(F.size("errors") == 0).alias("rows_valid"), F.count_if(F.size("errors") > 0).alias("rows_rejected")).crossJoin(F.broadcast(kept))


def annotate(raw: DataFrame, formats: Sequence[str], min_chars: int = 10, cap: int = 500, tolerance: int = 5, window_start: str = "2024-10-01", exact_script: bool = False) -> DataFrame:
    """Every row of raw (source_row_index, rating, date, review, platform) with its cleaned columns and drop_reason (null: kept)."""
    t = X.normalize_whitespace(F.col("review"))
    day = X.parse_date(F.col("date"), formats)
    d = raw.select("source_row_index", "platform", F.col("rating").cast("int").alias("rating"), F.col("review").alias("review_raw"), t.alias("review_text"), day.alias("review_date"))
    txt = F.col("review_text")
    return d.select(
        X.review_id(F.col("platform"), F.col("review_date"), F.col("rating"), txt).alias("base_id"),
        "source_row_index", "platform", "rating", X.rating_bucket(F.col("rating")).alias("rating_bucket"), "review_date",
        F.year("review_date").alias("year"), F.month("review_date").alias("month"), F.date_format("review_date", "yyyy-MM").alias("year_month"),
        "review_raw", "review_text", F.char_length(txt).alias("char_len"), X.word_count(txt).alias("word_count"), X.is_truncated(txt, cap, tolerance).alias("is_truncated"),
        X.no_terminal_punct(txt).alias("ends_without_terminal_punct"), (X.has_non_latin_exact if exact_script else X.has_non_latin)(txt).alias("has_non_latin"),
        (F.col("review_date") >= F.lit(window_start).cast("date")).alias("in_comparable_window"),
        F.when(F.char_length(txt) < min_chars, "review_too_short").when(F.col("review_date").isNull(), "unparseable_date").alias("drop_reason"),
    )


def number_collisions(df: DataFrame, base: str = "base_id", order: str = "source_row_index", out: str = "review_id") -> DataFrame:
    """The first of equal ids keeps it, the others get -1, -2, ...; an id that many rows have is numbered by many tasks."""
    n = F.col("_n") - 1
    return numbers_within(df, [base], [order], "_n").withColumn(out, F.when(n > 0, F.concat(base, F.lit("-"), n.cast("string"))).otherwise(F.col(base))).drop("_n", base)


def first_seen(df: DataFrame, keys: list[str], order: list[str], out: str = "is_first") -> DataFrame:
    """Whether a row is the first of its key; a key that many rows have is dealt out by its order."""
    return numbers_within(df, keys, order, "_n").withColumn(out, F.col("_n") == 1).drop("_n")


def build_clean(raw: DataFrame, formats: Sequence[str], threshold: float = 0.8, **options) -> DataFrame:
    """The clean table: CLEAN_COLUMNS, a row for every usable row of raw."""
    from tallyloom.operators.neardup import near_duplicate_groups
    from tallyloom.storage import Workspace

    kept = number_collisions(annotate(raw, formats, **options).where("drop_reason is null").drop("drop_reason"))
    kept = Workspace(raw.sparkSession, "clean").cut(kept)
    groups = near_duplicate_groups(kept.select("review_id", "source_row_index", "review_text"), threshold)
    return kept.join(groups, "review_id", "left").withColumns({
        "near_dup_group_id": F.coalesce("near_dup_group_id", F.lit(-1).cast("long")),
        "near_dup_group_size": F.coalesce("near_dup_group_size", F.lit(1).cast("long")),
        "is_near_dup_representative": F.coalesce("is_near_dup_representative", F.lit(True)),
    }).select(*CLEAN_COLUMNS)


def gate(clean: DataFrame, most: int = 10) -> list[str]:
    """The first contract violations of a clean table (driver guard: at most `most` rows are fetched)."""
    bad = F.array_compact(F.array(
        F.when(~F.col("review_id").rlike(r"^[0-9a-f]{16}(-\d+)?$"), F.lit("review_id")), F.when(~F.col("rating").between(1, 5), F.lit("rating")),
        F.when(~F.col("year_month").rlike(r"^\d{4}-\d{2}$"), F.lit("year_month")), F.when(F.col("near_dup_group_size") < 1, F.lit("near_dup_group_size")),
        F.when(F.col("char_len") != F.char_length("review_text"), F.lit("char_len")),
    ))
    return [f"row {r.source_row_index}: {', '.join(r.bad)}" for r in clean.select("source_row_index", bad.alias("bad")).where(F.size("bad") > 0).orderBy("source_row_index").limit(most).collect()]


def cleaning_report(annotated: DataFrame, clean: DataFrame) -> DataFrame:
    """One row of scalars; per-platform and per-rating counts as arrays of (key, n)."""
    drops = annotated.agg(F.count("*").alias("rows_in"), F.count_if(F.col("drop_reason") == "review_too_short").alias("too_short"), F.count_if(F.col("drop_reason") == "unparseable_date").alias("bad_dates"))
    c = F.col
    main = clean.agg(
        F.count("*").alias("rows_out"), F.count_if(c("review_raw") != c("review_text")).alias("whitespace_changed"), (F.count("*") - F.count_distinct("review_text")).alias("exact_duplicates"),
        F.count_if("is_truncated").alias("truncated"), F.count_if("ends_without_terminal_punct").alias("no_terminal_punct"), F.count_if("has_non_latin").alias("non_latin"),
        F.count_distinct(F.when(c("near_dup_group_id") >= 0, c("near_dup_group_id"))).alias("near_dup_groups"), F.count_if(c("near_dup_group_id") >= 0).alias("near_dup_members"),
        F.max("near_dup_group_size").alias("largest_near_dup_group"), F.count_if("in_comparable_window").alias("in_window"), F.min("review_date").alias("first_date"), F.max("review_date").alias("last_date"),
    )
    count_by = lambda k: clean.groupBy(F.col(k).cast("string").alias("key")).count().agg(F.array_sort(F.collect_list(F.struct("key", F.col("count").alias("n")))).alias(f"per_{k}"))
    out = drops
    for part in (main, count_by("platform"), count_by("rating")):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out
