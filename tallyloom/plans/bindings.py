"""Roles of the engine (reviews, labels, vectors) bound to test tables, for DataFrames and, as text, for a SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INTENTS = ["complaint", "praise", "feature_request", "churn_warning", "comparison", "question"]
SEVERITIES = ["critical", "high", "medium", "low"]
WINDOW_START = "2024-04-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], n):
    return F.get(F.array(*map(F.lit, values)), n.cast("int"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels as reviews: platform = lang."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k * 13 % 300).cast("int"))
    return d.join(y, "doc_id", "left").select(
        k.cast("string").alias("review_id"),
        k.alias("source_row_index"),
        F.col("lang").alias("platform"),
        "source",
        ((k * 7 + F.col("n_chars")) % 5 + 1).cast("int").alias("rating"),
        day.alias("review_date"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
        F.col("text").alias("review_text"),
        F.col("n_chars").alias("char_len"),
        F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").otherwise("neutral").alias("sentiment"),
        F.when(k % 5 != 0, _pick(SEVERITIES, k % 4)).alias("severity"),
        _pick(INTENTS, k % 6).alias("customer_intent"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("support_escalation"),
        (day >= F.lit(WINDOW_START).cast("date")).alias("in_comparable_window"),
        (F.col("n_chars") >= 495).alias("is_truncated"),
        ((k % 10) / 10.0).alias("grounding_rate"),
    )


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as reviews: platform = priority, month = order month."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        k.cast("string").alias("review_id"),
        F.col("o_orderpriority").alias("platform"),
        F.date_format("o_orderdate", "yyyy-MM").alias("year_month"),
        F.to_date("o_orderdate").alias("review_date"),
        F.when(F.col("o_orderstatus") == "F", "negative").when(F.col("o_orderstatus") == "O", "positive").otherwise("neutral").alias("sentiment"),
        F.when(k % 5 != 0, _pick(SEVERITIES, k % 4)).alias("severity"),
        _pick(INTENTS, k % 6).alias("customer_intent"),
        (F.col("o_totalprice") > 200000).alias("support_escalation"),
        (F.col("o_orderdate") >= "1996-01-01").alias("in_comparable_window"),
        ((k % 10) / 10.0).alias("grounding_rate"),
    )


def item_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its part and order as labels: area = brand, issue = type, polarity = return flag."""
    item, part, o = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    flag = F.col("l_returnflag")
    return (
        item.join(part.select("p_partkey", "p_brand", "p_type", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .join(o.select("o_orderkey", "o_orderpriority", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").cast("string").alias("review_id"),
            F.col("l_linenumber").alias("label_no"),
            F.col("p_brand").alias("product_area"),
            F.when(flag == "R", F.col("p_type")).alias("issue_type"),
            F.when(flag == "A", F.col("p_type")).alias("strength_type"),
            F.when(flag == "R", "issue").when(flag == "A", "strength").otherwise("none").alias("polarity"),
            F.col("l_discount").alias("confidence"),
            F.col("p_name").alias("evidence_span"),
            F.col("o_orderpriority").alias("platform"),
            F.date_format("o_orderdate", "yyyy-MM").alias("year_month"),
            (F.col("o_orderdate") >= "1996-01-01").alias("in_comparable_window"),
        )
    )


_IN = "CASE k % 6 WHEN 0 THEN 'complaint' WHEN 1 THEN 'praise' WHEN 2 THEN 'feature_request' WHEN 3 THEN 'churn_warning' WHEN 4 THEN 'comparison' ELSE 'question' END"
_SE = "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 4 = 0 THEN 'critical' WHEN k % 4 = 1 THEN 'high' WHEN k % 4 = 2 THEN 'medium' ELSE 'low' END"
REVIEWS = f"""reviews AS (SELECT CAST(k AS VARCHAR) AS review_id, k AS source_row_index, lang AS platform, source,
  CAST((k * 7 + n_chars) % 5 + 1 AS INTEGER) AS rating, day AS review_date, strftime(day, '%Y-%m') AS year_month, text AS review_text,
  n_chars AS char_len, CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'neutral' END AS sentiment, {_SE} AS severity,
  {_IN} AS customer_intent, coalesce(toxic = 1, false) AS support_escalation, day >= DATE '{WINDOW_START}' AS in_comparable_window,
  n_chars >= 495 AS is_truncated, (k % 10) / 10.0 AS grounding_rate
  FROM (SELECT d.doc_id AS k, lang, source, n_chars, text, quality, toxic, CAST(DATE '2024-01-01' + CAST(d.doc_id * 13 % 300 AS INTEGER) AS DATE) AS day
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))"""
ORDER_REVIEWS = f"""order_reviews AS (SELECT CAST(k AS VARCHAR) AS review_id, o_orderpriority AS platform, strftime(o_orderdate, '%Y-%m') AS year_month,
  CAST(o_orderdate AS DATE) AS review_date, CASE o_orderstatus WHEN 'F' THEN 'negative' WHEN 'O' THEN 'positive' ELSE 'neutral' END AS sentiment,
  {_SE} AS severity, {_IN} AS customer_intent, o_totalprice > 200000 AS support_escalation, o_orderdate >= TIMESTAMP '1996-01-01' AS in_comparable_window,
  (k % 10) / 10.0 AS grounding_rate FROM (SELECT *, o_orderkey AS k FROM orders))"""
ITEM_LABELS = """item_labels AS (SELECT CAST(l_orderkey AS VARCHAR) AS review_id, l_linenumber AS label_no, p_brand AS product_area,
  CASE WHEN l_returnflag = 'R' THEN p_type END AS issue_type, CASE WHEN l_returnflag = 'A' THEN p_type END AS strength_type,
  CASE l_returnflag WHEN 'R' THEN 'issue' WHEN 'A' THEN 'strength' ELSE 'none' END AS polarity, l_discount AS confidence, p_name AS evidence_span,
  o_orderpriority AS platform, strftime(o_orderdate, '%Y-%m') AS year_month, o_orderdate >= TIMESTAMP '1996-01-01' AS in_comparable_window
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
