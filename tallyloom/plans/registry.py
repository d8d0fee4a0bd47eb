"""Every query of the review-analytics part, bound to the test tables, with DuckDB SQL written independently of the DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.functions.stats import dot
from tallyloom.operators import clean, cluster, discovery, eda, enrichment, evaluation, labels, neardup, painpoints, profile, retrieval, rice, trends
from tallyloom.plans.bindings import ITEM_LABELS, ORDER_REVIEWS, REVIEWS, item_labels, order_reviews, reviews, table, with_
from tallyloom.sources.config import load_taxonomy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Z = 1.959963984540054


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, so that the order of a sum doesn't show."""
    return df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, doubles: str = ""):
    """Register a query; doubles: the SQL's columns to round to 6 places."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            fixed = ", ".join(f"round({c}, 6) AS {c}" for c in doubles.split())
            ORACLES[f.__name__] = f"SELECT * REPLACE ({fixed}) FROM ({sql})" if fixed else sql
        return f

    return add


def wilson_sql(h: str, n: str) -> tuple[str, str]:
    c = f"(({h}) / CAST({n} AS DOUBLE) + {Z} * {Z} / (2.0 * ({n}))) / (1 + {Z} * {Z} / ({n}))"
    m = f"{Z} * sqrt(({h}) / CAST({n} AS DOUBLE) * (1 - ({h}) / CAST({n} AS DOUBLE)) / ({n}) + {Z} * {Z} / (4.0 * ({n}) * ({n}))) / (1 + {Z} * {Z} / ({n}))"
    return f"CASE WHEN ({n}) > 0 THEN greatest(0.0, {c} - {m}) ELSE 0.0 END", f"CASE WHEN ({n}) > 0 THEN least(1.0, {c} + {m}) ELSE 0.0 END"


def p_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1 / (1 + 0.3275911 * {x}))"
    return f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-{x} * {x})"


METRIC_SQL = [
    ("negative_share", "Negative sentiment", "sentiment = 'negative'", "true"),
    ("severe_share", "High or critical severity", "severity IN ('high', 'critical')", "true"),
    ("escalation_rate", "Drove a support contact", "support_escalation", "true"),
    ("churn_share", "Stated intent to leave", "customer_intent = 'churn_warning'", "true"),
    ("praise_share", "Praise", "customer_intent = 'praise'", "false"),
]


def metrics_sql(source: str, by: str) -> str:
    return " UNION ALL ".join(f"SELECT {by}, '{k}' AS metric, '{label}' AS label, {worse} AS higher_is_worse, count(*) AS reviews, count(*) FILTER (WHERE {p}) AS hits FROM {source} GROUP BY {by}" for k, label, p, worse in METRIC_SQL)


def interval_sql(h="hits", n="reviews") -> str:
    low, high = wilson_sql(h, n)
    return f"coalesce({h} / nullif(CAST({n} AS DOUBLE), 0), 0.0) AS rate, {low} AS ci_low, {high} AS ci_high"


TAX = load_taxonomy()
PROBES = TAX.probes
LANGS = ["de", "en", "es", "fr"]
WIN = "in_comparable_window"
_SP = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
NORM = f"trim(regexp_replace(text, '{_SP}', ' ', 'g'))"
# RE2 has no case folding of the kind (?iu) beyond (?i), which covers these probes
HITS = {a: f"regexp_matches(review_text, '(?i){p}')" for a, p in PROBES.items()}
HIT_ROWS = " UNION ALL ".join(f"SELECT review_id, platform, rating, {WIN}, '{a}' AS area, {h} AS hit, {HITS['contact']} AS support FROM reviews" for a, h in HITS.items())


# --- scalars and cleaning ------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, length(t) AS norm_len, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS word_count, length(t) >= 495 AS is_truncated,
  length(t) > 0 AND right(t, 1) NOT IN ('.', '!', '?', '"', '''', ')') AS no_terminal, substr(sha256(lang || '|' || source || '|' || n_chars || '|' || t), 1, 16) AS review_id
  FROM (SELECT *, {NORM} AS t FROM documents)""")
def clean_text(spark, sf_dir):
    """F01, F02, F04, F05, F09."""
    from tallyloom.functions import text as X

    d = table(spark, sf_dir, "documents").withColumn("t", X.normalize_whitespace(F.col("text")))
    t = F.col("t")
    return d.select("doc_id", F.char_length(t).alias("norm_len"), X.word_count(t).alias("word_count"), X.is_truncated(t).alias("is_truncated"), X.no_terminal_punct(t).alias("no_terminal"), X.review_id(F.col("lang"), F.col("source"), F.col("n_chars"), t).alias("review_id"))


@query(with_(REVIEWS) + "SELECT review_id, CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END AS rating_bucket, year_month, year(review_date) AS year, month(review_date) AS month, in_comparable_window FROM reviews")
def rating_and_month(spark, sf_dir):
    """F07, F08, P04."""
    from tallyloom.functions import text as X

    r = reviews(spark, sf_dir)
    return r.select("review_id", X.rating_bucket(F.col("rating")).alias("rating_bucket"), "year_month", F.year("review_date").alias("year"), F.month("review_date").alias("month"), WIN)


_DATES = "CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%-d %B %Y') WHEN o_orderkey % 4 = 1 THEN ' ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%b %d %Y') ELSE 'soon' END"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderdate AS DATE) END AS parsed, o_orderkey % 4 >= 2 AS dropped FROM orders")
def date_parse(spark, sf_dir):
    """Dates written in four ways, of which two are accepted."""
    from tallyloom.functions import text as X

    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    day = F.col("o_orderdate")
    s = F.when(k == 0, F.date_format(day, "d MMMM yyyy")).when(k == 1, F.concat(F.lit(" "), F.date_format(day, "yyyy-MM-dd"), F.lit(" "))).when(k == 2, F.date_format(day, "MMM dd yyyy")).otherwise("soon")
    p = X.parse_date(s, ["%d %B %Y", "%Y-%m-%d"])
    return o.select("o_orderkey", p.alias("parsed"), p.isNull().alias("dropped"))


@query("SELECT doc_id, list_aggregate(list_filter([CASE WHEN doc_id % 7 > 4 THEN 'rating' END, CASE WHEN doc_id % 11 = 0 THEN 'date' END, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'platform' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS errors FROM documents")
def validate_rows(spark, sf_dir):
    """Documents read as raw rows, some of them broken on purpose."""
    k = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").select(k.alias("doc_id"), (k % 7 + 1).cast("string").alias("rating"), F.when(k % 11 == 0, "").otherwise("2024-01-01").alias("date"), F.col("text").alias("review"), F.upper("lang").alias("platform"))
    e = clean.contract_errors(raw, ["en", "fr", "de"])
    return e.select("doc_id", F.when(F.size("errors") > 0, F.array_join("errors", ",")).alias("errors"))


@query("SELECT count(*) AS rows_read, count(*) FILTER (WHERE doc_id % 7 <= 4) AS rows_valid, count(*) FILTER (WHERE doc_id % 7 > 4) AS rows_rejected FROM documents")
def ingest_report(spark, sf_dir):
    """S05."""
    k = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").select(k.alias("source_row_index"), (k % 7 + 1).cast("string").alias("rating"), F.lit("x").alias("date"), F.lit("y").alias("review"), F.col("lang").alias("platform"))
    return clean.ingest_report(clean.contract_errors(raw, LANGS)).select("rows_read", "rows_valid", "rows_rejected")


@query("SELECT doc_id, source || CASE WHEN n > 0 THEN '-' || n ELSE '' END AS review_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)")
def id_collisions(spark, sf_dir):
    """Ids taken from source collide."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("base_id"))
    return clean.number_collisions(d, order="doc_id")


@query("SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS is_first FROM documents")
def exact_dupes(spark, sf_dir):
    """W02, over a hash of the text, so that texts don't move."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return clean.first_seen(d, ["h"], ["doc_id"]).select("doc_id", "is_first")


@query("SELECT count(*) AS rows_in, count(*) FILTER (WHERE length(t) < 10) AS too_short, count(*) FILTER (WHERE length(t) >= 10) AS rows_out, count(*) FILTER (WHERE length(t) >= 10 AND t <> text) AS whitespace_changed, count(*) FILTER (WHERE length(t) >= 495) AS truncated FROM (SELECT text, " + NORM + " AS t FROM documents)")
def cleaning_report(spark, sf_dir):
    """The report's counts over documents."""
    k = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").select(k.alias("source_row_index"), F.col("lang").alias("platform"), (k % 5 + 1).alias("rating"), F.col("text").alias("review"), F.lit("2024-11-05").alias("date"))
    a = clean.annotate(raw, ["%Y-%m-%d"])
    kept = clean.number_collisions(a.where("drop_reason is null"))
    kept = kept.withColumns({"near_dup_group_id": F.lit(-1), "near_dup_group_size": F.lit(1)})
    return clean.cleaning_report(a, kept).select("rows_in", "too_short", "rows_out", "whitespace_changed", "truncated")


# near duplicates: the oracle builds all pairs, from the same definition
_TOK = "list_filter(regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}_]+'), lambda x: length(x) > 1)"
_ND = f"""d AS (SELECT doc_id, length(text) AS n_len, {_TOK} AS t FROM documents),
 g AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM d),
 tf AS (SELECT doc_id, term, 1 + ln(count(*)) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM d),
 w0 AS (SELECT doc_id, term, tf * (ln((n + 1.0) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term), n),
 w AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w0),
 e AS (SELECT a.doc_id AS u, b.doc_id AS v, sum(a.w * b.w) AS c FROM w a JOIN w b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.8 - 1e-9),
 s AS (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e), reach AS (SELECT a, b FROM s UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a),
 comp AS (SELECT a AS doc_id, least(a, min(b)) AS root FROM reach GROUP BY a),
 f AS (SELECT comp.doc_id, root, count(*) OVER (PARTITION BY root) AS size, first_value(comp.doc_id) OVER (PARTITION BY root ORDER BY n_len DESC, comp.doc_id) AS rep FROM comp JOIN d USING (doc_id))"""


@query(f"WITH RECURSIVE {_ND} SELECT doc_id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS near_dup_group_id, size AS near_dup_group_size, doc_id = rep AS is_near_dup_representative FROM f")
def near_dup_groups(spark, sf_dir):
    """N01, N02, W11, W12."""
    return neardup.near_duplicate_groups(table(spark, sf_dir, "documents"), 0.8, "doc_id", "doc_id", "text")


@query(with_(REVIEWS) + "SELECT source AS grp, min(review_date) AS first_date FROM reviews GROUP BY 1")
def first_dates(spark, sf_dir):
    """A06 by another dimension."""
    return eda.date_ranges(reviews(spark, sf_dir).withColumn("platform", F.col("source"))).select(F.col("platform").alias("grp"), "first_date")


# --- profiles ------------------------------------------------------------------------------------------------------


@query(with_(REVIEWS) + """SELECT count(*) AS reviews, count(DISTINCT platform) AS platforms, avg(rating) AS mean_rating, avg(char_len) AS mean_chars, avg(CASE WHEN rating <= 2 THEN 100.0 ELSE 0 END) AS pct_negative,
 avg(CASE WHEN rating = 3 THEN 100.0 ELSE 0 END) AS pct_neutral, avg(CASE WHEN rating >= 4 THEN 100.0 ELSE 0 END) AS pct_positive, min(review_date) AS first_date, max(review_date) AS last_date,
 CAST(max(review_date) - min(review_date) AS INTEGER) AS span_days, avg(CASE WHEN is_truncated THEN 100.0 ELSE 0 END) AS pct_truncated FROM reviews""", "mean_rating mean_chars pct_negative pct_neutral pct_positive pct_truncated")
def dataset_profile(spark, sf_dir):
    """A02."""
    return profile.dataset_profile(reviews(spark, sf_dir))


@query("SELECT lang AS platform, min(n_chars) AS min, quantile_cont(n_chars, 0.1) AS p10, quantile_cont(n_chars, 0.5) AS median, avg(n_chars) AS mean, quantile_cont(n_chars, 0.9) AS p90, quantile_cont(n_chars, 0.99) AS p99, max(n_chars) AS max FROM documents GROUP BY 1", "p10 median mean p90 p99")
def describe_linear(spark, sf_dir):
    """A03."""
    return profile.describe(table(spark, sf_dir, "documents").withColumnRenamed("lang", "platform"), "n_chars", ["platform"])


@query("SELECT lang AS platform, " + ", ".join(f"list_sort(list(n_chars))[CAST(least(floor(count(*) * CAST({f} AS DOUBLE)), count(*) - 1) AS BIGINT) + 1] AS p{round(f * 100):02d}" for f in (0.1, 0.5, 0.9, 0.99)) + " FROM documents GROUP BY 1")
def percentile_floor(spark, sf_dir):
    """A04."""
    return profile.describe_floor(table(spark, sf_dir, "documents").withColumnRenamed("lang", "platform"), "n_chars", ["platform"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(DISTINCT {c}) AS n_distinct, count(*) FILTER (WHERE coalesce(trim(CAST({c} AS VARCHAR)), '') = '') AS n_blank, count(*) FILTER (WHERE lower(trim(CAST({c} AS VARCHAR))) IN ('nan', 'null', 'none', 'na', 'n/a')) AS n_sentinel FROM documents" for c in ("lang", "source", "n_chars")))
def completeness(spark, sf_dir):
    """A20."""
    return profile.completeness(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"])


@query("SELECT lang AS value, count(*) AS n, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM documents) AS share FROM documents GROUP BY 1", "share")
def distribution(spark, sf_dir):
    """A21, A39."""
    return profile.distribution(table(spark, sf_dir, "documents"), "lang")


_BANDS = [(0, 99), (100, 499), (500, 500), (501, 1999), (2000, 10**9)]


@query(" UNION ALL ".join(f"SELECT {a} AS low, {b} AS high, count(*) FILTER (WHERE n_chars BETWEEN {a} AND {b}) AS n FROM documents" for a, b in _BANDS))
def length_bands(spark, sf_dir):
    """A22."""
    return profile.length_bands(table(spark, sf_dir, "documents"), "n_chars", _BANDS)


@query("SELECT count(*) - count(DISTINCT lower(text)) AS folded_duplicates, count(*) - count(DISTINCT text) AS exact_duplicates, count(*) FILTER (WHERE trim(text) = '') AS blank, count(*) FILTER (WHERE contains(text, chr(10))) AS multi_line, count(*) FILTER (WHERE length(text) > 0 AND right(text, 1) NOT IN ('.', '!', '?', '\"', '''', ')')) AS no_terminal_punct FROM documents")
def quality_flags(spark, sf_dir):
    """A23."""
    return profile.quality_flags(table(spark, sf_dir, "documents"), "text")


# --- exploration ---------------------------------------------------------------------------------------------------

_PIV = ", ".join(f"count(*) FILTER (WHERE platform = '{p}') AS {p}" for p in LANGS)


@query(with_(REVIEWS) + f"SELECT year_month, {_PIV}, count(*) AS total FROM reviews GROUP BY 1")
def month_pivot(spark, sf_dir):
    """A05."""
    return eda.pivot_counts(reviews(spark, sf_dir), "year_month", "platform", LANGS)


@query(with_(REVIEWS) + "SELECT platform, min(review_date) AS first_date, max(review_date) AS last_date FROM reviews GROUP BY 1")
def date_ranges(spark, sf_dir):
    """A06."""
    return eda.date_ranges(reviews(spark, sf_dir))


@query(with_(REVIEWS) + "SELECT count(*) FILTER (WHERE year_month = '2024-03') AS n, count(*) FILTER (WHERE year_month = '2024-03') / CAST(count(*) AS DOUBLE) AS share FROM reviews", "share")
def month_share(spark, sf_dir):
    """A07, with the month as a parameter."""
    return eda.month_share(reviews(spark, sf_dir), "2024-03")


@query(with_(REVIEWS) + "SELECT year_month, count(*) AS reviews, avg(CASE WHEN rating <= 2 THEN 100.0 ELSE 0 END) AS pct_negative FROM reviews GROUP BY 1", "pct_negative")
def negative_share(spark, sf_dir):
    """A08."""
    return eda.monthly_negative(reviews(spark, sf_dir))


_EV = "ev AS (SELECT event_type AS platform, CAST(ts AS DATE) AS review_date, strftime(ts, '%Y-%m-%d') AS year_month, event_id FROM events), cell AS (SELECT year_month, platform, count(*) AS n FROM ev GROUP BY ALL), ok AS (SELECT year_month FROM cell GROUP BY 1 HAVING min(n) >= 60 AND count(*) = (SELECT count(DISTINCT platform) FROM cell))"


@query(with_(_EV) + "SELECT count(DISTINCT ok.year_month) AS months, min(review_date) FILTER (WHERE ok.year_month IS NOT NULL) AS start, max(review_date) FILTER (WHERE ok.year_month IS NOT NULL) AS \"end\", count(ok.year_month) AS reviews, count(ok.year_month) / CAST(count(*) AS DOUBLE) AS share FROM ev LEFT JOIN ok USING (year_month)", "share")
def comparison_window(spark, sf_dir):
    """Days in which every event type has 60 events."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("platform"), F.to_date("ts").alias("review_date"), F.date_format("ts", "yyyy-MM-dd").alias("year_month"))
    return eda.comparison_window(e, 60)


@query(with_(_EV) + "SELECT count(*) AS n FROM ev SEMI JOIN ok USING (year_month)")
def month_filter(spark, sf_dir):
    """Events of the comparable days."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("platform"), F.date_format("ts", "yyyy-MM-dd").alias("year_month"))
    return e.join(F.broadcast(eda.comparable_months(e, 60)), "year_month", "left_semi").agg(F.count("*").alias("n"))


@query(with_(REVIEWS) + f"SELECT rating, {_PIV}, count(*) AS total FROM reviews GROUP BY 1")
def contingency(spark, sf_dir):
    """A10."""
    return eda.pivot_counts(reviews(spark, sf_dir), "rating", "platform", LANGS)


@query(with_(REVIEWS) + "SELECT platform, count(*) AS n, avg(rating) AS mean_rating, avg(CASE WHEN rating <= 2 THEN 100.0 ELSE 0 END) AS pct_negative, avg(CASE WHEN rating = 3 THEN 100.0 ELSE 0 END) AS pct_neutral, avg(CASE WHEN rating >= 4 THEN 100.0 ELSE 0 END) AS pct_positive FROM reviews GROUP BY 1", "mean_rating pct_negative pct_neutral pct_positive")
def rating_profile(spark, sf_dir):
    """A11."""
    return eda.rating_profile(reviews(spark, sf_dir))


@query(with_(REVIEWS) + "SELECT year_month, platform, avg(rating) AS mean_rating, count(*) AS n FROM reviews GROUP BY ALL", "mean_rating")
def mean_over_time(spark, sf_dir):
    """A12."""
    return eda.mean_over_time(reviews(spark, sf_dir))


@query(with_(REVIEWS) + "SELECT year_month, platform, CASE WHEN count(*) >= 30 THEN avg(rating) END AS mean_rating, count(*) AS n FROM reviews GROUP BY ALL", "mean_rating")
def thin_cells(spark, sf_dir):
    """A38b."""
    return eda.mean_over_time(reviews(spark, sf_dir), 30)


@query(with_(REVIEWS) + """, m AS (SELECT platform, avg(rating) AS mean_full, avg(rating) FILTER (WHERE in_comparable_window) AS mean_window, count(*) AS n_full, count(*) FILTER (WHERE in_comparable_window) AS n_window FROM reviews GROUP BY 1),
 k AS (SELECT *, mean_window - mean_full AS shift, rank() OVER (ORDER BY round(mean_full, 12) DESC) + (count(*) OVER (PARTITION BY round(mean_full, 12)) - 1) / 2.0 AS rank_full, rank() OVER (ORDER BY round(mean_window, 12) DESC) + (count(*) OVER (PARTITION BY round(mean_window, 12)) - 1) / 2.0 AS rank_window FROM m)
 SELECT *, rank_full <> rank_window AS reordered FROM k""", "mean_full mean_window shift rank_full rank_window")
def confound_rank(spark, sf_dir):
    """A13, J14, W03."""
    return eda.confound_check(reviews(spark, sf_dir), F.col(WIN))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in eda.STOPWORDS)


@query(with_(REVIEWS) + f"SELECT term, count(*) AS n FROM (SELECT DISTINCT review_id, unnest(regexp_extract_all(lower(review_text), '[a-z'']+')) AS term FROM reviews WHERE rating <= 2) WHERE length(term) > 2 AND term NOT IN ({_STOP}) GROUP BY 1 ORDER BY n DESC, term LIMIT 25")
def top_terms(spark, sf_dir):
    """A14, L05."""
    return eda.top_terms(reviews(spark, sf_dir).where("rating <= 2"), "review_text")


@query(with_(REVIEWS) + "SELECT platform, quantile_cont(char_len, 0.5) AS median_chars, avg(char_len) AS mean_chars, avg(CASE WHEN is_truncated THEN 100.0 ELSE 0 END) AS pct_truncated FROM reviews GROUP BY 1", "median_chars mean_chars pct_truncated")
def length_stats(spark, sf_dir):
    """A15."""
    return eda.length_stats(reviews(spark, sf_dir))


@query(with_(REVIEWS) + ", q AS (SELECT quantile_cont(char_len, 0.05) AS lo, quantile_cont(char_len, 0.95) AS hi FROM reviews) SELECT review_id, CASE WHEN char_len <= lo THEN 'short' ELSE 'long' END AS tail FROM reviews, q WHERE char_len <= lo OR char_len >= hi")
def length_tails(spark, sf_dir):
    """P10."""
    return eda.length_tails(reviews(spark, sf_dir).select("review_id", "char_len")).select("review_id", "tail")


@query(with_(REVIEWS) + "SELECT count(*) FILTER (WHERE is_truncated) AS truncated_n, avg(rating) FILTER (WHERE is_truncated) AS truncated_mean_rating, avg(rating) FILTER (WHERE NOT is_truncated) AS intact_mean_rating, 100.0 * avg(CAST(rating <= 2 AS INTEGER)) FILTER (WHERE is_truncated) AS truncated_pct_negative, 100.0 * avg(CAST(rating <= 2 AS INTEGER)) FILTER (WHERE NOT is_truncated) AS intact_pct_negative FROM reviews", "truncated_mean_rating intact_mean_rating truncated_pct_negative intact_pct_negative")
def truncation_cmp(spark, sf_dir):
    """A16."""
    return eda.truncation_comparison(reviews(spark, sf_dir))


@query(with_(REVIEWS) + "SELECT CASE WHEN year_month < '2024-04' THEN 'before 2024-04' ELSE year_month END AS year_month, " + _PIV + ", count(*) AS total FROM reviews GROUP BY 1")
def sparse_tail(spark, sf_dir):
    """A38, U01."""
    return eda.sparse_tail(reviews(spark, sf_dir), "2024-04", "platform", LANGS)


@query(with_(REVIEWS) + "SELECT platform, " + ", ".join(f"100.0 * count(*) FILTER (WHERE rating = {i}) / count(*) AS pct_{i}" for i in range(1, 6)) + " FROM reviews GROUP BY 1", " ".join(f"pct_{i}" for i in range(1, 6)))
def crosstab_pct(spark, sf_dir):
    """A37."""
    return eda.crosstab_percent(reviews(spark, sf_dir), "platform", "rating", [1, 2, 3, 4, 5])


@query(with_(REVIEWS) + "SELECT source_row_index % 50 AS near_dup_group_id, count(*) AS members, array_to_string(list_sort(list(DISTINCT platform)), ', ') AS platforms, avg(rating) AS mean_rating, left(arg_min(review_text, source_row_index), 110) AS sample FROM reviews GROUP BY 1", "mean_rating")
def template_groups(spark, sf_dir):
    """A17, over groups given by the id."""
    return eda.template_groups(reviews(spark, sf_dir).withColumn("near_dup_group_id", F.col("source_row_index") % 50))


# the report is of all reviews, the table lacks some: both sides are counted by the SQL as well
_RECONCILE = """t AS (SELECT * FROM reviews WHERE source_row_index % 50 <> 49), c(check_name, seen, reported) AS (
 SELECT 'rows_out', CAST((SELECT count(*) FROM t) AS VARCHAR), CAST((SELECT count(*) FROM reviews) AS VARCHAR)
 UNION ALL SELECT 'truncated', CAST((SELECT count(*) FROM t WHERE is_truncated) AS VARCHAR), CAST((SELECT count(*) FROM reviews WHERE is_truncated) AS VARCHAR)
 UNION ALL SELECT 'near_dup_members', CAST((SELECT count(*) FROM t WHERE source_row_index % 3 = 0) AS VARCHAR), NULL
 UNION ALL SELECT 'near_dup_groups', CAST((SELECT count(DISTINCT source_row_index % 9) FROM t WHERE source_row_index % 3 = 0) AS VARCHAR), CAST((SELECT count(DISTINCT source_row_index % 9) FROM reviews WHERE source_row_index % 3 = 0) AS VARCHAR)
 UNION ALL SELECT 'in_window', CAST((SELECT count(*) FROM t WHERE in_comparable_window) AS VARCHAR), CAST((SELECT count(*) FROM reviews WHERE in_comparable_window) AS VARCHAR)
 UNION ALL SELECT 'first_date', CAST((SELECT min(review_date) FROM t) AS VARCHAR), CAST((SELECT min(review_date) FROM reviews) AS VARCHAR)
 UNION ALL SELECT 'last_date', CAST((SELECT max(review_date) FROM t) AS VARCHAR), CAST((SELECT max(review_date) FROM reviews) AS VARCHAR)
 UNION ALL SELECT 'ids_unique', CAST((SELECT count(DISTINCT review_id) FROM t) AS VARCHAR), CAST((SELECT count(*) FROM t) AS VARCHAR))"""


@query(with_(REVIEWS, _RECONCILE) + "SELECT *, coalesce(seen = reported, false) AS ok FROM c")
def reconcile(spark, sf_dir):
    """A table that lost some rows against the report of the whole, in which a count is missing."""
    k = F.col("source_row_index")
    r = reviews(spark, sf_dir).withColumn("near_dup_group_id", F.when(k % 3 == 0, k % 9).otherwise(-1))
    groups = F.when(F.col("near_dup_group_id") >= 0, F.col("near_dup_group_id"))
    report = r.agg(F.count("*").alias("rows_out"), F.count_if("is_truncated").alias("truncated"), F.count_if(WIN).alias("in_window"), F.count_distinct(groups).alias("near_dup_groups"), F.min("review_date").alias("first_date"), F.max("review_date").alias("last_date"))
    return eda.reconcile(r.where(k % 50 != 49), report)


# --- probes --------------------------------------------------------------------------------------------------------


@query(with_(REVIEWS, f"h AS ({HIT_ROWS})", """c AS (SELECT area, platform, avg(CAST(hit AS INTEGER)) * 100 AS share FROM h GROUP BY ALL), s AS (SELECT area, max(share) / greatest(min(share), 0.1) AS platform_spread FROM c GROUP BY 1),
 a AS (SELECT area, count(*) FILTER (WHERE hit) AS matched, 100.0 * avg(CAST(hit AS INTEGER)) AS share_pct, coalesce(100.0 * avg(CAST(hit AS INTEGER)) FILTER (WHERE rating <= 2), 0) AS share_negative_pct, coalesce(100.0 * avg(CAST(hit AS INTEGER)) FILTER (WHERE rating >= 4), 0) AS share_positive_pct,
  coalesce(avg(CAST(support AS INTEGER)) FILTER (WHERE hit) / nullif(avg(CAST(support AS INTEGER)), 0), 0) AS support_lift FROM h GROUP BY 1)""") + "SELECT a.*, CASE WHEN share_negative_pct > 0 THEN share_positive_pct / share_negative_pct ELSE CAST('inf' AS DOUBLE) END AS pos_neg_ratio, platform_spread, representative_share_pct, share_pct - representative_share_pct AS near_dup_inflation_pp FROM a JOIN s USING (area) JOIN (SELECT area, 100.0 * avg(CAST(hit AS INTEGER)) AS representative_share_pct FROM h WHERE CAST(review_id AS BIGINT) % 3 <> 0 GROUP BY 1) USING (area)",
    "share_pct share_negative_pct share_positive_pct support_lift pos_neg_ratio platform_spread representative_share_pct near_dup_inflation_pp")
def discovery_stats(spark, sf_dir):
    """A24, F10; two of three reviews count as representatives."""
    r = reviews(spark, sf_dir).withColumn("is_representative", F.col("source_row_index") % 3 != 0)
    return discovery.area_statistics(r, PROBES, TAX.special["support_area"], representative="is_representative")


_NHITS = " + ".join(f"CAST({h} AS INTEGER)" for h in HITS.values())


@query(with_(REVIEWS) + f"SELECT {_NHITS} AS areas, count(*) AS reviews, avg(rating) AS mean_rating FROM reviews GROUP BY 1", "mean_rating")
def areas_per_review(spark, sf_dir):
    """A25."""
    return discovery.areas_per_review(reviews(spark, sf_dir), PROBES)


@query(with_(REVIEWS, f"h AS ({HIT_ROWS})", "n AS (SELECT area, count(*) FILTER (WHERE hit) AS c FROM h GROUP BY 1)") + """, b AS (SELECT x.area AS area_a, y.area AS area_b, count(*) FILTER (WHERE x.hit AND y.hit) AS "both" FROM h x JOIN h y ON x.review_id = y.review_id AND x.area < y.area GROUP BY ALL)
 SELECT area_a, area_b, "both", coalesce("both" / nullif(CAST(p.c + q.c - "both" AS DOUBLE), 0), 0) AS jaccard FROM b JOIN n p ON area_a = p.area JOIN n q ON area_b = q.area""", "jaccard")
def jaccard_matrix(spark, sf_dir):
    """A26, J10."""
    return discovery.cooccurrence(reviews(spark, sf_dir), PROBES)


@query(with_(REVIEWS, f"h AS ({HIT_ROWS})", "n AS (SELECT area, count(*) FILTER (WHERE hit) AS c FROM h GROUP BY 1)") + """, b AS (SELECT x.area AS area_a, y.area AS area_b, count(*) FILTER (WHERE x.hit AND y.hit) AS "both" FROM h x JOIN h y ON x.review_id = y.review_id AND x.area < y.area GROUP BY ALL)
 SELECT area_a, area_b, round(coalesce("both" / nullif(CAST(p.c + q.c - "both" AS DOUBLE), 0), 0), 6) AS jaccard FROM b JOIN n p ON area_a = p.area JOIN n q ON area_b = q.area ORDER BY jaccard DESC, area_a, area_b LIMIT 5""")
def top_pairs(spark, sf_dir):
    """L06."""
    j = discovery.cooccurrence(reviews(spark, sf_dir), PROBES).withColumn("jaccard", F.round("jaccard", 6))
    return j.orderBy(F.desc("jaccard"), "area_a", "area_b").limit(5).select("area_a", "area_b", "jaccard")


_SHARES = with_(REVIEWS, f"h AS ({HIT_ROWS})") + ", s AS (SELECT area, coalesce(platform, 'all') AS platform, 100.0 * avg(CAST(hit AS INTEGER)) AS share_full, 100.0 * avg(CAST(hit AS INTEGER)) FILTER (WHERE in_comparable_window) AS share_window FROM h GROUP BY GROUPING SETS ((area, platform), (area))) "


@query(_SHARES + "SELECT *, share_window - share_full AS shift FROM s", "share_full share_window shift")
def theme_shares(spark, sf_dir):
    """A18."""
    return discovery.theme_shares(reviews(spark, sf_dir), PROBES, F.col(WIN))


@query(_SHARES + ", g AS (SELECT area, max(share_window) / greatest(min(share_window), 0.1) AS spread, first(platform ORDER BY share_window DESC, platform) AS leader FROM s WHERE platform <> 'all' GROUP BY 1) SELECT area, spread, CASE WHEN spread < 1.5 THEN 'shared' WHEN spread >= 2 THEN 'specific' ELSE 'between' END AS kind, CASE WHEN spread >= 2 THEN leader END AS leader FROM g", "spread")
def theme_classes(spark, sf_dir):
    """A18, classes."""
    return discovery.theme_classes(discovery.theme_shares(reviews(spark, sf_dir), PROBES, F.col(WIN)))


# --- statistics ----------------------------------------------------------------------------------------------------


@query(with_(REVIEWS, f"m AS ({metrics_sql('reviews', 'platform')})") + f"SELECT *, {interval_sql()} FROM m", "rate ci_low ci_high")
def platform_metrics(spark, sf_dir):
    """A30, F13, P09, J11."""
    return trends.platform_metrics(reviews(spark, sf_dir))


_PAIR = "((ha / CAST(na AS DOUBLE) - hb / CAST(nb AS DOUBLE)) / nullif(sqrt((ha + hb) / CAST(na + nb AS DOUBLE) * (1 - (ha + hb) / CAST(na + nb AS DOUBLE)) * (1.0 / na + 1.0 / nb)), 0))"
_COMPARE = f"""p AS (SELECT a.metric, a.label, a.platform AS platform_a, b.platform AS platform_b, a.hits AS ha, a.reviews AS na, b.hits AS hb, b.reviews AS nb FROM m a JOIN m b ON a.metric = b.metric AND a.platform < b.platform),
 t AS (SELECT metric, label, platform_a, platform_b, ha / CAST(na AS DOUBLE) AS rate_a, hb / CAST(nb AS DOUBLE) AS rate_b, ha / CAST(na AS DOUBLE) - hb / CAST(nb AS DOUBLE) AS difference, coalesce({p_sql(_PAIR)}, 1.0) AS p_value FROM p),
 r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS n FROM t)"""


@query(with_(ORDER_REVIEWS, f"m AS ({metrics_sql('order_reviews', 'platform')})", _COMPARE) + "SELECT r.* EXCLUDE (k, n), k <= coalesce((SELECT max(k) FROM r WHERE p_value <= 0.05 * k / n), 0) AS significant FROM r", "rate_a rate_b difference p_value")
def compare_platforms(spark, sf_dir):
    """E01, F14, J09, W08."""
    return trends.compare_platforms(order_reviews(spark, sf_dir))


_AREA_CI = interval_sql("mentions", "reviews")
_AREA_Z = "((mentions / CAST(reviews AS DOUBLE) - (m - mentions) / CAST(n - reviews AS DOUBLE)) / nullif(sqrt(m / CAST(n AS DOUBLE) * (1 - m / CAST(n AS DOUBLE)) * (1.0 / reviews + 1.0 / (n - reviews))), 0))"
_AREAS = with_(ORDER_REVIEWS, ITEM_LABELS) + f""", tot AS (SELECT platform, count(*) AS reviews FROM order_reviews GROUP BY 1), c AS (SELECT product_area, platform, count(DISTINCT review_id) AS mentions FROM item_labels WHERE polarity = 'issue' GROUP BY ALL),
 ar AS (SELECT product_area, sum(mentions) AS m FROM c GROUP BY 1 HAVING sum(mentions) >= 30), g AS (SELECT product_area, platform, reviews, coalesce(mentions, 0) AS mentions, CAST(m AS BIGINT) AS m, (SELECT CAST(sum(reviews) AS BIGINT) FROM tot) AS n FROM ar CROSS JOIN tot LEFT JOIN c USING (product_area, platform)),
 t AS (SELECT product_area, platform, reviews, mentions, {_AREA_CI}, m / CAST(n AS DOUBLE) AS corpus_rate, coalesce({p_sql(_AREA_Z)}, 1.0) AS p_value FROM g), r AS (SELECT *, rate / nullif(corpus_rate, 0) AS lift, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS cnt FROM t) """


@query(_AREAS + "SELECT r.* EXCLUDE (k, cnt), k <= coalesce((SELECT max(k) FROM r WHERE p_value <= 0.05 * k / cnt), 0) AS significant FROM r", "rate ci_low ci_high corpus_rate p_value lift")
def area_rates(spark, sf_dir):
    """A31, P05, P07."""
    return trends.area_rates(item_labels(spark, sf_dir), order_reviews(spark, sf_dir))


@query(_AREAS + "SELECT product_area, platform, mentions, lift, p_value, 'established' AS verdict FROM r WHERE k <= coalesce((SELECT max(k) FROM r WHERE p_value <= 0.6 * k / cnt), 0)", "lift p_value")
def significant_only(spark, sf_dir):
    """What is accepted at a false discovery rate of 0.6 (the tables are random: at 0.05 nothing should be)."""
    found = trends.area_rates(item_labels(spark, sf_dir), order_reviews(spark, sf_dir), alpha=0.6)
    return found.select("product_area", "platform", "mentions", "lift", "p_value", X.significance_label(F.col("significant")).alias("verdict")).where("verdict = 'established'")


_MONTHLY = with_(ORDER_REVIEWS, f"m0 AS ({metrics_sql('order_reviews', 'platform, year_month')})", f"m AS (SELECT *, {interval_sql()} FROM m0 WHERE reviews >= 30)")


@query(_MONTHLY + "SELECT * FROM m", "rate ci_low ci_high")
def monthly_rates(spark, sf_dir):
    """A32, P08."""
    return trends.monthly_rates(order_reviews(spark, sf_dir), 30)


@query(with_(ORDER_REVIEWS) + ", v AS (SELECT count(DISTINCT year_month) FILTER (WHERE in_comparable_window) AS months FROM order_reviews) SELECT months, months >= 6 AS computable, CASE WHEN months < 6 THEN months || ' comparable month(s), 6 needed' ELSE '' END AS reason FROM v")
def trend_verdict(spark, sf_dir):
    """E02."""
    return trends.trend_verdict(order_reviews(spark, sf_dir))


@query(_MONTHLY + """, f AS (SELECT platform, metric, label, arg_min(year_month, year_month) AS from_month, arg_max(year_month, year_month) AS to_month, arg_min(rate, year_month) AS rate_from, arg_max(rate, year_month) AS rate_to,
 arg_max(ci_low, year_month) > arg_min(ci_high, year_month) OR arg_max(ci_high, year_month) < arg_min(ci_low, year_month) AS intervals_disjoint FROM m GROUP BY ALL) SELECT *, rate_to - rate_from AS change FROM f""", "rate_from rate_to change")
def mom_change(spark, sf_dir):
    """W07."""
    return trends.change(trends.monthly_rates(order_reviews(spark, sf_dir), 30))


# --- pain points ---------------------------------------------------------------------------------------------------

_RANK = "CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END"
_PP = with_(ORDER_REVIEWS, ITEM_LABELS) + f""", i AS (SELECT l.*, {_RANK} AS sev, support_escalation AS esc, coalesce(customer_intent = 'churn_warning', false) AS churn, coalesce(sentiment = 'negative', false) AS neg FROM item_labels l LEFT JOIN order_reviews r ON l.review_id = r.review_id WHERE polarity = 'issue'),
 top AS (SELECT product_area, issue_type, platform AS top_platform FROM (SELECT product_area, issue_type, platform, row_number() OVER (PARTITION BY product_area, issue_type ORDER BY n DESC, platform) AS k FROM (SELECT product_area, issue_type, platform, count(*) AS n FROM i GROUP BY ALL)) WHERE k = 1),
 g AS (SELECT product_area, issue_type, count(DISTINCT review_id) AS volume, avg(sev) AS mean_severity, avg(CAST(esc AS INTEGER)) AS escalation_rate, avg(CAST(churn AS INTEGER)) AS churn_rate, avg(CAST(neg AS INTEGER)) AS negative_share, avg(confidence) AS mean_confidence, count(DISTINCT platform) AS platforms FROM i GROUP BY ALL HAVING count(DISTINCT review_id) >= 100),
 s AS (SELECT *, coalesce((volume - min(volume) OVER ()) / nullif(CAST(max(volume) OVER () - min(volume) OVER () AS DOUBLE), 0), 0) AS nv, coalesce((mean_severity - min(mean_severity) OVER ()) / nullif(max(mean_severity) OVER () - min(mean_severity) OVER (), 0), 0) AS ns, coalesce((churn_rate - min(churn_rate) OVER ()) / nullif(max(churn_rate) OVER () - min(churn_rate) OVER (), 0), 0) AS nc FROM g),
 pp AS (SELECT product_area, issue_type, volume, round(mean_severity, 4) AS mean_severity, round(escalation_rate, 4) AS escalation_rate, round(churn_rate, 4) AS churn_rate, round(negative_share, 4) AS negative_share, round(mean_confidence, 4) AS mean_confidence, platforms, top_platform, round(0.35 * nv + 0.25 * ns + 0.15 * escalation_rate + 0.15 * nc + 0.10 * negative_share, 4) AS score FROM s JOIN top USING (product_area, issue_type)) """


@query(_PP + "SELECT *, CAST(row_number() OVER (ORDER BY score DESC, product_area, issue_type) AS INTEGER) AS rank FROM pp")
def pain_points(spark, sf_dir):
    """A27, A28, J04, P06, W04, W09."""
    return painpoints.pain_points(item_labels(spark, sf_dir), order_reviews(spark, sf_dir), 100)


@query(with_(ITEM_LABELS) + """, i AS (SELECT * FROM item_labels WHERE polarity = 'issue' AND in_comparable_window), mo AS (SELECT year_month, row_number() OVER (ORDER BY year_month DESC) AS k FROM (SELECT DISTINCT year_month FROM i)),
 g AS (SELECT product_area, issue_type, count(DISTINCT review_id) FILTER (WHERE k <= 3) AS recent, count(DISTINCT review_id) FILTER (WHERE k > 3) AS before FROM i JOIN mo USING (year_month) GROUP BY ALL)
 SELECT product_area, issue_type, round((recent / 3.0) / nullif(before / ((SELECT count(*) FROM mo) - 3.0), 0), 2) AS trend_ratio FROM g""")
def pain_trend(spark, sf_dir):
    """A29, J06."""
    return painpoints.trend(item_labels(spark, sf_dir))


@query(with_(ITEM_LABELS) + "SELECT product_area, issue_type, CAST(k AS INTEGER) AS evidence_rank, review_id, left(evidence_span, 200) AS quote FROM (SELECT *, row_number() OVER (PARTITION BY product_area, issue_type ORDER BY confidence DESC, review_id, label_no) AS k FROM item_labels WHERE polarity = 'issue') WHERE k <= 3")
def evidence_topn(spark, sf_dir):
    """W06, L04."""
    return painpoints.evidence(item_labels(spark, sf_dir))


# --- prioritisation ------------------------------------------------------------------------------------------------

_RICE = _PP + """, cited AS (SELECT product_area, issue_type, review_id FROM (SELECT *, row_number() OVER (PARTITION BY product_area, issue_type ORDER BY confidence DESC, review_id, label_no) AS k FROM item_labels WHERE polarity = 'issue') WHERE k <= 3),
 gr AS (SELECT product_area, issue_type, avg(grounding_rate) AS g FROM cited JOIN order_reviews USING (review_id) GROUP BY ALL), x AS (SELECT pp.*, coalesce(g, (SELECT avg(grounding_rate) FROM order_reviews)) AS g, issue_type = 'PROMO' OR product_area IN ('Brand#1', 'Brand#2') AS mech, product_area IN (SELECT product_area FROM (""" + _AREAS + """SELECT product_area FROM r WHERE k <= coalesce((SELECT max(k) FROM r WHERE p_value <= 0.6 * k / cnt), 0))) AS comp,
 CASE WHEN CAST(regexp_extract(product_area, '(\\d+)', 1) AS INTEGER) % 2 = 0 THEN CAST(regexp_extract(product_area, '(\\d+)', 1) AS INTEGER) / 2.0 END AS effort FROM pp LEFT JOIN gr USING (product_area, issue_type)),
 b AS (SELECT *, CASE WHEN mean_severity >= 3.5 THEN 4 WHEN mean_severity >= 3 THEN 3 WHEN mean_severity >= 2.5 THEN 2 WHEN mean_severity >= 2 THEN 1 ELSE 0 END AS base FROM x),
 st AS (SELECT *, least(4, base + CASE WHEN churn_rate >= 0.02 THEN 1 WHEN escalation_rate >= 0.5 AND base < 2 THEN 1 ELSE 0 END) AS step FROM b),
 cf AS (SELECT *, [0.25, 0.5, 1.0, 2.0, 3.0][step + 1] AS impact, ['minimal', 'low', 'medium', 'high', 'massive'][step + 1] AS impact_label, volume / 6.0 AS reach, CASE WHEN effort > 0 THEN effort END AS eff,
   0.30 * least(1, greatest(0, g)) + 0.25 * least(1.0, volume / 300.0) + 0.20 * least(1, greatest(0, mean_confidence)) + 0.15 * CAST(mech AS INTEGER) + 0.10 * CAST(comp AS INTEGER) AS conf FROM st),
 o AS (SELECT product_area, issue_type, round(reach, 2) AS reach_per_month, impact, impact_label, round(conf, 4) AS confidence, eff AS effort_person_weeks, round(reach * impact * conf, 2) AS ric, round(reach * impact * conf / eff, 2) AS rice, eff IS NOT NULL AS scored, reach * impact * conf AS exact FROM cf)
 SELECT * EXCLUDE (exact), CAST(row_number() OVER (ORDER BY scored DESC, CASE WHEN scored THEN rice ELSE ric END DESC, product_area, issue_type) AS INTEGER) AS rank FROM o"""


@query("SELECT * REPLACE (CAST(impact AS DOUBLE) AS impact, CAST(effort_person_weeks AS DOUBLE) AS effort_person_weeks) FROM (" + _RICE + ")")
def rice_scores(spark, sf_dir):
    """M16, F17-F20, J15-J18, W05, P14. Root causes and efforts are given by rules on the keys; areas stand out at a false discovery rate of 0.6."""
    lab, rev = item_labels(spark, sf_dir), order_reviews(spark, sf_dir)
    pts = painpoints.pain_points(lab, rev, 100)
    n = F.regexp_extract("product_area", r"(\d+)", 1).cast("int")
    causes = pts.where((F.col("issue_type") == "PROMO") | F.col("product_area").isin("Brand#1", "Brand#2")).select(*painpoints.KEYS)
    effort = pts.where(n % 2 == 0).select(*painpoints.KEYS, (n / 2.0).alias("effort_person_weeks")).where("effort_person_weeks > 0")
    r = rice.rice(pts, painpoints.evidence(lab).select(*painpoints.KEYS, "review_id"), rev, 6, causes, trends.area_rates(lab, rev, alpha=0.6), effort)
    return r.select(*[c for c in r.columns if not c.startswith("confidence_")])


_BASE = with_(ORDER_REVIEWS, f"m AS ({metrics_sql('order_reviews', 'platform')})", f"pm AS (SELECT *, {interval_sql()} FROM m)", "bl AS (SELECT metric, sum(rate * reviews) / sum(reviews) AS baseline FROM pm GROUP BY 1)")


@query(_BASE + "SELECT * FROM bl", "baseline")
def baseline_rate(spark, sf_dir):
    """A34."""
    return rice.baseline_rate(trends.platform_metrics(order_reviews(spark, sf_dir)))


_PER = "CAST(ceil(pow(1.959963984540054 * sqrt(2 * (b + t) / 2 * (1 - (b + t) / 2)) + 0.8416212335729143 * sqrt(b * (1 - b) + t * (1 - t)), 2) / (0.03 * 0.03)) AS BIGINT)"


@query(f"SELECT b AS baseline, 500.0 AS monthly, {_PER} AS per_arm, t AS target_rate, 2 * {_PER} AS total, 2 * {_PER} / 500.0 AS months_required, 2 * {_PER} / 500.0 <= 6 AS practical FROM (SELECT b, CASE WHEN b - 0.03 > 0 THEN b - 0.03 ELSE b + 0.03 END AS t FROM (SELECT DISTINCT (1 + doc_id % 97) / 100.0 AS b FROM documents))", "baseline target_rate months_required")
def sample_size(spark, sf_dir):
    """F15, F16."""
    b = table(spark, sf_dir, "documents").select(((1 + F.col("doc_id") % 97) / 100.0).alias("baseline")).distinct().withColumn("monthly", F.lit(500.0))
    return rice.plan_sizes(b, "baseline", "monthly")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unmeasurable_metric' WHEN doc_id % 3 = 0 THEN 'bad_direction' WHEN doc_id % 5 = 0 THEN 'no_stated_risk' END AS issue FROM documents")
def opportunity_checks(spark, sf_dir):
    """M13."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 4 == 0, "delight").otherwise("churn_share").alias("primary_metric"), F.when(k % 3 == 0, "sideways").otherwise("decrease").alias("expected_direction"), F.when(k % 5 == 0, "No risk to customers.").otherwise("Support load may rise").alias("risk_if_wrong"))
    return rice.check_opportunities(d).select("doc_id", "issue")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'invented_citation' WHEN doc_id % 5 = 0 THEN 'uncited_hypothesis' WHEN doc_id % 7 = 0 THEN 'no_disconfirming_evidence' END AS issue, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS kept FROM documents")
def citation_check(spark, sf_dir):
    """M11."""
    k = F.col("doc_id")
    own, other = k.cast("string"), (k + 1).cast("string")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 3 == 0, F.array(own, other)).when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(own, own)).alias("supporting_review_ids"), F.when(k % 7 == 0, " ").otherwise("some").alias("disconfirming_evidence"))
    supplied = table(spark, sf_dir, "documents").select("doc_id", F.array(own).alias("supplied_ids"))
    return rice.check_citations(d, supplied, ["doc_id"]).select("doc_id", "issue", "kept")


@query(_BASE + f", o AS (SELECT * FROM (VALUES ('faster answers', 'escalation_rate'), ('kinder words', 'negative_share'), ('less pain', 'severe_share'), ('more praise', 'praise_share'), ('magic', 'delight')) v(title, primary_metric)), j AS (SELECT title, primary_metric, baseline AS b, CASE WHEN baseline - 0.03 > 0 THEN baseline - 0.03 ELSE baseline + 0.03 END AS t FROM o LEFT JOIN bl ON primary_metric = metric), n AS (SELECT *, {_PER} AS per_arm FROM j) SELECT title, b AS baseline, per_arm, CASE primary_metric WHEN 'negative_share' THEN 'praise_share' WHEN 'delight' THEN NULL ELSE 'negative_share' END AS guardrail_metric, 2 * per_arm / 5000.0 AS months_required, array_to_string(list_filter([CASE WHEN 2 * per_arm / 5000.0 > 2 THEN 'not practical at the observed volume' END, CASE WHEN b < 0.02 THEN 'baseline below 2%: a small move is most of it' END, CASE WHEN b IS NULL THEN 'no baseline for this metric' END], lambda x: x IS NOT NULL), '; ') AS notes FROM n", "baseline months_required")
def experiment_plans(spark, sf_dir):
    """M15, J20."""
    o = spark.createDataFrame([("faster answers", "escalation_rate"), ("kinder words", "negative_share"), ("less pain", "severe_share"), ("more praise", "praise_share"), ("magic", "delight")], "title string, primary_metric string")
    plans = rice.experiment_plans(o, rice.baseline_rate(trends.platform_metrics(order_reviews(spark, sf_dir))), 5000, most_months=2)
    return plans.select("title", "baseline", "per_arm", "guardrail_metric", "months_required", F.array_join("notes", "; ").alias("notes"))


# --- labels: payloads built from documents by rules ----------------------------------------------------------------


def payloads(spark, sf_dir) -> DataFrame:
    """Rule-based payloads of the documents (the offline provider), as rows."""
    return labels.rule_labeller(reviews(spark, sf_dir), TAX)


@query("SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN NULL ELSE CAST(1 AS INTEGER) END AS n_items, CASE doc_id % 5 WHEN 4 THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS first_id FROM documents")
def parse_payloads(spark, sf_dir):
    """Five shapes of reply, the last of them broken."""
    k = F.col("doc_id")
    obj = F.concat(F.lit('{"review_id": "'), k.cast("string"), F.lit('", "sentiment": "positive", "areas": []}'))
    reply = F.when(k % 5 == 0, F.concat(F.lit('{"results": ['), obj, F.lit("]}"))).when(k % 5 == 1, F.concat(F.lit("["), obj, F.lit("]"))).when(k % 5 == 2, F.concat(F.lit('```json\n{"labels": ['), obj, F.lit("]}\n```"))).when(k % 5 == 3, F.concat(F.lit("Here: "), obj, F.lit(" Done."))).otherwise("sorry, no")
    p = labels.parse_replies(table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply")))
    return p.select("doc_id", F.size("items").alias("n_items"), F.get("items", F.lit(0)).review_id.alias("first_id")).withColumn("n_items", F.when(F.col("n_items") >= 0, F.col("n_items")))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN k % 10 = 0 THEN 'missing' WHEN k % 10 = 1 THEN 'duplicate' ELSE 'ok' END AS kind FROM (SELECT doc_id AS k FROM documents) UNION ALL SELECT 'unexpected' FROM documents WHERE doc_id % 10 = 2) GROUP BY 1")
def reconcile_ids(spark, sf_dir):
    """J07, J21."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"))
    ids = F.when(F.col("k") % 10 == 1, F.array(F.col("k").cast("string"), F.col("k").cast("string"))).when(F.col("k") % 10 == 2, F.array(F.col("k").cast("string"), F.concat(F.lit("x"), F.col("k").cast("string")))).otherwise(F.array(F.col("k").cast("string")))
    back = d.where("k % 10 <> 0").select(F.explode(ids).alias("review_id"))
    return labels.reconcile_ids(d.select(F.col("k").cast("string").alias("review_id")), back).groupBy("kind").agg(F.count("*").alias("n"))


def _broken(spark, sf_dir) -> DataFrame:
    """One payload a document, some with a violation of each kind."""
    k = F.col("doc_id")
    area = lambda a, i, s: F.struct(a.alias("product_area"), i.alias("issue_type"), s.alias("strength_type"), F.lit("x").alias("evidence_span"), F.lit(0.5).alias("confidence"))
    null = F.lit(None).cast("string")
    one = (
        F.when(k % 8 == 0, F.array(area(F.lit("nowhere"), null, null))).when(k % 8 == 1, F.array(area(F.lit("contact"), F.lit("leaked_email"), F.lit("reachable")))).when(k % 8 == 2, F.array(area(F.lit("contact"), null, null)))
        .when(k % 8 == 3, F.array(area(F.lit("contact"), F.lit("all_caps"), null))).when(k % 8 == 4, F.array(area(F.lit("contact"), null, F.lit("calm")))).when(k % 8 == 5, F.array(area(F.lit("tables"), F.lit("bare_table"), null), area(F.lit("tables"), F.lit("bare_table"), null)))
        .when(k % 8 == 6, F.array(area(F.lit("other"), null, null))).otherwise(F.array(area(F.lit("secrets"), F.lit("leaked_token"), null)))
    )
    sentiment = F.when(k % 9 == 0, "ecstatic").otherwise("positive")
    return table(spark, sf_dir, "documents").select(k.cast("string").alias("review_id"), one.alias("areas"), sentiment.alias("sentiment"), F.lit("praise").alias("customer_intent"), null.alias("severity"))


@query("SELECT CAST(doc_id AS VARCHAR) AS review_id, kind FROM (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'unknown_area' WHEN 1 THEN 'conflicting_polarity' WHEN 2 THEN 'missing_polarity' WHEN 3 THEN 'unknown_issue_type' WHEN 4 THEN 'unknown_strength_type' WHEN 5 THEN 'duplicate_label' END AS kind FROM documents UNION ALL SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'invalid_attribute' END FROM documents) WHERE kind IS NOT NULL")
def taxonomy_issues(spark, sf_dir):
    """M05, J22."""
    return labels.taxonomy_issues(_broken(spark, sf_dir), TAX).select("review_id", "kind")


@query("SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS grounding_rate FROM documents d")
def grounding(spark, sf_dir):
    """a span of the text, and in every third document an invented one."""
    from tallyloom.functions.text import grounding as rate

    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    spans = F.when(k % 3 == 0, F.array(F.concat(F.lit("  "), F.substring("text", 1, 20)), F.lit("zq never said"))).otherwise(F.array(F.substring("text", 1, 20)))
    return d.select("doc_id", rate(F.col("text"), spans).alias("grounding_rate"))


_LABELS = " UNION ALL ".join(
    f"SELECT review_id, platform, year_month, {i} AS place, '{a}' AS product_area, CASE WHEN rating <= 2 THEN '{x['issue_types'][0]}' END AS issue_type, CASE WHEN rating > 2 THEN '{x['strength_types'][0]}' END AS strength_type, regexp_extract(review_text, '(?i)({x['probe']})', 1) AS evidence_span FROM reviews WHERE regexp_matches(review_text, '(?i){x['probe']}')"
    for i, (a, x) in enumerate(TAX.areas.items())
)


@query(with_(REVIEWS, f"l AS ({_LABELS})") + "SELECT review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY place) - 1 AS INTEGER) AS label_no, product_area, issue_type, strength_type, evidence_span, CASE WHEN issue_type IS NULL THEN 'strength' ELSE 'issue' END AS polarity, platform, year_month FROM l")
def flatten_labels(spark, sf_dir):
    """M08, J01, J02, and the offline provider of M09: every label with what it carries."""
    r = reviews(spark, sf_dir)
    items = labels.with_grounding(payloads(spark, sf_dir), r)
    made = labels.flatten(items, r.select("review_id", "platform", "year_month"))[1]
    return made.select("review_id", "label_no", "product_area", "issue_type", "strength_type", "evidence_span", "polarity", "platform", "year_month")


@query(with_(REVIEWS) + f""", d AS (SELECT source_row_index AS k, ({_NHITS}) > 0 AS hit, rating FROM reviews WHERE source_row_index % 4 <> 0), g AS (SELECT *, CASE WHEN k % 6 = 1 AND hit THEN 0.0 ELSE 1.0 END AS rate FROM d)
 SELECT (SELECT count(*) FROM reviews) AS requested, count(*) AS enriched, avg(rate) AS mean_grounding, avg(CAST(rate = 1 AS INTEGER)) AS fully_grounded, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM reviews) AS coverage,
   (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT 'unknown_area:' || sum(areas) AS x FROM (SELECT """ + _NHITS + """ AS areas FROM reviews WHERE source_row_index % 4 <> 0 AND source_row_index % 6 = 2))) AS issues FROM g""", "mean_grounding fully_grounded coverage")
def run_report(spark, sf_dir):
    """A quarter of the reviews has no payload, a sixth of the others quotes what isn't there, a sixth names areas that aren't."""
    r, k = reviews(spark, sf_dir), F.col("review_id").cast("long")
    spoilt = F.transform("areas", lambda a: a.withField("evidence_span", F.lit("nobody wrote this at all")))
    made = payloads(spark, sf_dir).where(k % 4 != 0).withColumns({"areas": F.when(k % 6 == 1, spoilt).when(k % 6 == 2, F.transform("areas", lambda a: a.withField("product_area", F.lit("nowhere")))).otherwise(F.col("areas"))})
    items = labels.with_grounding(made, r)
    found, _ = labels.flatten(items, r.select("review_id", "platform"))
    report = labels.run_report(r, found, labels.taxonomy_issues(items, TAX))
    return report.withColumn("issues", F.array_join(F.transform("issues", lambda x: F.concat(x.kind, F.lit(":"), x.n)), ","))


@query("SELECT review_id, count(*) AS n_labels, bool_and(grounded) AS grounded FROM (" + " UNION ALL ".join(f"SELECT CAST(doc_id AS VARCHAR) AS review_id, true AS grounded FROM documents WHERE regexp_matches(text, '(?i){p}')" for p in PROBES.values()) + ") GROUP BY 1")
def enrich_offline(spark, sf_dir):
    """The loop over the whole corpus with the provider that needs no network; what it quotes is grounded."""
    r = reviews(spark, sf_dir).select("review_id", "review_text")
    got = enrichment.enrich_corpus(r, labels.system_prompt(TAX), TAX, enrichment.OfflineProvider(TAX), size=20, concurrency=spark.sparkContext.defaultParallelism)
    return got.items.select("review_id", F.explode("areas"), "grounding_rate").groupBy("review_id").agg(F.count("*").alias("n_labels"), (F.min("grounding_rate") == 1).alias("grounded"))


@query(with_(ORDER_REVIEWS, ITEM_LABELS) + "SELECT DISTINCT product_area, issue_type FROM item_labels")
def label_pairs(spark, sf_dir):
    """U05."""
    return labels.label_pairs(item_labels(spark, sf_dir))


def sample_sql(source: str, n: int, by: str, seed: int = 42) -> str:
    """Rows of a sample in proportion, in md5 order, as tables quota and picked."""
    same = " AND ".join(f"o.{c} IS NOT DISTINCT FROM q.{c}" for c in by.split(", "))
    return f"""quota AS (SELECT {by}, round_even(count(*) * least(CAST(1 AS DOUBLE), CAST({n} AS DOUBLE) / (SELECT count(*) FROM {source})), 0) AS quota FROM {source} GROUP BY ALL),
 o AS (SELECT *, md5(concat_ws(':', '{seed}', review_id)) AS h FROM {source}),
 picked AS (SELECT o.* FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY h, review_id) AS place FROM o) o JOIN quota q ON {same} WHERE place <= quota ORDER BY h, review_id LIMIT {n})"""


@query(with_(REVIEWS, sample_sql("reviews", 100, "platform, sentiment")) + "SELECT review_id, platform, sentiment FROM picked")
def stratified_sample(spark, sf_dir):
    """M10."""
    return labels.stratified_sample(reviews(spark, sf_dir).select("review_id", "platform", "sentiment"), 100, ["platform", "sentiment"])


# --- evaluation ----------------------------------------------------------------------------------------------------

# reference: areas that a probe finds; candidate: the same by another rule (every fifth document without them, every seventh with one more)
_SETS = with_(REVIEWS, f"h AS ({HIT_ROWS})", "ref AS (SELECT review_id, coalesce(list_sort(list(area) FILTER (WHERE hit)), []) AS a FROM h GROUP BY 1)") + """, cand AS (SELECT review_id, list_sort(list_distinct(CASE WHEN CAST(review_id AS BIGINT) % 5 = 0 THEN [] WHEN CAST(review_id AS BIGINT) % 7 = 0 THEN list_append(a, 'tables') ELSE a END)) AS b FROM ref WHERE CAST(review_id AS BIGINT) % 11 <> 0),
 p AS (SELECT review_id, a, b, len(list_intersect(a, b)) AS tp, len(b) - len(list_intersect(a, b)) AS fp, len(a) - len(list_intersect(a, b)) AS fn FROM ref JOIN cand USING (review_id)) """


def _sets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    r = reviews(spark, sf_dir)
    hits = discovery.long_hits(r, PROBES, ["review_id"])
    ref = evaluation.label_sets(hits.where("hit"), F.col("area"), r)
    k = F.col("review_id").cast("long")
    b = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 7 == 0, F.array_union("labels", F.array(F.lit("tables")))).otherwise(F.col("labels"))
    return ref, ref.where(k % 11 != 0).select("review_id", F.array_sort(b).alias("labels"))


@query(_SETS + "SELECT count(*) AS shared, (SELECT count(*) FROM ref) - count(*) AS reference_only, CAST(0 AS BIGINT) AS candidate_only, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) FILTER (WHERE fp + fn = 0) AS exact, avg(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE tp / CAST(tp + fp + fn AS DOUBLE) END) AS mean_jaccard, sum(tp) / nullif(CAST(sum(tp) + sum(fp) AS DOUBLE), 0) AS precision, sum(tp) / nullif(CAST(sum(tp) + sum(fn) AS DOUBLE), 0) AS recall, 2 * sum(tp) / nullif(CAST(2 * sum(tp) + sum(fp) + sum(fn) AS DOUBLE), 0) AS f1 FROM p", "mean_jaccard precision recall f1")
def multilabel_score(spark, sf_dir):
    """E04, J08, U02, U03, F21."""
    return evaluation.score_multilabel(*_sets(spark, sf_dir))


@query(_SETS + ", x AS (SELECT review_id, unnest(a) AS label FROM p), y AS (SELECT review_id, unnest(b) AS label FROM p), j AS (SELECT coalesce(x.label, y.label) AS label, x.label IS NOT NULL AS i, y.label IS NOT NULL AS o FROM x FULL JOIN y ON x.review_id = y.review_id AND x.label = y.label), g AS (SELECT label, count(*) FILTER (WHERE i AND o) AS tp, count(*) FILTER (WHERE NOT i AND o) AS fp, count(*) FILTER (WHERE i AND NOT o) AS fn FROM j GROUP BY 1) SELECT *, tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS precision, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS recall, CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END AS f1, tp + fn AS support FROM g", "precision recall f1")
def per_label(spark, sf_dir):
    """E05."""
    return evaluation.per_label_scores(*_sets(spark, sf_dir))


@query(_SETS + "SELECT review_id, array_to_string(a, ',') AS labels FROM ref")
def label_sets(spark, sf_dir):
    """E09."""
    return _sets(spark, sf_dir)[0].select("review_id", F.array_join("labels", ",").alias("labels"))


@query(_SETS + "SELECT review_id FROM p WHERE a <> b")
def disagreement(spark, sf_dir):
    """U06."""
    return evaluation.disagreements(*_sets(spark, sf_dir))


def kappa_sql(source: str, by: str = "") -> str:
    c, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    g = f"GROUP BY {by}" if by else ""
    w = f"PARTITION BY {by}" if by else ""
    return f"""t AS (SELECT {c}count(*) AS n, count(*) FILTER (WHERE a = b) AS agree FROM {source} {g}), ra AS (SELECT {c}a AS v, count(*) AS na FROM {source} GROUP BY ALL), rb AS (SELECT {c}b AS v, count(*) AS nb FROM {source} GROUP BY ALL),
 ex AS (SELECT {c}sum(na * nb) AS prod FROM ra JOIN rb USING ({c}v) {g}), tp AS (SELECT DISTINCT {c}max(na) OVER ({w}) AS top FROM ra),
 k AS (SELECT {c}n, agree, agree / CAST(n AS DOUBLE) AS accuracy, top / CAST(n AS DOUBLE) AS majority_baseline, coalesce(prod, 0) / (CAST(n AS DOUBLE) * n) AS e FROM t LEFT JOIN ex {on} JOIN tp {on})
 SELECT {c}n, agree, accuracy, majority_baseline, accuracy - majority_baseline AS lift, CASE WHEN e < 1 THEN (accuracy - e) / (1 - e) END AS kappa FROM k"""


@query("WITH z AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), " + kappa_sql("z"), "accuracy majority_baseline lift kappa")
def kappa(spark, sf_dir):
    """E06, E07."""
    return evaluation.score_categorical(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("SELECT quality AS reference, toxic AS candidate, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL")
def confusion(spark, sf_dir):
    """E08."""
    return evaluation.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


_AGREE = with_(REVIEWS) + ", q AS (SELECT sentiment AS sa, CASE WHEN source_row_index % 9 = 0 THEN 'mixed' ELSE sentiment END AS sb, customer_intent AS ia, CASE WHEN source_row_index % 4 = 0 THEN 'complaint' ELSE customer_intent END AS ib FROM reviews), z AS (SELECT 'sentiment' AS field, sa AS a, sb AS b FROM q UNION ALL SELECT 'customer_intent', ia, ib FROM q), "


@query(_AGREE + kappa_sql("z", "field"), "accuracy majority_baseline lift kappa")
def agreement(spark, sf_dir):
    """Agreement of two models' fields."""
    r = reviews(spark, sf_dir)
    k = F.col("source_row_index")
    other = r.select("review_id", F.when(k % 9 == 0, "mixed").otherwise(F.col("sentiment")).alias("sentiment"), F.when(k % 4 == 0, "complaint").otherwise(F.col("customer_intent")).alias("customer_intent"))
    ref, cand = _sets(spark, sf_dir)
    return evaluation.compare_models(ref, cand, r, other, ["sentiment", "customer_intent"])[1]


_INT = """SELECT count(*) AS total_labels, count(*) FILTER (WHERE k % 8 = 0) AS unknown_area, count(*) FILTER (WHERE k % 8 IN (3)) AS invalid_issue_type, count(*) FILTER (WHERE k % 8 = 4) AS invalid_strength_type, count(*) FILTER (WHERE k % 8 IN (0, 2, 6)) AS no_polarity,
 count(*) FILTER (WHERE k % 8 IN (1, 5, 7)) AS clean_labels, count(*) FILTER (WHERE k % 8 = 6) AS fallback_labels, count(DISTINCT k) FILTER (WHERE k % 8 = 6) AS fallback_reviews FROM (SELECT doc_id AS k FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 8 = 5)"""


@query(f"SELECT i.*, n AS reviews, below AS reviews_below_full, g AS mean_grounding, fallback_reviews / CAST(n AS DOUBLE) AS fallback_share, fallback_reviews / CAST(n AS DOUBLE) > 0.1 AS breached FROM ({_INT}) i, (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 10 < 10) AS below, avg((doc_id % 10) / 10.0) AS g FROM documents)", "mean_grounding fallback_share")
def integrity_audit(spark, sf_dir):
    """E11, F32."""
    lab = _broken(spark, sf_dir).select("review_id", F.inline("areas"))
    return evaluation.integrity_audit(lab, reviews(spark, sf_dir), TAX)


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'contact/leaked_email;tables/+tidy_table' WHEN 1 THEN 'contact!unknown_issue' WHEN 2 THEN '' WHEN 3 THEN 'mars!unknown_area' ELSE 'secrets!no_label' END AS parsed, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false END AS support_escalation, doc_id % 5 <> 2 OR doc_id % 3 <> 2 AS labelled FROM documents")
def gold_parse(spark, sf_dir):
    """F27, G05."""
    k = F.col("doc_id")
    t = F.when(k % 5 == 0, "contact/leaked_email; tables/+tidy_table").when(k % 5 == 1, "contact/all_caps").when(k % 5 == 2, "").when(k % 5 == 3, "mars/all_caps").otherwise("secrets")
    rows = table(spark, sf_dir, "documents").select("doc_id", k.cast("string").alias("review_id"), k.alias("row_no"), t.alias("labels"), F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "false").otherwise("").alias("support_escalation"), *[F.lit("").alias(f) for f in TAX.attributes])
    g = evaluation.load_gold(rows, TAX)
    show = F.array_join(F.transform("parsed", lambda p: F.when(p.problem.isNotNull(), F.concat(p.area, F.lit("!"), p.problem)).when(p.strength.isNotNull(), F.concat(p.area, F.lit("/+"), p.strength)).otherwise(F.concat(p.area, F.lit("/"), p.issue))), ";")
    return g.select("doc_id", show.alias("parsed"), "support_escalation", "labelled")


@query(_SETS + ", s AS (SELECT *, CASE WHEN CAST(review_id AS BIGINT) % 2 = 0 THEN 'random' WHEN CAST(review_id AS BIGINT) % 3 = 0 THEN 'disagreement' ELSE 'unknown' END AS stratum FROM p) SELECT stratum, count(*) AS shared, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) >= 30 AS sufficient FROM s GROUP BY 1")
def gold_score(spark, sf_dir):
    """G06, J03."""
    ref, cand = _sets(spark, sf_dir)
    k = F.col("review_id").cast("long")
    prov = ref.select("review_id", F.when(k % 2 == 0, "random").when(k % 3 == 0, "disagreement").alias("stratum"))
    # gold rows in the mini-language, scored against the candidate
    gold = ref.select("review_id", F.lit(True).alias("labelled"), F.transform("labels", lambda a: F.struct(a.alias("area"), F.lit(None).cast("string").alias("problem"))).alias("parsed"))
    return evaluation.score_gold(gold, prov, cand).select("stratum", "shared", "tp", "fp", "fn", "sufficient")


@query()
def fault_study(spark, sf_dir):
    """E14-E16 on rule-based payloads."""
    r = reviews(spark, sf_dir)
    return evaluation.fault_study(payloads(spark, sf_dir), r, TAX, 100)


@query()
def fault_summary(spark, sf_dir):
    """E17."""
    return evaluation.fault_summary(evaluation.fault_study(payloads(spark, sf_dir), reviews(spark, sf_dir), TAX, 100))


@query(_SETS + ", bucketed AS (SELECT *, CASE WHEN rating <= 2 THEN 'negative' ELSE 'other' END AS rating_bucket FROM reviews), " + sample_sql("bucketed", 100, "platform, rating_bucket") + """,
 hard AS (SELECT review_id FROM reviews WHERE review_id IN (SELECT review_id FROM p WHERE a <> b) AND review_id NOT IN (SELECT review_id FROM picked) ORDER BY md5(concat_ws(':', '43', review_id)), review_id LIMIT 50)
 SELECT review_id, 'random' AS stratum FROM picked UNION ALL SELECT review_id, 'disagreement' FROM hard""")
def gold_sample(spark, sf_dir):
    """G01-G03."""
    r = reviews(spark, sf_dir).withColumn("rating_bucket", F.when(F.col("rating") <= 2, "negative").otherwise("other"))
    ref, cand = _sets(spark, sf_dir)
    return evaluation.provenance(evaluation.gold_sample(r, evaluation.disagreements(ref, cand), 100, 50))


# --- vectors -------------------------------------------------------------------------------------------------------


def _first_vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 7").first().embedding]


_DOT = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: CAST(v.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE)))"
_NEAR = f"SELECT v.vec_id, v.label, {_DOT} AS score FROM embeddings v, embeddings q WHERE q.vec_id = 7"


@query(f"{_NEAR} ORDER BY score DESC, v.vec_id LIMIT 10", "score")
def knn(spark, sf_dir):
    """V02, J13, L07, S16."""
    return retrieval.top_k(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10).select("vec_id", "label", "score")


@query(f"SELECT vec_id, label, score, count(*) OVER () < 8 AS truncated FROM (SELECT * FROM ({_NEAR} ORDER BY score DESC, v.vec_id LIMIT 96) WHERE label IN (1, 2) ORDER BY score DESC, vec_id LIMIT 8)", "score")
def filtered_search(spark, sf_dir):
    """Ranked and cut before the filter."""
    return retrieval.search(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 8, F.col("label").isin(1, 2)).select("vec_id", "label", "score", "truncated")


_RE_CI = wilson_sql("relevant", "retrieved")
_REVAL = f"""WITH c AS (SELECT CAST(label AS VARCHAR) AS area, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL), q AS (SELECT area, list(x ORDER BY i) AS qv FROM c GROUP BY 1), sup AS (SELECT CAST(label AS VARCHAR) AS area, count(*) AS support FROM embeddings GROUP BY 1 HAVING count(*) >= 30),
 s AS (SELECT q.area, vec_id, CAST(label AS VARCHAR) = q.area AS hit, row_number() OVER (PARTITION BY q.area ORDER BY round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * qv[i])), 9) DESC, vec_id) AS k FROM embeddings, q SEMI JOIN sup USING (area)),
 g AS (SELECT area, count(*) AS retrieved, count(*) FILTER (WHERE hit) AS relevant FROM s WHERE k <= 8 GROUP BY 1),
 e AS (SELECT area, retrieved, relevant, support, relevant / CAST(retrieved AS DOUBLE) AS precision_at_k, {_RE_CI[0]} AS ci_low, {_RE_CI[1]} AS ci_high, support / (SELECT CAST(count(*) AS DOUBLE) FROM embeddings) AS base_rate FROM g JOIN sup USING (area)),
 f AS (SELECT *, precision_at_k / base_rate AS lift, ci_low > base_rate AS beats_base_rate FROM e) """


def _retrieval(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("area", F.col("label").cast("string"))
    mean = e.select("area", F.posexplode("embedding").alias("i", "x")).groupBy("area", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    q = mean.groupBy(F.col("area").alias("query")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("qv"))
    return retrieval.evaluate_retrieval(e, q, e.select("area", F.col("vec_id").alias("id")), 8, 30)


@query(_REVAL + "SELECT * FROM f", "precision_at_k ci_low ci_high base_rate lift")
def retrieval_eval(spark, sf_dir):
    """The mean vector of each label as its query."""
    return _retrieval(spark, sf_dir)


_POOL = wilson_sql("sum(relevant)", "sum(retrieved)")


@query(_REVAL + f"SELECT count(*) AS areas_evaluated, sum(relevant) / CAST(sum(retrieved) AS DOUBLE) AS pooled_precision, {_POOL[0]} AS ci_low, {_POOL[1]} AS ci_high, avg(base_rate) AS mean_base_rate, avg(lift) AS mean_lift, count(*) FILTER (WHERE beats_base_rate) AS areas_beating_base_rate, first(area ORDER BY precision_at_k, area) AS weakest_area FROM f", "pooled_precision ci_low ci_high mean_base_rate mean_lift")
def retrieval_summary(spark, sf_dir):
    """E13."""
    return retrieval.retrieval_summary(_retrieval(spark, sf_dir))


@query("""WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 1e-12)) AS v FROM embeddings),
 c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS x FROM n, range(1, 65) t(i) GROUP BY ALL) GROUP BY 1),
 s AS (SELECT label, vec_id, list_sum(list_transform(range(1, 65), lambda i: v[i] * c[i])) / sqrt(list_sum(list_transform(c, lambda y: y * y))) AS similarity FROM n JOIN c USING (label))
 SELECT label, vec_id, similarity, CAST(k AS INTEGER) AS exemplar_rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(similarity, 12) DESC, vec_id) AS k FROM s) WHERE k <= 3""", "similarity")
def exemplars(spark, sf_dir):
    """W10, C03, F23 on given labels."""
    e = table(spark, sf_dir, "embeddings")
    return cluster.exemplars(e, e.select("vec_id", "label"), 3, cluster_col="label")


@query()
def kmeans_silhouette(spark, sf_dir):
    """C01."""
    c = cluster.choose_k(table(spark, sf_dir, "embeddings"))
    return spark.createDataFrame([(k, float(s), k == c.k) for k, s in c.scores.items()], "k int, silhouette double, chosen boolean")


@query(with_(REVIEWS) + f""", a AS (SELECT label AS cluster, r.* FROM embeddings e JOIN reviews r ON e.vec_id = r.source_row_index), tp AS (SELECT cluster, platform AS top_platform FROM (SELECT cluster, platform, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, platform) AS k FROM (SELECT cluster, platform, count(*) AS n FROM a GROUP BY ALL)) WHERE k = 1)
 SELECT cluster, count(*) AS size, avg({_RANK}) AS mean_severity, avg(CAST(support_escalation AS INTEGER)) AS escalation_rate, avg(CAST(sentiment = 'negative' AS INTEGER)) AS negative_share, avg(rating) AS mean_rating, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM a) AS share, any_value(top_platform) AS top_platform FROM a JOIN tp USING (cluster) GROUP BY 1""", "mean_severity escalation_rate negative_share mean_rating share")
def cluster_summary(spark, sf_dir):
    """A33 on given labels."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("review_id"), F.col("label").alias("cluster"))
    return cluster.cluster_summary(e, reviews(spark, sf_dir), "review_id")


@query(with_(REVIEWS) + "SELECT count(*) AS reviews, count(DISTINCT platform) AS platforms, count(DISTINCT year_month) AS months, count(DISTINCT year_month) FILTER (WHERE in_comparable_window) AS comparable_months FROM reviews")
def corpus_summary(spark, sf_dir):
    """A35."""
    return eda.corpus_summary(reviews(spark, sf_dir))


class LetterCounts:
    """An encoder that any engine can follow: how often a text has each of eight letters."""

    def encode(self, texts, batch_size):
        return [[t.count(c) for c in "aehinost"] for t in texts]


_COUNTS = "[" + ", ".join(f"length({{0}}) - length(replace({{0}}, '{c}', ''))" for c in "aehinost") + "]"
_UNIT = "list_transform(c, lambda x: CAST(x / greatest(sqrt(list_sum(list_transform(c, lambda y: CAST(y * y AS DOUBLE)))), 1e-12) AS FLOAT))"


@query("WITH d AS (SELECT doc_id, " + _COUNTS.format("text") + " AS c FROM documents), e AS (SELECT doc_id, " + _UNIT + " AS v FROM d), q AS (SELECT " + _UNIT + " AS q FROM (SELECT " + _COUNTS.format("'the station on the east side'") + """ AS c))
 SELECT doc_id, list_sum(list_transform(range(1, 9), lambda i: CAST(v[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))) AS score FROM e, q ORDER BY round(score, 9) DESC, doc_id LIMIT 20""", "score")
def encoded_search(spark, sf_dir):
    """Documents encoded by an encoder that workers make, searched with an encoded text."""
    d = table(spark, sf_dir, "documents")
    made = retrieval.encode_texts(d, LetterCounts, 64, "doc_id", "text")
    asked = retrieval.encode_texts(spark.createDataFrame([(0, "the station on the east side")], "id int, t string"), LetterCounts, 1, "id", "t").first().embedding
    scored = made.select("doc_id", dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in asked])).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(20)


@query("""WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 1e-12)) AS v FROM embeddings),
 d AS (SELECT a.vec_id, a.label, b.label AS other, 1 - list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) AS far FROM n a JOIN n b ON a.vec_id <> b.vec_id),
 m AS (SELECT vec_id, label, other, avg(far) AS far FROM d GROUP BY ALL), ab AS (SELECT vec_id, label, max(far) FILTER (other = label) AS a, min(far) FILTER (other <> label) AS b FROM m GROUP BY ALL)
 SELECT label, count(*) AS size, avg(coalesce((b - a) / greatest(a, b), 0)) AS silhouette FROM ab GROUP BY 1""", "silhouette")
def label_silhouette(spark, sf_dir):
    """C01's measure, over all vectors, for given clusters; the SQL takes all pairs."""
    e = table(spark, sf_dir, "embeddings")
    return cluster.silhouette(e, e.select("vec_id", "label"), cluster_col="label")


def causes_by_rule(system, message):
    """A provider whose replies go wrong by issue type, as models' do."""
    import json
    import re

    issue = message.split("\n")[0].split(" / ")[-1]
    ids = re.findall(r"(?m)^\[([^\]]+)\] ", message)
    one = {"hypothesis": "h", "mechanism": "m", "supporting_review_ids": ids, "disconfirming_evidence": "little", "proposed_check": "c", "confidence": 0.5}
    if issue == "SMALL":
        return "I can't say."
    if issue == "MEDIUM":
        return json.dumps([one | {"confidence": 7}])
    change = {"PROMO": {"supporting_review_ids": [*ids, "nobody"]}, "ECONOMY": {"supporting_review_ids": []}, "LARGE": {"disconfirming_evidence": " "}}.get(issue, {})
    return "Here: " + json.dumps({"hypotheses": [one, one | change]}) + " Done."


@query(_PP + """, n AS (SELECT product_area, issue_type, CASE WHEN issue_type IN ('SMALL', 'MEDIUM') THEN 0 WHEN issue_type IN ('PROMO', 'ECONOMY') THEN 1 ELSE 2 END AS kept, CASE issue_type WHEN 'SMALL' THEN 'unparseable_response' WHEN 'MEDIUM' THEN 'schema_violation' WHEN 'PROMO' THEN 'invented_citation' WHEN 'ECONOMY' THEN 'uncited_hypothesis' WHEN 'LARGE' THEN 'no_disconfirming_evidence' END AS issue FROM pp),
 ev AS (SELECT product_area, issue_type, review_id FROM (SELECT *, row_number() OVER (PARTITION BY product_area, issue_type ORDER BY confidence DESC NULLS LAST, review_id, label_no) AS k FROM item_labels WHERE polarity = 'issue') WHERE k <= 3),
 c AS (SELECT product_area, issue_type, array_to_string(list_sort(list(DISTINCT review_id)), ',') AS cited FROM ev GROUP BY ALL)
 SELECT product_area, issue_type, kept, coalesce(issue, '') AS issue, CASE WHEN kept > 0 THEN cited ELSE '' END AS cited FROM n JOIN c USING (product_area, issue_type)""")
def root_causes(spark, sf_dir):
    """Prompt, reply, tolerant parse, schema and citation check for every pain point."""
    lab, rev = item_labels(spark, sf_dir), order_reviews(spark, sf_dir)
    pts = painpoints.pain_points(lab, rev, 100)
    kept, issues = rice.generate_hypotheses(pts, painpoints.evidence(lab), causes_by_rule)
    cited = F.array_sort(F.array_distinct(F.flatten(F.collect_list("supporting_review_ids"))))
    n = kept.groupBy(*painpoints.KEYS).agg(F.count("*").cast("int").alias("kept"), F.array_join(cited, ",").alias("cited"))
    what = issues.groupBy(*painpoints.KEYS).agg(F.array_join(F.array_sort(F.collect_set("issue")), ",").alias("issue"))
    out = pts.select(*painpoints.KEYS).join(n, painpoints.KEYS, "left").join(what, painpoints.KEYS, "left")
    return out.select(*painpoints.KEYS, F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("issue", F.lit("")).alias("issue"), F.coalesce("cited", F.lit("")).alias("cited"))
