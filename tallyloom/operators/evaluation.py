"""Label-quality evaluation: multi-label and categorical scores, agreement, integrity, gold sets, faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import jaccard, ratio, wilson
from tallyloom.functions.text import first_percent
from tallyloom.ordered import hash_order
from tallyloom.operators.labels import schema_valid, stratified_sample, taxonomy_issues, with_grounding
from tallyloom.sources.config import Taxonomy
from tallyloom.sources.tables import numbered_csv
from tallyloom.storage import Workspace

_SET = "array<string>"


def rate(hits: Column, total: Column) -> tuple[Column, Column, Column]:
    """(value, low, high); null without observations."""
    low, high = wilson(hits, total)
    some = total > 0
    return F.when(some, ratio(hits, total)), F.when(some, low), F.when(some, high)


def label_sets(labels: DataFrame, value: Column, ids: DataFrame | None = None, id_col: str = "review_id") -> DataFrame:
    """(id, labels) as a sorted set; ids gives further ids, with empty sets."""
    s = labels.groupBy(id_col).agg(F.array_sort(F.collect_set(value)).alias("labels"))
    if ids is None:
        return s
    return ids.select(id_col).distinct().join(s, id_col, "full").select(id_col, F.coalesce("labels", F.array().cast(_SET)).alias("labels"))


def _paired(reference: DataFrame, candidate: DataFrame, value: str, id_col: str) -> DataFrame:
    a, b = reference.select(id_col, F.col(value).alias("a"), F.lit(True).alias("in_a")), candidate.select(id_col, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    return a.join(b, id_col, "full")


def score_multilabel(reference: DataFrame, candidate: DataFrame, id_col: str = "review_id", by: list[str] | None = None) -> DataFrame:
    """Micro counts and scores over the ids that both have, and how many only one has. by: columns of reference."""
    keep = by or []
    p = _paired(reference, candidate, "labels", id_col)
    if keep:
        p = p.join(reference.select(id_col, *keep), id_col, "left")
    both = F.col("in_a") & F.col("in_b")
    tp, fp, fn = F.size(F.array_intersect("a", "b")), F.size(F.array_except("b", "a")), F.size(F.array_except("a", "b"))
    p = p.withColumns({"_tp": F.when(both, tp), "_fp": F.when(both, fp), "_fn": F.when(both, fn), "_ex": F.when(both, (fp + fn == 0).cast("int")), "_j": F.when(both, jaccard(F.col("a"), F.col("b")))})
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = [F.count_if(both).alias("shared"), F.count_if(F.col("in_b").isNull()).alias("reference_only"), F.count_if(F.col("in_a").isNull()).alias("candidate_only"), s("_tp").alias("tp"), s("_fp").alias("fp"), s("_fn").alias("fn"), s("_ex").alias("exact"), F.avg("_j").alias("mean_jaccard")]
    g = p.groupBy(*keep).agg(*counts) if keep else p.agg(*counts)
    return prf(g)


def prf(g: DataFrame) -> DataFrame:
    """g (tp, fp, fn) with precision, recall and F1, null where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": F.when(tp + fp > 0, F.when(tp + fn > 0, ratio(2 * tp, 2 * tp + fp + fn)))})


def per_label_scores(reference: DataFrame, candidate: DataFrame, id_col: str = "review_id") -> DataFrame:
    """Scores of each label over the shared ids; support is its count in the reference."""
    shared = reference.select(id_col).join(candidate.select(id_col), id_col, "left_semi")
    long = lambda d, name: d.join(shared, id_col, "left_semi").select(id_col, F.explode("labels").alias("label"), F.lit(True).alias(name))
    m = long(reference, "ra").join(long(candidate, "cb"), [id_col, "label"], "full")
    a, b = F.col("ra").isNotNull(), F.col("cb").isNotNull()
    return prf(m.groupBy("label").agg(F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fp"), F.count_if(a & ~b).alias("fn"))).withColumn("support", F.col("tp") + F.col("fn"))


def score_categorical(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy, majority baseline, lift over it and Cohen's kappa (null if agreement by chance is certain). Rows with a null are left out."""
    by = by or []
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    # marginals from the cells: a row for each value
    rows = cells.groupBy(*by, "a").agg(F.sum("n").alias("na"))
    cols = cells.groupBy(*by, F.col("b").alias("a")).agg(F.sum("n").alias("nb"))
    m = rows.join(cols, [*by, "a"], "full").na.fill(0, ["na", "nb"])
    one = [*by, F.lit(1).alias("_one")]
    marg = m.groupBy(*one).agg(F.sum(F.col("na") * F.col("nb")).alias("_prod"), F.max("na").alias("_top"))
    tot = cells.groupBy(*one).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("agree"))
    n = F.col("n").cast("double")
    d = tot.join(marg, [*by, "_one"]).withColumns({"accuracy": F.col("agree") / n, "majority_baseline": F.col("_top") / n, "_exp": F.col("_prod") / (n * n)})
    d = d.withColumns({"lift": F.col("accuracy") - F.col("majority_baseline"), "kappa": F.when(F.col("_exp") < 1, (F.col("accuracy") - F.col("_exp")) / F.nullif(1 - F.col("_exp"), F.lit(0.0)))})
    return d.select(*by, "n", "agree", "accuracy", "majority_baseline", "lift", "kappa")


def confusion(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(reference, candidate, n), long; pivot it for display."""
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("reference"), F.col(b).alias("candidate")).agg(F.count("*").alias("n"))


def compare_models(a_sets: DataFrame, b_sets: DataFrame, a_fields: DataFrame, b_fields: DataFrame, fields: list[str], id_col: str = "review_id") -> tuple[DataFrame, DataFrame]:
    """Agreement (not accuracy) of two models: set scores, and a row of categorical scores for each field."""
    sets = score_multilabel(a_sets, b_sets, id_col)
    p = a_fields.select(id_col, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields]).join(b_fields.select(id_col, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields]), id_col)
    long = p.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")) for f in fields])))
    return sets, score_categorical(long, "a", "b", ["field"])


def disagreements(a: DataFrame, b: DataFrame, id_col: str = "review_id") -> DataFrame:
    """Ids that both have with different sets."""
    return a.select(id_col, F.array_sort("labels").alias("x")).join(b.select(id_col, F.array_sort("labels").alias("y")), id_col).where("x <> y").select(id_col)


def integrity_masks(labels: DataFrame, tax: Taxonomy) -> DataFrame:
    """Labels with the four masks, which overlap. The taxonomy's pairs are literals, bounded by its document."""
    def invalid(column: str, kind: str) -> Column:
        pairs = F.array(*[F.lit(f"{a}/{x}") for a, x in tax.pairs(kind)])
        v = F.col(column)
        return F.coalesce((v != "") & (F.col("product_area") != tax.fallback) & ~F.array_contains(pairs, F.concat_ws("/", "product_area", v)), F.lit(False))

    return labels.withColumns({
        "unknown_area": ~F.coalesce(F.col("product_area").isin([*tax.areas, tax.fallback]), F.lit(False)), "invalid_issue_type": invalid("issue_type", "issue_types"),
        "invalid_strength_type": invalid("strength_type", "strength_types"), "no_polarity": F.col("issue_type").isNull() & F.col("strength_type").isNull(),
    })


def integrity_audit(labels: DataFrame, reviews: DataFrame, tax: Taxonomy, threshold: float | None = None) -> DataFrame:
    """One row: labels, each mask, clean labels (no mask), the fallback area's share against its threshold, grounding below 1.

    The threshold is the percentage that the taxonomy's own monitoring rule names, unless one is given.
    """
    m = integrity_masks(labels, tax)
    names = ["unknown_area", "invalid_issue_type", "invalid_strength_type", "no_polarity"]
    bad = F.lit(False)
    for n in names:
        bad = bad | F.col(n)
    fb = F.col("product_area") == tax.fallback
    a = m.agg(F.count("*").alias("total_labels"), *[F.count_if(n).alias(n) for n in names], F.count_if(~bad).alias("clean_labels"), F.count_if(fb).alias("fallback_labels"), F.count_distinct(F.when(fb, F.col("review_id"))).alias("fallback_reviews"))
    r = reviews.agg(F.count("*").alias("reviews"), F.count_if(F.col("grounding_rate") < 1).alias("reviews_below_full"), F.avg("grounding_rate").alias("mean_grounding"))
    return a.crossJoin(F.broadcast(r)).withColumn("fallback_share", F.coalesce(ratio(F.col("fallback_reviews"), F.col("reviews")), F.lit(0.0))).withColumn("breached", F.col("fallback_share") > (first_percent(F.lit(tax.rule)) if threshold is None else F.lit(threshold)))


# --- gold sets -----------------------------------------------------------------------------------------------------


def gold_sample(reviews: DataFrame, disagree: DataFrame, n_random: int = 100, n_hard: int = 50, by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """A stratified random part and a disjoint part of hard cases, with `stratum`, in shuffled order."""
    base = stratified_sample(reviews, n_random, by or ["platform", "rating_bucket"], seed=seed).withColumn("stratum", F.lit("random"))
    hard = reviews.join(disagree, "review_id", "left_semi").join(base.select("review_id"), "review_id", "left_anti")
    hard = hard.orderBy(hash_order("review_id", seed + 1), "review_id").limit(n_hard).withColumn("stratum", F.lit("disagreement"))
    return base.unionByName(hard).orderBy(hash_order("review_id", seed + 2), "review_id")


TEMPLATE_FIELDS = ["labels", "sentiment", "severity", "customer_intent", "support_escalation", "notes"]


def gold_template(sample: DataFrame) -> DataFrame:
    """What annotators get: no predictions, no stratum."""
    return sample.select("review_id", "platform", "rating", "review_text", *[F.lit("").alias(f) for f in TEMPLATE_FIELDS])


def provenance(sample: DataFrame) -> DataFrame:
    """G03."""
    return sample.select("review_id", "stratum")


def annotation_guide(tax: Taxonomy) -> str:
    """G04."""
    areas = "\n".join(f"- `{a}`: issues {', '.join(x['issue_types'])}; strengths {', '.join('+' + s for s in x['strength_types'])}" for a, x in tax.areas.items())
    fields = "\n".join(f"- {k}: {', '.join(v)}" for k, v in tax.attributes.items())
    return f"# Annotation guide\n\nWrite labels as `area/issue; area/+strength`. Leave a row blank to skip it.\n\n## Areas\n{areas}\n\n## Fields\n{fields}\n- support_escalation: yes or no\n"


def parse_tokens(df: DataFrame, tax: Taxonomy, column: str = "labels") -> DataFrame:
    """`area/issue; area/+strength` as `parsed` (array of area, issue, strength, problem). A known area stays with a wrong label noted."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), ";"), F.trim), lambda x: x != "")
    issues, strengths = (F.array(*[F.lit(f"{a}/{x}") for a, x in tax.pairs(k)]) for k in ("issue_types", "strength_types"))

    def one(t: Column) -> Column:
        area, sub = F.trim(F.substring_index(t, "/", 1)), F.when(F.contains(t, F.lit("/")), F.trim(F.substr(t, F.instr(t, "/") + 1)))
        strength = F.when(sub.startswith("+"), F.trim(F.substr(sub, F.lit(2))))
        issue = F.when(~sub.startswith("+") & (sub != ""), sub)
        problem = (
            F.when(~area.isin([*tax.areas, tax.fallback]), "unknown_area").when((area != tax.fallback) & issue.isNull() & strength.isNull(), "no_label")
            .when(issue.isNotNull() & ~F.array_contains(issues, F.concat_ws("/", area, issue)), "unknown_issue").when(strength.isNotNull() & ~F.array_contains(strengths, F.concat_ws("/", area, strength)), "unknown_strength")
        )
        return F.struct(area.alias("area"), issue.alias("issue"), strength.alias("strength"), problem.alias("problem"))

    return df.withColumn("parsed", F.transform(parts, one))


def format_tokens(labels: DataFrame) -> DataFrame:
    """(review_id, labels) in the mini-language; a strength wins if both are set."""
    t = F.when(F.col("strength_type").isNotNull(), F.concat("product_area", F.lit("/+"), "strength_type")).when(F.col("issue_type").isNotNull(), F.concat_ws("/", "product_area", "issue_type")).otherwise(F.col("product_area"))
    return labels.groupBy("review_id").agg(F.array_join(F.array_sort(F.collect_set(t)), "; ").alias("labels"))


def load_gold(rows: DataFrame, tax: Taxonomy, order: str = "row_no") -> DataFrame:
    """Gold rows with parsed labels, typed fields, `labelled`, `issues`; of repeated ids the first row is kept and notes it."""
    d = parse_tokens(rows, tax)
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    esc = F.lower(F.trim(F.coalesce(F.col("support_escalation").cast("string"), F.lit(""))))
    flag = F.when(esc.isin("true", "yes", "1", "y"), True).when(esc.isin("false", "no", "0", "n"), False)
    empty = blank("labels") & (esc == "")
    fields, notes = {}, [F.when((esc != "") & flag.isNull(), F.lit("invalid_support_escalation"))]
    for f, allowed in tax.attributes.items():
        v = F.lower(F.trim(F.coalesce(F.col(f), F.lit(""))))
        fields[f] = F.when(v.isin(allowed), v)
        notes.append(F.when((v != "") & ~v.isin(allowed), F.lit(f"invalid_{f}")))
        empty = empty & blank(f)
    w = Window.partitionBy("review_id")
    d = d.withColumn("_r", F.row_number().over(w.orderBy(order))).withColumn("_c", F.count("*").over(w)).where("_r = 1")
    notes.append(F.when(F.col("_c") > 1, F.lit("duplicate_review_id")))
    problems = F.transform(F.filter("parsed", lambda p: p.problem.isNotNull()), lambda p: F.concat_ws(":", p.problem, p.area))
    return d.withColumns({"issues": F.concat(problems, F.array_compact(F.array(*notes))), "labelled": ~empty}).withColumns({**fields, "support_escalation": flag}).drop("_r", "_c")


def gold_sets(gold: DataFrame, strict: bool = False) -> DataFrame:
    """(review_id, labels): areas of each labelled row. A known area with a wrong sub-label counts, unless strict."""
    ok = lambda p: p.problem.isNull() if strict else p.problem.isNull() | (p.problem != "unknown_area")
    return gold.where("labelled").select("review_id", F.array_sort(F.array_distinct(F.transform(F.filter("parsed", ok), lambda p: p.area))).alias("labels"))


def gold_pairs(gold: DataFrame) -> DataFrame:
    """(review_id, labels): area and label of each labelled row, as `area/issue` or `area/+strength`; only labels without a problem."""
    pair = lambda p: F.concat(p.area, F.lit("/"), F.coalesce(F.concat(F.lit("+"), p.strength), p.issue))
    made = F.transform(F.filter("parsed", lambda p: p.problem.isNull()), pair)
    return gold.where("labelled").select("review_id", F.array_sort(F.array_distinct(F.array_compact(made))).alias("labels"))


def predicted_pairs(labels: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(review_id, labels) of a labels table, in the form of gold_pairs."""
    has = lambda c: F.when(F.col(c) != "", F.col(c))
    return label_sets(labels, F.concat("product_area", F.lit("/"), F.coalesce(F.concat(F.lit("+"), has("strength_type")), has("issue_type"))), ids)


def _strata(rows: DataFrame, prov: DataFrame) -> DataFrame:
    return rows.join(prov, "review_id", "left").withColumn("stratum", F.coalesce("stratum", F.lit("unknown")))


def score_gold(gold: DataFrame, prov: DataFrame, predicted: DataFrame, least: int = 30, pairs: bool = False) -> DataFrame:
    """Set scores for each stratum (never pooled), with whether it has enough rows. pairs: of (area, label) instead of areas."""
    strata = _strata(gold_pairs(gold) if pairs else gold_sets(gold), prov)
    shared = predicted.join(strata.select("review_id"), "review_id", "left_semi")
    return score_multilabel(strata, shared, by=["stratum"]).withColumn("sufficient", F.col("shared") >= least)


def score_gold_fields(gold: DataFrame, prov: DataFrame, reviews: DataFrame, fields: list[str], least: int = 30) -> DataFrame:
    """(stratum, field, scores, sufficient) of the categorical fields that annotators filled in; values meet trimmed and in lower case."""
    from functools import reduce

    value = lambda side, f: F.lower(F.trim(F.col(f"{side}.{f}").cast("string")))
    both = _strata(gold.where("labelled"), prov).alias("g").join(reviews.alias("r"), "review_id")
    scored = [score_categorical(both.select("stratum", value("g", f).alias("_gold"), value("r", f).alias("_seen")), "_gold", "_seen", by=["stratum"]).withColumn("field", F.lit(f)) for f in fields]
    return reduce(DataFrame.unionByName, scored).withColumn("sufficient", F.col("n") >= least)


def load_gold_csv(spark: SparkSession, path: str, tax: Taxonomy) -> DataFrame:
    """load_gold over a CSV that annotators filled in; raises if a column misses."""
    need = ["review_id", "labels", *tax.attributes, "support_escalation"]
    rows = numbered_csv(spark, path, need, "row_no")
    return load_gold(rows.where(F.trim("review_id") != ""), tax)


# --- faults --------------------------------------------------------------------------------------------------------


def _first(change) -> Column:
    return F.transform("areas", lambda a, i: F.when(i == 0, change(a)).otherwise(a))


def faults(tax: Taxonomy) -> dict[str, tuple[str, Column, dict[str, Column]]]:
    """Fault -> (detector that should see it, whether it can be made, the columns it changes)."""
    some = F.size("areas") > 0
    first = F.get("areas", F.lit(0))
    words = F.split(F.coalesce(first.evidence_span, F.lit("")), " ")
    n, long_ = F.size(words), F.size(words) >= 4
    h = F.pmod(F.xxhash64(F.lit(7), "review_id"), F.lit(1_000_000))
    cut = (1 + h % F.greatest(n - 2, F.lit(1))).cast("int")
    real = first.product_area.isin(list(tax.areas))
    issues = {x: a for a, x in tax.pairs("issue_types")}
    other = F.create_map(*[y for x, a in issues.items() for y in (F.lit(x), F.lit(next(b for b in sorted(tax.areas) if b != a)))])
    own_issue = F.create_map(*[y for a, x in tax.areas.items() for y in (F.lit(a), F.lit(x["issue_types"][0]))])
    own_strength = F.create_map(*[y for a, x in tax.areas.items() for y in (F.lit(a), F.lit(x["strength_types"][0]))])
    span = lambda s: {"areas": _first(lambda a: a.withField("evidence_span", s))}
    null = F.lit(None).cast("string")
    return {
        "fabricated_span": ("ungrounded_evidence", some, span(F.concat(F.lit("an unheard-of sentence numbered "), h.cast("string")))),
        "truncated_span": ("ungrounded_evidence", some & long_, span(F.array_join(F.filter(words, lambda w, i: i != cut), " "))),
        "stitched_span": ("unparseable_response", some & long_, span(F.concat(F.array_join(F.slice(words, 1, 2), " "), F.lit("..."), F.array_join(F.slice(words, -2, 2), " ")))),
        "invented_area": ("unknown_area", some, {"areas": _first(lambda a: a.withField("product_area", F.lit(f"not_in_taxonomy_{sorted(tax.areas)[0]}")))}),
        "misfiled_issue_type": ("unknown_issue_type", some & F.map_contains_key(other, F.coalesce(first.issue_type, F.lit(""))), {"areas": _first(lambda a: a.withField("product_area", F.try_element_at(other, a.issue_type)))}),
        "conflicting_polarity": ("conflicting_polarity", some & real, {"areas": _first(lambda a: a.withField("issue_type", F.try_element_at(own_issue, a.product_area)).withField("strength_type", F.try_element_at(own_strength, a.product_area)))}),
        "missing_polarity": ("missing_polarity", some & real, {"areas": _first(lambda a: a.withField("issue_type", null).withField("strength_type", null))}),
        "invalid_sentiment": ("invalid_attribute", F.lit(True), {"sentiment": F.lit("ecstatic")}),
        "duplicate_label": ("duplicate_label", some & real, {"areas": F.concat("areas", F.slice("areas", 1, 1))}),
        "confidence_out_of_range": ("unparseable_response", some, {"areas": _first(lambda a: a.withField("confidence", F.lit(1.5)))}),
        "misaligned_review_id": ("unexpected_review_id", F.lit(True), {"review_id": F.substring(F.sha2(F.concat(F.lit("stray"), "review_id"), 256), 1, 16)}),
    }


def detect(items: DataFrame, texts: DataFrame, tax: Taxonomy) -> DataFrame:
    """(case, kinds): what the validators say of each payload. items: case, source_id, and the payload's columns; texts: review_id, review_text."""
    keyed = items.withColumn("review_id0", F.col("review_id"))
    ok = schema_valid(keyed)
    grounded = with_grounding(ok.withColumn("review_id", F.col("source_id")), texts).select("case", F.when(F.col("grounding_rate") < 1, "ungrounded_evidence").alias("kind"))
    schema = ok.select("case", F.when(~F.col("schema_ok"), "unparseable_response").alias("kind"))
    ids = ok.select("case", F.when(F.col("review_id0") != F.col("source_id"), "unexpected_review_id").alias("kind"))
    tax_kinds = taxonomy_issues(ok.withColumn("review_id", F.col("case")), tax).select(F.col("review_id").alias("case"), "kind")
    every = grounded.unionByName(schema).unionByName(ids).unionByName(tax_kinds)
    return items.select("case").distinct().join(every.where("kind is not null").groupBy("case").agg(F.array_sort(F.collect_set("kind")).alias("kinds")), "case", "left").select("case", F.coalesce("kinds", F.array().cast(_SET)).alias("kinds"))


def clean_pool(items: DataFrame, texts: DataFrame, tax: Taxonomy) -> DataFrame:
    """Payloads that no validator objects to; faults are injected into these only."""
    seen = detect(items.withColumns({"case": F.col("review_id"), "source_id": F.col("review_id")}), texts, tax)
    return items.join(seen.where(F.size("kinds") == 0).select(F.col("case").alias("review_id")), "review_id", "left_semi")


#: Payloads that clean_sample looks at in one step, at most about.
STEP_ROWS = 100_000


def clean_sample(items: DataFrame, texts: DataFrame, tax: Taxonomy, n: int, seed: int) -> DataFrame:
    """The first n rows of clean_pool in hash order, as a table.

    Payloads and texts are looked at a range of hashes at a time, from the first on, until n clean ones are found or all have been seen; a range has
    four times as many rows as the one before, up to STEP_ROWS.
    """
    ws = Workspace(items.sparkSession, "clean")
    h = F.xxhash64(F.lit(seed), "review_id")
    total, low, rows, found, seen = items.count(), -(1 << 63), 4 * n, [], 0
    while True:
        high = min(low + (min(max(rows, 1), STEP_ROWS) << 64) // max(total, 1), (1 << 63) - 1)
        found.append(ws.cut(clean_pool(items.where(h.between(low, high)), texts.where(h.between(low, high)), tax)))
        seen += found[-1].count()
        if seen >= n or high == (1 << 63) - 1:
            return ws.cut(ws.together(found).orderBy(h, "review_id").limit(n))
        low, rows = high + 1, rows * 4


def clean_baseline(items: DataFrame, texts: DataFrame, tax: Taxonomy) -> tuple[DataFrame, DataFrame]:
    """What the validators say of payloads nobody changed: one row (examined, flagged, rate, ci_low, ci_high), and (kind, n)."""
    seen = detect(items.withColumns({"case": F.col("review_id"), "source_id": F.col("review_id")}), texts, tax)
    v, low, high = rate(F.count_if(F.size("kinds") > 0), F.count("*"))
    one = seen.agg(F.count("*").alias("examined"), F.count_if(F.size("kinds") > 0).alias("flagged"), v.alias("false_positive_rate"), low.alias("ci_low"), high.alias("ci_high"))
    return one, seen.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def fault_study(items: DataFrame, texts: DataFrame, tax: Taxonomy, per_kind: int = 200, seed: int = 42) -> DataFrame:
    """(fault, expected, attempted, inapplicable, captured, attributed, capture_rate) over the same sample for every fault."""
    from functools import reduce

    pool = clean_sample(items, texts, tax, per_kind, seed)
    texts = Workspace(items.sparkSession, "faults").cut(texts.join(F.broadcast(pool.select("review_id").distinct()), "review_id", "left_semi").select("review_id", "review_text"))  # per_kind at most
    cols = [f.split(":")[0] for f in ("review_id", "areas", "pain_point", "sentiment", "severity", "customer_intent", "support_escalation", "overall_confidence")]
    made = []
    for name, (expected, applies, change) in faults(tax).items():
        d = pool.select(*cols).withColumns({"source_id": F.col("review_id"), "fault": F.lit(name), "expected": F.lit(expected), "applies": F.coalesce(applies, F.lit(False)), "case": F.concat_ws("/", F.lit(name), "review_id")})
        made.append(d.withColumns(change))
    every = reduce(DataFrame.unionByName, made)
    seen = detect(every.where("applies"), texts, tax)
    d = every.join(seen, "case", "left")
    n, got = F.count_if("applies"), F.count_if(F.col("applies") & (F.size("kinds") > 0))
    right = F.count_if(F.col("applies") & F.array_contains("kinds", F.col("expected")))
    return d.groupBy("fault", "expected").agg(n.alias("attempted"), F.count_if(~F.col("applies")).alias("inapplicable"), got.alias("captured"), right.alias("attributed"), F.when(n > 0, ratio(got, n)).alias("capture_rate"))


def fault_summary(study: DataFrame) -> DataFrame:
    """Weighted by injections."""
    v, low, high = rate(F.sum("captured"), F.sum("attempted"))
    return study.agg(F.sum("attempted").alias("attempted"), F.sum("captured").alias("captured"), v.alias("capture_rate"), low.alias("ci_low"), high.alias("ci_high"), ratio(F.sum("attributed"), F.sum("captured")).alias("attribution_rate"))


