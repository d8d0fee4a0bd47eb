"""Prioritisation: RICE inputs and ranking, experiment plans, opportunity and hypothesis checks."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import score as S
from tallyloom.functions.stats import months_needed, sample_per_arm, target_rate
from tallyloom.functions.text import outermost_json, strip_code_fences
from tallyloom.operators.labels import enrich
from tallyloom.operators.painpoints import KEYS
from tallyloom.storage import Workspace


def rice(points: DataFrame, evidence: DataFrame, reviews: DataFrame, months: int, root_causes: DataFrame | None = None, area_rates: DataFrame | None = None, effort: DataFrame | None = None) -> DataFrame:
    """Reach, impact, confidence and effort of each pain point; scored ones rank before the others.

    evidence: (keys, review_id), a row for each citation. Without known grounding the corpus mean counts.
    """
    if months <= 0:
        raise ValueError("months must be positive")
    grounded = evidence.join(reviews.select("review_id", "grounding_rate"), "review_id").groupBy(*KEYS).agg(F.avg("grounding_rate").alias("_g"))
    corpus = reviews.agg(F.coalesce(F.avg("grounding_rate"), F.lit(0.0)).alias("_all"))
    d = points.join(grounded, KEYS, "left").crossJoin(F.broadcast(corpus))
    mark = lambda d, f, keys, name: d.join(f.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left") if f is not None else d.withColumn(name, F.lit(False))
    d = mark(d, root_causes, KEYS, "_mech")
    d = mark(d, area_rates.where("significant") if area_rates is not None else None, ["product_area"], "_comp")
    d = d.join(effort, KEYS, "left") if effort is not None else d.withColumn("effort_person_weeks", F.lit(None).cast("double"))
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    parts = S.confidence_parts(F.coalesce("_g", "_all"), F.col("volume").cast("double"), F.col("mean_confidence"), has("_mech"), has("_comp"))
    d = d.withColumns({"_step": S.impact_step(F.col("mean_severity"), F.col("churn_rate"), F.col("escalation_rate")), "_reach": F.col("volume") / F.lit(float(months)), "_conf": S.confidence(parts)})
    ric = F.col("_reach") * S.impact_value(F.col("_step")) * F.col("_conf")
    eff = F.when(F.col("effort_person_weeks") > 0, F.col("effort_person_weeks"))
    out = d.select(
        *KEYS, F.round("_reach", 2).alias("reach_per_month"), S.impact_value(F.col("_step")).alias("impact"), S.impact_label(F.col("_step")).alias("impact_label"), F.round("_conf", 4).alias("confidence"), eff.alias("effort_person_weeks"),
        F.round(ric, 2).alias("ric"), F.round(F.try_divide(ric, eff), 2).alias("rice"), eff.isNotNull().alias("scored"), *[F.round(v, 3).alias(f"confidence_{k}") for k, v in parts.items()],
    )
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("scored"), F.desc(F.when(F.col("scored"), F.col("rice")).otherwise(F.col("ric"))), *KEYS)  # a row for each pain point
    return out.withColumn("rank", F.row_number().over(order))


def effort_template(points: DataFrame) -> DataFrame:
    """The CSV in which efforts are filled in."""
    return points.select(*KEYS, "volume", F.lit("").alias("effort_person_weeks"))


def baseline_rate(platform_metrics: DataFrame) -> DataFrame:
    """(metric, baseline): mean over platforms weighted by reviews; unweighted without reviews."""
    return platform_metrics.groupBy("metric").agg(F.coalesce(F.try_divide(F.sum(F.col("rate") * F.col("reviews")), F.nullif(F.sum("reviews").cast("double"), F.lit(0.0))), F.avg("rate")).alias("baseline"))


def plan_sizes(df: DataFrame, baseline: str, monthly: str, mde_pp: float = 3.0, alpha: float = 0.05, power: float = 0.8, most_months: float = 6.0) -> DataFrame:
    """per_arm, total, months_required, practical, target_rate; null where no plan is possible."""
    d = df.withColumns({"per_arm": sample_per_arm(F.col(baseline), mde_pp, alpha, power), "target_rate": target_rate(F.col(baseline), mde_pp)}).withColumn("total", F.col("per_arm") * 2)
    return d.withColumn("months_required", F.when(F.col("total").isNotNull(), months_needed(F.col("total"), F.col(monthly)))).withColumn("practical", F.col("months_required") <= most_months)


# The metric that must not get worse while another is moved.
GUARDRAILS = {"negative_share": "praise_share", "severe_share": "negative_share", "escalation_rate": "negative_share", "churn_share": "negative_share", "praise_share": "negative_share", "pain_point_volume": "negative_share"}


def experiment_plans(opportunities: DataFrame, baselines: DataFrame, monthly: float, **options) -> DataFrame:
    """A plan for each opportunity (title, primary_metric): sizes, guardrail metric, notes."""
    d = opportunities.join(F.broadcast(baselines), F.col("primary_metric") == F.col("metric"), "left").withColumn("monthly_volume", F.lit(float(monthly)))
    d = plan_sizes(d, "baseline", "monthly_volume", **options)
    guard = F.create_map(*[F.lit(x) for kv in GUARDRAILS.items() for x in kv])
    notes = F.array_compact(F.array(F.when(~F.col("practical"), F.lit("not practical at the observed volume")), F.when(F.col("baseline") < 0.02, F.lit("baseline below 2%: a small move is most of it")), F.when(F.col("baseline").isNull(), F.lit("no baseline for this metric"))))
    return d.withColumn("guardrail_metric", F.try_element_at(guard, F.col("primary_metric"))).withColumn("notes", notes).drop("metric")


# What this engine measures, and openings that state no risk.
MEASURABLE = ["negative_share", "severe_share", "escalation_rate", "churn_share", "praise_share", "pain_point_volume"]
NO_RISK = ["none", "no risk", "n/a", "nothing", "no downside", "minimal risk", "there is no risk", "no significant risk"]


def check_opportunities(df: DataFrame) -> DataFrame:
    """Df (primary_metric, expected_direction, risk_if_wrong) with `issue` (null: kept); the first failing check counts."""
    risk = F.regexp_replace(F.lower(F.trim("risk_if_wrong")), r"\.+$", "")
    empty = F.lit(False)
    for p in NO_RISK:
        empty = empty | risk.startswith(p)
    issue = (
        F.when(~F.coalesce(F.col("primary_metric").isin(MEASURABLE), F.lit(False)), "unmeasurable_metric")
        .when(~F.coalesce(F.col("expected_direction").isin("decrease", "increase"), F.lit(False)), "bad_direction")
        .when(empty, "no_stated_risk")
    )
    return df.withColumn("issue", issue)


OPPORTUNITY = "struct<title:string,change:string,addresses_hypothesis:string,primary_metric:string,expected_direction:string,risk_if_wrong:string>"
HYPOTHESIS = "struct<hypothesis:string,mechanism:string,supporting_review_ids:array<string>,disconfirming_evidence:string,proposed_check:string,confidence:double>"


def parse_list(reply: Column, name: str, element: str) -> Column:
    """The list under `name` in a reply's JSON, or the JSON itself if that is a list, words around it or not; null if there is neither."""
    j, whole = outermost_json(reply), strip_code_fences(reply)
    found = F.when(j.startswith("["), F.from_json(j, f"array<{element}>")).when(j.startswith("{"), F.from_json(j, f"{name} array<{element}>")[name])
    bare = F.regexp_extract(whole, r"(?s)(\[.*\])", 1)
    return F.coalesce(found, F.when(~whole.startswith("{") & (bare != ""), F.from_json(bare, f"array<{element}>")))


def hypotheses_of(points: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Points with `hypotheses`, those of the same area and issue, by name; empty if there are none."""
    own = F.array_sort(F.collect_list(F.struct("hypothesis", "mechanism", "disconfirming_evidence")))
    h = hypotheses.join(points.select(*KEYS).distinct(), KEYS, "left_semi").groupBy(*KEYS).agg(own.alias("hypotheses"))
    none = F.array().cast("array<struct<hypothesis:string,mechanism:string,disconfirming_evidence:string>>")
    return points.join(h, KEYS, "left").withColumn("hypotheses", F.coalesce("hypotheses", none))


def opportunity_prompt(n: int = 3) -> str:
    """The instructions for a model."""
    return (
        f"Name at most {n} changes to the product that act on the causes given for one pain point, and on no other cause.\n"
        "Say what is changed so exactly that a team could estimate it, and what customers lose if the idea is wrong; estimate nothing yourself.\n"
        f"primary_metric is one of {', '.join(MEASURABLE)}; expected_direction is decrease or increase.\n"
        'Answer with JSON only: {"opportunities": [{' + ", ".join(f'"{f.split(":")[0]}": "..."' for f in OPPORTUNITY[7:-1].split(",")) + "}]}"
    )


def opportunity_messages(points: DataFrame) -> DataFrame:
    """(group_id, message) for each point with hypotheses; what wasn't measured is `unknown`."""
    against = lambda h: F.when(F.trim(F.coalesce(h.disconfirming_evidence, F.lit(""))) != "", F.concat(F.lit("\n  but: "), h.disconfirming_evidence))
    cause = F.transform("hypotheses", lambda h: F.concat(F.lit("- "), F.coalesce(h.hypothesis, F.lit("")), F.lit("\n  how: "), F.coalesce(h.mechanism, F.lit("")), F.coalesce(against(h), F.lit(""))))
    head = F.concat(F.lit("Pain point: "), F.concat_ws(" / ", *KEYS), F.lit("\nSignal: "), signal_of(), F.lit("\nCauses:\n"), F.array_join(cause, "\n"))
    return points.where(F.size("hypotheses") > 0).select(F.concat_ws("/", *KEYS).alias("group_id"), head.alias("message"))


def generate_opportunities(points: DataFrame, hypotheses: DataFrame, provider: Callable[[str, str], str], n: int = 3, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(opportunities that pass check_opportunities, issues (keys, issue, detail)) for each pain point; a bad reply is an issue.

    points: keys, volume, mean_severity, escalation_rate, churn_rate. Replies are kept in the shared folder, so that each point is asked once.
    """
    p = hypotheses_of(points, hypotheses)
    ws = Workspace(points.sparkSession, "opportunities")
    replies = ws.cut(enrich(opportunity_messages(p), opportunity_prompt(n), provider, attempts))
    r = p.select(*KEYS, "hypotheses", F.concat_ws("/", *KEYS).alias("group_id")).join(replies, "group_id", "left")
    r = r.withColumn("found", F.slice(parse_list(F.col("reply"), "opportunities", OPPORTUNITY), 1, n))
    named = F.exists("found", lambda o: F.coalesce(F.trim(o.title), F.lit("")) == "")
    of_points = F.when(F.size("hypotheses") == 0, "no_hypotheses").when(F.col("error").isNotNull(), "api_error").when(F.col("found").isNull(), "unparseable_response").when(named, "schema_violation")
    r = r.withColumn("issue", of_points)
    checked = check_opportunities(r.where("issue is null").select(*KEYS, F.inline("found")))
    issues = r.where("issue is not null").select(*KEYS, "issue", F.substring(F.coalesce("error", "reply", F.lit("")), 1, 200).alias("detail"))
    return checked.where("issue is null").drop("issue"), issues.unionByName(checked.where("issue is not null").select(*KEYS, "issue", F.col("title").alias("detail")))


def signal_of() -> Column:
    """The measured facts of a pain point, as a line; what wasn't measured is `unknown`."""
    percent = lambda c: F.coalesce(F.concat(F.round(F.col(c) * 100).cast("int").cast("string"), F.lit("%")), F.lit("unknown"))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return F.concat(F.lit("reviews "), plain("volume"), F.lit(", mean severity (1 to 4) "), plain("mean_severity"), F.lit(", asked for support "), percent("escalation_rate"), F.lit(", mean to leave "), percent("churn_rate"))


def hypothesis_prompt(n: int = 3) -> str:
    """The instructions for a model."""
    return (
        f"Give at most {n} possible causes of one pain point, each a mechanism within the product that explains as many reviews as were counted.\n"
        "Argue from the reviews that are quoted and from nothing else: supporting_review_ids are ids in brackets, as they stand there; a cause without any is refused.\n"
        "disconfirming_evidence says what in the reviews speaks against the cause, proposed_check how the company could test it; confidence is from 0 to 1.\n"
        "Answer with JSON only, by this schema: " + json.dumps(hypothesis_schema(n), sort_keys=True)
    )


def hypothesis_schema(n: int = 3) -> dict:
    """The JSON schema of a reply."""
    kinds = {"supporting_review_ids": {"type": "array", "items": {"type": "string"}}, "confidence": {"type": "number", "minimum": 0, "maximum": 1}}
    fields = [f.name for f in T.StructType.fromDDL(f"h {HYPOTHESIS}")["h"].dataType.fields]
    item = {"type": "object", "properties": {f: kinds.get(f, {"type": "string"}) for f in fields}, "required": fields, "additionalProperties": False}
    return {"type": "object", "properties": {"hypotheses": {"type": "array", "maxItems": n, "items": item}}, "required": ["hypotheses"], "additionalProperties": False}


def hypothesis_messages(points: DataFrame) -> DataFrame:
    """(group_id, message) for each point with quotes (an array of evidence_rank, review_id, quote)."""
    quotes = F.array_join(F.transform("quotes", lambda q: F.concat(F.lit("["), q.review_id, F.lit("] "), F.coalesce(q.quote, F.lit("")))), "\n")
    message = F.concat(F.lit("Pain point: "), F.concat_ws(" / ", *KEYS), F.lit("\nSignal: "), signal_of(), F.lit("\nReviews:\n"), quotes)
    return points.where(F.size("quotes") > 0).select(F.concat_ws("/", *KEYS).alias("group_id"), message.alias("message"))


def generate_hypotheses(points: DataFrame, evidence: DataFrame, provider: Callable[[str, str], str], n: int = 3, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(hypotheses whose citations hold, issues (keys, issue, detail)) for each pain point; a bad reply is an issue, never an error.

    points: keys, volume, mean_severity, escalation_rate, churn_rate. evidence: keys, evidence_rank, review_id, quote, a few rows for each point. A reply is a list of
    hypotheses, bare or under that name, perhaps with words around it; a field that is missing or of a wrong kind makes the whole reply a
    violation, as the schema does. A hypothesis that cites what wasn't quoted, or nothing, goes; one that names nothing against itself stays, and is an issue too.
    """
    given = evidence.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("evidence_rank", "review_id", "quote"))).alias("quotes"))
    p = points.join(given, KEYS, "left").withColumn("group_id", F.concat_ws("/", *KEYS))
    ws = Workspace(points.sparkSession, "hypotheses")
    p = ws.cut(p)
    replies = ws.cut(enrich(hypothesis_messages(p), hypothesis_prompt(n), provider, attempts))
    r = p.select(*KEYS, "group_id", F.transform("quotes", lambda q: q.review_id).alias("supplied_ids")).join(replies, "group_id", "left")
    r = r.withColumn("found", F.slice(parse_list(F.col("reply"), "hypotheses", HYPOTHESIS), 1, n))
    texts = ("mechanism", "supporting_review_ids", "disconfirming_evidence", "proposed_check")
    bad = lambda h: h.isNull() | (F.coalesce(F.trim(h.hypothesis), F.lit("")) == "") | reduce(lambda a, c: a | h[c].isNull(), texts, F.lit(False)) | ~F.coalesce(h.confidence.between(0, 1), F.lit(False))
    issue = F.when(F.col("supplied_ids").isNull(), "no_evidence").when(F.col("error").isNotNull(), "api_error").when(F.col("found").isNull(), "unparseable_response").when(F.exists("found", bad), "schema_violation")
    r = r.withColumn("issue", issue)
    good = r.where("issue is null")
    checked = check_citations(good.select(*KEYS, F.inline("found")), good.select(*KEYS, "supplied_ids"), KEYS).drop("supplied_ids")
    of_points = r.where("issue is not null").select(*KEYS, "issue", F.substring(F.coalesce("error", "reply", F.lit("")), 1, 200).alias("detail"))
    issues = of_points.unionByName(checked.where("issue is not null").select(*KEYS, "issue", F.substring("hypothesis", 1, 120).alias("detail")))
    return checked.where("kept").drop("invented", "issue", "kept"), issues


def check_citations(hypotheses: DataFrame, supplied: DataFrame, key: list[str]) -> DataFrame:
    """Hypotheses (key, supporting_review_ids, disconfirming_evidence) with `invented`, `issue` and `kept`. supplied: (key, supplied_ids)."""
    d = hypotheses.join(supplied, key, "left")
    ids = F.array_distinct(F.coalesce("supporting_review_ids", F.array().cast("array<string>")))
    d = d.withColumn("invented", F.array_except(ids, F.coalesce("supplied_ids", F.array().cast("array<string>"))))
    blank = F.trim(F.coalesce("disconfirming_evidence", F.lit(""))) == ""
    issue = F.when(F.size("invented") > 0, "invented_citation").when(F.size(ids) == 0, "uncited_hypothesis").when(blank, "no_disconfirming_evidence")
    return d.withColumn("issue", issue).withColumn("kept", F.coalesce(issue == "no_disconfirming_evidence", F.lit(True)))


def root_cause_loop(search: Callable[[int], list[dict]], propose: Callable[[list[dict]], list[dict]], k: int = 8, attempts: int = 3, step: int = 4) -> dict:
    """Retrieve, hypothesise, validate; retry with more evidence while nothing is kept. A bounded loop on the driver over a few rows."""
    issues: list[str] = []
    for attempt in range(1, attempts + 1):
        found = search(k + step * (attempt - 1))
        known = {e["review_id"] for e in found}
        kept = []
        for h in propose(found):
            cited = list(dict.fromkeys(h.get("supporting_review_ids", [])))
            if not cited or not set(cited) <= known:
                issues.append("invented_citation" if cited else "uncited_hypothesis")
                continue
            if not (h.get("disconfirming_evidence") or "").strip():
                issues.append("no_disconfirming_evidence")
            kept.append(h | {"supporting_review_ids": cited})
        if kept:
            break
    return {"hypotheses": kept, "issues": issues, "attempts": attempt, "evidence": found}


