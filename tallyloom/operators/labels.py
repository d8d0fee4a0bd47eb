"""Structured labels: parse payloads, reconcile ids, validate against the taxonomy, ground, flatten; sampling and batching."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import ratio
from tallyloom.functions.text import grounding, outermost_json
from tallyloom.ordered import hash_order, hash_sample
from tallyloom.sources.config import Taxonomy

AREA = "struct<product_area:string,issue_type:string,strength_type:string,evidence_span:string,confidence:double>"
ITEM = f"struct<review_id:string,areas:array<{AREA}>,pain_point:string,sentiment:string,severity:string,customer_intent:string,support_escalation:boolean,overall_confidence:double>"


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with `items` (array of payloads; null if unparseable): {"results": [...]}, another wrapper name, a bare array, or one object."""
    j = outermost_json(F.col(reply))
    arr = F.from_json(F.when(j.startswith("["), j), f"array<{ITEM}>")
    members = F.from_json(F.when(j.startswith("{"), j), "map<string,string>")
    inner = F.get(F.filter(F.map_values(members), lambda v: F.ltrim(v).startswith("[")), F.lit(0))
    named = F.when(~F.map_contains_key(members, F.lit("review_id")), F.from_json(inner, f"array<{ITEM}>"))
    single = F.when(F.map_contains_key(members, F.lit("review_id")), F.array(F.from_json(j, ITEM)))
    return replies.withColumn("items", F.coalesce(arr, named, single))


def explode_items(parsed: DataFrame, keep: list[str]) -> DataFrame:
    return parsed.where("items is not null").select(*keep, F.posexplode("items").alias("pos", "item")).select(*keep, "pos", "item.*")


def payload_ok(item: Column) -> Column:
    """Whether a payload has an id, confidences in [0, 1] and no elided span."""
    bad_area = F.exists(F.coalesce(item.areas, F.array().cast(f"array<{AREA}>")), lambda a: ~F.coalesce(a.confidence.between(0, 1), F.lit(True)) | F.coalesce(F.contains(a.evidence_span, F.lit("...")) | F.contains(a.evidence_span, F.lit("…")), F.lit(False)))
    return item.review_id.isNotNull() & F.coalesce(item.overall_confidence.between(0, 1), F.lit(True)) & ~bad_area


def schema_valid(items: DataFrame) -> DataFrame:
    """items with `schema_ok`."""
    return items.withColumn("schema_ok", payload_ok(F.struct("review_id", "areas", "overall_confidence")))


def reconcile_ids(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """(review_id, kind): missing (to be asked again), unexpected (dropped), duplicate (first kept), ok. requested: review_id; returned: review_id, pos."""
    r = returned.groupBy("review_id").agg(F.count("*").alias("n"))
    q = requested.select("review_id").distinct().withColumn("asked", F.lit(True))
    kind = F.when(F.col("asked").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return q.join(r, "review_id", "full").select("review_id", kind.alias("kind"))


def _known(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def taxonomy_issues(items: DataFrame, tax: Taxonomy) -> DataFrame:
    """(review_id, kind, detail): a row for each violation. The taxonomy is a map literal: it is bounded by its document."""
    def table(kind):
        return F.create_map(*[x for a in tax.areas for x in (F.lit(a), _known(tax.areas[a][kind]))])

    issue, strength = table("issue_types"), table("strength_types")
    known = lambda a: a.isin(list(tax.areas))
    areas = F.coalesce("areas", F.array().cast(f"array<{AREA}>"))
    s = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    has = lambda c: F.coalesce(c != "", F.lit(False))

    def of(a: Column) -> Column:
        real = (a.product_area != tax.fallback) & known(a.product_area)
        return F.array_compact(F.array(
            F.when((a.product_area != tax.fallback) & ~known(a.product_area), s("unknown_area", a.product_area)),
            F.when(real & has(a.issue_type) & has(a.strength_type), s("conflicting_polarity", a.product_area)),
            F.when(real & ~has(a.issue_type) & ~has(a.strength_type), s("missing_polarity", a.product_area)),
            F.when(real & has(a.issue_type) & ~F.array_contains(F.try_element_at(issue, a.product_area), a.issue_type), s("unknown_issue_type", a.issue_type)),
            F.when(real & has(a.strength_type) & ~F.array_contains(F.try_element_at(strength, a.product_area), a.strength_type), s("unknown_strength_type", a.strength_type)),
        ))

    same = lambda a, b: (a.product_area == b.product_area) & a.issue_type.eqNullSafe(b.issue_type) & a.strength_type.eqNullSafe(b.strength_type)
    repeated = F.array_distinct(F.transform(F.filter(areas, lambda a: F.size(F.filter(areas, lambda b: same(a, b))) > 1), lambda a: a.product_area))
    attrs = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("sentiment").isin(tax.attributes["sentiment"]), F.lit(False)), s("invalid_attribute", F.concat(F.lit("sentiment="), F.coalesce("sentiment", F.lit("null"))))),
        F.when(~F.coalesce(F.col("customer_intent").isin(tax.attributes["customer_intent"]), F.lit(False)), s("invalid_attribute", F.concat(F.lit("customer_intent="), F.coalesce("customer_intent", F.lit("null"))))),
        F.when(F.col("severity").isNotNull() & ~F.col("severity").isin(tax.attributes["severity"]), s("invalid_attribute", F.concat(F.lit("severity="), "severity"))),
    ))
    every = F.concat(F.flatten(F.transform(areas, of)), F.transform(repeated, lambda a: s("duplicate_label", a)), attrs)
    return items.select("review_id", F.inline(every))


def with_grounding(items: DataFrame, texts: DataFrame, exact: bool = False) -> DataFrame:
    """items with grounding_rate against texts (review_id, review_text)."""
    spans = F.transform(F.coalesce("areas", F.array().cast(f"array<{AREA}>")), lambda a: a.evidence_span)
    return items.join(texts.select("review_id", "review_text"), "review_id", "left").withColumn("grounding_rate", grounding(F.col("review_text"), spans, exact)).drop("review_text")


def flatten(items: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(enriched reviews, labels), both with the carried columns of the reviews."""
    first = F.row_number().over(Window.partitionBy("review_id").orderBy("pos"))
    one = items.withColumn("_n", first).where("_n = 1").drop("_n")
    reviews = one.select("review_id", "sentiment", "severity", "customer_intent", "support_escalation", "pain_point", F.size(F.coalesce("areas", F.array().cast(f"array<{AREA}>"))).alias("n_areas"), "overall_confidence", F.coalesce("grounding_rate", F.lit(1.0)).alias("grounding_rate"))
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    polarity = F.when(has("issue_type"), "issue").when(has("strength_type"), "strength").otherwise("none")
    labels = one.select("review_id", F.posexplode("areas").alias("label_no", "a")).select("review_id", "label_no", "a.*").withColumn("polarity", polarity)
    return reviews.join(carried, "review_id"), labels.join(carried, "review_id", "left")


def ordered_labels(labels: DataFrame) -> DataFrame:
    """Labels by review, area, issue and strength, nulls last; the order of a table as it is written."""
    return labels.orderBy(*[F.asc_nulls_last(c) for c in ("review_id", "product_area", "issue_type", "strength_type")])


def label_pairs(labels: DataFrame) -> DataFrame:
    """One row for each (area, issue)."""
    return labels.dropDuplicates(["product_area", "issue_type"]).select("product_area", "issue_type")


def run_report(requested: DataFrame, reviews: DataFrame, issues: DataFrame) -> DataFrame:
    """Coverage, grounding and issue counts (as an array of kind and n), in one row."""
    asked = requested.agg(F.count_distinct("review_id").alias("requested"))
    got = reviews.agg(F.count("*").alias("enriched"), F.avg("grounding_rate").alias("mean_grounding"), F.avg((F.col("grounding_rate") >= 1).cast("double")).alias("fully_grounded"))
    kinds = issues.groupBy("kind").count().agg(F.array_sort(F.collect_list(F.struct("kind", F.col("count").alias("n")))).alias("issues"))
    return asked.crossJoin(F.broadcast(got)).crossJoin(F.broadcast(kinds)).withColumn("coverage", ratio(F.col("enriched"), F.col("requested")))


def stratified_sample(df: DataFrame, n: int, by: list[str], id_col: str = "review_id", seed: int = 42) -> DataFrame:
    """About n rows, every stratum in proportion (share rounded half to even), in hash order: the same rows every time."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_m"))
    total = df.agg(F.count("*").alias("_t"))
    quota = sizes.crossJoin(F.broadcast(total)).select(*by, F.bround(F.col("_m") * F.least(F.lit(1.0), F.lit(float(n)) / F.col("_t"))).alias("_q"))
    return hash_sample(df, quota, by, id_col, seed).orderBy(hash_order(id_col, seed), id_col).limit(n)


def chunk(df: DataFrame, size: int, id_col: str = "review_id") -> DataFrame:
    """Df with (group_id, member): rows in the order of their ids, cut into requests of `size` within each range partition (its last may be smaller).

    A row's place in its partition is what Spark numbers as it streams by, so requests are packed by as many tasks as there are partitions, without
    a window. Which rows share a request depends on the partitions: write the result before it is used twice.
    """
    place = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it in the lower 33
    d = df.repartitionByRange(id_col).sortWithinPartitions(id_col).withColumn("_at", place)
    part, at = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return d.withColumn("group_id", F.concat_ws("-", part, F.floor(at / size))).withColumn("member", at % size).drop("_at")


def system_prompt(tax: Taxonomy, noun: str = "review") -> str:
    """The instructions for a model, the same bytes for the same taxonomy."""
    lines = [f"Label each {noun} with product areas and attributes from these lists only."]
    for a, x in tax.areas.items():
        lines.append(f"- {a} ({x['domain']}): issues {', '.join(x['issue_types'])}; strengths {', '.join(x['strength_types'])}")
    lines.append(f"- {tax.fallback}: only if no area fits")
    lines += [f"{k}: {', '.join(v)}" for k, v in tax.attributes.items()]
    lines.append("Quote evidence word for word, without leaving anything out. Give an issue or a strength for each area, not both.")
    return "\n".join(lines)


def user_messages(chunked: DataFrame) -> DataFrame:
    """(group_id, message, ids) of each request; ratings are withheld."""
    part = F.array_sort(F.collect_list(F.struct("member", "review_id", "review_text")))
    g = chunked.groupBy("group_id").agg(part.alias("p"))
    return g.select("group_id", F.array_join(F.transform("p", lambda x: F.concat(F.lit("<review id=\""), x.review_id, F.lit("\">\n"), x.review_text, F.lit("\n</review>"))), "\n").alias("message"), F.transform("p", lambda x: x.review_id).alias("ids"))


def response_schema(tax: Taxonomy) -> dict:
    """The JSON schema of a reply, with the taxonomy's vocabularies."""
    issue, strength = [x for _, x in tax.pairs("issue_types")], [x for _, x in tax.pairs("strength_types")]
    area = {"product_area": {"type": "string", "enum": [*tax.areas, tax.fallback]}, "issue_type": {"type": ["string", "null"], "enum": [*issue, None]}, "strength_type": {"type": ["string", "null"], "enum": [*strength, None]}, "evidence_span": {"type": "string"}, "confidence": {"type": "number"}}
    item = {"review_id": {"type": "string"}, "areas": {"type": "array", "items": _object(area)}, "pain_point": {"type": ["string", "null"]}, "sentiment": {"type": "string", "enum": tax.attributes["sentiment"]}, "severity": {"type": ["string", "null"], "enum": [*tax.attributes["severity"], None]}, "customer_intent": {"type": "string", "enum": tax.attributes["customer_intent"]}, "support_escalation": {"type": "boolean"}, "overall_confidence": {"type": "number"}}
    return _object({"results": {"type": "array", "items": _object(item)}})


def _object(properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


Provider = Callable[[str, str], str]


class ProviderError(Exception):
    """A failed call; fatal ones (bad request, rights, quota, unknown model) aren't tried again."""

    FATAL = (400, 401, 402, 403, 404)

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status, self.retryable = status, status not in self.FATAL


def classify_error(e: Exception) -> ProviderError:
    """Any exception of a provider as a ProviderError, by its status: an attribute, else a number in its message; without one, another try may help."""
    if isinstance(e, ProviderError):
        return e
    status = next((s for s in (getattr(e, "status_code", None), getattr(e, "code", None)) if isinstance(s, int)), None)
    if status is None and (m := re.search(r"\b[45]\d\d\b", str(e))):
        status = int(m[0])
    return ProviderError(str(e), status)


#: The error of messages that a task no longer sends.
NOT_SENT = "not sent"


def enrich(messages: DataFrame, system: str, provider: Provider, attempts: int = 3, limit: int | None = None) -> DataFrame:
    """(group_id, reply, error) of each message, by a provider called in the workers, with bounded retries.

    provider(system, message) -> reply must be picklable; what it raises becomes an error, never a failed job. After `limit` fatal errors
    in a row a task sends nothing more. Side effects stay behind the provider; a task that is run again calls it again, so callers keep
    replies in a KeyedStore and pass only what is missing (enrichment.enrich_corpus does).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        in_a_row = 0
        for f in frames:
            out = []
            for g, m in zip(f["group_id"], f["message"], strict=True):
                reply, error = None, NOT_SENT
                for _ in range(attempts if limit is None or in_a_row < limit else 0):
                    try:
                        reply, error, in_a_row = provider(system, m), None, 0
                        break
                    except Exception as e:  # noqa: BLE001 - recorded, the run goes on
                        known = classify_error(e)
                        error = str(known) if known.retryable else f"fatal: {known}"
                        in_a_row = 0 if known.retryable else in_a_row + 1
                        if not known.retryable:
                            break
                out.append((g, reply, error))
            yield pd.DataFrame(out, columns=["group_id", "reply", "error"])

    return messages.select("group_id", "message").mapInPandas(run, "group_id string, reply string, error string")


class Breaker:
    """Stops a run after `limit` fatal batches in a row (kept on the driver, between batches)."""

    def __init__(self, limit: int = 5):
        self.limit, self.run = limit, 0

    def note(self, fatal: bool) -> None:
        self.run = self.run + 1 if fatal else 0
        if self.run >= self.limit:
            raise RuntimeError(f"{self.limit} batches in a row failed for good")


def rule_labeller(reviews: DataFrame, tax: Taxonomy) -> DataFrame:
    """The offline provider: payload rows from probes, as a model would return them (areas whose probe matches; its match as evidence)."""
    empty = F.lit(None).cast(AREA)
    low = F.col("rating") <= 2
    hits = [
        F.when(F.regexp_extract("review_text", f"(?iu)({x['probe']})", 1) != "", F.struct(F.lit(a).alias("product_area"), F.when(low, x["issue_types"][0]).alias("issue_type"), F.when(~low, x["strength_types"][0]).alias("strength_type"), F.regexp_extract("review_text", f"(?iu)({x['probe']})", 1).alias("evidence_span"), F.lit(0.9).alias("confidence"))).otherwise(empty)
        for a, x in tax.areas.items()
    ]
    rate = F.col("rating")
    return reviews.select(
        "review_id", F.array_compact(F.array(*hits)).cast(f"array<{AREA}>").alias("areas"), F.when(low, F.lit("low rating")).alias("pain_point"),
        F.when(rate <= 2, "negative").when(rate == 3, "neutral").otherwise("positive").alias("sentiment"), F.when(rate == 1, "high").when(rate == 2, "medium").alias("severity"),
        F.when(rate <= 2, "complaint").otherwise("praise").alias("customer_intent"), (rate == 1).alias("support_escalation"), F.lit(0.9).alias("overall_confidence"), F.lit(0).alias("pos"),
    )
