"""Enrichment of a corpus by a provider: waves of requests, checked replies, a keyed store, retries of what is missing; batches."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.labels import ITEM, NOT_SENT, Provider, chunk, enrich, explode_items, parse_replies, payload_ok, taxonomy_issues, user_messages, with_grounding
from tallyloom.sources.config import Taxonomy
from tallyloom.sources.stores import KeyedStore
from tallyloom.storage import Workspace

FIELDS = ["review_id", "areas", "pain_point", "sentiment", "severity", "customer_intent", "support_escalation", "overall_confidence"]
#: Of a KeyedStore of payloads: its value schema and key schema.
STORED, STORED_KEY = f"item {ITEM}", "review_id string"


class RunAborted(RuntimeError):
    """Calls fail for good one after the other: an account-level problem, so the other requests aren't sent."""


@dataclass
class Enriched:
    """items: payloads with grounding_rate; issues: (review_id, kind, detail); failed: review_id without a payload."""

    items: DataFrame
    issues: DataFrame
    failed: DataFrame
    cache_hits: int = 0
    requests: int = 0


def _error_kind(error: Column) -> Column:
    kinds = {"fatal: ": "api_error_fatal", "batch: ": "batch_failure", NOT_SENT: "not_sent"}
    return reduce(lambda rest, kv: F.when(error.startswith(kv[0]), kv[1]).otherwise(rest), kinds.items(), F.lit("api_error"))


def check_replies(replies: DataFrame, asked: DataFrame, tax: Taxonomy) -> Enriched:
    """Replies (group_id, reply, error) against what was asked (group_id, review_id, review_text): a report, not a gate.

    Groups meet by id, never by position; a group that wasn't asked is an issue. A reply that can't be parsed, or has a payload outside
    the schema, fails its whole group. Of a review returned twice the first payload counts; one that wasn't asked for is dropped.
    Labels outside the taxonomy and quotes that aren't in the text are reported, and kept.
    """
    issue = lambda who, kind, detail: [who.alias("review_id"), kind.alias("kind"), F.substring(detail, 1, 300).alias("detail")]
    group = F.lit("<group>")
    known = asked.select("group_id").distinct().withColumn("_known", F.lit(True))
    p = parse_replies(replies).join(known, "group_id", "left")
    valid = F.col("items").isNotNull() & ~F.coalesce(F.exists("items", lambda i: ~F.coalesce(payload_ok(i), F.lit(False))), F.lit(False))
    what = F.when(F.col("_known").isNull(), "unknown_group").when(F.col("error").isNotNull(), _error_kind(F.col("error"))).when(~valid, "unparseable_response")
    p = p.withColumn("_what", what)
    of_groups = p.where("_what is not null").select(*issue(group, F.col("_what"), F.coalesce("error", "reply", F.lit(""))))
    e = explode_items(p.where("_what is null"), ["group_id"]).join(asked.select("group_id", "review_id", F.lit(True).alias("_asked")), ["group_id", "review_id"], "left")
    nth = F.row_number().over(Window.partitionBy("group_id", "review_id").orderBy("pos"))  # a group is one request
    e = e.withColumn("_no", nth).withColumn("_what", F.when(F.col("_asked").isNull(), "unexpected_review_id").when(F.col("_no") > 1, "duplicate_review_id"))
    of_ids = e.where("_what is not null").select(*issue(F.col("review_id"), F.col("_what"), F.lit("")))
    items = with_grounding(e.where("_what is null").select(*FIELDS, F.lit(0).alias("pos")), asked)
    loose = items.where("grounding_rate < 1").select(*issue(F.col("review_id"), F.lit("ungrounded_evidence"), F.col("grounding_rate").cast("string")))
    issues = of_groups.unionByName(of_ids).unionByName(taxonomy_issues(items, tax)).unionByName(loose)
    return Enriched(items, issues, asked.select("review_id").join(items.select("review_id"), "review_id", "left_anti"))


def _keep(store: KeyedStore | None, items: DataFrame) -> None:
    if store is not None:
        store.add(items.select("review_id", F.struct(*FIELDS).cast(ITEM).alias("item")), time.time_ns())


def _stored(store: KeyedStore, reviews: DataFrame) -> DataFrame:
    """Payloads of the reviews, grounded anew: a rate belongs to payload and text, not to the request that made it."""
    return with_grounding(store.read().select("item.*").withColumn("pos", F.lit(0)).join(reviews.select("review_id"), "review_id", "left_semi"), reviews)


def enrich_corpus(
    reviews: DataFrame, system: str, tax: Taxonomy, provider: Provider, store: KeyedStore | None = None, size: int = 5, concurrency: int = 8,
    save_every: int = 25, attempts: int = 3, limit: int = 5, retry_missing: bool = True, read_through: bool = True,
) -> Enriched:
    """Payloads for reviews (review_id, review_text), each id once.

    What the store has is not asked again (read_through=False asks all, and still stores). `concurrency` tasks send the requests of a
    wave, `save_every` each at most (without a store there is one wave); after each wave its payloads are stored, so that a run that is started again goes on from there, and a job that dies loses
    `save_every` requests of each task. Requests are packed by range partitions, however many rows there are. A task stops sending after
    `limit` fatal errors in a row; the run then stores what it has and raises RunAborted. Reviews without a payload are asked
    once more, one to a request, unless an error was fatal.
    """
    ws = Workspace(reviews.sparkSession, "enrich")
    texts = ws.cut(reviews.select("review_id", "review_text"))
    use = store is not None and read_through
    pending = ws.cut(store.missing(texts)) if use else texts
    hits = texts.count() - pending.count() if use else 0
    parts: list[Enriched] = []
    requests = 0

    def ask(pending: DataFrame, size: int) -> bool:
        nonlocal requests
        fatal = False
        asked = ws.cut(chunk(pending, size))
        # waves are there for what is stored between them
        waves = 1 if store is None else max(1, -(-asked.select("group_id").distinct().count() // (save_every * concurrency)))
        by_wave = asked if waves == 1 else ws.cut(asked.withColumn("_wave", F.pmod(F.xxhash64("group_id"), F.lit(waves))).repartition("_wave"), "_wave")
        told, kept = [], []
        for wave in range(waves):
            now = asked if waves == 1 else by_wave.where(F.col("_wave") == wave)
            messages = user_messages(now).repartition(concurrency, "group_id")
            replies = ws.cut(enrich(messages, system, provider, attempts, limit))
            told.append(replies)
            n = replies.agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").startswith("fatal: ")).alias("fatal"), F.count_if(F.col("error") == NOT_SENT).alias("unsent"), F.max(F.when(F.col("error").startswith("fatal: "), F.col("error"))).alias("why")).first()
            if store is not None:
                kept.append(ws.cut(check_replies(replies, now, tax).items))
                _keep(store, kept[-1])
            requests += n.good
            fatal = fatal or n.fatal > 0
            if n.unsent or (n.fatal >= limit and not n.good):
                raise RunAborted(f"{n.fatal} requests failed for good, {n.unsent} weren't sent: {n.why}")
        got = check_replies(ws.together(told), asked, tax)
        got.items = ws.together(kept) if kept else ws.cut(got.items)
        parts.append(got)
        return fatal

    fatal = ask(pending, size)
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    missing = ws.cut(pending.join(union([p.items.select("review_id") for p in parts]), "review_id", "left_anti"))
    if retry_missing and not fatal and not missing.isEmpty():
        ask(missing, 1)
    items = _stored(store, texts) if use else union([p.items for p in parts])
    return Enriched(items, union([p.issues for p in parts]), texts.select("review_id").join(items.select("review_id"), "review_id", "left_anti"), hits, requests)


class BatchClient(Protocol):
    """What a batch needs from a vendor; requests and results are folders of JSON lines, which Spark writes and reads."""

    def submit(self, requests: str, system: str) -> str:
        """requests: lines of group_id and message; returns the batch's id."""

    def status(self, batch_id: str) -> str:
        """"ended" when all is done."""

    def results(self, batch_id: str) -> str:
        """Where the lines are: group_id, outcome ("succeeded" or another), reply, detail, in any order."""


def submit_batch(reviews: DataFrame, system: str, client: BatchClient, folder: str, size: int = 5) -> str:
    """Write the requests and which reviews each has into the folder, submit them; returns the batch's id."""
    chunk(reviews.select("review_id", "review_text"), size).select("group_id", "member", "review_id", "review_text").write.mode("overwrite").parquet(f"{folder}/asked")
    asked = reviews.sparkSession.read.parquet(f"{folder}/asked")
    user_messages(asked).select("group_id", "message").write.mode("overwrite").json(f"{folder}/requests")
    return client.submit(f"{folder}/requests", system)


def poll_batch(client: BatchClient, batch_id: str, interval: float = 60, timeout: float = 24 * 3600, on_poll: Callable[[str], None] | None = None) -> str:
    """Wait until the batch has ended; TimeoutError leaves it running."""
    end = time.monotonic() + timeout
    while (status := client.status(batch_id)) != "ended":
        if on_poll:
            on_poll(status)
        if time.monotonic() > end:
            raise TimeoutError(f"batch {batch_id} is {status} after {timeout} s; it runs on and can be collected later")
        time.sleep(interval)
    return status


def collect_batch(spark: SparkSession, client: BatchClient, batch_id: str, folder: str, tax: Taxonomy, store: KeyedStore | None = None) -> Enriched:
    """The checked results of a batch, stored if there is a store."""
    lines = spark.read.schema("group_id string, outcome string, reply string, detail string").json(client.results(batch_id))
    failed = F.when(~F.col("outcome").eqNullSafe("succeeded"), F.concat(F.lit("batch: "), F.concat_ws(": ", "outcome", "detail")))
    got = check_replies(lines.select("group_id", "reply", failed.alias("error")), spark.read.parquet(f"{folder}/asked"), tax)
    if store is not None:
        got.items = Workspace(spark, "batch").cut(got.items)
        _keep(store, got.items)
    return got


def resubmit_failed(got: Enriched, system: str, client: BatchClient, folder: str, again: str, size: int = 1) -> str | None:
    """A batch of the reviews that a collected batch brought nothing for; its id, or None where nothing is missing.

    folder is the collected batch's, `again` the new one's, which poll_batch and collect_batch take as any other. Requests are small by default, as a
    request fails whole. Texts come from the asked table, so the corpus isn't read again.
    """
    spark = got.items.sparkSession
    asked = spark.read.parquet(f"{folder}/asked").select("review_id", "review_text")
    missing = Workspace(spark, "batch-again").cut(asked.join(got.failed.select("review_id").distinct(), "review_id", "left_semi"))
    return None if missing.isEmpty() else submit_batch(missing, system, client, again, size)


def load_model_cache(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of a foreign cache file, one JSON object of them under keys of any kind, by the review_id that each has.

    Of payloads with one review_id the last key's counts; a missing or broken file gives an empty frame.
    """
    empty = spark.createDataFrame([], ITEM[len("struct<") : -1])
    try:
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{ITEM}>").alias("m"))
        rows = whole.select(F.posexplode(F.map_values("m")).alias("pos", "item")).where("item.review_id <> ''")
        got = rows.groupBy("item.review_id").agg(F.max_by("item", "pos").alias("item")).select("item.*")
        got.isEmpty()
        return got
    except PySparkException:
        return empty


class OfflineProvider:
    """A provider without a network: areas whose probe matches, its match as evidence, always as the area's first issue."""

    def __init__(self, tax: Taxonomy):
        self.areas = {a: (x["probe"], x["issue_types"][0]) for a, x in tax.areas.items()}

    def __call__(self, system: str, message: str) -> str:
        return json.dumps({"results": [self._payload(i, t) for i, t in re.findall(r'<review id="([^"]*)">\n(.*?)\n</review>(?=\n<review id="|\Z)', message, re.S)]})

    def _payload(self, review_id: str, text: str) -> dict:
        hits = [(a, issue, m[0]) for a, (probe, issue) in self.areas.items() if (m := re.search(probe, text, re.I)) and m[0]]
        areas = [{"product_area": a, "issue_type": issue, "strength_type": None, "evidence_span": span, "confidence": 0.9} for a, issue, span in hits]
        return {"review_id": review_id, "areas": areas, "pain_point": None, "sentiment": "neutral", "severity": None, "customer_intent": "complaint", "support_escalation": False, "overall_confidence": 0.9}
