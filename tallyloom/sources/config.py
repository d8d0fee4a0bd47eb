"""YAML sources: dataset, taxonomy, model registry. Small documents, read and validated on the driver."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from tallyloom.functions.text import java_pattern

CONFIG = Path(__file__).resolve().parent.parent.parent / "config"


class ConfigError(ValueError):
    pass


def load_dataset(path: str | Path | None = None) -> dict[str, Any]:
    """A dataset profile; $TALLYLOOM_DATASET names another file. Date formats must be usable, platform ids unique."""
    d = yaml.safe_load(Path(path or os.environ.get("TALLYLOOM_DATASET") or CONFIG / "dataset.yaml").read_text(encoding="utf-8"))
    ids = [p["id"] for p in d.get("platforms", [])]
    if not ids or len(ids) != len(set(ids)):
        raise ConfigError(f"platform ids must be there and unique: {ids}")
    if not d.get("date_formats"):
        raise ConfigError("date_formats is empty")
    for f in d["date_formats"]:
        java_pattern(f)
    return d


def load_models(path: str | Path | None = None) -> dict[str, dict[str, Any]]:
    """Model id -> profile (provider, prices per million tokens, batch discount, effort); by default those of config/models.yaml."""
    d = yaml.safe_load(Path(path or CONFIG / "models.yaml").read_text(encoding="utf-8"))
    models = {m["id"]: {"batch_discount": 1.0, "effort": None} | m for m in d["models"]}
    if len(models) != len(d["models"]):
        raise ConfigError("model ids must be unique")
    for m in models.values():
        lost = [k for k in ("provider", "input_per_million", "output_per_million") if k not in m]
        if lost or min(m["input_per_million"], m["output_per_million"]) < 0 or not 0 < m["batch_discount"] <= 1 or m["effort"] not in (None, *EFFORT):
            raise ConfigError(f"model {m['id']}: {f'{lost} missing' if lost else 'a price, discount or effort is out of range'}")
    return models


#: Output tokens for each one that is read, by effort: models that think are billed for it.
EFFORT = {"low": 1.5, "medium": 2.0, "high": 3.0}


def corpus_cost(profile: dict[str, Any], reviews: int, prompt_chars: int, size: int = 5, review_tokens: float = 90, output_tokens: float = 260, retry_rate: float = 0.1) -> dict[str, float]:
    """requests, tokens and price of enriching a corpus, before it is sent; a planning figure.

    Every request carries the instructions (4 characters to a token), `size` reviews at most. A share of the reviews is asked again by itself, instructions
    included, and answered twice. Nothing is taken off for cached instructions.
    """
    if not 0 <= retry_rate < 1:
        raise ValueError("retry_rate must be in [0, 1)")
    groups, again, prompt = max(1, -(-reviews // size)), round(reviews * retry_rate), prompt_chars // 4
    sent = groups * prompt + reviews * review_tokens + again * (prompt + review_tokens)
    got = (reviews + again) * output_tokens * EFFORT.get(profile.get("effort") or "", 1.0)
    return {"requests": groups + again, "input_tokens": sent, "output_tokens": got, "usd": estimate_cost(profile, sent, got), "usd_batch": estimate_cost(profile, sent, got, True)}


def estimate_cost(profile: dict[str, Any], input_tokens: float, output_tokens: float, batch: bool = False) -> float:
    """the price of a run in the profile's currency."""
    usd = input_tokens / 1e6 * profile["input_per_million"] + output_tokens / 1e6 * profile["output_per_million"]
    return usd * (profile.get("batch_discount", 1.0) if batch else 1.0)


def max_tokens_for(reviews: int, per_review: int = 400, floor: int = 1024, ceiling: int = 16000) -> int:
    """the output budget of a request for some reviews."""
    return max(floor, min(ceiling, reviews * per_review))


@dataclass(frozen=True)
class Taxonomy:
    """Domains, areas with their issue and strength labels and probes, attribute vocabularies."""

    domains: list[str]
    areas: dict[str, dict[str, Any]]
    attributes: dict[str, list[str]]
    special: dict[str, str]
    fallback: str
    rule: str = ""
    extra: dict[str, Any] = field(default_factory=dict)

    @property
    def probes(self) -> dict[str, str]:
        return {a: x["probe"] for a, x in self.areas.items()}

    def pairs(self, kind: str) -> list[tuple[str, str]]:
        return [(a, label) for a, x in self.areas.items() for label in x[kind]]

    def frame(self, spark: SparkSession, kind: str) -> DataFrame:
        """(product_area, label) of issue_types or strength_types: a dimension bounded by the document it comes from."""
        return spark.createDataFrame(self.pairs(kind), "product_area string, label string")

    def area_queries(self) -> dict[str, str]:
        """A text for each area, from its id and labels, for retrieval."""
        return {a: " ".join([a, *x["issue_types"], *x["strength_types"]]).replace("_", " ") for a, x in self.areas.items()}


def load_taxonomy(path: str | Path | None = None) -> Taxonomy:
    """Read and check as a graph."""
    d = yaml.safe_load(Path(path or CONFIG / "taxonomy.yaml").read_text(encoding="utf-8"))
    areas = {a["id"]: a for a in d["areas"]}
    problems = []
    if len(areas) != len(d["areas"]):
        problems.append("area ids repeat")
    if d["fallback_area"]["id"] in areas:
        problems.append("the fallback area is also an area")
    used = {a["domain"] for a in d["areas"]}
    problems += [f"unknown domain {x}" for x in used - set(d["domains"])] + [f"domain without area {x}" for x in set(d["domains"]) - used]
    labels = [x for a in d["areas"] for k in ("issue_types", "strength_types") for x in a[k]]
    problems += [f"label {x} repeats" for x in {x for x in labels if labels.count(x) > 1}]
    problems += [f"special area {k} -> {v}" for k, v in d.get("special_areas", {}).items() if v not in areas]
    for a in d["areas"]:
        p = a.get("probe", "")
        if not p:
            problems.append(f"no probe for {a['id']}")
        elif any(ord(c) < 32 for c in p):
            problems.append(f"control character in the probe of {a['id']}")
        else:
            try:
                re.compile(p)
            except re.error as e:
                problems.append(f"probe of {a['id']}: {e}")
    if problems:
        raise ConfigError("; ".join(problems))
    return Taxonomy(d["domains"], areas, d["attributes"], d.get("special_areas", {}), d["fallback_area"]["id"], d["fallback_area"].get("monitoring_rule", ""))
