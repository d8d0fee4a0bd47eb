"""Prioritisation expressions: reach, impact, confidence, effort."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scales, cut points, weights.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
IMPACT_STEPS = ["minimal", "low", "medium", "high", "massive"]
IMPACT_SCALE = [0.25, 0.5, 1.0, 2.0, 3.0]
CHURN_PROMOTES, ESCALATION_PROMOTES = 0.02, 0.5
CONFIDENCE_WEIGHTS = {"grounding": 0.30, "sample": 0.25, "label_confidence": 0.20, "mechanism": 0.15, "competitive": 0.10}
SAMPLE_SATURATION = 300
SCORE_WEIGHTS = {"volume": 0.35, "severity": 0.25, "escalation": 0.15, "churn": 0.15, "negativity": 0.10}


def severity_rank(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in SEVERITY_RANK.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def impact_step(severity: Column, churn: Column, escalation: Column) -> Column:
    """0 (minimal) to 4 (massive): cut by mean severity; churn promotes, else frequent escalation does, from below medium."""
    s = F.coalesce(severity, F.lit(0.0))
    base = F.when(s >= 3.5, 4).when(s >= 3.0, 3).when(s >= 2.5, 2).when(s >= 2.0, 1).otherwise(0)
    up = (churn >= CHURN_PROMOTES) | ((escalation >= ESCALATION_PROMOTES) & (base < 2))
    return F.least(F.lit(4), base + F.coalesce(up, F.lit(False)).cast("int"))


def impact_label(step: Column) -> Column:
    return F.get(F.array(*map(F.lit, IMPACT_STEPS)), step)


def impact_value(step: Column) -> Column:
    return F.get(F.array(*map(F.lit, IMPACT_SCALE)), step)


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def confidence_parts(grounding: Column, volume: Column, label_confidence: Column, mechanism: Column, competitive: Column) -> dict[str, Column]:
    return {
        "grounding": _unit(grounding),
        "sample": F.least(F.lit(1.0), volume / SAMPLE_SATURATION),
        "label_confidence": _unit(label_confidence),
        "mechanism": mechanism.cast("double"),
        "competitive": competitive.cast("double"),
    }


def confidence(parts: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for name, weight in CONFIDENCE_WEIGHTS.items():
        out = out + weight * parts[name]
    return out


def min_max(c: Column, low: Column, high: Column) -> Column:
    """To [0, 1]; 0 where all values are the same."""
    return F.when(high > low, (c - low) / F.nullif(high - low, F.lit(0))).otherwise(0.0)
