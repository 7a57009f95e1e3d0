"""Weighted scores and classes, in exact decimals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smallest score of each class; below the last one is REJECT.
CLASSES: tuple[tuple[str, int], ...] = (("HIGH_PRIORITY", 80), ("SECONDARY", 65), ("REVIEW", 50))


def _exact(weight: float) -> Column:
    return F.lit(Decimal(str(weight))).cast("decimal(5,2)")


def lead_priority(website_quality: Column, business_opportunity: Column, market_fit: Column, weights: Mapping[str, float]) -> Column:
    """A poor website raises the priority: (100 - quality), opportunity and fit by weight, as decimal(5,2); null if one is."""
    parts = (
        (F.lit(100) - website_quality.cast("decimal(5,2)"), "website_quality"),
        (business_opportunity.cast("decimal(5,2)"), "business_opportunity"),
        (market_fit.cast("decimal(5,2)"), "market_fit"),
    )
    total = None
    for value, name in parts:
        term = value.cast("decimal(7,2)") * _exact(weights[name])
        total = term if total is None else total + term
    return total.cast("decimal(5,2)")


def classes_of(thresholds: Mapping[str, float]) -> tuple[tuple[str, float], ...]:
    """Classes and their smallest scores from the setting scoring.lead_classification.thresholds, the highest first."""
    found = [(name, thresholds[f"{name.lower()}_min"]) for name, _ in CLASSES if f"{name.lower()}_min" in thresholds]
    return tuple(sorted(found, key=lambda c: -c[1]))


def lead_class(score: Column, classes: Sequence[tuple[str, float]] = CLASSES) -> Column:
    """The first of ``classes`` whose smallest score is reached, else REJECT; null for null."""
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for name, least in classes:
        out = out.when(score >= least, name)
    return out.otherwise("REJECT")


def weighted_score(scores: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """The mean of the category scores by weight, as decimal(5,2); null if one is null."""
    total = None
    for name, weight in weights.items():
        term = scores[name].cast("decimal(7,2)") * _exact(weight)
        total = term if total is None else total + term
    return (total / F.lit(Decimal(str(sum(weights.values())))).cast("decimal(7,2)")).cast("decimal(5,2)")


def weight_sum(weights: Column) -> Column:
    """The exact sum of a map of weights."""
    return F.aggregate(F.map_values(weights), F.lit(0).cast("decimal(12,4)"), lambda s, w: (s + w.cast("decimal(12,4)")).cast("decimal(12,4)"))
