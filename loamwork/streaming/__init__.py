"""Saved plans on streams: what is stateless applies as it is; drift is checked by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..model import Decision
from ..operators import CardinalityChecker, CrossColumnRule, FuzzyUnifier, OutlierHandler, SchemaCaster
from ..plans.checks import detect_drift
from ..plans.plan import CleaningPlan

STATELESS = (SchemaCaster, OutlierHandler, FuzzyUnifier, CrossColumnRule, CardinalityChecker)


def apply_to_stream(stream: DataFrame, plan: CleaningPlan, rules: list, fills: dict | None = None, watermark: tuple[str, str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """The plan's casts, clips, mappings, constraint filters and drops on a stream.

    ``fills`` gives fixed values for nulls (a stream has no median). With
    ``watermark`` (column, delay) and ``keys`` duplicates go within the watermark.
    """
    if watermark:
        stream = stream.withWatermark(*watermark)
        if keys:
            stream = stream.dropDuplicatesWithinWatermark(keys)
    if fills:
        stream = stream.fillna(fills)
    for rule in rules:
        own: list[Decision] = [d for d in plan.approved if d.rule_name == rule.name]
        if own and isinstance(rule, STATELESS):
            stream = rule.transform(stream, own)
    return stream


def drift_monitor(plan: CleaningPlan, alert: Callable[[int, dict], None]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that reports each batch's drift against the plan's baseline."""

    def check(batch: DataFrame, number: int) -> None:
        for a in detect_drift(plan.baseline_stats, batch):
            alert(number, a)

    return check
