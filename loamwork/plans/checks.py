"""Checks beside the rules: distribution drift against a baseline, and target leakage."""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import CATEGORY_CAP, clean_nan, col, correlation, profile
from ..model import is_numeric

NULL_SHIFT = 0.10
MEAN_SHIFT = 0.15
LEAK_CORRELATION = 0.85

log = logging.getLogger(__name__)


def drift_alerts(baseline: dict[str, dict[str, Any]], now: dict[str, dict[str, Any]]) -> list[dict[str, Any]]:
    """Alerts on missing columns, null ratios, means and new categories; columns beside the baseline are ignored.

    A mean is compared relative to the baseline's, absolutely where that is zero.
    Categories are compared here only where both list them; ``detect_drift`` compares the rest.
    """
    alerts = []

    def alert(column: str, kind: str, message: str, **detail: Any) -> None:
        alerts.append({"column": column, "kind": kind, "message": message, **detail})

    for column, then in baseline.items():
        stats = now.get(column)
        if stats is None:
            alert(column, "missing_column", f"{column} is missing")
            continue
        moved = abs(stats["null_ratio"] - then["null_ratio"])
        if moved > NULL_SHIFT:
            alert(column, "null_ratio", f"{column}: null ratio {then['null_ratio']:.3f} became {stats['null_ratio']:.3f}", shift=moved)
        if "mean" in then and "mean" in stats:
            shift = abs(stats["mean"] - then["mean"])
            shift = shift / abs(then["mean"]) if then["mean"] else shift
            if shift > MEAN_SHIFT:
                alert(column, "mean", f"{column}: mean {then['mean']:g} became {stats['mean']:g}", shift=shift)
        if "categories" in then and "categories" in stats:
            new = sorted(set(stats["categories"]) - set(then["categories"]))
            if new:
                alert(column, "new_categories", f"{column}: new categories {new}", categories=new)
    return alerts


def _many_categories(baseline: dict[str, dict[str, Any]], now: dict[str, dict[str, Any]], df: DataFrame, reference: DataFrame | None) -> list[dict[str, Any]]:
    """New categories of the columns that a profile does not list: how many, and the first of them."""
    alerts = []
    for column, then in baseline.items():
        if column not in now or "categories_capped" not in then or ("categories" in then and "categories" in now[column]):
            continue
        value = col(column).cast("string")
        if "categories" in then:
            known = df.sparkSession.createDataFrame([(v,) for v in then["categories"]], "v string")
        elif reference is not None:
            known = reference.select(value.alias("v"))
        else:
            log.warning("%s: the baseline does not list its categories; new ones are not looked for", column)
            continue
        values = df.select(value.alias("v")).filter("v is not null").distinct().join(known.distinct(), "v", "left_anti")
        number = values.count()
        if number:
            first = [r["v"] for r in values.orderBy("v").limit(CATEGORY_CAP).collect()]
            alerts.append({"column": column, "kind": "new_categories", "message": f"{column}: {number} new categories, from {first[:5]} on", "categories": first, "count": number})
    return alerts


def detect_drift(baseline: dict[str, dict[str, Any]], df: DataFrame, reference: DataFrame | None = None) -> list[dict[str, Any]]:
    """Alerts against a baseline profile; ``reference``, its table, serves columns whose categories it does not list."""
    if not baseline:
        return []
    now = profile(df)
    if not now:  # an empty table has all its columns, and nothing to compare
        return [a for a in drift_alerts(baseline, {c: {"null_ratio": baseline[c]["null_ratio"]} for c in df.columns if c in baseline}) if a["kind"] == "missing_column"]
    return drift_alerts(baseline, now) + _many_categories(baseline, now, df, reference)


def leakage_warnings(df: DataFrame, target: str, limit: float = LEAK_CORRELATION) -> list[dict[str, Any]]:
    """Columns that are named after the target, and columns that nearly copy it; one aggregate."""
    if target not in df.columns:
        raise AssertionError(f"target column {target!r} is not in the table")
    found = [
        {"column": c, "kind": "semantic", "message": f"{c} is named after the target {target}"}
        for c in df.columns
        if c != target and target.lower() in c.lower()
    ]
    df = clean_nan(df)
    usable = lambda c: is_numeric(df.schema[c].dataType) or isinstance(df.schema[c].dataType, T.BooleanType)
    as_number = lambda c: col(c).cast("int" if isinstance(df.schema[c].dataType, T.BooleanType) else "double")
    others = [c for c in df.columns if c != target and usable(c)]
    if usable(target) and others:
        row = df.agg(*[correlation(as_number(c), as_number(target)).alias(f"r{i}") for i, c in enumerate(others)]).first()
        found += [
            {"column": c, "kind": "correlation", "correlation": row[f"r{i}"], "message": f"{c} correlates with the target {target} at {row[f'r{i}']:.3f}"}
            for i, c in enumerate(others)
            if row[f"r{i}"] is not None and abs(row[f"r{i}"]) > limit
        ]
    return found
