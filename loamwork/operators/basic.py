"""Casts, exact duplicates, null fills, outlier clips, cardinality and cross-column constraints.

Detection batches what it counts into one or two aggregates over the table;
transforms are lazy projections and filters.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import clean_nan, col, distinct_count, medians, null_counts, quartiles
from ..model import Decision, is_countable, is_numeric, is_string, is_temporal, semantic_type, target_type
from .base import BaseRule

IQR_FACTOR = 1.5
IDENTIFIER_RATIO = 0.99


class SchemaCaster(BaseRule):
    """Casts columns to a target schema; text columns named like dates are parsed to timestamps."""

    def __init__(self, schema: dict[str, str] | None = None, strict: bool = False):
        super().__init__()
        self.schema, self.strict = schema or {}, strict

    def detect(self, df: DataFrame, params: dict[str, Any] | None = None) -> list[Decision]:
        wanted = {**self.schema, **((params or {}).get("schema") or {})}
        found = []
        for f in df.schema:
            if semantic_type(f.name) == "datetime_hint" and is_string(f.dataType):
                found.append(self.decide(f.name, "cast", "the name suggests a date", target_type="Datetime", method="to_datetime"))
            elif f.name in wanted:
                kind = target_type(wanted[f.name])
                if kind is not None and kind != f.dataType and not (is_temporal(kind) and f.dataType == kind):
                    found.append(self.decide(f.name, "cast", f"{f.dataType.simpleString()} is to be {wanted[f.name]}", target_type=wanted[f.name]))
        return found

    def transform(self, df: DataFrame, decisions: list[Decision]) -> DataFrame:
        casts = {}
        for d in decisions:
            kind = target_type(d.parameters.get("target_type", ""))
            if d.column in df.columns and kind is not None:
                c = col(d.column)
                if d.parameters.get("method") == "to_datetime":
                    casts[d.column] = F.try_to_timestamp(c).cast(T.TimestampNTZType()) if not self.strict else c.cast(T.TimestampNTZType())
                else:
                    casts[d.column] = c.cast(kind) if self.strict else c.try_cast(kind)
        return df.withColumns(casts) if casts else df


class DuplicateHandler(BaseRule):
    """Removes rows equal in ``subset`` (all columns by default).

    keep: any, first, last or none. First and last are by ``order_by``, which a
    table has no order without; full-row duplicates need none, they are equal.
    """

    def __init__(self, subset: list[str] | None = None, keep: str = "first", order_by: list[str] | None = None):
        super().__init__()
        self.subset, self.keep, self.order_by = subset, keep, order_by

    def detect(self, df: DataFrame, params: dict[str, Any] | None = None) -> list[Decision]:
        p = params or {}
        subset, keep, order = p.get("subset", self.subset), p.get("keep", self.keep), p.get("order_by", self.order_by)
        keys = [c for c in subset or df.columns if is_countable(df.schema[c].dataType)]
        row = df.groupBy(*map(col, keys)).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") > 1), F.sum(F.when(F.col("n") > 1, F.col("n")))).first()
        rows, groups = row[0] or 0, row[1]
        drop = (row[3] or 0) if keep == "none" else rows - groups
        if not drop:
            return []
        return [
            self.decide("all", "drop_duplicates", f"{drop} rows repeat others", 0.8 if subset else 1.0, subset=subset, keep=keep, order_by=order, num_duplicates=drop)
        ]

    def transform(self, df: DataFrame, decisions: list[Decision]) -> DataFrame:
        for d in decisions:
            subset, keep, order = (d.parameters.get(k) for k in ("subset", "keep", "order_by"))
            keys = [c for c in subset or df.columns if is_countable(df.schema[c].dataType)]
            if keep == "none":
                w = Window.partitionBy(*map(col, keys))
                df = df.withColumn("__n", F.count(F.lit(1)).over(w)).filter("__n = 1").drop("__n")
            elif keep == "any" or not subset:
                df = df.dropDuplicates(keys)
            else:
                by = [col(c) for c in order or [c for c in df.columns if is_countable(df.schema[c].dataType)]]
                w = Window.partitionBy(*map(col, keys)).orderBy(*[c.asc() if keep == "first" else c.desc() for c in by])
                df = df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
        return df


class NullHandler(BaseRule):
    """Fills nulls: numbers by median or mean, the rest by the most frequent value, the least of them on a tie.

    The fill value is computed when the plan is applied, on the table as it is
    then, or on the plan's input with ``fill_from='input'``; it is joined to the
    rows as a one-row table, so that the transform stays lazy.
    """

    def __init__(self, numeric_strategy: str | None = "median", categorical_strategy: str | None = "mode", fill_from: str = "current"):
        super().__init__()
        self.numeric_strategy, self.categorical_strategy, self.fill_from = numeric_strategy, categorical_strategy, fill_from
        self.source: DataFrame | None = None

    def detect(self, df: DataFrame, params: dict[str, Any] | None = None) -> list[Decision]:
        p = params or {}
        numeric, other = p.get("numeric_strategy", self.numeric_strategy), p.get("categorical_strategy", self.categorical_strategy)
        df = clean_nan(df)
        counts, found = null_counts(df), []
        for f in df.schema:
            strategy = numeric if is_numeric(f.dataType) else other
            if counts[f.name] and strategy not in (None, "none") and is_countable(f.dataType):
                ratio = counts[f.name] / counts["__rows"]
                found.append(self.decide(f.name, strategy, f"{counts[f.name]} nulls", ratio, strategy=strategy))
        return found

    @staticmethod
    def values(df: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
        """One row of the fills in order; no task holds all values of a column."""
        middle = [c for c, s in wanted if s == "median"]
        out = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.avg(col(c)).alias(f"__fill{i}") for i, (c, s) in enumerate(wanted) if s == "mean"])
        if middle:
            out = out.crossJoin(medians(df, middle))
        for i, (c, s) in enumerate(wanted):
            if s not in ("median", "mean"):
                counts = df.filter(col(c).isNotNull()).groupBy(col(c).alias("v")).agg((-F.count(F.lit(1))).alias("n"))
                out = out.crossJoin(counts.agg(F.min_by("v", F.struct("n", "v")).alias(f"__fill{i}")))
        return out.select(*[F.col(f"m{middle.index(c)}" if s == "median" else f"__fill{i}").alias(f"__fill{i}") for i, (c, s) in enumerate(wanted)])

    def transform(self, df: DataFrame, decisions: list[Decision]) -> DataFrame:
        df = clean_nan(df)
        wanted = [(d.column, d.parameters.get("strategy", d.action)) for d in decisions if d.column in df.columns]
        if not wanted:
            return df
        source = clean_nan(self.source) if self.fill_from == "input" and self.source is not None else df
        fills = self.values(source, wanted)
        joined = df.crossJoin(F.broadcast(fills))  # one row
        at = {c: i for i, (c, _) in enumerate(wanted)}
        return joined.select(*[F.coalesce(col(c), F.col(f"__fill{at[c]}")).alias(c) if c in at else col(c) for c in df.columns])


class OutlierHandler(BaseRule):
    """Clips numbers, identifiers apart, to the quartiles widened by a multiple of their distance."""

    def __init__(self, multiplier: float = IQR_FACTOR, exact: bool = True):
        super().__init__()
        self.multiplier, self.exact = multiplier, exact

    def detect(self, df: DataFrame, params: dict[str, Any] | None = None) -> list[Decision]:
        k = (params or {}).get("multiplier", self.multiplier)
        df = clean_nan(df)
        columns = [f.name for f in df.schema if is_numeric(f.dataType) and semantic_type(f.name) != "identifier"]
        bounds = {c: (q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])) for c, q in quartiles(df, columns, self.exact).items() if q}
        if not bounds:
            return []
        out = [F.count_if((col(c) < lo) | (col(c) > hi)).alias(f"o{i}") for i, (c, (lo, hi)) in enumerate(bounds.items())]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *out).first()
        return [
            self.decide(c, "clip", f"{row[f'o{i}']} values beyond [{lo:g}, {hi:g}]", row[f"o{i}"] / row["rows"], lower_bound=lo, upper_bound=hi)
            for i, (c, (lo, hi)) in enumerate(bounds.items())
            if row[f"o{i}"]
        ]

    def transform(self, df: DataFrame, decisions: list[Decision]) -> DataFrame:
        clips = {}
        for d in decisions:
            if d.column in df.columns:
                c, lo, hi = col(d.column), d.parameters["lower_bound"], d.parameters["upper_bound"]
                clips[d.column] = F.when(c < lo, F.lit(lo)).when(c > hi, F.lit(hi)).otherwise(c)
        return df.withColumns(clips) if clips else df


class CardinalityChecker(BaseRule):
    """Drops columns of one value (a null is a value) and flags text columns that look like keys."""

    def __init__(self, exact: bool = True):
        super().__init__()
        self.exact = exact

    def detect(self, df: DataFrame, params: dict[str, Any] | None = None) -> list[Decision]:
        df = clean_nan(df)
        columns = [f for f in df.schema if is_countable(f.dataType)]
        if not columns:
            return []
        count = distinct_count if self.exact else lambda c: F.approx_count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))
        row = df.agg(F.count(F.lit(1)).alias("rows"), *[count(col(f.name)).alias(f"u{i}") for i, f in enumerate(columns)]).first()
        found = []
        for i, f in enumerate(columns):
            n = row[f"u{i}"]
            if not row["rows"]:
                continue
            if n == 1:
                found.append(self.decide(f.name, "drop_column", "one value only", unique_count=1, reason="constant"))
            elif is_string(f.dataType) and n / row["rows"] > IDENTIFIER_RATIO:
                found.append(self.decide(f.name, "flag_id", "nearly all values differ", 0.9, unique_ratio=n / row["rows"], reason="identifier"))
        return found

    def transform(self, df: DataFrame, decisions: list[Decision]) -> DataFrame:
        return df.drop(*[d.column for d in decisions if d.action == "drop_column"])


@dataclass
class Constraint:
    """``condition`` (SQL text or a Column) is true where a row violates; null is no violation unless asked for."""

    name: str
    condition: str | Column
    error_msg: str = ""
    action: str = "warn"
    null_is_violation: bool = False

    def violated(self) -> Column:
        c = F.expr(self.condition) if isinstance(self.condition, str) else self.condition
        return F.coalesce(c, F.lit(self.null_is_violation))


class CrossColumnRule(BaseRule):
    """Counts violations of constraints in one aggregate; those with action drop filter the rows."""

    def __init__(self, constraints: list[Constraint]):
        super().__init__()
        self.constraints = constraints

    def detect(self, df: DataFrame, params: dict[str, Any] | None = None) -> list[Decision]:
        if not self.constraints:
            return []
        row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c.violated()).alias(f"v{i}") for i, c in enumerate(self.constraints)]).first()
        return [
            self.decide(
                c.name, "drop" if c.action == "drop" else "flag_violation", c.error_msg or f"{row[f'v{i}']} rows violate {c.name}", row[f"v{i}"] / row["rows"],
                constraint_name=c.name, violation_count=row[f"v{i}"], error_msg=c.error_msg, constraint_action=c.action,
            )
            for i, c in enumerate(self.constraints)
            if row[f"v{i}"]
        ]

    def transform(self, df: DataFrame, decisions: list[Decision]) -> DataFrame:
        drop = {d.column for d in decisions if d.action == "drop"}
        for c in self.constraints:
            if c.name in drop:
                df = df.filter(~c.violated())
        return df
