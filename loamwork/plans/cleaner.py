"""The cleaner: audits a table into a plan, and applies approved plans.

Detection looks at the table as it comes; transforms run one after the other on
the changing table, as one lazy plan.
"""

from __future__ import annotations

import inspect
import logging
import time
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.stats import clean_nan, profile
from ..model import Decision
from ..operators import CardinalityChecker, CrossColumnRule, DuplicateHandler, KnnImputer, NullHandler, OutlierHandler, Rule, SchemaCaster
from ..sources import default_output, read_path, write_path
from ..telemetry import AuditReport, Emitter, TelemetrySink
from .checks import detect_drift, leakage_warnings
from .plan import CleaningPlan
from .registry import check_rule, discover_rules

#: A plan's baseline lists the categories of columns of up to so many; new ones of larger columns are not looked for, with a warning.
BASELINE_CATEGORIES = 100_000


class DataCleaner:
    def __init__(self, rules: list[Rule] | None = None, impute_strategy: str | None = None, sinks: list[TelemetrySink] | None = None, spark: SparkSession | None = None, plugins: bool = True):
        self.rules: list[Rule] = list(rules) if rules is not None else [SchemaCaster(), DuplicateHandler(), NullHandler(), OutlierHandler(), CardinalityChecker()]
        self.impute_strategy, self.sinks, self._spark = impute_strategy, list(sinks or []), spark
        if impute_strategy == "knn" and not any(isinstance(r, KnnImputer) for r in self.rules):
            at = next((i for i, r in enumerate(self.rules) if isinstance(r, NullHandler)), len(self.rules))
            self.rules.insert(at, KnnImputer())
        if rules is None and plugins:
            self.rules += discover_rules()
        self.config_params: dict[str, dict[str, Any]] = {}
        self.last_report: AuditReport | None = None

    @classmethod
    def from_config(cls, path: str | Path, **kwargs: Any) -> DataCleaner:
        """TOML: ``[cleaner] impute_strategy`` and ``[rules.<Name>]`` with constructor arguments and detection parameters."""
        config = tomllib.loads(Path(path).read_text())
        cleaner = cls(impute_strategy=config.get("cleaner", {}).get("impute_strategy"), **kwargs)
        for name, given in config.get("rules", {}).items():
            for i, rule in enumerate(cleaner.rules):
                if rule.name != name:
                    continue
                known = inspect.signature(type(rule).__init__).parameters
                own = {k: v for k, v in given.items() if k in known}
                try:
                    cleaner.rules[i] = type(rule)(**own)
                except (TypeError, ValueError):
                    logging.getLogger("loamwork").exception("settings of %s don't fit; defaults stay", name)
                rest = {k: v for k, v in given.items() if k not in known}
                if rest:
                    cleaner.config_params[name] = rest
        return cleaner

    def register_rule(self, rule: Rule) -> None:
        self.rules.append(check_rule(rule))

    def _frame(self, data: DataFrame | str | Path) -> DataFrame:
        if isinstance(data, DataFrame):
            return data
        if not isinstance(data, (str, Path)):  # a pandas table
            return (self._spark or SparkSession.getActiveSession()).createDataFrame(data)
        return read_path(self._spark or SparkSession.builder.getOrCreate(), str(data))

    def fit(self, data: DataFrame | str | Path, params_map: dict[str, dict[str, Any]] | None = None, target_col: str | None = None) -> CleaningPlan:
        df, emit = clean_nan(self._frame(data)), Emitter(self.sinks)
        given = dict(params_map or {})
        if self.impute_strategy == "knn":
            given["NullHandler"] = {"numeric_strategy": "none", **given.get("NullHandler", {})}
        warnings = []
        if target_col is not None:
            warnings = leakage_warnings(df, target_col)
        decisions: list[Decision] = []
        for rule in self.rules:
            params = {**self.config_params.get(rule.name, {}), **given.get(rule.name, {})}
            found = rule.detect(df, params) if params else rule.detect(df)
            for d in found:
                if not isinstance(d, Decision):
                    raise TypeError(f"{rule.name} returned {type(d).__name__} instead of a Decision")
            decisions += found
        for w in warnings:
            emit("target_leakage", column=w["column"], **{k: v for k, v in w.items() if k != "column"})
        return CleaningPlan(decisions, profile(df, BASELINE_CATEGORIES), warnings)

    def apply(self, df: DataFrame, plan: CleaningPlan) -> DataFrame:
        """The approved decisions as one lazy table; no job runs but where a rule needs one."""
        source = clean_nan(df)
        out = source
        drops = [r for r in self.rules if isinstance(r, CardinalityChecker)]
        # Constraints may speak of columns that are dropped, so drops come last.
        for rule in [*(r for r in self.rules if r not in drops), *drops]:
            own = [d for d in plan.approved if d.rule_name == rule.name]
            if isinstance(rule, CrossColumnRule):
                names = {c.name for c in rule.constraints}
                own = [d for d in own if d.column in names]
            if isinstance(rule, NullHandler):
                rule.source = source
            if own:
                out = rule.transform(out, own)
        return out

    def transform(self, data: DataFrame | str | Path, plan: CleaningPlan, output_path: str | None = None) -> tuple[DataFrame | str, AuditReport]:
        """The cleaned table (or the path it was written to, for a path) and the report."""
        began, emit = time.time(), Emitter(self.sinks)
        df = self._frame(data)
        alerts = []
        for w in plan.leakage_warnings:
            emit("target_leakage", column=w["column"], **{k: v for k, v in w.items() if k != "column"})
            alerts.append(dict(w))
        for d in plan.decisions:
            if d.action == "flag_violation":
                emit("constraint_violation", d.rule_name, d.column, **d.parameters)
                alerts.append({"column": d.column, "kind": "constraint", "message": f"{d.column}: {d.parameters['violation_count']} violations. {d.parameters['error_msg']}"})
        for a in detect_drift(plan.baseline_stats, df):
            emit("drift_alert", column=a["column"], **{k: v for k, v in a.items() if k != "column"})
            alerts.append(a)
        out = self.apply(df, plan)
        mutations = []
        by_name = {r.name: r for r in self.rules}
        for d in plan.approved:
            rule = by_name.get(d.rule_name)
            if rule is None:
                continue
            summary = rule.explain([d]) if hasattr(rule, "explain") else f"{d.action} on {d.column}"
            extra = {"dropped_rows": d.parameters["violation_count"]} if d.action == "drop" else {}
            emit("rule_mutation", d.rule_name, d.column, summary=summary, action=d.action, **extra)
            mutations.append({"rule_name": d.rule_name, "column": d.column, "action": d.action, "summary": summary, **extra})
        result: DataFrame | str = out
        if isinstance(data, (str, Path)):
            result = write_path(out, output_path or default_output(str(data)))
            rows = read_path(out.sparkSession, result).count()
        else:
            if output_path:
                write_path(out, output_path)
            rows = out.count()
        self.last_report = AuditReport((df.count(), len(df.columns)), (rows, len(out.columns)), (time.time() - began) * 1000, mutations, alerts)
        return result, self.last_report

    def fit_transform(self, data: DataFrame | str | Path, target_col: str | None = None, output_path: str | None = None):
        return self.transform(data, self.fit(data, target_col=target_col).approve_all(), output_path)


class CleaningAccessor:
    """``df.loam``: audit, clean and report of a table."""

    def __init__(self, df: DataFrame):
        self.df = df

    def audit(self, **kwargs: Any) -> CleaningPlan:
        return DataCleaner(**{k: v for k, v in kwargs.items() if k != "target_col"}).fit(self.df, target_col=kwargs.get("target_col"))

    def clean(self, **kwargs: Any) -> DataFrame:
        out, report = DataCleaner(**{k: v for k, v in kwargs.items() if k != "target_col"}).fit_transform(self.df, kwargs.get("target_col"))
        out._loam_report = report
        return out

    @property
    def report(self) -> AuditReport | None:
        return getattr(self.df, "_loam_report", None)


def install_accessor() -> None:
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    for kind in {DataFrame, Classic}:
        kind.loam = property(CleaningAccessor)
