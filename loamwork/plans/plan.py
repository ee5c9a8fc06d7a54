"""A cleaning plan: decisions, the baseline profile and leakage warnings."""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..model import Decision, decisions_frame

VERSION = "1.0"


@dataclass
class CleaningPlan:
    decisions: list[Decision] = field(default_factory=list)
    baseline_stats: dict[str, dict[str, Any]] = field(default_factory=dict)
    leakage_warnings: list[dict[str, Any]] = field(default_factory=list)

    def approve_all(self) -> CleaningPlan:
        for d in self.decisions:
            d.approved = True
        return self

    def reject(self, rule_name: str, column: str | None = None) -> int:
        """Reject a rule's decisions, for one column or for all; returns how many."""
        hit = [d for d in self.decisions if d.rule_name == rule_name and column in (None, d.column)]
        for d in hit:
            d.approved = False
        return len(hit)

    @property
    def approved(self) -> list[Decision]:
        return [d for d in self.decisions if d.approved]

    def by_column(self) -> dict[str, list[Decision]]:
        """Approved decisions by column, in plan order."""
        out: dict[str, list[Decision]] = defaultdict(list)
        for d in self.approved:
            out[d.column].append(d)
        return dict(out)

    def summary(self) -> str:
        lines = [f"{len(self.approved)} of {len(self.decisions)} decisions approved"]
        lines += [f"[{'x' if d.approved else ' '}] {d.rule_name} {d.action} on {d.column} ({d.signal_strength:.2f}): {d.rationale}" for d in self.decisions]
        lines += [f"leakage: {w['message']}" for w in self.leakage_warnings]
        return "\n".join(lines)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return decisions_frame(spark, self.decisions)

    def save(self, path: str | Path) -> None:
        body = {
            "version": VERSION,
            "decisions": [d.to_dict() for d in self.decisions],
            "baseline_stats": self.baseline_stats,
            "leakage_warnings": self.leakage_warnings,
        }
        Path(path).write_text(json.dumps(body, indent=2, default=str))

    @classmethod
    def load(cls, path: str | Path) -> CleaningPlan:
        body = json.loads(Path(path).read_text())
        if body.get("version") != VERSION:
            raise ValueError(f"plan version {body.get('version')!r} is not {VERSION}")
        return cls([Decision.from_dict(d) for d in body["decisions"]], body["baseline_stats"], body["leakage_warnings"])
