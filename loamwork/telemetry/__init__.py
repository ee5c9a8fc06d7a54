"""Structured events, sinks for them, and the audit report of a run."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections import defaultdict
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any, Protocol, runtime_checkable

ALERTS = ("target_leakage", "drift_alert", "constraint_violation")


@dataclass
class TelemetryEvent:
    event_type: str
    run_id: str
    rule_name: str | None = None
    column: str | None = None
    payload: dict[str, Any] = field(default_factory=dict)
    timestamp: float = field(default_factory=time.time)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


@runtime_checkable
class TelemetrySink(Protocol):
    def emit(self, event: TelemetryEvent) -> None: ...


class JsonLinesSink:
    """Appends one JSON object a line; ``spark.read.json`` reads the file."""

    def __init__(self, file_path: str | Path):
        self.path = Path(file_path)

    def emit(self, event: TelemetryEvent) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a") as out:
            out.write(json.dumps(event.to_dict(), default=str) + "\n")


class LoggingSink:
    """Alerts as warnings, the rest as information."""

    def __init__(self, logger: logging.Logger | None = None):
        self.logger = logger or logging.getLogger("loamwork")

    def emit(self, event: TelemetryEvent) -> None:
        level = logging.WARNING if event.event_type in ALERTS else logging.INFO
        self.logger.log(level, "%s %s %s %s", event.event_type, event.rule_name, event.column, json.dumps(event.payload, default=str))


@dataclass
class AuditReport:
    """What a transform did: shapes, time, changes and alerts."""

    initial_shape: tuple[int, int]
    final_shape: tuple[int, int]
    execution_time_ms: float
    mutations: list[dict[str, Any]] = field(default_factory=list)
    alerts: list[dict[str, Any]] = field(default_factory=list)

    def by_rule(self) -> dict[str, list[str]]:
        """Distinct summaries by rule, in the order they came."""
        out: dict[str, dict[str, None]] = defaultdict(dict)
        for m in self.mutations:
            out[m["rule_name"]][m["summary"]] = None
        return {k: list(v) for k, v in out.items()}

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def display(self) -> str:
        lines = [f"{self.initial_shape} -> {self.final_shape} in {self.execution_time_ms:.0f} ms"]
        lines += [f"{rule}: {s}" for rule, found in self.by_rule().items() for s in found]
        lines += [f"alert: {a['message']}" for a in self.alerts]
        return "\n".join(lines)


class Emitter:
    """Sends events of one run to all sinks; a sink that fails doesn't stop the run."""

    def __init__(self, sinks: list[TelemetrySink]):
        self.sinks, self.run_id = sinks, uuid.uuid4().hex

    def __call__(self, event_type: str, rule_name: str | None = None, column: str | None = None, **payload: Any) -> None:
        event = TelemetryEvent(event_type, self.run_id, rule_name, column, payload)
        for sink in self.sinks:
            try:
                sink.emit(event)
            except Exception:
                logging.getLogger("loamwork").exception("telemetry sink %r failed", sink)
