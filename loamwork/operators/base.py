"""What a rule is: it detects on a table and transforms by approved decisions."""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame

from ..model import Decision


@runtime_checkable
class Rule(Protocol):
    name: str

    def detect(self, df: DataFrame, params: dict[str, Any] | None = None) -> list[Decision]: ...

    def transform(self, df: DataFrame, decisions: list[Decision]) -> DataFrame: ...


class BaseRule:
    """A rule named after its class, with a plain explanation of its decisions."""

    def __init__(self) -> None:
        self.name = type(self).__name__

    def detect(self, df: DataFrame, params: dict[str, Any] | None = None) -> list[Decision]:
        raise NotImplementedError

    def transform(self, df: DataFrame, decisions: list[Decision]) -> DataFrame:
        raise NotImplementedError

    def explain(self, decisions: list[Decision]) -> str:
        return "; ".join(self.describe(d) for d in decisions)

    def describe(self, d: Decision) -> str:
        return f"{d.action} on {d.column}: {d.rationale}"

    def decide(self, column: str, action: str, rationale: str, strength: float = 1.0, **parameters: Any) -> Decision:
        return Decision(self.name, column, action, parameters, strength, rationale)
