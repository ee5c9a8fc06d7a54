"""Rules that other packages bring, by entry point."""

from __future__ import annotations

import inspect
import logging
from importlib.metadata import entry_points

from ..operators.base import Rule

GROUP = "loamwork.rules"


def check_rule(rule: object) -> Rule:
    if not isinstance(rule, Rule):
        raise TypeError(f"{rule!r} is not a rule: it needs name, detect and transform")
    return rule


def discover_rules(group: str = GROUP) -> list[Rule]:
    """Classes are instantiated; what fails to load is logged and left out."""
    found = []
    for point in entry_points(group=group):
        try:
            loaded = point.load()
            found.append(check_rule(loaded() if inspect.isclass(loaded) else loaded))
        except Exception:
            logging.getLogger("loamwork").exception("rule %s can't be loaded", point.name)
    return found
