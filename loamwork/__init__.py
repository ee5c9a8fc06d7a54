"""Audits and cleans tables on Spark: findings become reviewable decisions, approved ones a lazy plan."""

from .model import Decision
from .plans import CleaningPlan
from .plans.cleaner import CleaningAccessor, DataCleaner, install_accessor

__all__ = ["CleaningAccessor", "CleaningPlan", "DataCleaner", "Decision", "install_accessor"]
