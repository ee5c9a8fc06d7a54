"""The cleaning rules."""

from .base import BaseRule, Rule
from .basic import CardinalityChecker, CrossColumnRule, Constraint, DuplicateHandler, NullHandler, OutlierHandler, SchemaCaster
from .knn import KnnImputer
from .similar import FuzzyUnifier, NearDuplicateDetector

__all__ = [
    "BaseRule", "CardinalityChecker", "Constraint", "CrossColumnRule", "DuplicateHandler", "FuzzyUnifier", "KnnImputer",
    "NearDuplicateDetector", "NullHandler", "OutlierHandler", "Rule", "SchemaCaster",
]
