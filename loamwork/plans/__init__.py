"""Reviewable cleaning plans and their persistence."""

from .plan import CleaningPlan

__all__ = ["CleaningPlan"]
