"""Registered queries."""

from tickloom.plans import books, market, research, statistics, storage, trading
from tickloom.plans.registry import REGISTRY
from tickloom.plans.research import reversal_ic

__all__ = ["REGISTRY", "books", "market", "research", "reversal_ic", "statistics", "storage", "trading"]
