"""Registered queries: each operator on the given tables, next to its oracle SQL."""

from nounspan.catalog import (  # noqa: F401
    concordance,
    evaluation,
    inputs,
    lexicon,
    models,
    passages,
    relevance,
    samples,
    sampling,
)
from nounspan.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
