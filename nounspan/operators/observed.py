"""Counts of rows taken by the job that uses a table anyway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Observed:
    """A table with aggregates that are known once it has been written.

    ``df`` goes into one write, which must read it once: not below a sort of
    the whole table, whose sampling would read it a second time.
    """

    def __init__(self, df: DataFrame, **counts: Column):
        self._seen = Observation()
        wanted = counts or {"rows": F.count(F.lit(1))}
        self.df = df.observe(self._seen, *[c.alias(name) for name, c in wanted.items()])

    def get(self) -> dict[str, int]:
        """The aggregates; waits for the job that reads the table."""
        return dict(self._seen.get)

    def rows(self) -> int:
        return self.get()["rows"]


def funnel_counts(stages: dict[str, Column]) -> dict[str, Column]:
    """Rows in all, and rows that passed each stage and all before it, as aggregates."""
    passed, counts = F.lit(True), {"total": F.count(F.lit(1))}
    for name, predicate in stages.items():
        passed = passed & F.coalesce(predicate, F.lit(False))
        counts[name] = F.count_if(passed)
    return counts


def observed_funnel(df: DataFrame, stages: dict[str, Column]) -> Observed:
    """The rows that pass all stages, with the funnel of the whole table beside them."""
    seen = Observed(df, **funnel_counts(stages))
    kept = seen.df
    for predicate in stages.values():
        kept = kept.filter(F.coalesce(predicate, F.lit(False)))
    seen.df = kept
    return seen
