"""Resume a run: skip the terms that are already in the output, append the rest."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nounspan.streaming.portions import PortionTable


def pending_terms(terms: DataFrame, done: DataFrame) -> DataFrame:
    """Terms without a record in the output."""
    return terms.join(done.select("term"), "term", "left_anti")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """Output of earlier runs, or None before the first."""
    return PortionTable(spark, path).read()


def append_pending(
    terms: DataFrame,
    path: str,
    make_records: Callable[[DataFrame], DataFrame],
    slices: int = 1,
) -> int:
    """Compute records for pending terms and append them, a slice of the terms after the other.

    Every slice is a job of its own that reads the corpus once, and is stored
    in full or not at all: a failure leaves the slices before it in the output,
    nothing of its own, and the next run starts there.  Returns the number of
    records added.
    """
    table = PortionTable(terms.sparkSession, path)
    done = table.read()
    todo = terms if done is None else pending_terms(terms, done)
    run, added = uuid.uuid4().hex, 0
    for k in range(slices):
        mine = todo if slices == 1 else todo.filter(F.pmod(F.xxhash64("term"), F.lit(slices)) == k)
        added += table.write(make_records(mine), f"{len(table.portions()):06d}-{run}-{k}")
    return added
