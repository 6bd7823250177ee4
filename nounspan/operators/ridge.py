"""Ridge regression for a whole grid of penalties from one pass over the data.

The sums of products of the columns tell everything: coefficients for every
penalty follow from those of the training rows, and errors from those of the
validation rows.  Tasks send one matrix each, which are added in a tree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Matrices that one task adds up in a round of the tree.
FAN_IN = 32
# Rows that a task turns into one matrix.
ROWS = 512


@dataclass(frozen=True)
class Products:
    """Sums of products of ``(1, features, label)`` over some rows."""

    sums: np.ndarray

    @property
    def n(self) -> float:
        return float(self.sums[0, 0])

    def solve(self, penalty: float) -> np.ndarray:
        """Intercept and coefficients; the penalty is on standardised columns.

        A column without any spread gets no weight.
        """
        n, width = self.n, len(self.sums) - 2
        means = self.sums[0] / n
        spread = self.sums[1:, 1:] / n - np.outer(means[1:], means[1:])
        scale = np.sqrt(np.maximum(np.diag(spread), 0.0))
        used = np.flatnonzero(scale[:width] > 0)
        weights = np.zeros(width + 1)
        if len(used) and scale[width] > 0:
            inside = spread[np.ix_(used, used)] / np.outer(scale[used], scale[used])
            toward = spread[used, width] / (scale[used] * scale[width])
            inside[np.diag_indices(len(used))] += penalty / scale[width]
            weights[used + 1] = np.linalg.lstsq(inside, toward, rcond=None)[0] * scale[width] / scale[used]
        weights[0] = means[width + 1] - weights[1:] @ means[1 : width + 1]
        return weights

    def error(self, weights: np.ndarray) -> float:
        """Mean squared error of a model over these rows."""
        residual = np.append(-weights, 1.0)
        return float(max(residual @ self.sums @ residual / self.n, 0.0))


def products(df: DataFrame, features: str, label: str, by: str) -> dict[str, Products]:
    """Sums of products for each value of ``by``, a column of few values, in one job.

    ``features`` is an array of numbers of one length.  Rows with a null among
    label and group are left out.
    """
    rows = df.filter(F.col(label).isNotNull() & F.col(by).isNotNull()).select(
        F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), F.col(by).alias("g")
    )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for g, blob in zip(batch.column("g").to_pylist(), batch.column("sums").to_pylist()):
                sums[g] = sums.get(g, 0.0) + np.frombuffer(blob)
        yield _sent(sums)

    tree = rows.mapInArrow(_summed, "g string, sums binary")
    tasks = df.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        tree = tree.repartition(tasks).mapInArrow(added, "g string, sums binary")
    total: dict = {}
    for r in tree.collect():
        total[r["g"]] = total.get(r["g"], 0.0) + np.frombuffer(r["sums"])
    return {g: Products(s.reshape(int(len(s) ** 0.5), -1)) for g, s in total.items()}


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One matrix for each group; of a batch only ``ROWS`` rows at a time are copied."""
    sums: dict = {}
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
            whole = np.column_stack([np.ones(part.num_rows), flat, part.column("y").to_numpy()])
            groups = np.array(part.column("g").to_pylist())
            for g in np.unique(groups):
                mine = whole[groups == g]
                sums[g] = sums.get(g, 0.0) + mine.T @ mine
    yield _sent(sums)


def _sent(sums: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([str(g) for g in sums], pa.string()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
        ["g", "sums"],
    )


def ridge_grid(
    df: DataFrame, features: str, label: str, split: str, grid: Iterable[float], train: str = "train", val: str = "val"
) -> dict[float, tuple[float, np.ndarray]]:
    """``penalty -> (validation error, weights)``; the rows are read once, whatever the grid."""
    sums = products(df.filter(F.col(split).isin(train, val)), features, label, split)
    if train not in sums or val not in sums:
        raise ValueError(f"there must be rows of {train!r} and of {val!r}")
    weights = {penalty: sums[train].solve(penalty) for penalty in grid}
    return {penalty: (sums[val].error(w), w) for penalty, w in weights.items()}
