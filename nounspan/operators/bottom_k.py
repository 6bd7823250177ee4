"""Samples that can be merged: rows kept with the values by which they were drawn.

The ``n`` rows of a key with the smallest draws are a sample of its rows.  A
draw depends on the seed and the row alone, so the samples of several parts of
a corpus, merged by the same rule, are the sample of the whole.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nounspan.functions.hashing import race_time, row_hash
from nounspan.operators.sampling import top_per_key
from nounspan.session import write_out
from nounspan.sources import storage


@dataclass(frozen=True)
class KeySample:
    """Drawn rows with their ``draw``, and the number of rows (``total``) of each key.

    Rows of weight zero or less, null or NaN count in the total, but are never
    drawn.  A null key is a key.
    """

    rows: DataFrame
    totals: DataFrame
    key: str
    ids: tuple[str, ...]
    n: int
    seed: int
    weight: str | None = None

    @classmethod
    def draw(
        cls, df: DataFrame, key: str, n: int, seed: int, ids: list[str], weight: str | None = None
    ) -> KeySample:
        """At most ``n`` rows of each key, uniformly or with chances proportional to a weight.

        ``ids`` identify a row within its key, in all parts of the corpus.  The
        table is evaluated once.
        """
        value = row_hash(seed, F.col(key), *map(F.col, ids))
        if weight is not None:
            able = (F.col(weight) > 0) & ~F.isnan(F.col(weight).cast("double"))
            value = F.when(able, race_time(value, F.col(weight)))
        held = write_out(df.withColumn("draw", value), "draws")
        order = [F.col("draw"), *map(F.col, ids)]
        rows = top_per_key(held.filter("draw IS NOT NULL"), [key], order, n).drop("rank")
        totals = held.groupBy(key).agg(F.count("*").alias("total"))
        return cls(rows, totals, key, tuple(ids), n, seed, weight)

    @classmethod
    def merge(cls, parts: list[KeySample], n: int | None = None) -> KeySample:
        """The sample of all parts together, which must be disjoint and drawn alike.

        It can be as large as the smallest part's or smaller.
        """
        if not parts:
            raise ValueError("no samples to merge")
        first, n = parts[0], n or min(p.n for p in parts)
        for p in parts:
            if (p.key, p.ids, p.seed, p.weight) != (first.key, first.ids, first.seed, first.weight):
                raise ValueError("samples of different draws cannot be merged")
            if p.n < n:
                raise ValueError(f"a part holds {p.n} rows of a key, fewer than {n}")
        rows = reduce(DataFrame.unionByName, [p.rows for p in parts])
        totals = reduce(DataFrame.unionByName, [p.totals for p in parts])
        order = [F.col("draw"), *map(F.col, first.ids)]
        return cls(
            top_per_key(rows, [first.key], order, n).drop("rank"),
            totals.groupBy(first.key).agg(F.sum("total").alias("total")),
            first.key, first.ids, n, first.seed, first.weight,
        )

    def ranked(self) -> DataFrame:
        """The drawn rows with their rank from 1 within their key."""
        order = [F.col("draw"), *map(F.col, self.ids)]
        return top_per_key(self.rows, [self.key], order, self.n).drop("draw")

    def write(self, path: str) -> None:
        """Store the sample; it can be read once its description stands beside it."""
        spark = self.rows.sparkSession
        self.rows.write.parquet(f"{path}/rows")
        self.totals.write.parquet(f"{path}/totals")
        told = {
            "key": self.key, "ids": list(self.ids), "n": self.n, "seed": self.seed, "weight": self.weight,
            "rows": json.loads(self.rows.schema.json()), "totals": json.loads(self.totals.schema.json()),
        }
        storage.publish(spark, f"{path}/sample.json", json.dumps(told))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> KeySample:
        told = json.loads(storage.read_text(spark, f"{path}/sample.json"))
        rows, totals = (
            spark.read.schema(StructType.fromJson(told[c])).parquet(f"{path}/{c}") for c in ("rows", "totals")
        )
        return cls(rows, totals, told["key"], tuple(told["ids"]), told["n"], told["seed"], told["weight"])
