"""Dense row numbers over a total order, without a one-partition window."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nounspan.session import write_out


def with_rid(df: DataFrame, order_by: list, name: str = "rid") -> DataFrame:
    """Add a dense id from 0 in the given total order.

    Rows are range-partitioned and sorted once, and stored together with their
    partition number and their place in it; the id is that place plus the
    number of rows in earlier partitions.  Only one count per partition comes
    to the driver.  Storing the sorted rows fixes the range bounds, which a
    second evaluation would draw anew.
    """
    spark = df.sparkSession
    seq = F.monotonically_increasing_id()
    placed = write_out(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .select(
            "*",
            F.shiftright(seq, 33).cast("int").alias("_rid_part"),
            seq.bitwiseAND(F.lit(2**33 - 1)).alias("_rid_at"),
        ),
        "rid",
    )
    counts = sorted(placed.groupBy("_rid_part").count().collect())
    starts = [0, *accumulate(r["count"] for r in counts)]
    # As Arrow: a list of rows would pass through Python workers of its own.
    known = pa.table(
        {
            "_rid_part": pa.array([r["_rid_part"] for r in counts], pa.int32()),
            "_start": pa.array(starts[:-1], pa.int64()),
        }
    )
    offsets = spark.createDataFrame(known, "_rid_part int, _start long")
    return placed.join(F.broadcast(offsets), "_rid_part").select(
        (F.col("_start") + F.col("_rid_at")).alias(name), *[F.col(f"`{c}`") for c in df.columns]
    )
