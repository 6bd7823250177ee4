"""Tables stored by the hash of a key, so that joins and groups on it need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from nounspan.session import scratch_path

# Buckets of a table: tables that are to meet need the same number.
BUCKETS = 64


def write_bucketed(df: DataFrame, key: str, path: str | None = None, name: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Store a table in sorted buckets of a key and return it as Spark's catalog knows it.

    Rows of one bucket are brought together first, so that each bucket is one
    file.  A frequent key makes its bucket large; a table with keys like that
    is better joined by a shuffle, which splits them.
    """
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, key)
        .write.bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path or scratch_path(spark, name))
        .saveAsTable(name)
    )
    return spark.table(name)
