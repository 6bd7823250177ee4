"""Session helpers: scratch storage, bounded small sides, scan width."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bounds for a table that is copied to every executor.  A lexicon has
# hundreds of rows; anything beyond these bounds takes the shuffled path.
MAX_SMALL_ROWS = 100_000
MAX_SMALL_BYTES = 32 * 1024 * 1024

_local_scratch: str | None = None


def local_session(cores: str | int = "*", app: str = "nounspan") -> SparkSession:
    """Session for tests and benchmarks.  On a cluster, submit with its own conf."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session,
    whose tasks all see one disk, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    global _local_scratch
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="nounspan-")
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_out(df: DataFrame, label: str) -> DataFrame:
    """Store ``df`` once as Parquet in the scratch folder and read it back.

    Used where one expensive result feeds several consumers: later reads prune
    columns, and a lost executor costs a file read instead of a recomputation.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame, max_rows: int = MAX_SMALL_ROWS) -> pa.Table | None:
    """Content of a table that is meant to be small, or None if it is not.

    At most ``max_rows + 1`` rows ever reach the driver.
    """
    content = df.limit(max_rows + 1).toArrow()
    fits = content.num_rows <= max_rows and content.nbytes <= MAX_SMALL_BYTES
    return content if fits else None


def small_rows(df: DataFrame, max_rows: int = MAX_SMALL_ROWS) -> list[dict] | None:
    """Rows of a small table as dicts, or None if it is not small."""
    content = small_table(df, max_rows)
    return None if content is None else content.to_pylist()


def hinted(df: DataFrame, max_rows: int = MAX_SMALL_ROWS) -> DataFrame | None:
    """The table, evaluated once and hinted for broadcast, or None if it is not small."""
    content = small_table(df, max_rows)
    if content is None:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(content, df.schema))


def small_side(df: DataFrame, max_rows: int = MAX_SMALL_ROWS) -> DataFrame:
    """Join side with a broadcast hint when its size is proven to be small.

    A larger table comes back unhinted, so that the join shuffles and AQE
    splits its skewed keys.
    """
    side = hinted(df, max_rows)
    return df if side is None else side


def widen(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan that has fewer partitions than the cluster has cores.

    A large corpus arrives in more splits than cores and passes through
    untouched; only a corpus in one or two row groups pays for a shuffle.
    ``key`` must be close to unique.  Later conditions stay above the shuffle,
    where all cores evaluate them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    spread = df.repartition(cores, key)
    return spread.select(*[pinned(F.col(c)).alias(c) for c in df.columns])


def pinned(value: Column) -> Column:
    """The value as it is, computed in this place of the plan.

    The condition always holds, but the optimizer cannot know that, so it
    neither moves later filters below this point nor repeats the expression
    in them.
    """
    return F.when(F.spark_partition_id() >= 0, value)
