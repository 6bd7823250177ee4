"""Exact deduplication by a distributed content sort.

Texts are normalised (white space deleted), range-partitioned by Spark's
sampled splitters over (leading bytes, digest, piece), sorted externally by
their normalised bytes, and every row is compared in full with its neighbour.
The first row of a run of equal texts stays.

The splitter key is bounded: 16 leading characters and a digest, so sampling
moves no texts to the driver.  A text that holds more than a quarter of a
partition's share is cut into pieces by a hash of the row id; the first rows of
the pieces, a bounded number, are sorted and compared once more.
"""

from __future__ import annotations

from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nounspan.llm.common import SPACES, shuffle_width, text_of

# A text is cut into pieces when its copies hold more than this part of an
# even partition; at most PARTS * shuffle partitions texts can exceed it.
PARTS = 4
ROW_COST = 64


def normalised(text: Column) -> Column:
    """The text without white space; two texts are equal when these are."""
    return F.regexp_replace(text, SPACES + "+", "")


def _marked(rows: DataFrame, near: list[str], order: list[Column]) -> DataFrame:
    """Compare each row with the one before it and number the runs of equal texts.

    ``near`` are columns that equal texts share and that the rows are already
    partitioned by, so no further exchange is planned.
    """
    along = Window.partitionBy(*near).orderBy("norm", *order)
    first = F.coalesce(F.lag("norm").over(along) != F.col("norm"), F.lit(True))
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("first", first)
        .withColumn("run", F.sum(F.col("first").cast("long")).over(upto))
        .withColumn("keeper", F.last(F.when(F.col("first"), F.struct("id")), True).over(upto))
    )


def _heavy(slim: DataFrame) -> list:
    """Digests whose copies fill too much of a partition, with a number of pieces.

    Weights are summed before the shuffle, and no more than PARTS digests for
    each shuffle partition can pass the bound.
    """
    width = shuffle_width(slim.sparkSession)
    total = slim.agg(F.sum("cost")).first()[0] or 0
    bound = max(total / (PARTS * width), ROW_COST)
    rows = (
        slim.groupBy("digest")
        .agg(F.sum("cost").alias("cost"), F.count("*").alias("n"))
        .filter((F.col("cost") > bound) & (F.col("n") > 1))
        .limit(PARTS * width)
        .collect()
    )
    return [(r["digest"], max(2, min(r["n"], ceil(r["cost"] / bound)))) for r in rows]


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """Every row with ``keep_id, group_size, kept, text_sha256``.

    The input columns (or those named in ``carry``) come back in one struct
    ``row``, so their names cannot clash.  Texts are equal when identical after deleting white space; null
    counts as empty.  Of equal texts the one with the most code points in the
    original text stays, then the smallest id (no id: last).  Of repeated rows
    with that id exactly one is kept.  An empty table gives no rows.
    """
    spark = df.sparkSession
    text = text_of(text_col)
    carry = df.columns if carry is None else carry
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    # The text moves once: inside the row, or beside it if the row goes without.
    beside = [] if text_col in carry else [text.alias("text")]
    source = df.select(row, F.col(id_col).alias("id"), *beside)
    moved = F.col("text") if beside else text_of(f"row.`{text_col}`")
    norm = normalised(moved)
    slim = df.select(
        F.sha2(normalised(text), 256).alias("digest"),
        (F.octet_length(text) + ROW_COST).cast("long").alias("cost"),
    )
    heavy = _heavy(slim)
    keyed = source.select(
        "*", F.substring(norm, 1, 16).alias("lead"), F.sha2(norm, 256).alias("digest")
    )
    if heavy:
        # At most PARTS rows for each shuffle partition.
        # As Arrow: a list of rows would pass through Python workers of its own.
        digests, numbers = zip(*heavy)
        known = pa.table({"digest": pa.array(digests, pa.string()), "pieces": pa.array(numbers, pa.int32())})
        hot = F.broadcast(spark.createDataFrame(known, "digest string, pieces int"))
        keyed = keyed.join(hot, "digest", "left").withColumn(
            "piece",
            F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("id"), F.col("pieces"))).otherwise(0),
        )
    order = [F.col("n_chars").desc(), F.col("id").asc_nulls_last()]
    # A constant in the key would be folded away and the partitioning no longer recognised.
    near = ["lead", "digest", "piece"] if heavy else ["lead", "digest"]

    def sorted_runs(rows: DataFrame) -> DataFrame:
        placed = rows.repartitionByRange(*near).select(
            "*", norm.alias("norm"), F.length(moved).alias("n_chars")
        )
        return _marked(placed, near, order).withColumn(
            "local_size", F.count("*").over(Window.partitionBy(*near, "run"))
        )

    runs = sorted_runs(keyed)
    if not heavy:
        return runs.select(
            "row",
            F.col("keeper.id").alias("keep_id"),
            F.col("local_size").alias("group_size"),
            F.col("first").alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    # The first rows of all pieces, sorted and compared across pieces.
    firsts = (
        sorted_runs(keyed.filter("pieces is not null"))
        .filter("first")
        .select("id", "norm", "n_chars", "digest", "piece", F.col("run").alias("piece_run"), "local_size")
    )
    met = _marked(firsts.repartition("digest"), ["digest"], order).select(
        "digest",
        "piece",
        F.col("piece_run").alias("run"),
        F.col("keeper").alias("over_keeper"),
        F.col("first").alias("over_first"),
        F.sum("local_size").over(Window.partitionBy("digest", "run")).alias("over_size"),
    )
    # Bounded: one row for each piece, at most 2 * PARTS for each shuffle partition.
    return runs.join(F.broadcast(met), ["digest", "piece", "run"], "left").select(
        "row",
        F.coalesce("over_keeper", "keeper")["id"].alias("keep_id"),
        F.coalesce("over_size", "local_size").alias("group_size"),
        (F.col("first") & F.coalesce("over_first", F.lit(True))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def distinct_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their own columns."""
    return exact_dedup(df, id_col, text_col).filter("kept").select("row.*")
