"""Seeded samples per key, exact stratified splits, ranking.

A choice depends on the seed and on the identity of the row, so it is the same
for every number of partitions and survives a re-run task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nounspan.functions.hashing import race_time, row_hash
from nounspan.session import small_side, write_out

# Up to this rank Spark cuts each task's rows to the best n per key before the
# shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
TASK_CUT_LIMIT = 1_000
# Hash digits that each level of a histogram adds: 16^4 buckets in a bucket.
PREFIX = 4
HASH_DIGITS = 32
# Buckets per unit of the logarithm of an arrival time; each level splits them by a power of two.
LOG_STEPS = 4_096
LOG_SPLIT = 65_536
LOG_LEVELS = 3
# Rows among which a rank is looked for by sorting.
BUCKET_ROWS = 4_096

# A coarse value that never decreases along an order, at a level; null beyond the last one.
Buckets = Callable[[int], Column | None]


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank", lanes: int = 32
) -> DataFrame:
    """The first ``n`` rows of each key, ranked from 1.

    A hot key is ranked in lanes first: each task keeps its best n rows, each
    lane keeps its best n, and only lanes x n rows per key meet in one task.
    """
    lane = F.spark_partition_id() % lanes
    in_lane = Window.partitionBy(*keys, "_lane").orderBy(*order)
    in_key = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_lane", lane)
        .withColumn(rank, F.row_number().over(in_lane))
        .filter(F.col(rank) <= n)
        .drop(rank, "_lane")
        .withColumn(rank, F.row_number().over(in_key))
        .filter(F.col(rank) <= n)
    )


def hash_buckets(digest: str) -> Buckets:
    """Prefixes of a hash in hex digits."""
    return lambda level: (
        F.substring(digest, 1, PREFIX * (level + 1)) if PREFIX * level < HASH_DIGITS else None
    )


def log_buckets(value: str) -> Buckets:
    """Steps of the logarithm of a positive number.

    Scaling by a power of two is exact, so every step lies in one of the level before.
    """
    return lambda level: (
        F.floor(F.ln(value) * LOG_STEPS * float(LOG_SPLIT) ** level) if level < LOG_LEVELS else None
    )


def holding_buckets(
    df: DataFrame, keys: list[str], buckets: Buckets, ranks: dict, most: int | None = None
) -> tuple[DataFrame, int]:
    """Per key and name, the bucket that holds a rank, refined until it has few rows.

    Returns ``keys, name, _bucket, _at`` (rank in the bucket) and ``_n`` (its
    rows), and the level of the buckets.  Every level is a histogram, combined
    before the shuffle, of the rows in the buckets of the level before.  Only
    rows of equal values are never parted.
    """
    most = BUCKET_ROWS if most is None else most
    named = [*keys, "name"]

    def holding(histogram: DataFrame, parts: list[str]) -> DataFrame:
        upto = F.sum("count").over(Window.partitionBy(*parts).orderBy("_bucket"))
        return (
            histogram.withColumn("_upto", upto)
            .filter((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("count")))
            .select(*named, "_bucket", (F.col("rank") - F.col("_upto") + F.col("count")).alias("_at"), F.col("count").alias("_n"))
        )

    wanted = F.array(
        *[F.struct(F.lit(k).alias("name"), c.cast("bigint").alias("rank")) for k, c in ranks.items()]
    )
    whole = (
        df.groupBy(*keys, buckets(0).alias("_bucket"))
        .count()
        .withColumn("_total", F.sum("count").over(Window.partitionBy(*keys)))
        .select("*", F.explode(wanted).alias("_w"))
        .select(*keys, "_bucket", "count", "_w.*")
    )
    level, found = 0, write_out(holding(whole, named), "buckets")
    while buckets(level + 1) is not None and (found.agg(F.max("_n")).first()[0] or 0) > most:
        inside = null_safe(
            df.withColumn("_bucket", buckets(level)), small_side(found.drop("_n")), [*keys, "_bucket"]
        )
        split = inside.groupBy(*named, F.col("_at").alias("rank"), buckets(level + 1).alias("_bucket")).count()
        level, found = level + 1, write_out(holding(split, named), "buckets")
    return found, level


def cut_points(
    df: DataFrame, keys: list[str], buckets: Buckets, order: list[str], ranks: dict
) -> DataFrame:
    """Per key, the rows that stand at given ranks of an order.

    ``df`` is a stored table, which is read once for each level of the search.
    Only the rows of the buckets that hold a rank are sorted, some thousands
    for each key and rank, however many rows the key has.  ``ranks`` maps names
    to columns over ``_total``, the number of rows of the key.  The result has
    one row per key: ``keys``, and per name a struct of the ``order`` columns.
    """
    slim = df.select(*keys, *order)
    found, level = holding_buckets(slim, keys, buckets, ranks)
    in_bucket = Window.partitionBy(*keys, "_bucket", "name").orderBy(*order)
    rows = (
        null_safe(slim.withColumn("_bucket", buckets(level)), small_side(found.drop("_n")), [*keys, "_bucket"])
        .withColumn("_rn", F.row_number().over(in_bucket))
        .filter(F.col("_rn") == F.col("_at"))
    )
    # One row per key and name, so max is that row.
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == k, F.struct(*order))).alias(k) for k in ranks]
    )


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys where null equals null."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    met = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, met).drop(*[f"_r_{k}" for k in keys])


def draw_per_key(
    df: DataFrame, keys: list[str], value: Column, buckets: Buckets, ids: list[str], n: int
) -> DataFrame:
    """The ``n`` rows with the smallest ``value`` per key, ranked from 1.

    For a large ``n`` the rows are stored once with their values.
    """
    drawn = df.withColumn("_value", value)
    if n > TASK_CUT_LIMIT:
        drawn = write_out(drawn, "drawn")
        order = ["_value", *ids]
        cuts = small_side(
            cut_points(drawn, keys, buckets, order, {"_cut": F.least(F.col("_total"), F.lit(n))})
        )
        drawn = (
            null_safe(drawn, cuts, keys)
            .filter(F.struct(*order) <= F.col("_cut"))
            .drop("_cut")
        )
        in_key = Window.partitionBy(*keys).orderBy(*order)
        return drawn.withColumn("rank", F.row_number().over(in_key)).drop("_value")
    return top_per_key(drawn, keys, [F.col("_value"), *map(F.col, ids)], n).drop("_value")


def sample_per_key(
    df: DataFrame, key: str, n: int, seed: int, ids: list[str]
) -> DataFrame:
    """Uniform sample of ``n`` rows per key without replacement.

    ``ids`` must identify a row within its key.
    """
    digest = row_hash(seed, F.col(key), *map(F.col, ids))
    return draw_per_key(df, [key], digest, hash_buckets("_value"), ids, n)


def weighted_sample_per_key(
    df: DataFrame, key: str, n: int, weight: str, seed: int, ids: list[str]
) -> DataFrame:
    """Sample of ``n`` rows per key, chances proportional to ``weight``.

    Rows whose weight is zero, negative, NaN or null are never drawn.
    """
    positive = df.filter((F.col(weight) > 0) & ~F.isnan(F.col(weight).cast("double")))
    time = race_time(row_hash(seed, F.col(key), *map(F.col, ids)), F.col(weight))
    return draw_per_key(positive, [key], time, log_buckets("_value"), ids, n)


def stratified_split(
    df: DataFrame,
    label: str,
    ids: list[str],
    test: float = 0.1,
    val: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: per label, a share for test and a share of the rest for validation.

    Sizes are exact.  The rows are stored once with their hashes.  No label is
    gathered in one task: the two cut points per label come from histograms,
    and the rows are then only compared with them.
    """
    total = F.col("_total")
    n_test = F.round(F.lit(test) * total)
    n_val = F.round(F.lit(val) * (total - n_test))
    hashed = write_out(
        df.filter(F.col(label).isNotNull()).withColumn("_hash", row_hash(seed, *map(F.col, ids))), "hashed"
    )
    order = ["_hash", *ids]
    cuts = cut_points(
        hashed,
        [label],
        hash_buckets("_hash"),
        order,
        {"_test": n_test, "_val": n_test + n_val},
    )
    here = F.struct(*order)
    split = (
        F.when(here <= F.col("_test"), "test").when(here <= F.col("_val"), "val").otherwise("train")
    )
    return (
        hashed.join(small_side(cuts), label, "left")
        .select(*[F.col(f"`{c}`") for c in df.columns], split.alias("split"))
    )


def rank_passages(scored: DataFrame, ties: list[str], score: str = "score") -> DataFrame:
    """Global order by decreasing score."""
    return scored.orderBy(F.col(score).desc(), *ties)


def preview(df: DataFrame, order_by: list[str], n: int = 3) -> DataFrame:
    """The first rows of a table in a total order."""
    return df.orderBy(*order_by).limit(n)


def nest_samples(stats: DataFrame, selected: DataFrame, text: str = "passage") -> DataFrame:
    """One record per term; ``selected`` is null where nothing matched.

    A list holds at most the n passages that were drawn for its term.
    """
    lists = selected.groupBy("term").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("text")))).alias("_s")
    )
    return stats.join(lists, "term", "left").select(
        "term", "total_matches", "total_selected", F.col("_s.text").alias("selected")
    )


