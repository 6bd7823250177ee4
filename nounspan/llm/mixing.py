"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copy rate of its documents: a whole
number of copies and a fractional probability.  Two fractional documents are
paired, and word mass moves between them at random, without bias, until one of
them is integral; the other meets the next.  A document's expected words are
its share of the target, and the words of a source change by no step, so the
mix misses a target by less than the one document that is rounded last.

Pairs are formed inside blocks of documents by a hash of their id; what is
left of each source in a block, one document, meets the others up a tree of
blocks.  No task sees more than a block of documents or a node of residuals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nounspan.llm.common import SPACES, checkpointed, id_key
from nounspan.operators.ids import with_rid

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2.0
BLOCK_ROWS = 8192
FAN_IN = 64
SOURCES_A_NODE = 32
NEAR = 1e-9


def word_count(text: Column) -> Column:
    """Number of stretches without white space; null counts as none."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+", " "))
    spaces = F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))
    return F.when(spaced == "", 0).otherwise(spaces + 1).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
) -> DataFrame:
    """``source, source_size`` with a ``target`` each.

    Sources by code point, null last, take the weights in turn.  Targets share
    ``share`` of all sizes by weight; one above ``most`` times its source stops
    there and its excess is shared again by weight, until none is above.  Each
    round is one aggregate over the sources.
    """
    numbered = with_rid(sizes, [F.col("source").asc_nulls_last()], name="place")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = numbered.select(
        "source",
        "source_size",
        F.get(cycle, (F.col("place") % len(weights)).cast("int")).alias("weight"),
        (F.col("source_size") * most).alias("cap"),
    )
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * level
        seen = rows.agg(
            F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("full"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(over.cast("int")).alias("n"),
        ).first()
        if not seen["open"] or seen["n"] == stopped:
            break
        stopped = seen["n"]
        level = max(0.0, total - seen["full"]) / seen["open"]
    target = F.least("cap", F.col("weight") * F.lit(float(level or 0.0)))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def draws(seed: int, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One number in [0, 1) for each row from its hash and the seed."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) ^ (places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x += np.uint64(seed) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def pivot(size: np.ndarray, part: np.ndarray, random: np.ndarray) -> np.ndarray:
    """Round the fractional parts of one source; at most one stays fractional.

    Moving ``d`` words from one document to another changes their parts by
    ``d / size``; the two possible moves have such chances that neither part
    changes on average.
    """
    part = part.copy()
    held = -1
    for i in np.flatnonzero((part > NEAR) & (part < 1 - NEAR)):
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - part[a]) * size[a], part[b] * size[b])
        down = min(part[a] * size[a], (1 - part[b]) * size[b])
        move = up if random[b] * (up + down) < down else -down
        part[a] += move / size[a]
        part[b] -= move / size[b]
        for x in (a, b):
            if part[x] <= NEAR or part[x] >= 1 - NEAR:
                part[x] = round(part[x])
        left = [x for x in (a, b) if 0 < part[x] < 1]
        held = left[0] if left else -1
    return part


def _rounded(level: int, seed: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["source_no", "mark", "place"], kind="stable", ignore_index=True)
        random = draws(seed + level, group["mark"].to_numpy(), group["place"].to_numpy())
        size, part = group["size"].to_numpy(np.float64), group["part"].to_numpy().copy()
        number = group["source_no"].to_numpy()
        edges = np.flatnonzero(np.diff(number)) + 1
        for rows in np.split(np.arange(len(group)), edges):
            part[rows] = pivot(size[rows], part[rows], random[rows])
            if last:
                for r in rows[(part[rows] > 0) & (part[rows] < 1)]:
                    part[r] = float(random[r] < part[r])
        return group.assign(part=part)

    return run


ROUND_NAMES = ["place", "mark", "source_no", "node", "size", "whole", "part"]
ROUND_SCHEMA = "place long, mark long, source_no long, node long, size long, whole int, part double"


def round_copies(rows: DataFrame, total: int, seed: int) -> DataFrame:
    """``place, copies`` for rows with ``place, mark, source_no, size, rate``."""
    blocks = max(1, -(-total // BLOCK_ROWS))
    whole = F.floor(F.col("rate") + NEAR).cast("int")
    part = F.col("rate") - whole
    open_ = rows.select(
        "place",
        "mark",
        "source_no",
        F.pmod(F.xxhash64(F.lit(seed), "mark"), F.lit(blocks)).cast("long").alias("node"),
        "size",
        whole.alias("whole"),
        F.when((F.col("size") > 0) & (part > NEAR), part).otherwise(0.0).alias("part"),
    )
    keys, level, settled = [F.col("node")], 0, []
    while True:
        last = blocks == 1
        rounded = _rounded(level, seed, last)
        done = checkpointed(open_.groupBy(*keys).applyInPandas(rounded, schema=ROUND_SCHEMA))
        fractional = (F.col("part") > 0) & (F.col("part") < 1)
        settled.append(done.filter(~fractional))
        if last:
            break
        level, blocks = level + 1, -(-blocks // FAN_IN)
        # From here a group holds one residual for each block below and each of a few sources.
        open_ = done.filter(fractional).withColumn("node", F.floor(F.col("node") / FAN_IN))
        keys = [F.col("node"), F.floor(F.col("source_no") / SOURCES_A_NODE).alias("lane")]
        open_ = open_.select(*ROUND_NAMES)
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result.select("place", (F.col("whole") + F.col("part").cast("int")).alias("copies"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 42,
    **rule,
) -> DataFrame:
    """``id, source, size, source_size, target, copies`` for every row.

    Size is the number of words; null text has none and null source is a source
    of its own.  A row without words is copied by the whole part of its rate
    alone.  Repeated rows are rounded each for itself.  An empty table gives no
    rows.  The draw depends on the seed and the rows, never on partitions.
    """
    slim = df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
    )
    placed = with_rid(slim, [id_key("id"), F.col("source").asc_nulls_first(), F.col("size")], "place")
    total = placed.count()
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = with_rid(source_targets(sizes, **rule), [F.col("source").asc_nulls_last()], "source_no")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = placed.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).select(
        "place",
        F.xxhash64("id", "d.source", "size").alias("mark"),
        "source_no",
        F.col("id"),
        F.col("d.source").alias("source"),
        "size",
        "source_size",
        "target",
        rate.alias("rate"),
    )
    copies = round_copies(known, total, seed)
    return known.join(copies, "place").select(
        "id", "source", "size", "source_size", "target", "copies"
    )


def mixed_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    **rule,
) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    along = Window.partitionBy("key").orderBy("id", "source", "size")

    def numbered(rows: DataFrame) -> DataFrame:
        """Equal rows are told apart by a number, so that one join key is enough."""
        return rows.withColumn("key", F.xxhash64("id", "source", "size")).withColumn(
            "nth", F.row_number().over(along)
        )

    taken = numbered(mix(df, id_col, text_col, source_col, **rule))
    whole = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
    )
    joined = numbered(whole).join(taken.select("key", "nth", "copies"), ["key", "nth"])
    return (
        joined.filter("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("row.*")
    )
