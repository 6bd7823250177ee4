"""Uniform shuffle into shards of exact sizes.

The rows of the input's own partitions are dealt to shards.  How many rows of
each partition go to each shard is drawn exactly: a communication matrix whose
rows follow the multivariate hypergeometric law of a uniform permutation.
Each partition permutes its rows locally and deals them out by its row of the
matrix; one exchange brings them to their shards, and each shard is permuted
again.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nounspan.llm.common import shuffle_width, text_of
from nounspan.session import write_out

# Partitions that share a row of the matrix, if there are more of them than rows.
MOST_BLOCKS = 4096
ROUNDS = 6
# Bits of a mark, by which a shard is permuted.
MARK_BITS = 62
_PART = 33


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` of ``good + bad``, without replacement.

    Inverse transform over the values within 12 standard deviations of the
    mean (beyond them lies less than 1e-30), by ratios of neighbouring
    probabilities; numpy's own generator ends at 1e9.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    whole = good + bad
    mean = draws * (good / whole)
    spread = np.sqrt(mean * (bad / whole) * max(0.0, (whole - draws) / max(1, whole - 1)))
    low = max(low, int(mean - 12 * spread - 12))
    high = min(high, int(mean + 12 * spread + 12))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows for each block and shard: the counts that a uniform permutation would give."""
    rng = np.random.default_rng(seed)
    left = list(shard_sizes)
    matrix = []
    for size in block_sizes:
        row, rest, pool = [], size, sum(left)
        for have in left:
            drawn = hypergeometric(rng, have, pool - have, rest) if rest else 0
            row.append(drawn)
            rest -= drawn
            pool -= have
        left = [a - b for a, b in zip(left, row)]
        matrix.append(row)
    return matrix


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(*parts: int) -> np.uint64:
    """A hash of small numbers."""
    key = np.zeros(1, np.uint64)
    for part in parts:
        key = _mixed(key + np.uint64(part % 2**64) + np.uint64(0x9E3779B97F4A7C15))
    return key[0]


def permuted(places: np.ndarray, n: int, key: np.uint64) -> np.ndarray:
    """Places 0 to ``n - 1`` under a pseudo-random permutation, each on its own.

    A Feistel network on the next even number of bits; what falls outside goes
    round again.
    """
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in range(ROUNDS):
            left, right = right, left ^ (_mixed(right + key + np.uint64(k * 0x632BE59BD9B4E019 % 2**64)) & mask)
        return (left << half) | right

    out = once(places.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 42) -> DataFrame:
    """Every row with its ``shard`` and its gapless place ``slot`` in the shard.

    The input columns come back in one struct ``row``.  Shard sizes differ by
    at most one; each row is as likely to land in one place as in any other.
    The rows are stored once with their partition and their place in it, from
    which all draws follow, so a task that is run again deals out the same
    rows.  Repeated rows, empty and null ones are rows like others, and the
    place of a row has nothing to do with its content.  An empty table gives no
    rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    stored = write_out(df.select(row, F.monotonically_increasing_id().alias("at")), "to-shard")
    # One number for each partition of the input.
    sizes = dict(stored.groupBy(F.shiftright("at", _PART).cast("int")).count().collect())
    total, blocks = sum(sizes.values()), max(1, min(MOST_BLOCKS, len(sizes)))
    offsets = np.zeros(max(sizes, default=0) + 1, np.int64)
    block_sizes = [0] * blocks
    for part, size in sorted(sizes.items()):
        offsets[part] = block_sizes[part % blocks]
        block_sizes[part % blocks] += size
    shard_sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix(block_sizes, shard_sizes, seed)
    ends = [np.array(list(accumulate(cells)), np.uint64) for cells in matrix]

    @F.pandas_udf("shard int, mark long")
    def dealt(at: pd.Series) -> pd.DataFrame:
        number = at.to_numpy()
        part = number >> _PART
        place = offsets[part] + (number & ((1 << _PART) - 1))
        shard = np.zeros(len(number), np.int32)
        for block in np.unique(part % blocks):
            mine = part % blocks == block
            moved = permuted(place[mine], block_sizes[block], _key(seed, 1, int(block)))
            shard[mine] = np.searchsorted(ends[block], moved, side="right")
        mark = _mixed(number.astype(np.uint64) ^ _key(seed, 2)) >> np.uint64(64 - MARK_BITS)
        return pd.DataFrame({"shard": shard, "mark": mark.astype(np.int64)})

    # Each shard is sorted in ranges of the mark, so that no task holds a whole one.
    ranges = -(-shuffle_width(df.sparkSession) // n_shards)
    low = MARK_BITS // 2
    part = F.col("d.shard") * ranges + F.shiftright(F.shiftright("d.mark", low) * ranges, MARK_BITS - low).cast("int")
    counts = dict(stored.select(dealt("at").alias("d")).groupBy(part).count().collect())
    starts = [
        start
        for s in range(n_shards)
        for start in [0, *accumulate(counts.get(s * ranges + r, 0) for r in range(ranges))][:-1]
    ]
    placed = (
        stored.select("row", "at", dealt("at").alias("d"))
        .select("row", "at", "d.shard", "d.mark", part.alias("part"))
        .repartitionById(n_shards * ranges, F.col("part"))
        .sortWithinPartitions("part", "mark", "at")
    )
    start = F.get(F.array(*[F.lit(s) for s in starts]), F.col("part"))
    seq = F.monotonically_increasing_id().bitwiseAND(F.lit(2**_PART - 1))
    return placed.select("row", "shard", (start + seq).cast("long").alias("slot"))


def described(df: DataFrame) -> DataFrame:
    """Size and checksum of each document that stands in its shard, from the text that arrived."""
    text = text_of("row.text")
    return df.select(
        "row.doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        "shard",
        "slot",
    )
