"""Trie of conversation prefixes, built from a splitter skeleton.

A conversation is a path: the digests of its turns one after another.  Sampled
splitters cut all paths, in order, into shards.  The trie of the splitters' own
paths is the skeleton, and it is broadcast: a node that is no prefix of a
splitter lies wholly in one shard, whose sorted paths finish it in one walk.
Skeleton nodes may lie in many shards; each shard sends partial aggregates for
them, which are combined by key, and subtrees of the skeleton are summed last.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nounspan.llm.common import Scratch, shuffle_width

# Bytes of the digest of a turn.
TURN = 16
# Sampled paths for each shard; the splitters are chosen among them.
SAMPLE = 32
# Ids that travel in one piece to the digest of a skeleton node.
PIECE = 10_000
BATCH_ROWS = 20_000


def turn_path(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turns``: the turns of a conversation in order, as digest and code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    # The length before the role keeps role and text apart.
    whole = F.sha2(F.concat_ws(":", F.length(role), role, text), 256)
    turns = df.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.struct(
            F.col(turn_col).isNotNull().alias("numbered"),
            F.col(turn_col).alias("turn"),
            F.substring(F.unhex(whole), 1, TURN).alias("digest"),
            F.length(text).alias("chars"),
        ).alias("t"),
    )
    return turns.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t")).select(
        "conv", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns")
    )


def with_shared_prefix(paths: DataFrame, block: int = 100, longest: int = 6) -> DataFrame:
    """Conversations rebuilt with the first turns of their block's first conversation.

    Conversation ``c`` takes ``crc32(c) % longest`` turns of conversation
    ``c - c % block`` (all if it has fewer, none if there is none) in place of as
    many of its own.  A leader meets at most ``2 * block`` conversations.
    """
    h = (F.crc32(F.col("conv").cast("string")) % longest).cast("int")
    led = paths.withColumns({"h": h, "leader": F.col("conv") - F.col("conv") % block})
    heads = paths.filter(F.col("conv") % block == 0).select(
        F.col("conv").alias("leader"), F.slice("turns", 1, max(longest - 1, 1)).alias("head")
    )
    own = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    head = F.coalesce(F.expr("slice(head, 1, h)"), F.slice("turns", 1, 0))
    return led.join(heads, "leader", "left").select("conv", F.concat(head, own).alias("turns"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that both paths begin with."""
    least = min(len(a), len(b))
    if a[:least] == b[:least]:
        return least // TURN
    low, high = 0, least // TURN
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * TURN] == b[: mid * TURN] else (low, mid)
    return low


def node_key(prefix: bytes) -> bytes:
    return sha256(prefix).digest()


class Node:
    """An open node of the walk through the sorted paths of a shard."""

    __slots__ = ("chars", "children", "conv", "ends", "ended", "leaves", "n", "saved", "waiting")

    def __init__(self, chars: int):
        self.chars, self.conv = chars, None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends, self.ended = sha256(), 0
        self.waiting: list[list] = []

    def add(self, conv: int, n: int) -> None:
        self.n += n
        if self.conv is None or conv < self.conv:
            self.conv = conv


# kind 0: a finished node; 1: a part of a skeleton node; 2: ids that end at one.
PARTS = (
    "kind int, key binary, depth long, conv long, parent long, n long, children long, leaves long, saved long, "
    "chars long, shard int, seq long, ends string"
)
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_FIELDS = pa.schema([(f, _KINDS[k]) for f, k in (part.split() for part in PARTS.split(", "))])


class Walk:
    """Finishes the nodes of one shard; ``rows`` yields results as they close."""

    def __init__(self, shard: int, bounds: list[bytes]):
        self.shard, self.bounds = shard, bounds
        self.path = b""
        self.nodes: list[Node] = [Node(0)]
        self.skeleton = 0
        self.pending: list[str] = []
        self.seq = 0

    def in_skeleton(self, depth: int) -> bool:
        """Whether the open node of that depth is a prefix of a splitter (the root always is)."""
        return depth <= self.skeleton

    def add(self, conv: int, path: bytes, chars: list[int]) -> Iterator[tuple]:
        shared = shared_turns(self.path, path)
        if path != self.path:
            yield from self.send_ends()
        yield from self.close(shared)
        self.path = path
        self.skeleton = max((shared_turns(path, b) for b in self.bounds), default=0)
        self.nodes.extend(Node(c) for c in chars[shared:])
        last = self.nodes[-1]
        last.add(conv, 1)
        if self.in_skeleton(len(self.nodes) - 1):
            self.pending.append(str(conv))
            if len(self.pending) >= PIECE:
                yield from self.send_ends()
        else:
            last.ends.update(f",{conv}".encode() if last.ended else str(conv).encode())
        last.ended += 1

    def send_ends(self) -> Iterator[tuple]:
        if self.pending:
            self.seq += 1
            ends = ",".join(self.pending)
            yield 2, node_key(self.path), None, None, None, None, None, None, None, None, self.shard, self.seq, ends
            self.pending = []

    def close(self, depth: int) -> Iterator[tuple]:
        """Close all open nodes deeper than ``depth``."""
        while len(self.nodes) - 1 > depth:
            at = len(self.nodes) - 1
            node, parent = self.nodes.pop(), self.nodes[-1]
            parent.add(node.conv, node.n)
            if self.in_skeleton(at):
                yield self.part(node, at)
                continue
            leaves = node.leaves if node.children else 1
            saved = node.saved + (node.n - 1) * node.chars
            for row in node.waiting:
                row[4] = node.conv
                yield tuple(row)
            row = [0, None, at, node.conv, None, node.n, node.children, leaves, saved, None, None, None, node.ends.hexdigest()]
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved
            if self.in_skeleton(at - 1):
                # The parent's smallest member is known only after the reduction.
                row[1] = node_key(self.path[: (at - 1) * TURN])
                yield tuple(row)
            else:
                parent.waiting.append(row)

    def part(self, node: Node, depth: int) -> tuple:
        key = node_key(self.path[: depth * TURN])
        return 1, key, depth, node.conv, None, node.n, node.children, node.leaves, node.saved, node.chars, None, None, None

    def finish(self) -> Iterator[tuple]:
        yield from self.send_ends()
        yield from self.close(0)
        yield self.part(self.nodes[0], 0)


def splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most ``shards - 1`` paths with their conversation, evenly among a sample.

    The sample holds ``SAMPLE * shards`` conversations, those of the lowest hash,
    whatever the size of the table.
    """
    sample = paths.orderBy(F.xxhash64("conv"), "conv").limit(SAMPLE * shards).select("path", "conv").collect()
    order = sorted((bytes(r["path"]), r["conv"]) for r in sample)
    return sorted({order[len(order) * i // shards] for i in range(1, shards)}) if order else []


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def shard_parts(paths: DataFrame, cuts: list[tuple[bytes, int]], shards: int) -> DataFrame:
    """Finished nodes, parts of skeleton nodes and ids that end at them, for all shards."""
    spark = paths.sparkSession
    shared = spark.sparkContext.broadcast(cuts)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv").to_pylist())
            shard = pa.array([bisect_right(shared.value, key) for key in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, *batch.columns], ["shard", *batch.schema.names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            open_ = None
            for batch in batches:
                for shard, conv, path, chars in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv", "path", "chars"))):
                    if open_ is None or open_.shard != shard:
                        if open_ is not None:
                            yield from open_.finish()
                        bounds = shared.value[max(shard - 1, 0) : shard + 1]
                        open_ = Walk(shard, [b for b, _ in bounds])
                    yield from open_.add(conv, path, chars)
            if open_ is not None:
                yield from open_.finish()

        yield from _batches(rows(), _FIELDS)

    numbered = paths.select("conv", "path", "chars").mapInArrow(
        number, "shard int, conv long, path binary, chars array<int>"
    )
    dealt = numbered.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv")
    return dealt.mapInArrow(walk, PARTS)


def ends_digests(parts: DataFrame) -> DataFrame:
    """``key, ends``: digest of the ids that end at a skeleton node, read piece by piece.

    A digest of a list is sequential, so one task reads the pieces of a node in
    order; it never holds more than one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("ends", pa.string())])

        def rows():
            key, state = None, None
            for batch in batches:
                for this, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                    if this == key:
                        state.update(b",")
                    else:
                        if key is not None:
                            yield key, state.hexdigest()
                        key, state = this, sha256()
                    state.update(ends.encode())
            if key is not None:
                yield key, state.hexdigest()

        yield from _batches(rows(), schema)

    pieces = parts.filter("kind = 2").select("key", "shard", "seq", "ends")
    order = pieces.repartition("key").sortWithinPartitions("key", "shard", "seq")
    return order.mapInArrow(run, "key binary, ends string")


def skeleton_nodes(parts: DataFrame, cuts: list[tuple[bytes, int]]) -> list[tuple]:
    """``key, depth, conv, parent, n, children, leaves, saved`` of all skeleton nodes.

    The parts are combined by key on the executors.  What is left is one row for
    each prefix of a splitter, which a walk in path order sums over subtrees.
    """
    whole = {
        bytes(r["key"]): r
        for r in parts.filter("kind = 1")
        .groupBy("key")
        .agg(*[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.min("conv").alias("conv"), F.max("chars").alias("chars"))
        .collect()
    }
    prefixes = [b""]
    before = b""
    for path, _ in cuts:
        for depth in range(shared_turns(before, path) + 1, len(path) // TURN + 1):
            prefixes.append(path[: depth * TURN])
        before = path
    totals: dict[bytes, list] = {}
    # Children stand after their parents, so the way back meets them first.
    for prefix in reversed(prefixes):
        row = whole.get(node_key(prefix))
        if row is None:
            continue
        extra = totals.setdefault(prefix, [0, 0, 0])
        children = row["children"] + extra[0]
        leaves = (row["leaves"] + extra[1]) if children else 1
        saved = row["saved"] + extra[2] + (row["n"] - 1) * row["chars"]
        totals[prefix] = [children, leaves, saved]
        if prefix:
            up = totals.setdefault(prefix[:-TURN], [0, 0, 0])
            totals[prefix[:-TURN]] = [up[0] + 1, up[1] + leaves, up[2] + saved]
    rows = []
    for prefix in prefixes:
        row = whole.get(node_key(prefix))
        if row is not None:
            up = whole[node_key(prefix[:-TURN])]["conv"] if prefix else None
            rows.append((node_key(prefix), len(prefix) // TURN, row["conv"], up, row["n"], *totals[prefix]))
    return rows


NODE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """All nodes of the trie of ``conv, turns`` (see ``turn_path``).

    One row for each distinct beginning of a conversation, the empty one
    included: its smallest member, depth, the parent's smallest member, members,
    children, childless nodes below (itself if childless), the code points that
    sharing saves in its subtree, and the digest of the ids of the conversations
    that end there.  Conversations are rows of one id each; a conversation must
    fit a row.  Without conversations there is no row, not even the root.

    ``shards`` is the number of ranges, by default that of shuffle partitions;
    the driver holds their splitters and one aggregate for each turn of them.
    """
    spark = conversations.sparkSession
    shards = shards or shuffle_width(spark)
    path = F.aggregate("turns", F.lit(b""), lambda p, t: F.concat(p, t["digest"]))
    slim = conversations.select(
        "conv", path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars")
    )
    with Scratch(spark, "trie-paths") as scratch:
        paths = scratch.store(slim, "paths")
        cuts = splitters(paths, shards)
        parts = Scratch(spark, "trie").store(shard_parts(paths, cuts, shards), "parts")
    skeleton = spark.createDataFrame(
        skeleton_nodes(parts, cuts),
        "key binary, depth long, conv long, parent long, n long, children long, leaves long, saved long",
    )
    values = ["n", "children", "leaves", "saved"]
    # One row for each prefix of a splitter, so the skeleton is as small as the splitters.
    tops = F.broadcast(skeleton.select("key", F.col("conv").alias("top")))
    done = parts.filter("kind = 0").join(tops, "key", "left").select(
        "conv", "depth", F.coalesce("parent", "top").alias("parent"), *values, "ends"
    )
    nothing = F.sha2(F.lit(""), 256)
    upper = skeleton.join(ends_digests(parts), "key", "left").select(
        "conv", "depth", "parent", *values, F.coalesce("ends", nothing).alias("ends")
    )
    return done.unionByName(upper).toDF(*NODE_COLUMNS)


def conversation_trie(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    shards: int | None = None,
) -> DataFrame:
    """The trie of the conversations rebuilt with shared beginnings.

    Turns are ordered by number, null first; turns of one number by the digest
    of role and text, so repeated rows stand next to each other and each counts
    as a turn.  A null role or text is an empty one.  Rows without a
    conversation's id belong to none and are left out.  Other columns are not
    read.
    """
    return prefix_trie(with_shared_prefix(turn_path(df, conv_col, turn_col, role_col, text_col)), shards)
