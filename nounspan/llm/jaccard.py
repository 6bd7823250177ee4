"""Exact Jaccard links of word-shingle sets through a token-group matrix.

Similar documents are partitioned into groups, a group is known by the union
of its tokens, and a query document opens another group only if enough of its
tokens lie in that union.  The bound is checked on prefixes: if two sets reach
the similarity, the first ``n - ceil(.75 n) + l`` tokens of both, in one order
of all tokens, share at least ``l``.

1. Equal sets are one node.  With every node a group of its own, a first matrix
   finds the nodes whose prefix overlaps the union of all others enough to have
   any link at all; the rest are settled.
2. The others are grouped around typical leaders by minwise hashes.  A group is
   opened in pieces of bounded size, with its leader in each, and what links
   there is contracted to components.
3. A matrix over these groups gives the queries that overlap other components
   enough, and for each the groups worth opening.  Queries that reach the bound
   by tokens of very many groups alone are bounded once more on their whole
   sets, among themselves.

Before every exchange a task reduces a token to one entry, so that a word or
passage of a third of all documents does not gather anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nounspan.llm.common import checkpointed, id_key, intermediates, pieces, release_memory, settled
from nounspan.llm.components import Forest, components
from nounspan.session import write_out

WORDS = 5
PERCENT = 75
HASHES = 8
AGREE = 2
PIECE = 256
# A token in more groups than this opens none of them by itself.
HOT_GROUPS = 32
BUCKET_ENTRIES = 1_000_000
# A list of documents to fetch is broadcast up to this many bytes, joined by a shuffle beyond.
BROADCAST_BYTES = 8 * 1024 * 1024

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


# ---------------------------------------------------------------- sets


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int = WORDS) -> np.ndarray:
    """Distinct shingles of a whole text as sorted 64-bit hashes.

    ``bytes.split`` cuts at exactly the white space of the contract.  The order
    of the hashes is the order of all tokens.
    """
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    width = min(width, len(words))
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    end = len(words) - width + 1
    with np.errstate(over="ignore"):
        total = np.full(end, width, dtype=np.uint64)
        for k in range(width):
            total += hashed[k : end + k] * _ODD[k]
        return np.unique(_mixed(total))


def needed(n: int) -> int:
    """Least overlap of a set of ``n`` with any set that it links to."""
    return -(-PERCENT * n // 100)


def prefix_length(n: int) -> int:
    return n - needed(n) + -(-n // 16)


def least_shared(n: int) -> int:
    """Tokens that the prefixes of a set of ``n`` and of any linked set share at least."""
    return -(-needed(n) // 16)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Number of tokens of ``a`` in the sorted list ``b``."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < PERCENT * large:
        return False
    both = overlap(a, b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def node_of(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def label_of(node: bytes) -> int:
    return int.from_bytes(node[:8], "little")


def minwise(tokens: np.ndarray) -> list[int]:
    with np.errstate(over="ignore"):
        return [int(_mixed(tokens ^ _ODD[0] * np.uint64(2 * j + 1)).min().view(np.int64)) for j in range(HASHES)]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes = [], []
        for text in batch.column("text").cast(pa.binary()):
            tokens = shingles(text.as_py())
            nodes.append(node_of(tokens) if len(tokens) else None)
            sizes.append(len(tokens))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("mark"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64())],
            ["id", "mark", "node", "n"],
        )
        release_memory()


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in batches for piece in pieces(whole, "text")):
        nodes, blobs, hashes = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            tokens = shingles(text.as_py())
            if len(tokens):
                nodes.append(node_of(tokens))
                blobs.append(tokens.tobytes())
                hashes.append(minwise(tokens))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(nodes, pa.binary()),
                pa.array(np.array([label_of(n) for n in nodes], dtype=np.uint64).view(np.int64)),
                pa.array(blobs, pa.binary()),
                pa.array(hashes, pa.list_(pa.int64())),
            ],
            ["node", "label", "tokens", "minwise"],
        )
        release_memory()


# ---------------------------------------------------------------- matrix of all nodes


def _entries(buckets: int):
    """Matrix entries of one piece of a batch, packed by token bucket.

    A token of several nodes of the piece is shared whatever others hold:
    its nodes are counted here, and one entry without a node goes out.
    """

    def run(batches):
        for batch in (piece for whole in batches for piece in pieces(whole, "text")):
            found = {}
            for text in batch.column("text").cast(pa.binary()):
                tokens = shingles(text.as_py())
                if len(tokens):
                    # A copy: a view would hold the whole set.
                    found[label_of(node_of(tokens))] = tokens[: prefix_length(len(tokens))].copy()
            if not found:
                continue
            labels = np.fromiter(found, np.uint64, len(found))
            tokens = np.concatenate(list(found.values()))
            owner = np.repeat(np.arange(len(labels), dtype=np.int32), [len(t) for t in found.values()])
            found.clear()
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            first = np.concatenate(([True], tokens[1:] != tokens[:-1]))
            size = np.diff(np.append(np.flatnonzero(first), len(tokens)))
            alone = np.repeat(size == 1, size)
            shared = np.bincount(owner[~alone], minlength=len(labels))
            many = tokens[first][size > 1]
            tokens, owner = tokens[alone], owner[alone]
            where = _bucket(tokens, buckets)
            order = np.lexsort((owner, where))
            tokens, owner, where = tokens[order], owner[order], where[order]
            edges = np.searchsorted(where, np.arange(buckets + 1))
            spread = np.searchsorted(_bucket(many, buckets), np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                lo, hi = edges[b], edges[b + 1]
                mine, counts = np.unique(owner[lo:hi], return_counts=True)
                rows.append((b, tokens[lo:hi], labels[mine], counts, many[spread[b] : spread[b + 1]], ()))
            hit = np.flatnonzero(shared)
            rows.append((int(labels[0] % np.uint64(buckets)), (), labels[hit], shared[hit], (), (1,)))
            yield _packed(rows)
            del tokens, owner, where, order, rows, alone, many
            release_memory()

    return run


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of tokens, so that a sorted list is sorted by bucket."""
    return ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


ENTRY_SCHEMA = "bucket int, tokens binary, labels binary, counts binary, many binary, own boolean"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    blob = lambda values, kind: np.asarray(values, dtype=kind).tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(r[0]) for r in rows], pa.int32()),
            pa.array([blob(r[1], "<u8") for r in rows], pa.binary()),
            pa.array([blob(r[2], "<u8") for r in rows], pa.binary()),
            pa.array([blob(r[3], "<u4") for r in rows], pa.binary()),
            pa.array([blob(r[4], "<u8") for r in rows], pa.binary()),
            pa.array([bool(r[5]) for r in rows], pa.bool_()),
        ],
        ["bucket", "tokens", "labels", "counts", "many", "own"],
    )


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """Tokens of each node that another node has too, in one bucket."""
    release_memory()
    labels, counts = [], []
    for row in group[group["own"]].itertuples():
        labels.append(np.frombuffer(row.labels, "<u8"))
        counts.append(np.frombuffer(row.counts, "<u4"))
    rest = group[~group["own"]]
    tokens = np.frombuffer(b"".join(rest["tokens"]), "<u8")
    owner = np.repeat(
        np.frombuffer(b"".join(rest["labels"]), "<u8"), np.frombuffer(b"".join(rest["counts"]), "<u4")
    )
    many = np.frombuffer(b"".join(rest["many"]), "<u8")
    if len(tokens):
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        del order
        edge = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        # Another batch may hold the same node; only a different one counts.
        other = np.concatenate(([False], (owner[1:] != owner[:-1]) & (tokens[1:] == tokens[:-1])))
        hit = np.logical_or.reduceat(other, edge) | np.isin(tokens[edge], many)
        hit = np.repeat(hit, np.diff(np.append(edge, len(tokens))))
        # A node that came in several batches has each token once.
        pairs = np.unique(np.stack((owner[hit], tokens[hit])), axis=1) if hit.any() else np.zeros((2, 0), "<u8")
        own, n = np.unique(pairs[0], return_counts=True)
        labels.append(own)
        counts.append(n)
    if not labels:
        return pd.DataFrame({"label": np.zeros(0, np.int64), "shared": np.zeros(0, np.int64)})
    return pd.DataFrame(
        {
            "label": np.concatenate(labels).astype(np.uint64).view(np.int64),
            "shared": np.concatenate(counts).astype(np.int64),
        }
    )


def _candidates(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that may have a link: enough of their prefix lies in other nodes."""
    total = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-int(total * 5 // 16) // BUCKET_ENTRIES))
    entries = docs.select("text").mapInArrow(_entries(buckets), ENTRY_SCHEMA)
    counted = entries.groupBy("bucket").applyInPandas(_shared, "label long, shared long")
    shared = counted.groupBy("label").agg(F.sum("shared").alias("shared"))
    # Copies of a node in several batches may count a token more than once: never less.
    return nodes.join(shared, "label").filter(F.col("shared") >= least_shared_sql("n"))


def least_shared_sql(n: str):
    least = F.ceil(F.col(n) * PERCENT / 100)
    return F.ceil(least / 16)


# ---------------------------------------------------------------- groups


def _leaders(sets: DataFrame) -> DataFrame:
    """``node, leader``: the most typical node that shares enough minwise hashes with it.

    A node is typical if many others share its hashes, as the text does that a
    group of edited copies comes from; such a leader links to most of its group.
    """
    slim = sets.select("node", F.posexplode("minwise").alias("j", "hash"))
    crowd = slim.groupBy("j", "hash").agg(F.count("*").alias("k")).filter("k > 1")
    met = checkpointed(slim.join(crowd, ["j", "hash"]))
    typical = met.groupBy("node").agg(F.sum("k").alias("fame"))
    famed = checkpointed(met.join(typical, "node").select("node", "j", "hash", "fame"))
    heads = famed.groupBy("j", "hash").agg(F.max(F.struct("fame", "node")).alias("head"))
    agreeing = famed.join(heads, ["j", "hash"]).groupBy("node", "head").agg(F.count("*").alias("agree"))
    best = (
        agreeing.filter(F.col("agree") >= AGREE).groupBy("node").agg(F.max("head").alias("head"))
    )
    return sets.select("node").join(best, "node", "left").select(
        "node", F.coalesce("head.node", "node").alias("leader")
    )


EDGE_SCHEMA = "a binary, b binary"


def _tokens(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8")


def _open_own(group: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links in one piece of a group, its leader included.

    Two members that others connect already are not compared, so that a piece
    has fewer links than members.  The leader comes first: it links to most.
    """
    lead = next(i for i, flag in enumerate(group["leads"]) if flag)
    order = [lead, *(i for i in range(len(group)) if i != lead)]
    nodes = [group["node"].iloc[i] for i in order]
    sets = [_tokens(group["tokens"].iloc[i]) for i in order]
    part = np.arange(len(nodes))
    out = []
    for i, tokens in enumerate(sets):
        for k in np.flatnonzero(part[i + 1 :] != part[i]) + i + 1:
            if part[k] != part[i] and linked(tokens, sets[k]):
                part[part == part[k]] = part[i]
                out.append((nodes[i], nodes[k]))
    release_memory()
    return pd.DataFrame(out, columns=["a", "b"])


def _own_links(sets: DataFrame, leaders: DataFrame) -> DataFrame:
    """Links inside the pieces of groups; the leader of a group is in each of its pieces."""
    sized = leaders.groupBy("leader").agg(F.count("*").alias("size")).filter("size > 1")
    pieces = F.ceil(F.col("size") / PIECE).cast("int")
    members = leaders.join(sized.select("leader", pieces.alias("pieces")), "leader")
    piece = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    placed = members.filter("node <> leader").select(
        "node", "leader", piece.alias("piece"), F.lit(False).alias("leads")
    )
    heads = sized.select(
        F.col("leader").alias("node"),
        "leader",
        F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"),
        F.lit(True).alias("leads"),
    )
    wanted = checkpointed(placed.unionByName(heads))
    return (
        sets.select("node", "tokens").join(_small(wanted, wanted.count() * 64), "node")
        .groupBy("leader", "piece")
        .applyInPandas(_open_own, EDGE_SCHEMA)
    )


# ---------------------------------------------------------------- matrix of groups


def _rows(whole: bool):
    """One row for each token of a set, or of its prefix."""

    def run(batches):
        for batch in (piece for whole_ in batches for piece in pieces(whole_, "tokens")):
            blobs = [_tokens(t) for t in batch.column("tokens").to_pylist()]
            lists = blobs if whole else [t[: prefix_length(len(t))] for t in blobs]
            sizes = [len(t) for t in lists]
            columns = [batch.column(c).to_numpy() for c in ("label", "component", "grp")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(0, "<u8"), *lists]).view(np.int64)),
                    *[pa.array(np.repeat(c, sizes)) for c in columns],
                    pa.array(np.repeat([len(t) for t in blobs], sizes).astype(np.int64)),
                ],
                ["token", "label", "component", "grp", "n"],
            )
            release_memory()

    return run


def _opened(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """Open a piece of a group for the queries that its token union may hold.

    Only links that join components not joined before are kept, a spanning
    forest: fewer than there are components here, whatever the size of a group.
    """
    sets = [_tokens(t) for t in members["tokens"]]
    if not sets or queries.empty:
        return pd.DataFrame([], columns=["a", "b"])
    union = np.unique(np.concatenate(sets))
    others: dict = {}
    for node, component, kept in zip(members["node"], members["component"], sets):
        others.setdefault(component, []).append((node, kept))
    forest, out = Forest(), []
    for node, own, blob in zip(queries["node"], queries["component"], queries["tokens"]):
        tokens = _tokens(blob)
        away = [c for c in others if forest.top(c) != forest.top(own)]
        if not away or overlap(tokens, union) < needed(len(tokens)):
            continue
        for component in away:
            if forest.top(component) == forest.top(own):
                continue
            for other, kept in others[component]:
                if linked(tokens, kept):
                    forest.join(own, component)
                    out.append((node, other))
                    break
    release_memory()
    return pd.DataFrame(out, columns=["a", "b"])


def _bounded(held: DataFrame, whole: bool) -> DataFrame:
    """Tokens that queries share with other groups, for queries with enough of them.

    ``token, label, component, grp, least, shared, df``; ``df`` is the number
    of groups with the token.  A component counts once however many members
    have the token, and is reduced to that before the shuffle.
    """
    matrix = held.mapInArrow(_rows(whole), "token long, label long, component long, grp long, n long")
    spread = (
        matrix.groupBy("token")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low <> high")
        .select("token")
    )
    crossing = checkpointed(matrix.join(spread, "token"))
    least = F.ceil(F.col("n") * PERCENT / 100) if whole else least_shared_sql("n")
    queries = (
        crossing.groupBy("label")
        .agg(F.count("*").alias("shared"), F.first(least).alias("least"))
        .filter("shared >= least")
    )
    queries = checkpointed(queries)
    open_ = crossing.drop("n").join(_small(queries, queries.count() * 24), "label")
    df = open_.select("token", "grp").distinct().groupBy("token").agg(F.count("*").alias("df"))
    return open_.join(df, "token")


def _union(open_: DataFrame) -> DataFrame:
    """The matrix: tokens of each group, with the components that bring them there."""
    return open_.groupBy("token", F.col("grp").alias("other")).agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    )


def _to_open(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``label, other``: queries and the groups to open; ``label`` of those left out.

    A query's overlap with a group is at most its tokens that other components
    bring to the group's union.  Tokens of very many groups are not looked up:
    they count as overlap with every group.  Queries that reach the bound by
    them alone are left out.
    """
    hot = (F.col("df") > HOT_GROUPS).cast("long")
    asking = open_.groupBy("label").agg(F.sum(hot).alias("hot"), F.first("least").alias("least"))
    asking = checkpointed(asking)
    known = open_.filter(F.col("df") <= HOT_GROUPS)
    light = known.drop("least", "grp").join(asking.filter("hot < least"), "label")
    overlaps = (
        light.join(_union(known), "token")
        .filter("low <> component OR high <> component")
        .groupBy("label", "other")
        .agg(F.count("*").alias("both"), F.first(F.col("least") - F.col("hot")).alias("wanted"))
    )
    return overlaps.filter("both >= wanted").select("label", "other"), asking.filter("hot >= least").select("label")


def _to_open_rarest(open_: DataFrame) -> DataFrame:
    """The groups to open for queries that consist of very common tokens.

    Any group with ``least`` of a query's ``shared`` tokens has one of the
    query's ``shared - least + 1`` rarest ones.
    """
    first = (F.col("shared") - F.col("least") + 1).cast("int")
    rarest = (
        open_.groupBy("label", "component", "shared", "least")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("list"))
        .select("label", "component", F.explode(F.slice("list", F.lit(1), first)).alias("t"))
        .select("label", "component", F.col("t.token").alias("token"))
    )
    return (
        rarest.join(_union(open_), "token")
        .filter("low <> component OR high <> component")
        .select("label", "other")
        .distinct()
    )


def _small(rows: DataFrame, size: int) -> DataFrame:
    """Broadcast a table of a known size when that is small, else leave it to a shuffle."""
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def _less_own(wanted: DataFrame, at: DataFrame, heavy: DataFrame) -> DataFrame:
    """The groups to open, less what the largest component of a group would ask of its own group.

    Its only partners there are the members of other components, and a link is
    bounded the same from both of its ends: they ask.  Only a heavy query may
    fail to, so a group with one of those outside its largest component keeps
    all its queries.
    """
    sized = at.groupBy("grp", "component").agg(F.count("*").alias("n"))
    main = sized.groupBy("grp").agg(F.max(F.struct("n", "component")).alias("main"))
    main = main.select("grp", F.col("main.component").alias("main"))
    silent = at.join(heavy, "label").join(main, "grp").filter("component <> main").select("grp").distinct()
    spared = main.join(silent, "grp", "left_anti")
    own = at.join(spared, "grp").filter("component = main").select("label", F.col("grp").alias("other"))
    return wanted.join(own, ["label", "other"], "left_anti")


def _cross_links(sets: DataFrame, groups: DataFrame, leaders: DataFrame) -> DataFrame:
    """Links between different components."""
    slim = groups.join(leaders, "node").select(
        "node", _label("component").alias("component"), _label("leader").alias("grp")
    )
    at = checkpointed(sets.select("label", "node").join(slim, "node").drop("node"))
    held = sets.select("label", "node", "tokens").join(_small(at, at.count() * 24), "label")
    open_ = checkpointed(_bounded(held, whole=False))
    asking, heavy = _to_open(open_)
    wanted = [asking]
    # Queries that very common tokens alone bring up to the bound are index rows for
    # the others, and are bounded among themselves by their whole sets.
    size = heavy.count() * 8
    if size:
        among = checkpointed(_bounded(held.join(_small(heavy, size), "label"), whole=True))
        again, still = _to_open(among)
        dense = _small(still, still.count() * 8)
        wanted += [again, _to_open_rarest(checkpointed(among.join(dense, "label", "left_semi")))]
    found = wanted[0]
    for more in wanted[1:]:
        found = found.unionByName(more)
    wanted = checkpointed(_less_own(found.distinct(), at, heavy))
    # A group is opened in pieces of bounded size, each for a bounded number of queries.
    members = open_.select("label", F.col("grp").alias("other")).distinct()
    lanes = wanted.groupBy("other").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("lanes"))
    pieces = members.groupBy("other").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    sized = checkpointed(lanes.join(pieces, "other"))
    sized = _small(sized, sized.count() * 16)
    part = lambda n: F.pmod(F.xxhash64("label"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = members.join(sized, "other").select(
        "label", "other", part("pieces").alias("piece"), each("lanes").alias("lane")
    )
    asked = wanted.join(sized, "other").select(
        "label", "other", each("pieces").alias("piece"), part("lanes").alias("lane")
    )
    keys = ["other", "piece", "lane"]

    def side(rows: DataFrame) -> DataFrame:
        rows = checkpointed(rows)
        joined = held.join(_small(rows, rows.count() * 32), "label")
        # toDF gives both sides columns of their own; they come from the same tables.
        return joined.select(*keys, "node", "component", "tokens").toDF(*keys, "node", "component", "tokens")

    return (
        side(inside).groupBy(*keys).cogroup(side(asked).groupBy(*keys)).applyInPandas(_opened, EDGE_SCHEMA)
    )


# ---------------------------------------------------------------- the operator


def _decided(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, mark, n, component_id`` of every row; ``mark`` tells the texts of one id apart."""
    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    marked = source.withColumn("mark", F.xxhash64("text"))
    docs = checkpointed(marked.mapInArrow(_documents, f"id {kind}, mark long, node binary, n long"))
    nodes = settled(
        spark,
        lambda: docs.filter("n > 0")
        .groupBy("node")
        .agg(F.min(id_key("id")).alias("key"), F.first("n").alias("n"))
        .withColumn("label", _label("node")),
    )
    able = settled(spark, lambda: _candidates(source, nodes))
    sets = settled(spark, lambda: _fetch(source, able))
    leaders = settled(spark, lambda: _leaders(sets))
    own = settled(spark, lambda: _own_links(sets, leaders))
    groups = settled(spark, lambda: _grouped(sets, own))
    links = settled(spark, lambda: own.unionByName(_cross_links(sets, groups, leaders)))
    merged = settled(spark, lambda: _grouped(sets, links))
    # The smallest id of each component, by way of its nodes.
    known = nodes.join(merged, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
    at = docs.filter("n > 0").join(known, "node")
    least = at.groupBy("component").agg(F.min("id").alias("component_id"))
    linked_ = at.join(least, "component").select("id", "mark", "n", "component_id")
    blank = docs.filter("n = 0").select("id", "mark", "n", F.col("id").alias("component_id"))
    return linked_.unionByName(blank)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, n_shingles, component_id`` for every row.

    Two texts link when their sets of word shingles have a Jaccard similarity
    of at least 0.75; a component is named by its smallest id.  A text of fewer
    words than a shingle is one shingle; null and blank texts have none, link
    with nothing and are components of their own.  Rows without an id link
    like others, but name a component only if all of it has none (null).
    Repeated rows are one node.  An empty table gives no rows.
    """
    with intermediates(df.sparkSession):
        found = write_out(_decided(df, id_col, text_col), "components")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _label(node: str):
    """The first eight bytes of a node as a signed number, last byte first."""
    digits = F.concat(*[F.hex(F.substring(F.col(node), i, 1)) for i in range(8, 0, -1)])
    wide = F.conv(digits, 16, -10)
    return wide.cast("long")


def _fetch(source: DataFrame, able: DataFrame) -> DataFrame:
    """Sets of the nodes that may link, from one document of each."""
    n = able.count()
    # A checked size: the list is broadcast when small, else both sides are shuffled.
    wanted = _small(able.select("key"), n * 16)
    texts = source.withColumn("key", id_key("id")).join(wanted, "key", "left_semi")
    sets = texts.select("text").mapInArrow(
        _fetched, "node binary, label long, tokens binary, minwise array<long>"
    )
    # Only where ids repeat can a node come twice.
    return sets if texts.select("key").count() == n else sets.dropDuplicates(["node"])


def _grouped(sets: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links)
    return sets.select("node").join(found, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without those that link to a row with a smaller id.

    One document of each component stays: the one that names it.  It is decided
    for each row, by its id and text: of two texts under one id, one may stay
    and the other go, and if both name their common component, the text of the
    smaller hash stays.  Repeated rows of the same id and text stay or go
    together.  Rows without an id all stay.  Blank and null texts stay.
    """
    with intermediates(df.sparkSession):
        found = write_out(_decided(df, id_col, text_col), "components")
    # Of several texts under the id that names their component, one stands for it.
    named = found.filter((F.col("id") == F.col("component_id")) & (F.col("n") > 0))
    first = named.groupBy("component_id").agg(F.min("mark").alias("least"), F.max("mark").alias("most"))
    first = first.filter("least <> most").drop("most")
    rest = named.join(first, "component_id").filter("mark <> least")
    gone = (
        found.filter(F.col("id") != F.col("component_id")).select("id", "mark")
        .unionByName(rest.select("id", "mark"))
        .select(id_key("id").alias("key"), "mark")
        .distinct()
    )
    if gone.count() * 24 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    whole = df.select(row, id_key(id_col).alias("key"), F.xxhash64(F.col(text_col)).alias("mark"))
    return whole.join(gone, ["key", "mark"], "left_anti").select("row.*")
