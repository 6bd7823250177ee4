"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Two suffixes belong together if their first ``depth`` bytes are equal.  They are
dealt by digits, the most significant first, and a group that holds one suffix
leaves at once, so that later passes see only what still has a rival.

* First digit.  Of all suffixes that start within ``width`` places the one whose
  first ``depth - width + 1`` bytes hash lowest is their anchor; every
  ``depth``-byte string holds its anchor, and equal strings hold it at the same
  place.  Suffixes are dealt by the anchor's digit, one row for a whole run of
  neighbours with the same anchor.
* Later digits.  A run splits into intervals of a sixteenth of its width.  The
  digit of an interval is all that its suffixes share, up to the full depth for
  a single suffix.  An interval without a rival has no repeated string; one
  whose strings are all equal to a rival's is repeated as a whole; only the
  others are split again.

Counts travel as numbers that are combined before each shuffle.  The members of
a frequent group are never brought together; they meet the few distinct digits
of their group in joins whose skewed partitions Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nounspan.functions.bloom import BloomFilter
from nounspan.llm.common import Scratch, text_of

DEPTH = 400
FAN = 16
# Places looked at together; a longer text is read in such steps.
STEP = 1 << 16
# Rows and bytes after which a result batch is passed on.
BATCH_ROWS = 20_000
BATCH_BYTES = 8_000_000

_FACTOR = 0x9E3779B97F4A7C15
_PLACE_BITS = np.uint64(27)
_PLACES = np.uint64((1 << 27) - 1)


def first_width(depth: int) -> int:
    """Suffixes under one anchor: a power of two that leaves a third of the depth as digit."""
    return 1 << ((2 * depth // 3).bit_length() - 1)


def _powers(factor: int, size: int) -> np.ndarray:
    out = np.full(size, factor % 2**64, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Anchors:
    """Runs of neighbouring suffixes that share their anchor."""

    def __init__(self, depth: int):
        self.depth, self.width = depth, first_width(depth)
        self.digit = depth - self.width + 1
        self.up = _powers(_FACTOR, STEP + depth)
        self.down = _powers(pow(_FACTOR, -1, 2**64), STEP + depth)

    def runs(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last start, anchor and hash of its digit, for every run."""
        codes = np.frombuffer(data, np.uint8)
        parts = []
        for start in range(0, len(codes) - self.depth + 1, STEP):
            code = codes[start : start + STEP + self.depth - 1].astype(np.uint64) + np.uint64(1)
            size = len(code)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(code * self.up[:size], out=sums[1:])
            hashed = (sums[self.digit :] - sums[: -self.digit]) * self.down[: size - self.digit + 1]
            hashed ^= hashed >> np.uint64(29)
            hashed *= np.uint64(0xBF58476D1CE4E5B9)
            hashed ^= hashed >> np.uint64(32)
            # The place stands in the low bits, so of equal hashes the leftmost wins.
            low = (hashed >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(hashed), dtype=np.uint64)
            reach = 1
            while reach < self.width:
                low = np.minimum(low[:-reach], low[reach:])
                reach *= 2
            at = (low & _PLACES).astype(np.int64)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            last = np.append(first[1:], len(at)) - 1
            parts.append((first + start, last + start, at[first] + start, hashed[at[first]].view(np.int64)))
        if not parts:
            return (np.zeros(0, np.int64),) * 4
        first, last, at, digit = (np.concatenate(p) for p in zip(*parts))
        # A run that goes on in the next step is one run.
        new = np.diff(at, prepend=-1) != 0
        ends = np.append(np.flatnonzero(new)[1:], len(at)) - 1
        return first[new], last[ends], at[new], digit[new]


def digest(*parts: bytes) -> int:
    return int.from_bytes(blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def joined_spans(spans: list[tuple[int, int]], gap: int = 0) -> list[tuple[int, int]]:
    """Sorted spans with an exclusive end, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight=None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row) if weight else 0
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of the batches one at a time, strings as bytes."""
    for batch in batches:
        columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.columns]
        for row in zip(*columns):
            yield tuple(v.as_py() for v in row)


def _fields(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in text.split(", "))])


RUNS = "who long, also long, at long, lo long, hi long, core long, whole long, n long"


def suffix_runs(docs: DataFrame, depth: int) -> DataFrame:
    """One row for each run: its text, its starts, the first digit, a digest of all its bytes.

    Runs that a text holds several times are one row with their number ``n``;
    the others of them come as rows without a digit, known to be repeated.
    """

    def run(batches):
        anchors = Anchors(depth)

        def rows():
            for who, also, data in _rows(batches):
                if len(data) < depth:
                    continue
                seen: dict[tuple[int, int], list] = {}
                known = []
                for lo, hi, at, core in zip(*(a.tolist() for a in anchors.runs(data))):
                    whole = digest(b"%d:%d:" % (at - lo, hi - lo), data[lo : hi + depth])
                    first = seen.setdefault((core, whole), [at, lo, hi, 0])
                    first[3] += 1
                    if first[3] > 1:
                        known.append((lo, hi + 1))
                for (core, whole), (at, lo, hi, n) in seen.items():
                    yield who, also, at, lo, hi, core, whole, n
                for start, end in joined_spans(known):
                    yield who, also, None, start, end - 1, None, None, 0

        yield from _batches(rows(), _fields(RUNS))

    return docs.select("who", "also", "text").mapInArrow(run, RUNS)


STRINGS = "who long, also long, at long, lo long, hi long, core long, open boolean, string binary"


def run_strings(docs: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """The bytes of the runs that need further digits, cut from their texts.

    A text meets the list of its own runs, which are fewer than its bytes.
    """
    lists = targets.groupBy("who", "also").agg(F.collect_set(F.struct("at", "lo", "hi", "core", "open")).alias("runs"))
    held = BloomFilter(targets, ["who", "also"])
    texts = docs.filter(held.may_hold("who", "also")).join(lists, ["who", "also"])

    def run(batches):
        def rows():
            before = None
            for who, also, data, runs in _rows(batches):
                # Repeated rows stand together after the join; one of them is enough.
                if (who, also) == before:
                    continue
                before = (who, also)
                for r in runs:
                    string = data[r["lo"] : r["hi"] + depth]
                    yield who, also, r["at"], r["lo"], r["hi"], r["core"], r["open"], string

        yield from _batches(rows(), _fields(STRINGS), lambda row: len(row[7]))

    return texts.select("who", "also", "text", "runs").mapInArrow(run, STRINGS)


INTERVALS = (
    "who long, also long, at long, run long, lo long, hi long, part long, core long, digit long, whole long, open boolean"
)


def intervals(strings: DataFrame, depth: int, width: int, wider: int | None = None) -> DataFrame:
    """Runs split into intervals of ``width`` places, counted back from the anchor.

    With ``wider``, only the parts of that width in the column ``parts`` are split.
    ``digit`` stands for the bytes that all suffixes of an interval share up to
    the depth, ``whole`` for all bytes of those that the run holds.
    """

    def run(batches):
        def rows():
            for who, also, at, first, last, core, open_, string, *parts in _rows(batches):
                least, most = at - last, at - first
                pieces = [(least, most)]
                if wider:
                    pieces = [(max(least, p * wider), min(most, p * wider + wider - 1)) for p in parts[0]]
                for a, b in pieces:
                    for part in range(a // width, b // width + 1):
                        near, far = max(a, part * width), min(b, part * width + width - 1)
                        left = most - part * width
                        shared = string[left : left - width + 1 + depth]
                        full = string[most - far : most - near + depth]
                        whole = digest(b"%d:%d:" % (far, near), full) if width > 1 else 0
                        yield who, also, at, first, at - far, at - near, part, core, digest(b"%d:" % part, shared), whole, open_

        yield from _batches(rows(), _fields(INTERVALS))

    return strings.mapInArrow(run, INTERVALS)


def repeated_starts(docs: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """``who, also, lo, hi``: starts of strings of ``depth`` bytes that also start elsewhere.

    ``docs`` holds ``who, also, text``; rows of one identity are equal texts of
    one id, each of which counts.  Spans may come in any order and touch.
    """
    runs = scratch.store(suffix_runs(docs, depth), "runs")
    digits = scratch.store(
        runs.filter("core IS NOT NULL")
        .groupBy("core")
        .agg(F.sum("n").alias("n"), (F.min("whole") != F.max("whole")).alias("mixed"))
        .filter("n > 1")
        .select("core", "mixed"),
        "digits",
    )
    rivals = BloomFilter(digits, ["core"])
    alive = scratch.store(runs.filter(rivals.may_hold("core")).join(digits, "core"), "alive")
    pairs = scratch.store(
        alive.filter("mixed")
        .groupBy("core", "whole")
        .agg(F.sum("n").alias("copies"), F.min(F.struct("who", "also", "at", "lo", "hi")).alias("run")),
        "pairs",
    )
    span = ["who", "also", "lo", "hi"]
    copies = pairs.filter("copies > 1").select("core", "whole")
    spans = [
        runs.filter("core IS NULL").select(span),
        alive.filter("NOT mixed").select(span),
        alive.filter("mixed").join(copies, ["core", "whole"]).select(span),
    ]
    # One run for each digest: open ones, and the copied ones that they may equal in part.
    targets = pairs.select("core", "run.*", (F.col("copies") == 1).alias("open"))
    strings = scratch.store(run_strings(docs, targets, depth), "strings")
    width, split = first_width(depth), strings
    while width > 1:
        wider, width = width, max(1, width // FAN)
        whole = wider == first_width(depth)
        parts = scratch.store(intervals(split, depth, width, None if whole else wider), f"parts-{width}")
        groups = scratch.store(
            parts.groupBy("core", "digit")
            .agg(
                F.count("*").alias("n"),
                (F.min("whole") != F.max("whole")).alias("mixed"),
                F.max("open").alias("asked"),
            )
            .filter("n > 1 AND asked")
            .select("core", "digit", "mixed"),
            f"groups-{width}",
        )
        rivals = BloomFilter(groups, ["core", "digit"])
        met = scratch.store(
            parts.filter(rivals.may_hold("core", "digit")).join(groups, ["core", "digit"]), f"met-{width}"
        )
        spans.append(met.filter("open AND NOT mixed").select(span))
        key = ["who", "also", "at", "lo"]
        again = met.filter("mixed").groupBy("who", "also", "at", F.col("run").alias("lo"))
        split = strings.join(again.agg(F.collect_set("part").alias("parts")), key).select(*strings.columns, "parts")
    starts = spans[0]
    for more in spans[1:]:
        starts = starts.unionByName(more)
    return starts


KEPT = "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def without_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH
) -> DataFrame:
    """Every whole text as UTF-8 bytes, without those of strings that also start elsewhere.

    Returns the id, ``n_bytes``, ``n_removed``, the removed ``spans`` in bytes
    (sorted, end exclusive, none touching another) and the bytes ``kept``, one
    row for each row.  A string is looked for in all texts, its own included,
    and overlaps count; matches never cross texts, and all are judged on the
    input.  Repeated rows are copies of one another, whatever their id.  Null
    text counts as empty, a null id is an id.  Other columns are not read.  No
    rows, no result.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("key"), text_of(text_col).alias("text")).withColumns(
        {"who": F.xxhash64("key", "text"), "also": F.xxhash64(F.lit(1), "key", "text")}
    )
    with Scratch(spark, "repeats") as scratch:
        starts = repeated_starts(docs.select("who", "also", "text"), depth, scratch)
        found = Scratch(spark, "repeats-found").store(
            starts.groupBy("who", "also").agg(F.collect_set(F.struct("lo", "hi")).alias("starts")), "starts"
        )
    held = BloomFilter(found, ["who", "also"])
    maybe = held.may_hold("who", "also")
    touched = docs.filter(maybe).join(found, ["who", "also"], "left").select("key", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), _SPANS, pa.binary()]

        def made(keys, rows):
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays([keys, *columns], ["key", "n_bytes", "n_removed", "spans", "kept"])

        for batch in batches:
            keys, since, size, rows = batch.column("key"), 0, 0, []
            for data, starts in zip(batch.column("text").cast(pa.binary()), batch.column("starts")):
                data = data.as_py()
                spans = joined_spans([(s["lo"], s["hi"] + depth) for s in starts.as_py() or []])
                at, parts = 0, []
                for start, end in spans:
                    parts.append(data[at:start])
                    at = end
                parts.append(data[at:])
                removed = sum(end - start for start, end in spans)
                rows.append((len(data), removed, [{"start": a, "end": b} for a, b in spans], b"".join(parts)))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield made(keys.slice(since, len(rows)), rows)
                    since, size, rows = since + len(rows), 0, []
            if rows:
                yield made(keys.slice(since, len(rows)), rows)

    # Texts without a repeated string stay where they are.
    data = F.col("text").cast("binary")
    clean = docs.filter(~maybe).select(
        "key",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
        data.alias("kept"),
    )
    return touched.mapInArrow(run, f"key {kind}, {KEPT}").unionByName(clean).withColumnRenamed("key", id_col)
