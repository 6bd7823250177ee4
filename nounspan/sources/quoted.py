"""Large delimited files with quoted line breaks, read by many tasks.

Whether a line begins a record depends on the quotes before it in its file.
Their parity is counted for each block, and the parities of the blocks are
combined in a prefix sum.  A task then reads its blocks in order and cuts them
into records where it finds them, so lines are never shuffled: only the pieces
of records that go over the end of a block are brought together.  Parsing stays
Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'
PLACE = ["file", "block", "line"]
# Pieces of blocks: ``line`` is null before the first record, ``open`` marks the last one if it goes on.
_PIECES = "nr long, line long, open boolean, text string"
_PIECE_COLUMNS = ["nr", "line", "open", "text"]


def quote_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(QUOTE), F.lit("")))


def _blocks(lines: DataFrame) -> DataFrame:
    """One row for each block of a file, numbered: whether a cell is open where it begins and where it ends."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.groupBy("file", "block").agg(F.sum(quote_count(F.col("value")) % 2).alias("odd"))
    before = F.coalesce(F.sum("odd").over(earlier), F.lit(0))
    return sums.select(
        "file", "block", (before % 2).alias("inside"), ((before + F.col("odd")) % 2).alias("open"),
        F.row_number().over(Window.orderBy("file", "block")).cast("long").alias("nr"),
    )


class _Cutter:
    """Cuts the lines of a task's blocks, as they come, into records."""

    def __init__(self):
        self.nr, self.odd, self.line, self.start, self.held = None, 0, 0, None, []

    def ended(self) -> list[tuple]:
        """The piece at the end of a block."""
        rows = [self._held(open=self.start is not None and bool(self.odd))] if self.held else []
        self.held = []
        return rows

    def _held(self, open: bool) -> tuple:
        texts = self.held[0] if len(self.held) == 1 else pa.concat_arrays(self.held)
        return self.nr, self.start, open, "\n".join(texts.to_pylist())

    def cut(self, nr: int, inside: int, values: pa.Array) -> Iterator[pa.RecordBatch]:
        """Lines of one block that follow each other; what may go on is held."""
        rows = []
        if nr != self.nr:
            rows += self.ended()
            self.nr, self.odd, self.line, self.start = nr, inside, 0, None
        quotes = pc.count_substring(values, QUOTE).to_numpy(zero_copy_only=False).astype(np.int64) % 2
        sums = self.odd + np.cumsum(quotes)
        begins = np.flatnonzero((sums - quotes) % 2 == 0)
        if len(begins):
            if begins[0]:
                self.held.append(values.slice(0, begins[0]))
            if self.held:
                rows.append(self._held(open=False))
            if rows:
                yield _batch(*zip(*rows))
            whole = len(begins) - 1
            if whole:
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), values)
                yield _batch([nr] * whole, begins[:-1] + self.line, [False] * whole, pc.binary_join(lists, "\n"))
            self.start, self.held = int(begins[-1]) + self.line, [values.slice(begins[-1])]
        else:
            self.held.append(values)
            if rows:
                yield _batch(*zip(*rows))
        self.odd, self.line = int(sums[-1] % 2), self.line + len(values)


def _batch(nr, line, open, text) -> pa.RecordBatch:
    columns = [pa.array(nr, pa.int64()), pa.array(line, pa.int64()), pa.array(open, pa.bool_()), pa.array(text, pa.string())]
    return pa.RecordBatch.from_arrays(columns, _PIECE_COLUMNS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = _Cutter()
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = batch.column("nr").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(edges, edges[1:]):
            yield from cutter.cut(int(numbers[a]), batch.column("inside")[a].as_py(), batch.column("value").slice(a, b - a))
    rows = cutter.ended()
    if rows:
        yield _batch(*zip(*rows))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, line, top, text`` of every record, in the order of the files by block and line.

    A record belongs to the block in which it begins; ``top`` marks the first
    one of a file.  Quotes inside a cell are doubled, so they do not change the
    parity.  Where a closing quote is missing, the record takes the rest of its
    file, as any reader would have it.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    # One row for a split of the files, so the table is small whatever the files hold.
    blocks = _blocks(lines)

    def pieces(among: DataFrame) -> DataFrame:
        named = lines.join(F.broadcast(among), ["file", "block"]).select("nr", "inside", "value")
        return named.mapInArrow(_cut, _PIECES)

    goes_on = F.col("line").isNull() | F.col("open")
    alone = pieces(blocks).filter(~goes_on).select("nr", "line", "text")
    # Only blocks that begin or end inside a record have pieces of one, two at most.
    parts = pieces(blocks.filter("inside = 1 OR open = 1")).filter(goes_on).join(
        F.broadcast(blocks.select("nr", "file")), "nr"
    )
    # A piece before the first record of its block belongs to the last record of an earlier one.
    so_far = Window.partitionBy("file").orderBy("nr", F.col("line").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    home = F.last(F.when(F.col("line").isNotNull(), F.struct("nr", "line")), ignorenulls=True).over(so_far)
    joined = (
        parts.select(home.alias("home"), F.struct("nr", F.col("line").isNotNull().alias("last"), "text").alias("part"))
        .groupBy("home")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .select("home.nr", "home.line", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    )
    return alone.unionByName(joined).join(F.broadcast(blocks.select("nr", "file", "block")), "nr").select(
        *PLACE, ((F.col("block") == 0) & (F.col("line") == 0)).alias("top"), "text"
    )


def read_large_csv(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", place: bool = False
) -> DataFrame:
    """Rows of delimited files with a header each, all columns as strings, blanks as null.

    Every block of a file is read by a task of its own, whatever line breaks
    the cells hold.  ``place`` adds the columns that order the rows as they
    stand in the files.
    """
    options = {
        "sep": sep, "quote": QUOTE, "escape": QUOTE, "nullValue": "", "emptyValue": "", "maxCharsPerColumn": "-1",
        "multiLine": "true",
    }
    rows = records(spark, path).filter("NOT top").withColumn("text", F.regexp_replace("text", r"\r\z", ""))
    columns = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)
    parsed = F.from_csv("text", columns, options)
    kept = rows.filter("text <> ''").select(*(PLACE if place else []), parsed.alias("r"))
    return kept.select(*(PLACE if place else []), "r.*")
