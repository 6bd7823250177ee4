"""Fill-in-the-middle examples, cut by an indexable skip list.

A text is a list of units: runs of ASCII letters, and every other code point on
its own.  The lowest lane of the skip list is the text itself.  Express lanes
above it link the units that a coin has promoted, and every link carries how
many units and how many code points it passes.  A cut after so many units goes
down the lanes, adds up these widths and ends on the exact code point.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nounspan.llm.common import text_of

# The marks of the three parts, and what a unit is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = re.compile("<[PSM]>")
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")

# A unit reaches the next lane with one chance in FAN.
FAN = 16
# Code points looked at together; a longer text is read in such steps.
STEP = 1 << 16
# Heights of the units, by place modulo STEP.  They decide the speed, never the cut.
HEIGHTS = np.random.default_rng(FAN).geometric(1 - 1 / FAN, STEP) - 1
# A result batch is passed on when its texts reach so many code points.
BATCH_CHARS = 4_000_000


class SkipList:
    """Units of one text with express lanes; ``len`` is the number of units."""

    def __init__(self, text: str):
        self.text = text
        count, inside = 0, False
        units, points, heights = [], [], []
        for start in range(0, len(text), STEP):
            codes = np.frombuffer(text[start : start + STEP].encode("utf-32-le", "surrogatepass"), "<u4")
            letter = (codes | 32) - np.uint32(97) < 26
            begins = ~letter
            begins[1:] |= ~letter[:-1]
            # A run of letters may come from the step before.
            begins[0] |= not inside
            inside = bool(letter[-1])
            at = np.flatnonzero(begins)
            number = np.arange(count, count + len(at))
            height = HEIGHTS[number % STEP]
            up = height > 0
            units.append(number[up])
            points.append(at[up] + start)
            heights.append(height[up])
            count += len(at)
        self.count = count
        # From the lowest express lane up: widths in units, in code points, places one lane below.
        self.lanes: list[tuple[list, list, list]] = []
        if not units:
            return
        unit, point, height = (np.concatenate(a) for a in (units, points, heights))
        below = np.arange(len(unit))
        while len(unit):
            self.lanes.append((np.diff(unit, prepend=0).tolist(), np.diff(point, prepend=0).tolist(), below.tolist()))
            below = np.flatnonzero(height > len(self.lanes))
            unit, point, height = unit[below], point[below], height[below]

    def __len__(self) -> int:
        return self.count

    def point(self, rank: int) -> int:
        """Code points in the first ``rank`` units."""
        units = points = 0
        node = -1
        for unit_widths, point_widths, below in reversed(self.lanes):
            while node + 1 < len(unit_widths) and units + unit_widths[node + 1] <= rank:
                node += 1
                units += unit_widths[node]
                points += point_widths[node]
            node = below[node] if node >= 0 else -1
        for _ in range(rank - units):
            points = UNIT.match(self.text, points).end()
        return points


def example(
    text: str, draws: tuple[int, int, int, int], plain_percent: int = 10, spm_percent: int = 20
) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the text in that form."""
    lanes = SkipList(text)
    n = len(lanes)
    if not text or MARK.search(text) or draws[2] % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = lanes.point(first), lanes.point(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    plain_percent: int = 10,
    spm_percent: int = 20,
) -> DataFrame:
    """Every whole text as a fill-in-the-middle example.

    Returns the id, ``n`` units, ``form`` (``plain``, ``psm`` or ``spm``), the
    code points of prefix and middle (null if plain) and ``output``.  The cuts
    follow from the seed and the id alone, so a rerun task gives the same rows
    and equal rows give equal examples; a null id draws as an empty one.  A null
    or empty text, and one that holds a mark, stays plain.  Other columns are
    not read.  No rows, no result.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = [part.split()[0] for part in SCHEMA.split(", ")]

        def made(keys, rows):
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays([keys, *columns], ["key", *names])

        for batch in batches:
            keys, since, chars, rows = batch.column("key"), 0, 0, []
            for draw, text in zip(batch.column("draw"), batch.column("text")):
                draw, text = draw.as_py(), text.as_py()
                draws = tuple(int(draw[i : i + 8], 16) for i in (0, 8, 16, 24))
                rows.append(example(text, draws, plain_percent, spm_percent))
                chars += len(text)
                if chars >= BATCH_CHARS:
                    yield made(keys.slice(since, len(rows)), rows)
                    since, chars, rows = since + len(rows), 0, []
            if rows:
                yield made(keys.slice(since, len(rows)), rows)

    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = df.select(F.col(id_col).alias("key"), draw.alias("draw"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` has rearranged into ``output``.

    No part holds a mark, so the first mark of each kind is the true one.  Null
    where an input is null.
    """
    mark = len(PREFIX)

    def between(left: Column | int, right: Column) -> Column:
        return F.substring(output, F.lit(left) + mark, right - left - mark)

    suffix_at, prefix_at = F.locate(SUFFIX, output), F.locate(PREFIX, output)
    middle_at = F.locate(MIDDLE, output)
    middle = F.substring(output, middle_at + mark, F.length(output))
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(between(1, suffix_at), middle, between(suffix_at, middle_at)))
        .when(form == "spm", F.concat(between(prefix_at, middle_at), middle, between(1, prefix_at)))
    )
