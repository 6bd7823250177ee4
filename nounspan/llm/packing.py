"""Vector bin packing of tokenised examples into fixed-length sequences.

Every example has three demands: tokens, one segment, and loss-bearing tokens.
A sequence is filled by the dot-product heuristic: of the examples that fit
all three limits, the one whose demands point most along the remaining
capacity comes next.  Where an example may be cut, the gap that no whole
example fits is filled with the start of the longest one.

Each task packs its own rows through a bounded pool, so nothing is shuffled and
only the last sequence of a task can be short.
"""

from __future__ import annotations

import gc
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from nounspan.llm.common import release_memory

END_ID = 1
CACHE_WORDS = 300_000
PIECES = (
    "start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, "
    "sequence_id long, offset long"
)


# ---------------------------------------------------------------- tokens


def byte_letters() -> dict[int, str]:
    """The visible letter that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _word_pattern() -> re.Pattern:
    """The vocabulary's cut into words, for lower-cased text of ``WordIds.plain``."""
    kinds = {chr(c): unicodedata.category(chr(c))[0] for c in range(0x180)}
    letters = "".join(c for c, kind in kinds.items() if kind == "L")
    numbers = "".join(c for c, kind in kinds.items() if kind == "N")
    spaces = "\\x09-\\x0D\\x20\\x85\\xA0"
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


WORDS = _word_pattern()
# Beyond composed Latin letters and common punctuation, a letter with two of lower case, or a special token.
OTHER = re.compile(r"[^\x00-\u012F\u0131-\u017F\u2010-\u2027]|<\|")
# Holds what vocabularies cut in different ways.
PROBE = "It's We'LL x''d don't 12.5% a_b-c... ÀÉ½ß\x1fy\x85z\xa0“q” #!\n"


class WordIds(dict):
    """Token ids (little-endian unsigned 32-bit bytes) of words, kept up to a bound.

    The vocabulary lower-cases a text and cuts it into words that never cross
    white space; a text's ids are the ids of its words one after another.  Plain
    text is cut here, so that a word is looked up without its case and the
    punctuation around it.  Other texts are looked up by their stretches between
    spaces; those that are not plain, and all of a vocabulary that cuts
    differently, go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.cuts = False
        self.cuts = self.of_stretch(PROBE) == self.of_plain(PROBE)
        self.clear()

    def __missing__(self, word: str) -> bytes:
        """Ids of a word that ``WORDS`` has cut."""
        if len(self) >= CACHE_WORDS:
            self.clear()
        spelt = word
        if not (word.isascii() and word.isalnum()):
            spelt = word.encode().decode("latin-1").translate(self.letters)
        ids = self[word] = self.packed([token.id for token in self.model.tokenize(spelt)])
        return ids

    @staticmethod
    def plain(text: str) -> bool:
        """The vocabulary's normaliser just lower-cases it, and ``WORDS`` cuts it."""
        return "<|" not in text if text.isascii() else not OTHER.search(text)

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def of_plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, WORDS.findall(text.lower())))

    def of_stretch(self, stretch: str) -> bytes:
        ids = self.get(stretch)
        if ids is None:
            if self.cuts and self.plain(stretch):
                ids = self.of_plain(stretch)
            else:
                ids = self.packed(self.tokenizer.encode(stretch, add_special_tokens=False).ids)
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[stretch] = ids
        return ids

    def of(self, text: str) -> bytes:
        if self.cuts and self.plain(text):
            return self.of_plain(text)
        return b"".join(map(self.of_stretch, text.replace("\n", " ").split(" ")))


# ---------------------------------------------------------------- packing


class Item:
    """What is left of one example: ids from ``start`` on."""

    __slots__ = ("key", "ids", "start", "total", "loss")

    def __init__(self, key, ids: bytes, loss: np.ndarray | None):
        self.key, self.ids, self.start = key, ids, 0
        self.total = len(ids) // 4
        # Loss-bearing tokens before each place; without a mask all bear loss.
        self.loss = None if loss is None else np.concatenate(([0], np.cumsum(loss, dtype=np.int64)))

    def length(self) -> int:
        return self.total - self.start

    def loss_of(self, length: int) -> int:
        if self.loss is None:
            return length
        return int(self.loss[self.start + length] - self.loss[self.start])

    def fitting(self, tokens: int, loss: int) -> int:
        """Longest piece within both limits."""
        most = min(tokens, self.length())
        if self.loss is None:
            return min(most, loss)
        reach = int(np.searchsorted(self.loss, self.loss[self.start] + loss, side="right")) - 1
        return min(most, reach - self.start)


class Packer:
    """Packs examples as they come; ``sequence`` numbers follow ``first``."""

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool, least_cut: int, first: int):
        self.limits = (tokens, segments, loss)
        self.cut, self.least_cut, self.sequence = cut, least_cut, first
        self.pool: list[Item] = []
        self.held = 0
        # Empty examples share sequences of their own.
        self.empty_sequence, self.empty_seats = first, 0
        self.out: list[tuple] = []

    def add(self, item: Item) -> None:
        tokens, segments, loss = self.limits
        if not item.total:
            # Written at once: it needs a seat and no room, so it need not wait in the pool.
            if not self.empty_seats:
                self.empty_sequence, self.empty_seats = self.sequence, segments
                self.sequence += 1
            self.empty_seats -= 1
            self.out.append((item.key, 0, 0, zlib.crc32(item.ids), 0, 0, self.empty_sequence, 0))
            return
        if self.cut:
            # Whole sequences first; the rest joins the pool.
            while item.length() > tokens or item.loss_of(item.length()) > loss:
                self.place(item, item.fitting(tokens, loss), 0)
                self.sequence += 1
            if not item.length():
                return
        elif item.total > tokens or item.loss_of(item.total) > loss:
            self.out.append((item.key, 0, item.total, zlib.crc32(item.ids), item.total,
                             item.loss_of(item.total), None, None))
            return
        self.pool.append(item)
        self.held += item.length()

    def place(self, item: Item, length: int, offset: int) -> None:
        if length <= 0 < item.length():
            raise ValueError("the loss limit is below one token")
        piece = item.ids[4 * item.start : 4 * (item.start + length)]
        self.out.append((item.key, item.start, length, zlib.crc32(piece), item.total,
                         item.loss_of(length), self.sequence, offset))
        item.start += length

    def pack(self, keep: int) -> None:
        """Fill sequences until fewer than ``keep`` tokens are left in the pool."""
        tokens, segments, loss = self.limits
        items = self.pool
        size = np.array([i.length() for i in items], dtype=np.float64)
        burden = np.array([i.loss_of(i.length()) for i in items], dtype=np.float64)
        alive = np.ones(len(items), dtype=bool)
        while self.held >= max(keep, 1) and alive.any():
            room, seats, bear, offset = tokens, segments, loss, 0
            while seats and room:
                fits = alive & (size <= room) & (burden <= bear)
                if fits.any():
                    along = (
                        size / tokens * (room / tokens)
                        + (seats / segments) / segments
                        + burden / loss * (bear / loss)
                    )
                    best = int(np.argmax(np.where(fits, along, -1.0)))
                    length = items[best].length()
                    alive[best] = False
                elif self.cut and room >= self.least_cut and alive.any():
                    best = int(np.argmax(np.where(alive, size, -1.0)))
                    length = items[best].fitting(room, bear)
                    if length < self.least_cut:
                        break
                else:
                    break
                lost = items[best].loss_of(length)
                self.place(items[best], length, offset)
                room, seats, bear, offset = room - length, seats - 1, bear - lost, offset + length
                self.held -= length
                size[best], burden[best] = size[best] - length, burden[best] - lost
            self.sequence += 1
        self.pool = [item for item, left in zip(items, alive) if left]


def pack_batches(
    batches: Iterator[pa.RecordBatch],
    example: Callable[[dict], tuple[bytes, np.ndarray | None]],
    key_type: pa.DataType,
    limits: tuple[int, int, int],
    cut: bool,
    least_cut: int,
    pool_items: int,
) -> Iterator[pa.RecordBatch]:
    """Pieces of the examples of one task.  Memory: one batch and one pool.

    ``example`` and what it holds are let go at the end.
    """
    names = ["start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
    packer = Packer(*limits, cut, least_cut, TaskContext.get().partitionId() << 40)

    def written() -> pa.RecordBatch:
        rows = list(zip(*packer.out)) or [[]] * 8
        packer.out = []
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0], key_type), *[pa.array(c, pa.int64()) for c in rows[1:]]], ["key", *names]
        )

    for batch in batches:
        # One row at a time: the batch is held once, as it came.
        for values in zip(*batch.columns):
            row = dict(zip(batch.schema.names, (v.as_py() for v in values)))
            ids, loss = example(row)
            packer.add(Item(row["key"], ids, loss))
            if len(packer.pool) >= pool_items:
                packer.pack(keep=limits[0])
        yield written()
        release_memory()
    packer.pack(keep=0)
    yield written()
    # Workers live on: what this task has learned of words goes now.
    del example
    gc.collect()
    release_memory()


def _pieces(rows: DataFrame, id_col: str, example_of, limits, cut, least_cut, pool_items) -> DataFrame:
    kind = rows.schema["key"].dataType
    key_sql = kind.simpleString()

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        yield from pack_batches(
            batches, example_of(), to_arrow_type(kind), limits, cut, least_cut, pool_items
        )

    return rows.mapInArrow(run, f"key {key_sql}, {PIECES}").withColumnRenamed("key", id_col)


def pack_texts(
    df: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 2048,
    max_segments: int = 256,
    max_loss: int = 2048,
    least_cut: int = 16,
    pool_items: int = 1024,
) -> DataFrame:
    """Pieces of all texts, cut freely, one row for each.

    A text's ids are its tokens and then the end id; null counts as empty and
    has the end id alone.  Every id lies in exactly one piece; the pieces of a
    sequence follow each other from offset 0.  Repeated rows are packed each
    for itself; a null id stays null.  No rows, no pieces.
    """

    def example_of():
        words, end = WordIds(vocabulary), WordIds.packed([END_ID])

        def example(row):
            return words.of(row["text"] or "") + end, None

        return example

    rows = df.selectExpr(f"`{id_col}` AS key", f"`{text_col}` AS text")
    return _pieces(rows, id_col, example_of, (max_tokens, max_segments, max_loss), True, least_cut, pool_items)


def pack_examples(
    df: DataFrame,
    id_col: str = "id",
    ids_col: str = "ids",
    loss_col: str = "bears_loss",
    max_tokens: int = 2048,
    max_segments: int = 16,
    max_loss: int = 1024,
    pool_items: int = 1024,
) -> DataFrame:
    """Whole instruction examples under all three limits; none is cut.

    ``ids`` is an array of token ids, ``bears_loss`` a flag for each (null: all
    bear loss).  An example beyond a limit by itself gets no sequence: its
    ``sequence_id`` and ``offset`` are null.  A null or empty example has one
    piece of length 0, in a sequence with others of its task.
    """

    def example_of():
        def example(row):
            ids, loss = row["ids"] or [], row["loss"]
            mask = None if loss is None else np.resize(np.array([bool(x) for x in loss] or [True]), len(ids))
            return WordIds.packed(ids), mask

        return example

    rows = df.selectExpr(f"`{id_col}` AS key", f"`{ids_col}` AS ids", f"`{loss_col}` AS loss")
    return _pieces(rows, id_col, example_of, (max_tokens, max_segments, max_loss), False, 1, pool_items)
