"""Bloom filters of bounded size, built and probed by built-in functions.

A filter is one array of 64-bit words.  It says "surely not" or "maybe", so it
may only stand before an exact join, to keep rows without a partner out of the
shuffle.  Its size is a parameter and never grows with the data: with too many
keys it lets more rows through, and the join after it still decides.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23
PROBES = 3


def _places(key: list[Column], bits: int, probes: int) -> list[Column]:
    """Bits of a key, by double hashing."""
    first, second = F.xxhash64(*key), F.xxhash64(F.lit(1), *key)
    return [F.pmod(F.shiftright(first, 1) + F.lit(i) * F.shiftright(second, 8), F.lit(bits)) for i in range(probes)]


class BloomFilter:
    """Keys of a table; ``may_hold`` is false only for keys that are not in it.

    Null is a key like any other.  At most ``bits / 8`` bytes reach the driver
    and the executors.
    """

    def __init__(self, df: DataFrame, key: list[str], bits: int = BITS, probes: int = PROBES):
        if bits % 64:
            raise ValueError("the bits must fill whole words")
        self.bits, self.probes = bits, probes
        places = df.select(F.explode(F.array(*_places([F.col(c) for c in key], bits, probes))).alias("bit"))
        found = (
            places.groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("set"))
            .toArrow()
        )
        words = [0] * (bits // 64)
        for word, value in zip(found["word"].to_pylist(), found["set"].to_pylist()):
            words[word] = value
        self.share_set = sum((w & (2**64 - 1)).bit_count() for w in words) / bits
        schema = pa.schema([("words", pa.list_(pa.int64()))])
        self._words = df.sparkSession.createDataFrame(pa.table({"words": [words]}, schema=schema))

    def may_hold(self, *key: str | Column) -> Column:
        """Whether the key may be in the table; a subquery gives the words to every task once."""
        columns = [F.col(c) if isinstance(c, str) else c for c in key]
        held = F.lit(True)
        for place in _places(columns, self.bits, self.probes):
            word = F.element_at(self._words.scalar(), (F.shiftright(place, 6) + 1).cast("int"))
            held = held & (F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return held
