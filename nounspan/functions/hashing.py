"""Seeded pseudo-randomness that depends on the row, never on its partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_hash(seed: int, *parts: Column) -> Column:
    """32 hex digits drawn from the seed and the identity of the row."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def unit_draw(digest: Column) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of a hash."""
    whole = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return (whole + 1) / F.lit(float(2**52 + 1))


def race_time(digest: Column, weight: Column) -> Column:
    """Arrival time of a row in an exponential race; the earliest n are drawn.

    Keeping the n smallest values of -ln(u)/w draws n rows without replacement
    with chances proportional to w (Efraimidis and Spirakis, 2006).
    """
    return -F.ln(unit_draw(digest)) / weight
