"""Human annotation sets: valid rows, and rows that both systems share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nounspan.functions.text import ngram_at, split_sentences, tokens


def valid_annotations(
    df: DataFrame, source: str = "source", seed: str = "seed_noun", sentences: str | None = None
) -> DataFrame:
    """Rows with exactly four sentences of which the third holds the seed."""
    parts = F.col(sentences) if sentences else split_sentences(F.col(source))
    third = tokens(F.get(parts, F.lit(2)))
    wanted = tokens(F.col(seed))
    size = F.size(wanted)
    starts = F.sequence(F.lit(0), F.greatest(F.size(third) - 1, F.lit(0)))
    found = F.when(size == 1, F.array_contains(third, F.get(wanted, F.lit(0)))).otherwise(
        F.exists(starts, lambda at: ngram_at(third, at, size) == wanted)
    )
    return df.filter((F.size(parts) == 4) & (size > 0) & found)


def common_annotations(
    a: DataFrame, b: DataFrame, key: str = "id", label: str = "label"
) -> DataFrame:
    """Rows of ``a`` that were annotated for both systems."""
    return a.filter(F.col(label).isNotNull()).join(
        b.filter(F.col(label).isNotNull()).select(key), key, "left_semi"
    )
