"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (one to three letters,
words padded with a space) in order of frequency.  A document has a profile of
its own; its distance to a language is the sum over its n-grams of how far the
ranks lie apart, and the most for an n-gram that the language lacks.

Counts are summed inside each batch first, so training shuffles one row for
each language, n-gram and batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nounspan.llm.common import release_memory

PROFILE = 400
HELD_GRAMS = 2_000_000
SPACE = 32

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is none."""
    global _letters
    if _letters is None:
        low = np.full(0x110000, SPACE, dtype=np.uint32)
        for code in range(0x110000):
            char = chr(code)
            if char.isalpha():
                lower = char.lower()
                low[code] = ord(lower) if len(lower) == 1 else code
        _letters = low
    return _letters


def grams_of(text: str) -> np.ndarray:
    """All n-grams of one to three letters; none spans a space between letters."""
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")].astype(np.int64)
    codes = np.concatenate(([SPACE], codes, [SPACE]))
    gap = codes == SPACE
    # Runs of spaces become one.
    codes = codes[~(gap & np.concatenate(([False], gap[:-1])))]
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64)
    gap = codes == SPACE
    one = codes[~gap]
    two = (codes[:-1] << 21) | codes[1:]
    three = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    return np.concatenate((one, two, three[~gap[1:-1]]))


def ranked(grams: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code points."""
    values, counts = np.unique(grams, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:most]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of at most about HELD_GRAMS n-grams at a time, and one text."""
    by_lang: dict[str, list[np.ndarray]] = {}
    held = 0

    def summed() -> Iterator[pa.RecordBatch]:
        for lang, found in by_lang.items():
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts)],
                ["lang", "gram", "n"],
            )
        by_lang.clear()
        release_memory()

    for batch in batches:
        # One text at a time: the batch is held once, as it came.
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            grams = grams_of(text.as_py() or "")
            by_lang.setdefault(lang, []).append(grams)
            held += len(grams)
            if held >= HELD_GRAMS:
                yield from summed()
                held = 0
    yield from summed()


def fit_profiles(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE
) -> dict[str, np.ndarray]:
    """Profiles learned from all rows with a language; ``size`` n-grams each.

    What comes to the driver is bounded by the number of languages and
    ``size``.  A language without letters has an empty profile.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long")
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    kept = totals.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size).collect()
    profiles: dict[str, dict[int, int]] = {}
    for row in kept:
        profiles.setdefault(row["lang"], {})[row["rank"]] = row["gram"]
    return {
        lang: np.array([by_rank[r] for r in sorted(by_rank)], dtype=np.int64)
        for lang, by_rank in sorted(profiles.items())
    }


class Ranks:
    """Ranks of all known n-grams, one row for each language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.langs, self.size = list(profiles), size
        self.known = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        self.rank = np.full((len(self.langs), len(self.known) + 1), -1, dtype=np.int64)
        for row, grams in enumerate(profiles.values()):
            self.rank[row, np.searchsorted(self.known, grams)] = np.arange(len(grams))

    def distances(self, grams: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language, as a share of the largest."""
        own = ranked(grams, self.size)
        at = np.searchsorted(self.known, own)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != own)] = -1
        other = self.rank[:, at]
        apart = np.where(other < 0, self.size, np.abs(other - np.arange(len(own))))
        return apart.sum(axis=1) / (self.size * len(own))

    def nearest(self, grams: np.ndarray) -> tuple[str, float]:
        far = self.distances(grams)
        best = int(np.argmin(far))
        others = np.delete(far, best)
        next_ = float(others.min()) if len(others) else 1.0
        return self.langs[best], float(next_ - far[best]) / next_ if next_ > 0 else 0.0


def language_of(text: Column, profiles: dict[str, np.ndarray], size: int = PROFILE) -> Column:
    """Struct ``lang_pred, score`` of a whole text; see ``predict``."""

    @F.arrow_udf("lang_pred string, score double")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = Ranks(profiles, size) if profiles else None
        for texts in batches:
            langs, scores = [], []
            # One text at a time: the batch is held once, as it came.
            for value in (text.as_py() for text in texts):
                grams = grams_of(value) if value and ranks else ()
                lang, score = ranks.nearest(grams) if len(grams) else ("und", 0.0)
                langs.append(lang)
                scores.append(score)
            found = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.StructArray.from_arrays(found, ["lang_pred", "score"])
            del texts, found, langs, scores
            release_memory()

    return nearest(text)


def predict(
    df: DataFrame,
    profiles: dict[str, np.ndarray],
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = PROFILE,
) -> DataFrame:
    """``<id>, lang_pred, score`` for every row; whole texts are read.

    ``score`` is the lead of the nearest language over the next, 0 to 1 (the
    nearness itself if there is only one language).  Null text, text without a
    letter, and an empty set of profiles give ``und`` and 0.  Of languages
    equally near, the first by name is taken.
    """
    found = df.select(F.col(id_col), language_of(F.col(text_col), profiles, size).alias("found"))
    return found.select(id_col, "found.lang_pred", "found.score")


def identified(
    df: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text"
) -> DataFrame:
    """The rows of ``df`` whose language is recognised; those without a letter go."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    found = df.select(row, language_of(F.col(text_col), profiles).alias("found"))
    return found.filter("found.lang_pred <> 'und'").select("row.*")


def held_out(id_col: str = "doc_id"):
    """Rows that no profile is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
