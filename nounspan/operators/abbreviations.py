"""Abbreviations learned from a corpus, so that their full stop ends no sentence.

A word that nearly always stands before a full stop is an abbreviation: the
log-likelihood ratio compares that with chance, long words and words that also
occur without a full stop weigh less (Kiss and Strunk, 2006).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A word, perhaps with stops inside, perhaps with one at its end, between quotes and other marks.
WORD = r"""^[("']*([\p{L}]+(?:[.][\p{L}]+)*)([.]?)[,;:!?)"']*$"""
SPACES = r"[ \t\r\n]+"
# Chance of a full stop after an abbreviation.
CERTAIN = 0.99
THRESHOLD = 0.3
# Full stops after a word that are evidence enough.
LEAST = 3
# The list is broadcast as a literal; the words of the highest scores are kept.
MOST = 1_000


def abbreviation_scores(corpus: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``word, n_stop, n_plain, score`` of all words that stand before a full stop ``least`` times or more.

    The words of a text are counted in each task before the shuffle.  Null
    texts have no words.
    """
    pieces = corpus.select(F.explode(F.split(text_col, SPACES)).alias("piece"))
    words = pieces.select(
        F.lower(F.regexp_extract("piece", WORD, 1)).alias("word"),
        (F.regexp_extract("piece", WORD, 2) != "").cast("long").alias("stop"),
    ).filter("word <> ''")
    counts = words.groupBy("word").agg(F.sum("stop").alias("n_stop"), F.count("*").alias("n"))
    totals = words.agg(F.sum("stop").alias("stops"), F.count("*").alias("words"))
    # One row of two numbers.
    both = counts.filter(F.col("n_stop") >= least).join(F.broadcast(totals))
    chance = F.col("stops") / F.col("words")
    plain = F.col("n") - F.col("n_stop")
    by_chance = F.col("n_stop") * F.ln(chance) + plain * F.ln(1 - chance)
    by_rule = F.col("n_stop") * F.ln(F.lit(CERTAIN)) + plain * F.ln(F.lit(1 - CERTAIN))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    score = (
        2 * (by_rule - by_chance)
        * F.exp(-letters)
        * (F.length("word") - letters + 1)
        * F.pow(letters.cast("double"), -plain.cast("double"))
    )
    return both.select("word", "n_stop", plain.alias("n_plain"), score.alias("score"))


def learned_abbreviations(
    corpus: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, least: int = LEAST, most: int = MOST
) -> list[str]:
    """The abbreviations of a corpus, at most ``most``, for ``split_sentences`` and what builds on it."""
    scores = abbreviation_scores(corpus, text_col, least).filter(F.col("score") >= threshold)
    return sorted(r["word"] for r in scores.orderBy(F.desc("score"), "word").limit(most).collect())
