"""Lexicon jobs: seed terms, slices, long form, substring index, plurals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nounspan.functions.forms import form_columns, split_forms
from nounspan.functions.inflect import pluralise
from nounspan.functions.text import strip_article, tokens
from nounspan.operators.ids import with_rid
from nounspan.session import write_out

# Characters by which a suffix is found; longer seeds are checked in the phrase.
SUFFIX_KEY = 6
# The same where pieces are looked up: of long keys few suffixes share one, however many there are.
LOOKUP_KEY = 8


def seed_terms(lexicon: DataFrame, remove_article: bool = True) -> DataFrame:
    """``row_no, term, term_tokens``: the noun as written, and as it is matched.

    The article is dropped and a trailing ``;`` is taken off.
    """
    noun = strip_article(F.col("english")) if remove_article else F.col("english")
    term = F.regexp_replace(noun, r"[; ]+\z", "")
    return lexicon.select("row_no", term.alias("term"), tokens(term).alias("term_tokens"))


def term_range(lexicon: DataFrame, left: int, right: int) -> DataFrame:
    """Rows at positions ``[left, right)`` of the file order."""
    at = F.col("_pos")
    return with_rid(lexicon, ["row_no"], "_pos").filter((at >= left) & (at < right)).drop("_pos")


def distinct_terms(terms: DataFrame) -> DataFrame:
    """A repeated term counts once, at its first row."""
    return terms.groupBy("term").agg(
        F.min("row_no").alias("row_no"), F.first("term_tokens").alias("term_tokens")
    )


def long_forms(lexicon: DataFrame, number: str = "plural") -> DataFrame:
    """One row per lexicon row and form type, with the cell as it stands."""
    return lexicon.unpivot(
        ["row_no", "english"], list(form_columns(number)), "form_type", "cell"
    )


def form_lists(lexicon: DataFrame, number: str = "plural") -> DataFrame:
    """Lexicon with each form cell as an array of alternatives."""
    return lexicon.select(
        "row_no", "english", *[split_forms(F.col(c)).alias(c) for c in form_columns(number)]
    )


def substring_index(lexicon: DataFrame) -> DataFrame:
    """``(piece, row_no)``: first row whose lower-cased noun phrase contains the piece.

    Looking a seed up as a substring of any phrase becomes an equality join on
    this index.  A phrase of length L yields L(L+1)/2 + 1 pieces, so the index
    grows with the lexicon and never with the data.
    """
    phrase = F.lower("english")
    starts = lexicon.select(
        "row_no",
        phrase.alias("phrase"),
        F.explode(F.sequence(F.lit(1), F.greatest(F.length(phrase), F.lit(1)))).alias("at"),
    )
    lengths = F.sequence(F.lit(0), F.length("phrase") - F.col("at") + 1)
    return (
        starts.select("row_no", "phrase", "at", F.explode(lengths).alias("n"))
        .groupBy(F.substring("phrase", F.col("at"), F.col("n")).alias("piece"))
        .agg(F.min("row_no").alias("row_no"))
    )


def distinct_phrases(lexicon: DataFrame) -> DataFrame:
    """``phrase, row_no``: every lower-cased noun phrase with its first row; null ones drop out."""
    phrase = F.lower("english")
    return lexicon.groupBy(phrase.alias("phrase")).agg(F.min("row_no").alias("row_no")).filter("phrase IS NOT NULL")


def suffix_table(phrases: DataFrame, key_length: int = SUFFIX_KEY) -> DataFrame:
    """``row_no, at, key``: one row per suffix of each phrase, with its first characters.

    As many rows as the phrases have characters, each of bounded size: the
    suffix itself stands in the phrase, from ``at`` (1 for the whole) on.
    """
    starts = F.sequence(F.lit(1), F.length("phrase"))
    return (
        phrases.filter("phrase <> ''")
        .select("row_no", "phrase", F.explode(starts).alias("at"))
        .select("row_no", "at", F.substring("phrase", F.col("at"), F.lit(key_length)).alias("key"))
    )


def first_rows(pieces: DataFrame, phrases: DataFrame, key_length: int = LOOKUP_KEY) -> DataFrame:
    """``piece, row_no``: first row whose phrase contains the piece; others drop out.

    ``pieces`` are distinct.  A piece shorter than the key is a prefix of keys.
    A longer one is cut into keys, one after the other, looked up by the rarest
    of them, wherever in the piece that stands, and compared with the phrase
    there; a piece with a key that no suffix has is in no phrase and goes before.
    """
    suffixes = write_out(suffix_table(phrases, key_length), "suffixes")
    known = write_out(
        suffixes.groupBy("key").agg(F.count("*").alias("count"), F.min("row_no").alias("row_no")), "suffix-keys"
    )
    size = F.length("piece")
    lengths = F.sequence(F.lit(1), F.least(F.length("key"), F.lit(key_length - 1)))
    prefixes = (
        known.select("row_no", "key", F.explode(lengths).alias("_n"))
        .groupBy(F.substring("key", F.lit(1), F.col("_n")).alias("piece"))
        .agg(F.min("row_no").alias("row_no"))
    )
    # The empty piece is in every phrase.
    everywhere = phrases.agg(F.min("row_no").alias("row_no")).select(F.lit("").alias("piece"), "row_no")
    short = pieces.filter(size < key_length).join(
        prefixes.unionByName(everywhere.filter("row_no IS NOT NULL")), "piece"
    )

    counts = known.filter(F.length("key") == key_length).select("key", "count")
    last = size - key_length + 1
    starts = F.array_union(F.sequence(F.lit(1), last, F.lit(key_length)), F.array(last))
    keys = (
        pieces.filter(size >= key_length)
        .select("piece", F.explode(starts).alias("_from"))
        .select("piece", "_from", F.substring("piece", F.col("_from"), F.lit(key_length)).alias("key"))
    )
    rarest = (
        keys.join(counts, "key", "left")
        .groupBy("piece")
        # Count and place in one number: places are below 2^31.
        .agg(F.min(F.shiftleft(F.coalesce("count", F.lit(0)).cast("long"), 31) + F.col("_from")).alias("_r"))
        .select("piece", F.shiftright("_r", 31).alias("n"), F.col("_r").bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("_from"))
        .filter("n > 0")
        .select("piece", "_from", F.substring("piece", F.col("_from"), F.lit(key_length)).alias("key"))
    )
    begins = F.col("at") - F.col("_from") + 1
    found = (
        rarest.join(suffixes, "key")
        .select("piece", "row_no", begins.alias("_at"))
        .filter("_at >= 1")
        .join(phrases, "row_no")
        .filter(F.substring("phrase", F.col("_at"), size) == F.col("piece"))
    )
    return short.unionByName(found.groupBy("piece").agg(F.min("row_no").alias("row_no")))


def pluralise_lexicon(df: DataFrame, column: str, name: str = "plural") -> DataFrame:
    """Add the plural of a noun or of the last word of a phrase."""
    return df.select("*", pluralise(F.col(column)).alias(name))
