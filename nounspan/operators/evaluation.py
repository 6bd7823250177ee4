"""Which gendered forms a translation uses, measured against the form lexicon."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nounspan.functions.forms import comparable, form_columns, form_indicator
from nounspan.functions.prompts import FEMININE, INCLUSIVE, MASCULINE, NEUTRAL, NONE
from nounspan.functions.text import clean_completion, strip_article
from nounspan.operators.lexicon import distinct_phrases, first_rows, form_lists, substring_index
from nounspan.session import MAX_SMALL_ROWS, hinted, small_side, write_out


def few_pieces(lexicon: DataFrame, limit: int = MAX_SMALL_ROWS) -> bool:
    """Whether all substrings of all noun phrases are fewer than ``limit``."""
    size = F.length("english").cast("double")
    pieces = lexicon.agg(F.sum(size * (size + 1) / 2 + 1)).first()[0]
    return (pieces or 0) <= limit


def match_lexicon(
    seeds: DataFrame,
    lexicon: DataFrame,
    number: str = "plural",
    exact: bool = False,
    prepare: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add the form lists of the first lexicon row whose noun phrase contains the seed.

    File order decides, as in a scan from the top.  Only the lexicon side is
    lower-cased, so a seed with a capital finds nothing.  ``exact`` compares
    the whole noun without its article, on both sides in lower case.  An
    unknown seed keeps null lists.  ``prepare`` is applied to every form once,
    in the lexicon.

    Of a small lexicon all substrings are broadcast, so that the seeds never
    move.  In a larger one the distinct seeds are looked up by its suffixes,
    and only the rows that they hit go back to the seeds.
    """
    wanted, many = F.lower("seed_noun") if exact else F.col("seed_noun"), False
    if exact:
        noun = F.regexp_replace(F.lower(strip_article(F.col("english"))), r"[; ]+\z", "")
        index = lexicon.groupBy(noun.alias("piece")).agg(F.min("row_no").alias("row_no"))
        at = hinted(index)
        if at is None:
            at = small_side(index.join(seeds.select(wanted.alias("piece")).distinct(), "piece"))
    elif few_pieces(lexicon):
        at = small_side(substring_index(lexicon))
    else:
        phrases = write_out(distinct_phrases(lexicon), "phrases")
        # No more phrases than rows: many phrases prove that the forms are not small.
        many = phrases.count() > MAX_SMALL_ROWS
        pieces = seeds.select(wanted.alias("piece")).filter("piece IS NOT NULL").distinct()
        # Stored: a table that proves too large for a broadcast is not computed again for the shuffle.
        at = small_side(write_out(first_rows(write_out(pieces, "pieces"), phrases), "first-rows"))
    at = at.withColumnRenamed("row_no", "lexicon_row")
    forms = form_lists(lexicon, number).select(
        F.col("row_no").alias("lexicon_row"),
        *[F.transform(c, lambda f: prepare(f)).alias(c) if prepare else c for c in form_columns(number)],
    )
    return (
        seeds.join(at, wanted == F.col("piece"), "left")
        .drop("piece")
        .join(forms if many else small_side(forms), "lexicon_row", "left")
        .select(*[F.col(f"`{c}`") for c in seeds.columns], "lexicon_row", *form_columns(number))
    )


def form_hits(
    translations: DataFrame,
    lexicon: DataFrame,
    number: str = "plural",
    exact: bool = False,
    whole_word: bool = False,
) -> DataFrame:
    """Translations plus one 0/1 column ``<form>_count`` per form type.

    Translations pass through two broadcast joins and are never shuffled.
    """
    matched = match_lexicon(
        translations, lexicon, number, exact, lambda form: comparable(form, whole_word)
    ).withColumn("_text", comparable(F.col("translation"), whole_word))
    return matched.select(
        *[F.col(f"`{c}`") for c in translations.columns],
        *[
            form_indicator(F.col("_text"), F.col(c)).alias(f"{c}_count")
            for c in form_columns(number)
        ],
    )


# The styles of a translation by the lexicon.
STYLES = {
    "MP": "german_mp",
    "FP": "german_fp",
    "GN": "gender_neutral",
    "GI": "gender_inclusive",
}


def translate_by_lexicon(df: DataFrame, column: str, seed: str, lexicon: DataFrame, style: str) -> DataFrame:
    """Add ``model, translation``: the text in lower case, with the seed's form of a style in its place.

    A translator without a model, as a baseline to compare systems with.  The
    form is the first one of the lexicon row that the seed finds; a blank one
    falls back to the masculine form, and an unknown seed leaves the text as it is.
    """
    masculine, styled = STYLES["MP"], STYLES[style]
    seeds = df.select(F.lower(seed).alias("seed_noun")).distinct()
    forms = match_lexicon(seeds, lexicon).select(
        F.col("seed_noun").alias("_seed"),
        F.lower(F.coalesce(F.get(styled, F.lit(0)), F.get(masculine, F.lit(0)))).alias("_form"),
    )
    text = F.lower(column)
    # A replacement by an empty search string would change nothing, but is not defined.
    told = F.when(
        F.col("_form").isNotNull() & (F.lower(seed) != ""), F.replace(text, F.lower(seed), F.col("_form"))
    ).otherwise(text)
    return df.join(small_side(forms), F.lower(seed) == F.col("_seed"), "left").select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.lit(f"lexicon/{style}").alias("model"),
        clean_completion(told).alias("translation"),
    )


def verdict_by_forms() -> Column:
    """The verdict that follows from the four indicators: the first form type found.

    Inclusive comes before feminine, then neutral, then masculine.
    """
    found = (
        ("gender_inclusive", INCLUSIVE),
        ("german_fp", FEMININE),
        ("gender_neutral", NEUTRAL),
        ("german_mp", MASCULINE),
    )
    verdict = F.lit(NONE)
    for column, word in reversed(found):
        verdict = F.when(F.col(f"{column}_count") == 1, F.lit(word)).otherwise(verdict)
    return verdict


def form_totals(hits: DataFrame, number: str = "plural") -> DataFrame:
    """Sum of every indicator over all rows."""
    return hits.agg(*[F.sum(f"{c}_count").alias(f"{c}_total") for c in form_columns(number)])


def form_report(
    hits: DataFrame, by: tuple[str, ...] = ("model", "corpus"), number: str = "plural"
) -> DataFrame:
    """Totals and rates of every form type per system."""
    columns = form_columns(number)
    return hits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"{c}_count").alias(f"{c}_total") for c in columns],
        *[F.avg(f"{c}_count").alias(f"{c}_rate") for c in columns],
    )


def long_hits(hits: DataFrame, ids: list[str], number: str = "plural") -> DataFrame:
    """Indicators in long form: one row per translation and form type."""
    named = hits.select(*ids, *[F.col(f"{c}_count").alias(c) for c in form_columns(number)])
    return named.unpivot(ids, list(form_columns(number)), "form_type", "hit")


def union_systems(systems: dict[str, DataFrame]) -> DataFrame:
    """Translations of several systems in one table with a ``model`` column."""
    if not systems:
        raise ValueError("no systems to unite")
    parts = [df.withColumn("model", F.lit(model).cast("string")) for model, df in systems.items()]
    return reduce(DataFrame.unionByName, parts)
