"""Gendered forms: multi-value cells and form indicators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nounspan.functions.text import strip, tokens

# Column names of the two lexicon shapes.
PLURAL_FORMS = ("german_mp", "german_fp")
SINGULAR_FORMS = ("german_ms", "german_fs")
FAIR_FORMS = ("gender_neutral", "gender_inclusive")


def form_columns(number: str = "plural") -> tuple[str, ...]:
    """Form columns for a grammatical number, or for a path that names it."""
    return (PLURAL_FORMS if "plural" in number else SINGULAR_FORMS) + FAIR_FORMS


def split_forms(cell: Column) -> Column:
    """Alternatives of a ``;`` cell, trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), ";"), lambda form: strip(form))
    return F.array_remove(parts, "")


def comparable(text: Column, whole_word: bool = False) -> Column:
    """Text or form as it is compared: lower-cased, or as a padded run of tokens."""
    if not whole_word:
        return F.lower(text)
    padded = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    return F.nullif(padded, F.lit("  "))


def form_indicator(text: Column, forms: Column) -> Column:
    """1 if any form occurs in the text, else 0; both in comparable form.

    A form counts wherever it is a substring, so a masculine form also counts
    inside a feminine one, unless both sides are padded runs of tokens.
    """
    found = F.exists(forms, lambda form: F.contains(text, form))
    return F.coalesce(found, F.lit(False)).cast("int")
