"""Evaluate translations by the form lexicon or by a judge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nounspan.operators.evaluation import form_hits, form_report
from nounspan.operators.inference import CallPolicy, judge
from nounspan.operators.observed import Observed
from nounspan.session import write_out
from nounspan.sources.readers import read_annotations, read_lexicon, read_translations
from nounspan.sources.writers import write_table


def evaluate_forms(
    translations: DataFrame, lexicon: DataFrame, by: tuple[str, ...], number: str = "plural", **options
) -> tuple[DataFrame, DataFrame]:
    """Indicator rows and the report per system."""
    hits = form_hits(translations, lexicon, number, **options)
    return hits, form_report(hits, by, number)


def run_form_evaluation(
    spark: SparkSession,
    lexicon_path: str,
    translations_path: str,
    output_path: str,
    number: str | None = None,
    by: tuple[str, ...] = ("model", "corpus"),
) -> DataFrame:
    """Write indicator rows for all systems at once and return the report.

    The grammatical number is taken from the lexicon path unless given.
    Systems and corpora are folders ``model=.../corpus=...`` of the input.
    """
    lexicon = read_lexicon(spark, lexicon_path)
    translations = read_translations(spark, translations_path)
    number = number or ("plural" if "plural" in lexicon_path else "singular")
    present = tuple(c for c in by if c in translations.columns)
    hits = write_out(form_hits(translations, lexicon, number), "hits")
    write_table(hits, output_path, "csv", partition_by=present)
    return form_report(hits, present, number)


def run_judging(
    spark: SparkSession,
    annotations_path: str,
    output_path: str,
    make_judge: Callable,
    policy: CallPolicy | None = None,
) -> dict[str, int]:
    """Judge the rows to keep of an annotated table; returns rows, judged ones and failures."""
    judged = judge(read_annotations(spark, annotations_path), make_judge, policy=policy)
    seen = Observed(
        judged,
        rows=F.count(F.lit(1)),
        judged=F.count_if(F.col("to_keep") & F.col("error").isNull()),
        failed=F.count(F.col("error")),
    )
    write_table(seen.df, output_path, "csv")
    return seen.get()
