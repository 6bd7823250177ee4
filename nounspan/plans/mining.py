"""Mine passages for seed nouns, merge and clean sample sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nounspan.operators.bottom_k import KeySample
from nounspan.operators.concordance import concordance, filter_pos, own_sentence, term_stats
from nounspan.operators.inference import with_pos
from nounspan.operators.lexicon import distinct_terms, seed_terms, term_range
from nounspan.operators.relevance import score_passages
from nounspan.operators.samples import merge_samples, prepare_counted
from nounspan.operators.sampling import (
    nest_samples,
    sample_per_key,
    weighted_sample_per_key,
)
from nounspan.session import write_out
from nounspan.sources.readers import load_corpus, read_lexicon, read_samples
from nounspan.sources.writers import write_table
from nounspan.streaming.resume import append_pending

ROW_ID = ["doc_id", "sent_pos", "token_pos"]


def find_matches(
    corpus: DataFrame,
    terms: DataFrame,
    context_before: int = 3,
    mode: str = "token",
    pos_lexicon: DataFrame | None = None,
    make_tagger: Callable | None = None,
    tags: tuple[str, ...] = ("NOUN", "PROPN"),
    scorer: PipelineModel | None = None,
    distinct: bool = False,
    abbreviations: Sequence[str] = (),
) -> DataFrame:
    """Matches of all terms in one pass, of the wanted parts of speech, with scores if there is a scorer."""
    matches = concordance(
        corpus,
        terms,
        context_before=context_before,
        mode=mode,
        with_sentences=make_tagger is not None,
        abbreviations=abbreviations,
    )
    if pos_lexicon is not None:
        matches = filter_pos(matches, pos_lexicon, tags)
    if make_tagger is not None:
        # A token is tagged where it stands in its sentence.
        matches = matches.withColumn("_sentence", own_sentence(context_before))
        matches = with_pos(matches.drop("sentences"), make_tagger, "_sentence", place="token_pos")
        matches = matches.filter(F.col("pos").isin(*tags)).drop("pos", "_sentence")
    if distinct:
        # The first occurrence stands for all equal passages of a term.
        matches = matches.groupBy("term", "passage").agg(
            F.min(F.struct(*ROW_ID)).alias("_at")
        ).select("term", "_at.*", "passage")
    return matches if scorer is None else score_passages(matches, scorer, "passage")


def mine(
    corpus: DataFrame, terms: DataFrame, n_samples: int = 3, seed: int = 42, scorer: PipelineModel | None = None, **options
) -> DataFrame:
    """Sample records ``term, total_matches, total_selected, selected`` for all terms.

    The matches are stored once, because both the counts and the sample are
    drawn from them.  ``options`` are those of ``find_matches``.
    """
    matches = write_out(find_matches(corpus, terms, scorer=scorer, **options), "matches")
    if scorer is None:
        chosen = sample_per_key(matches, "term", n_samples, seed, ROW_ID)
    else:
        chosen = weighted_sample_per_key(matches, "term", n_samples, "score", seed, ROW_ID)
    return nest_samples(term_stats(terms, matches, n_samples), chosen)


def mine_part(
    corpus: DataFrame, terms: DataFrame, n_samples: int = 3, seed: int = 42, scorer: PipelineModel | None = None, **options
) -> KeySample:
    """The mergeable sample of a part of a corpus, to be stored and merged with others.

    Passages that are to count once (``distinct``) do so within a part.
    """
    matches = find_matches(corpus, terms, scorer=scorer, **options)
    return KeySample.draw(matches, "term", n_samples, seed, ROW_ID, None if scorer is None else "score")


def merge_mined(terms: DataFrame, parts: list[KeySample], n_samples: int | None = None) -> DataFrame:
    """The sample records that mining all parts at once would have given."""
    whole = KeySample.merge(parts, n_samples)
    found = F.coalesce(F.col("total"), F.lit(0))
    stats = terms.select("term").join(whole.totals, "term", "left").select(
        "term",
        found.cast("int").alias("total_matches"),
        F.least(found, F.lit(whole.n)).cast("int").alias("total_selected"),
    )
    return nest_samples(stats, whole.ranked())


def run_mining(
    spark: SparkSession,
    lexicon_path: str,
    corpus_name: str,
    corpus_path: str,
    output_path: str,
    slice_of_terms: tuple[int, int] | None = None,
    remove_article: bool = True,
    commits: int = 1,
    **options,
) -> int:
    """Mine a stored corpus; a second run only adds terms that are still missing.

    The terms are stored in ``commits`` portions, each with a pass over the
    corpus.  Returns the number of terms that were added.
    """
    lexicon = read_lexicon(spark, lexicon_path)
    if slice_of_terms:
        lexicon = term_range(lexicon, *slice_of_terms)
    terms = distinct_terms(seed_terms(lexicon, remove_article))
    corpus = load_corpus(spark, corpus_name, corpus_path)
    return append_pending(terms, output_path, lambda todo: mine(corpus, todo, **options), commits)


def run_preparation(
    spark: SparkSession, sample_paths: list[str], output_path: str, max_tokens: int = 256
) -> dict[str, int]:
    """Merge sample sets, later ones win, and write the clean passage table.

    Returns the seeds and passages before and after each filter.
    """
    merged = merge_samples(*[read_samples(spark, p) for p in sample_paths])
    passages, counts = prepare_counted(merged, max_tokens)
    write_table(passages, output_path, "csv", sep="\t")
    return counts
