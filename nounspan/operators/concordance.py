"""Concordance: every term in every document, in one pass over the corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nounspan.functions.bloom import BloomFilter
from nounspan.functions.text import (
    between_tokens,
    context_window,
    has_any_token,
    max_lines,
    ngram_at,
    split_sentences,
    tokens,
)
from nounspan.session import MAX_SMALL_ROWS, pinned, small_rows, small_side, small_table

# A term list up to this size is also written into the document filter.
MAX_FILTER_TERMS = 2_000


def first_tokens(terms: DataFrame, limit: int = MAX_FILTER_TERMS) -> list[str] | None:
    """Distinct first tokens of the terms, or None if there are too many."""
    firsts = terms.select(F.get("term_tokens", F.lit(0)).alias("t")).filter("t is not null")
    rows = small_rows(firsts.distinct(), limit)
    return None if rows is None else sorted(r["t"] for r in rows)


def first_token_filter(terms: DataFrame) -> BloomFilter:
    """Bounded filter for a term list of any length: most tokens of a corpus start no term."""
    return BloomFilter(terms.select(F.get("term_tokens", F.lit(0)).alias("t")).filter("t IS NOT NULL"), ["t"])


def with_text_key(corpus: DataFrame) -> DataFrame:
    """Add ``_text``, a hash: several lines may share a document's id, and an id may be null."""
    return corpus.withColumn("_text", F.xxhash64("text"))


def same_place(*columns: str) -> Column:
    """Rows ``l`` and ``r`` of one text, and of equal places in it; a null id equals a null id."""
    met = F.expr("l._text = r._text AND l.doc_id <=> r.doc_id")
    for c in columns:
        met = met & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    return met


def places_of_first_tokens(words: DataFrame, terms: DataFrame, *place: str) -> DataFrame:
    """Distinct places whose token ``_w`` starts a term; few others reach the shuffle."""
    firsts = terms.select(F.get("term_tokens", F.lit(0)).alias("_w")).distinct()
    near = words.filter(first_token_filter(terms).may_hold("_w"))
    return near.join(firsts, "_w", "left_semi").select("doc_id", "_text", *place).distinct()


def with_any_term(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """Documents that hold the first token of some term, however many terms there are.

    A list too long for a literal is joined on the distinct tokens of each
    document that pass a Bloom filter; only ids, a hash of the text and such
    tokens are shuffled for that.
    """
    wanted = first_tokens(terms)
    if wanted is None:
        keyed = with_text_key(corpus)
        words = keyed.select("doc_id", "_text", F.explode(F.array_distinct(tokens(F.col("text")))).alias("_w"))
        held = places_of_first_tokens(words, terms)
        return keyed.alias("l").join(held.alias("r"), same_place(), "left_semi").drop("_text")
    if not wanted:
        return corpus.filter(F.lit(False))
    return corpus.filter(has_any_token(F.col("text"), wanted))


def pick_mode(terms: DataFrame, mode: str) -> DataFrame:
    """Single-token terms, phrases of several tokens, or all of them."""
    size = F.size("term_tokens")
    if mode == "token":
        return terms.filter(size == 1)
    if mode == "phrase":
        return terms.filter(size > 1)
    if mode == "all":
        return terms.filter(size >= 1)
    raise ValueError(f"mode {mode!r} is none of token, phrase, all")


def only_if_held(sentences: Column, wanted: list[str]) -> Column:
    """The sentences of a text if it holds a wanted token, else null.

    Texts without any term are not cut into sentences.  As a condition on the
    value, not a filter, the test stays above the exchange that spreads a
    narrow scan; a list that is too long for a literal is left to the join.
    """
    if len(wanted) > MAX_FILTER_TERMS:
        return sentences
    held = has_any_token(F.col("text"), wanted) if wanted else F.lit(False)
    return F.when(held, sentences)


def sentence_table(
    corpus: DataFrame, *keep: str, only: list[str] | None = None, abbreviations: Sequence[str] = ()
) -> DataFrame:
    """One row per sentence: ``doc_id, sent_pos, sentence`` and the columns to keep."""
    parts = split_sentences(F.col("text"), abbreviations)
    if only is not None:
        parts = only_if_held(parts, only)
    # The outer explode keeps the optimizer from splitting a text twice.
    return corpus.select(
        "doc_id", *keep, F.posexplode_outer(parts).alias("sent_pos", "sentence")
    ).filter("sentence is not null")


def sentence_passages(sentences: DataFrame, before: int = 2, after: int = 1) -> DataFrame:
    """Add the passage around each sentence of a stored sentence table.

    Only for tables that no longer hold whole documents; from documents, the
    passage is cut from the sentence array without a shuffle.
    """
    around = Window.partitionBy("doc_id").orderBy("sent_pos").rowsBetween(-before, after)
    return sentences.withColumn(
        "passage", F.array_join(F.collect_list("sentence").over(around), " ")
    )


def hits_by_broadcast(
    corpus: DataFrame, keyed: DataFrame, wanted: list[str] | None, abbreviations: Sequence[str] = ()
) -> DataFrame:
    """Tokens that start a term, with the sentences around them.

    The sentence array of a document travels by reference within one stage;
    nothing is copied for tokens that are no hit.
    """
    sentences = split_sentences(F.col("text"), abbreviations)
    if wanted is not None:
        sentences = only_if_held(sentences, wanted)
    # The outer explodes keep the optimizer from deriving a filter that would
    # split every text a second time; the join drops their null rows.
    words = (
        corpus.select("doc_id", sentences.alias("_sents"))
        .select("doc_id", "_sents", F.posexplode_outer("_sents").alias("sent_pos", "_sent"))
        .select("doc_id", "_sents", "sent_pos", tokens(F.col("_sent")).alias("_words"))
        .select(
            "doc_id",
            "_sents",
            "sent_pos",
            "_words",
            F.posexplode_outer("_words").alias("token_pos", "_word"),
        )
    )
    return words.join(keyed, F.col("_word") == F.col("_first"))


def hits_by_shuffle(corpus: DataFrame, keyed: DataFrame, abbreviations: Sequence[str] = ()) -> DataFrame:
    """The same for a term list that is too large to broadcast.

    Only places and tokens are shuffled to the terms, and only those tokens
    that a Bloom filter of the first tokens lets through; texts join the hits
    afterwards by document and a hash of the text.  AQE splits frequent tokens.
    """
    keyed_texts = with_text_key(corpus)
    words = sentence_table(keyed_texts, "_text", abbreviations=abbreviations).select(
        "doc_id", "_text", "sent_pos", tokens(F.col("sentence")).alias("_words")
    )
    words = words.select(
        "doc_id", "_text", "sent_pos", F.posexplode_outer("_words").alias("token_pos", "_word")
    ).filter(first_token_filter(keyed).may_hold("_word"))
    found = words.join(keyed, F.col("_word") == F.col("_first"))
    texts = keyed_texts.dropDuplicates(["doc_id", "_text"]).select(
        "doc_id", "_text", split_sentences(F.col("text"), abbreviations).alias("_sents")
    )
    met = found.alias("l").join(texts.alias("r"), same_place())
    return met.select("l.*", "r._sents").withColumn("_words", tokens(F.get("_sents", F.col("sent_pos"))))


def concordance(
    corpus: DataFrame,
    terms: DataFrame,
    context_before: int = 2,
    context_after: int = 1,
    lines: int = 3,
    mode: str = "token",
    prefilter: bool = True,
    with_sentences: bool = False,
    max_terms: int = MAX_SMALL_ROWS,
    abbreviations: Sequence[str] = (),
) -> DataFrame:
    """One row per occurrence of a term, with its passage.

    ``corpus`` is ``(doc_id, text)``, ``terms`` comes from ``distinct_terms``.
    The result is ``term, doc_id, sent_pos, token_pos, passage``; a sentence
    that holds a term twice gives two rows.

    Up to ``max_terms`` terms are broadcast, and documents stream through
    sentences, tokens and a hash join in one stage without a shuffle.  A phrase
    joins on its first token and is then compared in full, with what stands
    between its tokens.  A longer term list
    is joined by a shuffle of bare tokens.  After ``abbreviations`` no sentence
    ends.
    """
    keyed = pick_mode(terms, mode).select(
        "term", "term_tokens", F.get("term_tokens", F.lit(0)).alias("_first")
    )
    content = small_table(keyed, max_terms)
    if content is None:
        hits = hits_by_shuffle(corpus, keyed, abbreviations)
    else:
        wanted = sorted(set(content["_first"].to_pylist())) if prefilter else None
        keyed = F.broadcast(terms.sparkSession.createDataFrame(content, keyed.schema))
        hits = hits_by_broadcast(corpus, keyed, wanted, abbreviations)
    if mode != "token":
        whole = ngram_at(F.col("_words"), F.col("token_pos"), F.size("term_tokens"))
        # As written: the same tokens, and the same characters between them.
        gaps = F.size("term_tokens") - 1
        found = F.slice(
            between_tokens(F.get("_sents", F.col("sent_pos"))), F.col("token_pos") + 2, gaps
        )
        as_written = (gaps == 0) | (found == F.slice(between_tokens(F.col("term")), F.lit(2), gaps))
        hits = hits.filter((whole == F.col("term_tokens")) & as_written)
    # Pinned, or conditions on the passage would move into the join, where a
    # passage is built for every token, and more than once.
    passage = pinned(
        context_window(F.col("_sents"), F.col("sent_pos"), context_before, context_after)
    )
    kept = ["term", "doc_id", "sent_pos", "token_pos", passage.alias("passage")]
    if with_sentences:
        first = F.greatest(F.col("sent_pos") - context_before, F.lit(0))
        kept.append(
            F.slice("_sents", first + 1, F.col("sent_pos") + 1 + context_after - first).alias(
                "sentences"
            )
        )
    return hits.select(*kept).filter(
        max_lines(F.col("passage"), lines) & (F.col("passage") != "")
    )


def own_sentence(context_before: int) -> Column:
    """The sentence of a match, of the ``sentences`` that ``concordance`` cut for it."""
    return F.get("sentences", F.least(F.col("sent_pos"), F.lit(context_before)))


def sentences_with_terms(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """Sentences that hold the first token of some term."""
    wanted = first_tokens(terms)
    if wanted is not None:
        held = has_any_token(F.col("sentence"), wanted) if wanted else F.lit(False)
        return sentence_table(corpus, only=wanted).filter(held)
    # Too many terms for a literal list: a semi join on the tokens that pass a Bloom filter.
    sentences = sentence_table(with_text_key(corpus), "_text")
    words = sentences.select(
        "doc_id", "_text", "sent_pos", F.explode(F.array_distinct(tokens(F.col("sentence")))).alias("_w")
    )
    held = places_of_first_tokens(words, terms, "sent_pos")
    met = sentences.alias("l").join(held.alias("r"), same_place("sent_pos"), "left_semi")
    return met.select("doc_id", "sent_pos", "sentence")


def filter_pos(
    matches: DataFrame,
    pos_lexicon: DataFrame,
    tags: tuple[str, ...] = ("NOUN", "PROPN"),
    token: str = "term",
) -> DataFrame:
    """Matches whose token is listed with one of the tags in ``(token, pos)``."""
    nouns = pos_lexicon.filter(F.col("pos").isin(*tags)).select(
        F.col("token").alias("_noun")
    )
    return matches.join(
        small_side(nouns.distinct()), F.lower(F.col(token)) == F.col("_noun"), "left_semi"
    )


def term_stats(terms: DataFrame, matches: DataFrame, n: int) -> DataFrame:
    """Matches and selection size per term; a term without a match stays, with 0 and 0."""
    counts = matches.groupBy("term").agg(F.count("*").alias("_n"))
    found = F.coalesce(F.col("_n"), F.lit(0))
    return (
        terms.select("term")
        .join(counts, "term", "left")
        .select(
            "term",
            found.cast("int").alias("total_matches"),
            F.least(found, F.lit(n)).cast("int").alias("total_selected"),
        )
    )
