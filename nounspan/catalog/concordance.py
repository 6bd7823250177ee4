"""Queries on the corpus: finding terms in context."""

from __future__ import annotations

from pyspark.sql import functions as F

from nounspan.catalog.base import (
    CTE_LONG_TERMS,
    CTE_SENT,
    CTE_TERMS,
    POS_ROWS,
    _values,
    cte_hits,
    documents,
    long_terms,
    query,
    sql_sentences,
    sql_strip,
    sql_tokens,
    terms,
)
from nounspan.operators.concordance import (
    concordance,
    filter_pos,
    sentences_with_terms,
    term_stats,
    with_any_term,
)
from nounspan.operators.relevance import attach_scores
from nounspan.sources.readers import corpus_lines

COLUMNS = "term, doc_id, sent_pos, token_pos, passage"


def hits(spark, sf, **options):
    return concordance(documents(spark, sf), terms(spark), **options)


@query(
    "p4_with_any_term",
    f"""WITH {CTE_TERMS} SELECT doc_id, n_chars FROM documents
    WHERE list_has_any({sql_tokens('text')}, (SELECT list(DISTINCT w[1]) FROM terms))""",
)
def p4(spark, sf):
    docs = documents(spark, sf, "doc_id", "text", "n_chars")
    return with_any_term(docs, terms(spark)).select("doc_id", "n_chars")


@query(
    "p5_sentences_with_terms",
    f"""WITH {CTE_SENT}, {CTE_TERMS} SELECT doc_id, sent_pos, sentence FROM sent
    WHERE list_has_any({sql_tokens('sentence')}, (SELECT list(DISTINCT w[1]) FROM terms))""",
)
def p5(spark, sf):
    return sentences_with_terms(documents(spark, sf), terms(spark))


@query(
    "p4_with_any_term_large",
    f"""WITH {CTE_LONG_TERMS}, dw AS (SELECT doc_id, n_chars, unnest({sql_tokens('text')}) AS w FROM documents)
    SELECT DISTINCT doc_id, n_chars FROM dw WHERE w IN (SELECT term FROM terms)""",
)
def p4_large(spark, sf):
    docs = documents(spark, sf, "doc_id", "text", "n_chars")
    return with_any_term(docs, long_terms(spark, sf)).select("doc_id", "n_chars")


@query(
    "p5_sentences_with_terms_large",
    f"""WITH {CTE_LONG_TERMS}, l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no,
    {sql_strip('unnest(string_split(text, chr(10)))')} AS line FROM documents),
    s AS (SELECT doc_id, line_no, {sql_sentences('line')} AS s FROM l),
    x AS (SELECT doc_id, line_no, unnest(range(len(s)))::INTEGER AS sent_pos, unnest(s) AS sentence FROM s),
    w AS (SELECT doc_id, line_no, sent_pos, unnest({sql_tokens('sentence')}) AS w FROM x),
    h AS (SELECT DISTINCT doc_id, line_no, sent_pos FROM w WHERE w IN (SELECT term FROM terms))
    SELECT doc_id, sent_pos, sentence FROM x JOIN h USING (doc_id, line_no, sent_pos)""",
)
def p5_large(spark, sf):
    # A line is a document, so several share an id.
    lines = corpus_lines(documents(spark, sf)).select("doc_id", "text")
    return sentences_with_terms(lines, long_terms(spark, sf))


@query(
    "j1_concordance_large",
    f"WITH {cte_hits(before=1, after=0, terms=CTE_LONG_TERMS)} SELECT {COLUMNS} FROM kept",
)
def j1_large(spark, sf):
    return concordance(documents(spark, sf), long_terms(spark, sf), 1, 0, max_terms=2_000)


@query(
    "p6_filter_pos",
    f"""WITH {cte_hits(sizes='= 1')}, tag AS (SELECT * FROM (VALUES {_values(POS_ROWS)}) AS v(token, pos))
    SELECT {COLUMNS} FROM kept
    WHERE lower(term) IN (SELECT token FROM tag WHERE pos IN ('NOUN', 'PROPN'))""",
)
def p6(spark, sf):
    tags = spark.createDataFrame(POS_ROWS, "token string, pos string")
    return filter_pos(hits(spark, sf), tags)


@query("j1_concordance", f"WITH {cte_hits(sizes='= 1')} SELECT {COLUMNS} FROM kept")
def j1(spark, sf):
    return hits(spark, sf, mode="token")


@query("j2_concordance_phrase", f"WITH {cte_hits(sizes='> 1')} SELECT {COLUMNS} FROM kept")
def j2(spark, sf):
    return hits(spark, sf, mode="phrase")


@query("j2_concordance_all", f"WITH {cte_hits(before=3)} SELECT {COLUMNS} FROM kept")
def j2_all(spark, sf):
    return hits(spark, sf, mode="all", context_before=3)


@query("j2_concordance_shuffled", f"WITH {cte_hits()} SELECT {COLUMNS} FROM kept")
def j2_shuffled(spark, sf):
    # The path of a term list that is too large to broadcast.
    return hits(spark, sf, mode="all", max_terms=0)


@query(
    "j3_attach_scores",
    f"""WITH {cte_hits()} SELECT term, doc_id, sent_pos, token_pos,
    greatest((length(passage) - 400) / 100.0, 0.0)::DOUBLE AS score FROM kept""",
)
def j3(spark, sf):
    scored = attach_scores(hits(spark, sf, mode="all"), (F.length("passage") - 400) / 100.0)
    return scored.select("term", "doc_id", "sent_pos", "token_pos", "score")


@query(
    "a1_term_stats",
    f"""WITH {cte_hits()} SELECT t.term, count(k.term)::INTEGER AS total_matches,
    least(count(k.term), 5)::INTEGER AS total_selected
    FROM terms t LEFT JOIN kept k ON k.term = t.term GROUP BY t.term""",
)
def a1(spark, sf):
    return term_stats(terms(spark), hits(spark, sf, mode="all"), 5)
