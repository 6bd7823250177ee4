"""Queries that measure which gendered forms translations use."""

from __future__ import annotations

from pyspark.sql import functions as F

from nounspan.catalog.base import (
    CTE_DERIVED,
    CTE_LEX,
    CTE_SENT,
    CTE_TRANSLATIONS,
    documents,
    derived_lexicon,
    lexicon,
    query,
    sql_forms,
    sql_tokens,
    table,
    translations,
)
from nounspan.functions.forms import form_columns
from nounspan.functions.text import tokens
from nounspan.operators.annotations import common_annotations
from nounspan.operators.concordance import sentence_table
from nounspan.operators.evaluation import (
    form_hits,
    form_report,
    form_totals,
    long_hits,
    match_lexicon,
    union_systems,
)
from nounspan.session import write_out

FORMS = form_columns("plural")

# First lexicon row per seed, by a scan in file order.
CTE_FIRST = (
    f"{CTE_TRANSLATIONS}, {CTE_LEX}, fm AS (SELECT s.seed_noun, min(l.row_no) AS row_no "
    "FROM (SELECT DISTINCT seed_noun FROM tr) s JOIN lex l "
    "ON contains(lower(l.english), s.seed_noun) GROUP BY 1)"
)


def _hit(column: str) -> str:
    return (
        f"coalesce(len(list_filter({sql_forms('l.' + column)}, "
        "lambda f: contains(lower(tr.translation), lower(f)))) > 0, false)::INTEGER "
        f"AS {column}_count"
    )


CTE_FORM_HITS = (
    f"{CTE_FIRST}, fh AS (SELECT tr.*, {', '.join(_hit(c) for c in FORMS)} FROM tr "
    "LEFT JOIN fm ON fm.seed_noun = tr.seed_noun LEFT JOIN lex l ON l.row_no = fm.row_no)"
)
COUNTS = ", ".join(f"{c}_count" for c in FORMS)


def hits(spark, sf):
    return form_hits(translations(spark, sf), lexicon(spark))


@query(
    "j4_match_lexicon",
    f"""WITH {CTE_FIRST} SELECT tr.doc_id, tr.sent_pos, tr.seed_noun, l.row_no AS lexicon_row,
    {', '.join(f"array_to_string(CASE WHEN l.row_no IS NOT NULL THEN {sql_forms('l.' + c)} END, '|') AS {c}" for c in FORMS)}
    FROM tr LEFT JOIN fm ON fm.seed_noun = tr.seed_noun LEFT JOIN lex l ON l.row_no = fm.row_no""",
)
def j4(spark, sf):
    matched = match_lexicon(translations(spark, sf), lexicon(spark))
    return matched.select(
        "doc_id", "sent_pos", "seed_noun", "lexicon_row",
        *[F.array_join(c, "|").alias(c) for c in FORMS],
    )


@query(
    "j4_match_lexicon_large",
    f"""WITH {CTE_DERIVED}, seeds AS (SELECT doc_id, unnest(list_distinct({sql_tokens('text')})) AS seed_noun
    FROM documents), ph AS (SELECT lower(english) AS p, min(row_no) AS row_no FROM dlex GROUP BY 1),
    st AS (SELECT row_no, p, unnest(range(1, length(p) + 1)) AS a FROM ph),
    pc AS (SELECT row_no, p, a, unnest(range(1, length(p) - a + 2)) AS n FROM st),
    fm AS (SELECT substr(p, a, n) AS seed_noun, min(row_no) AS row_no FROM pc GROUP BY 1)
    SELECT s.doc_id, s.seed_noun, fm.row_no AS lexicon_row FROM seeds s LEFT JOIN fm USING (seed_noun)""",
)
def j4_large(spark, sf):
    # Every word of every text is a seed, and the lexicon holds every word: the suffix lookup.
    words = F.explode(F.array_distinct(tokens(F.col("text")))).alias("seed_noun")
    # Stored once, as lexicons are.
    lex = write_out(derived_lexicon(spark, sf), "lexicon")
    matched = match_lexicon(documents(spark, sf).select("doc_id", words), lex)
    return matched.select("doc_id", "seed_noun", "lexicon_row")


@query(
    "j4_match_lexicon_exact",
    f"""WITH {CTE_TRANSLATIONS}, {CTE_LEX}, fm AS (SELECT rtrim(substr(lower(english), 5), '; ') AS noun,
    min(row_no) AS row_no FROM lex GROUP BY 1) SELECT tr.doc_id, tr.sent_pos, fm.row_no AS lexicon_row
    FROM tr LEFT JOIN fm ON fm.noun = lower(tr.seed_noun)""",
)
def j4_exact(spark, sf):
    matched = match_lexicon(translations(spark, sf), lexicon(spark), exact=True)
    return matched.select("doc_id", "sent_pos", "lexicon_row")


@query(
    "p21_form_hits",
    f"""WITH {CTE_FORM_HITS} SELECT doc_id, sent_pos, model, corpus, seed_noun, translation,
    {COUNTS} FROM fh""",
)
def p21(spark, sf):
    return hits(spark, sf)


def _word_hit(column: str) -> str:
    padded = f"' ' || array_to_string({sql_tokens('tr.translation')}, ' ') || ' '"
    form = f"' ' || array_to_string({sql_tokens('f')}, ' ') || ' '"
    return (
        f"coalesce(len(list_filter({sql_forms('l.' + column)}, "
        f"lambda f: contains({padded}, {form}))) > 0, false)::INTEGER AS {column}_count"
    )


@query(
    "p21_form_hits_whole_word",
    f"""WITH {CTE_FIRST} SELECT tr.doc_id, tr.sent_pos, {', '.join(_word_hit(c) for c in FORMS)}
    FROM tr LEFT JOIN fm ON fm.seed_noun = tr.seed_noun LEFT JOIN lex l ON l.row_no = fm.row_no""",
)
def p21_words(spark, sf):
    found = form_hits(translations(spark, sf), lexicon(spark), whole_word=True)
    return found.select("doc_id", "sent_pos", *[f"{c}_count" for c in FORMS])


@query(
    "p21_long_hits",
    f"WITH {CTE_FORM_HITS} "
    + " UNION ALL ".join(
        f"SELECT doc_id, sent_pos, model, seed_noun, '{c}' AS form_type, {c}_count AS hit FROM fh"
        for c in FORMS
    ),
)
def p21_long(spark, sf):
    return long_hits(hits(spark, sf), ["doc_id", "sent_pos", "model", "seed_noun"])


@query(
    "a2_form_totals",
    f"WITH {CTE_FORM_HITS} SELECT "
    + ", ".join(f"sum({c}_count)::BIGINT AS {c}_total" for c in FORMS)
    + " FROM fh",
)
def a2(spark, sf):
    return form_totals(hits(spark, sf))


@query(
    "a3_form_report",
    f"WITH {CTE_FORM_HITS} SELECT model, corpus, count(*) AS n, "
    + ", ".join(f"sum({c}_count)::BIGINT AS {c}_total" for c in FORMS)
    + ", "
    + ", ".join(f"round(avg({c}_count), 6) AS {c}_rate" for c in FORMS)
    + " FROM fh GROUP BY model, corpus",
)
def a3(spark, sf):
    report = form_report(hits(spark, sf))
    rates = [f"{c}_rate" for c in FORMS]
    return report.select(
        *[c for c in report.columns if c not in rates], *[F.round(r, 6).alias(r) for r in rates]
    )


@query(
    "set3_union_systems",
    f"WITH {CTE_SENT} SELECT doc_id, sent_pos, sentence, lang AS model FROM sent",
)
def set3(spark, sf):
    # A system for every language that occurs; their number does not grow with the table.
    names = [r["lang"] for r in table(spark, sf, "documents").select("lang").distinct().collect()]
    return union_systems(
        {
            lang: sentence_table(documents(spark, sf, where=F.col("lang").eqNullSafe(lang)))
            for lang in names
        }
    )


@query(
    "j10_common_annotations",
    """WITH a AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'y' END AS label FROM labels),
    b AS (SELECT doc_id AS id, CASE WHEN toxic = 0 THEN 'y' END AS label FROM labels)
    SELECT a.id, a.label FROM a JOIN b ON a.id = b.id
    WHERE a.label IS NOT NULL AND b.label IS NOT NULL""",
)
def j10(spark, sf):
    # Two systems: one has its good rows annotated, the other its harmless rows.
    rows = table(spark, sf, "labels")
    a = rows.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "y").alias("label"))
    b = rows.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 0, "y").alias("label"))
    return common_annotations(a, b)
