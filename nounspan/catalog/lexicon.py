"""Queries on lexicons, which are derived from the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from nounspan.catalog.base import CTE_DERIVED, cte_derived, derived_lexicon, query, sql_forms
from nounspan.functions.forms import form_columns, split_forms
from nounspan.operators.lexicon import (
    SUFFIX_KEY,
    distinct_phrases,
    distinct_terms,
    form_lists,
    long_forms,
    seed_terms,
    substring_index,
    suffix_table,
    term_range,
)

FORMS = form_columns("plural")
SQL_LONG = " UNION ALL ".join(
    f"SELECT row_no, english, '{c}' AS form_type, {c} AS cell FROM dlex" for c in FORMS
)


@query(
    "p2_term_range",
    f"""WITH {CTE_DERIVED} SELECT row_no, english FROM (SELECT *,
    row_number() OVER (ORDER BY row_no) - 1 AS pos FROM dlex) WHERE pos >= 40 AND pos < 200""",
)
def p2(spark, sf):
    return term_range(derived_lexicon(spark, sf), 40, 200).select("row_no", "english")


@query("p19_form_columns", f"WITH {CTE_DERIVED} {SQL_LONG}")
def p19(spark, sf):
    return long_forms(derived_lexicon(spark, sf))


@query(
    "p20_split_forms",
    f"""WITH {CTE_DERIVED}, cells AS ({SQL_LONG}), parts AS (SELECT row_no, form_type,
    {sql_forms('cell')} AS f FROM cells) SELECT row_no, form_type,
    unnest(range(len(f)))::INTEGER AS pos, unnest(f) AS form FROM parts""",
)
def p20(spark, sf):
    return long_forms(derived_lexicon(spark, sf)).select(
        "row_no", "form_type", F.posexplode(split_forms(F.col("cell"))).alias("pos", "form")
    )


@query(
    "p20_form_lists",
    f"WITH {CTE_DERIVED} SELECT row_no, "
    + ", ".join(f"array_to_string({sql_forms(c)}, '|') AS {c}" for c in FORMS)
    + " FROM dlex",
)
def p20_lists(spark, sf):
    return form_lists(derived_lexicon(spark, sf)).select(
        "row_no", *[F.array_join(c, "|").alias(c) for c in FORMS]
    )


@query(
    "set2_distinct_terms",
    f"""WITH {CTE_DERIVED} SELECT rtrim(regexp_replace(english, '\\A[^ ]* ?', ''), '; ') AS term,
    min(row_no) AS row_no FROM dlex GROUP BY 1""",
)
def set2(spark, sf):
    return distinct_terms(seed_terms(derived_lexicon(spark, sf))).select("term", "row_no")


@query(
    "j4_substring_index",
    f"""WITH {cte_derived('benchmark', "''")}, ph AS (SELECT row_no, lower(english) AS p FROM dlex),
    st AS (SELECT row_no, p, unnest(range(1, len(p) + 1)) AS a FROM ph),
    pc AS (SELECT row_no, p, a, unnest(range(0, len(p) - a + 2)) AS n FROM st)
    SELECT substr(p, a, n) AS piece, min(row_no) AS row_no FROM pc GROUP BY 1""",
)
def j4_index(spark, sf):
    # All substrings are kept for small lexicons only: here the words of the benchmark.
    return substring_index(derived_lexicon(spark, sf, "benchmark"))


@query(
    "j4_suffix_table",
    f"""WITH {CTE_DERIVED}, ph AS (SELECT lower(english) AS p, min(row_no) AS row_no FROM dlex GROUP BY 1),
    st AS (SELECT row_no, p, unnest(range(1, length(p) + 1))::INTEGER AS "at" FROM ph)
    SELECT row_no, "at", substr(p, "at", {SUFFIX_KEY}) AS key FROM st""",
)
def j4_suffixes(spark, sf):
    return suffix_table(distinct_phrases(derived_lexicon(spark, sf)))
