"""Queries on sources and sinks: what is written is what is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from nounspan.catalog.base import (
    CTE_DERIVED,
    CTE_LABELLED,
    CTE_SENT,
    CTE_TRANSLATIONS,
    CTE_TURNS,
    derived_lexicon,
    documents,
    labelled,
    query,
    sql_hash,
    sql_strip,
    table,
    translations,
    turns,
)
from nounspan.catalog.passages import CTE_JUDGE, judge_input
from nounspan.catalog.samples import CTE_SAMPLES, document_samples
from nounspan.operators.relevance import map_labels
from nounspan.plans.relevance import make_splits
from nounspan.session import scratch_path
from nounspan.sources import readers, writers
from nounspan.sources.schemas import LEXICON_HEADERS


@query(
    "s1_read_lexicon",
    f"""WITH {CTE_DERIVED} SELECT row_no AS id, german_mp, german_fp,
    coalesce(gender_neutral, '') AS gender_neutral, gender_inclusive, english, row_no FROM dlex""",
)
def s1(spark, sf):
    headers = {column: header for header, column in LEXICON_HEADERS.items()}
    rows = derived_lexicon(spark, sf).withColumnRenamed("row_no", "id")
    path = scratch_path(spark, "lexicon_plural")
    writers.write_table(
        rows.select(*[F.col(c).alias(headers[c]) for c in rows.columns]), path, "csv"
    )
    return readers.read_lexicon(spark, path)


@query(
    "s2_corpus_lines",
    f"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line_no,
    unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, line_no, {sql_strip('line')} AS text FROM l""",
)
def s2(spark, sf):
    return readers.corpus_lines(documents(spark, sf))


@query(
    "s2_read_lines",
    f"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
    l AS (SELECT doc_id, unnest(range(len(s))) AS line_no, {sql_strip('unnest(s)')} AS text FROM s)
    SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS doc_id, text FROM l""",
)
def s2_files(spark, sf):
    path = scratch_path(spark, "lines")
    documents(spark, sf).orderBy("doc_id").select("text").write.text(path)
    return readers.read_lines(spark, path)


@query("s3_corpus_documents", "SELECT doc_id, text FROM documents")
def s3(spark, sf):
    return readers.corpus_documents(spark, f"{sf}/documents.parquet")


@query(
    "s4_load_corpus",
    """SELECT 'wikipedia' AS corpus, doc_id, -1 AS line_no, length(text)::INTEGER AS n FROM documents
    UNION ALL SELECT 'europarl', row_number() OVER (ORDER BY page_id, line_no) - 1, line_no, n
    FROM (SELECT page_id, unnest(range(len(string_split(html, chr(10)))))::INTEGER AS line_no, length("""
    + sql_strip("unnest(string_split(html, chr(10)))")
    + ")::INTEGER AS n FROM pages)",
)
def s4(spark, sf):
    docs = readers.load_corpus(spark, "wikipedia", f"{sf}/documents.parquet")
    lines = readers.load_corpus(spark, "europarl", f"{sf}/pages.parquet", "html", "page_id")
    n = F.length("text").alias("n")
    return docs.select(F.lit("wikipedia").alias("corpus"), "doc_id", F.lit(-1).alias("line_no"), n).unionByName(
        lines.select(F.lit("europarl").alias("corpus"), "doc_id", "line_no", n)
    )


NESTED_SQL = (
    f"WITH {CTE_SAMPLES} SELECT term, total_matches, total_selected, "
    "array_to_string(selected, ' || ') AS selected FROM smp"
)


def _flat(df):
    return df.select(
        "term", "total_matches", "total_selected", F.array_join("selected", " || ").alias("selected")
    )


@query("s5_read_samples", NESTED_SQL)
def s5(spark, sf):
    path = scratch_path(spark, "samples")
    writers.export_samples(document_samples(spark, sf), path)
    return _flat(readers.read_samples(spark, path))


@query("k1_write_samples", NESTED_SQL)
def k1(spark, sf):
    path = scratch_path(spark, "samples")
    writers.write_samples(document_samples(spark, sf), path)
    return _flat(readers.read_samples(spark, path, indent=None))


@query(
    "s6_read_annotations",
    f"""WITH {CTE_JUDGE} SELECT id, coalesce(to_keep, false) AS to_keep, seed_noun,
    translation FROM ji""",
)
def s6(spark, sf):
    path = scratch_path(spark, "annotations")
    rows = judge_input(spark, sf).withColumnRenamed("id", "ID")
    writers.write_table(rows, path, "csv", sep="\t")
    return readers.read_annotations(spark, path)


@query(
    "s7_read_translations",
    f"WITH {CTE_TRANSLATIONS} SELECT doc_id::VARCHAR AS doc_id, sent_pos::VARCHAR AS sent_pos, seed_noun, translation FROM tr",
)
def s7(spark, sf):
    path = scratch_path(spark, "translations")
    rows = translations(spark, sf).select("doc_id", "sent_pos", "seed_noun", "translation")
    writers.write_table(rows.withColumnRenamed("seed_noun", "seed"), path, "csv")
    return readers.read_translations(spark, path)


@query(
    "s7_read_translations_large",
    f"""WITH {CTE_SENT} SELECT doc_id::VARCHAR AS doc_id, source AS seed_noun,
    'line' || chr(10) || '"' || sentence || '"' || chr(10) AS translation FROM sent""",
)
def s7_large(spark, sf):
    # One file, every other cell of which holds quotes and line breaks, read by several tasks.
    path = scratch_path(spark, "translations")
    cell = F.concat(F.lit('line\n"'), F.col("translation"), F.lit('"\n')).alias("translation")
    rows = translations(spark, sf).select("doc_id", F.col("model").alias("seed"), cell)
    writers.write_table(rows.coalesce(1), path, "csv")
    return readers.read_translations(spark, path, large=True)


@query(
    "s8_read_prompts_large",
    f"""WITH {CTE_TURNS} SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS id,
    conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, english AS "English" FROM turns""",
)
def s8_large(spark, sf):
    path = scratch_path(spark, "prompts")
    rows = turns(spark, sf).select("conv_id", "turn", F.col("english").alias("English"))
    writers.write_table(rows.orderBy("conv_id", "turn"), path, "csv")
    return readers.read_prompts(spark, path, large=True)


@query(
    "s8_read_prompts",
    f"""WITH {CTE_TURNS} SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS id,
    conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, english AS "English" FROM turns""",
)
def s8(spark, sf):
    path = scratch_path(spark, "prompts")
    rows = turns(spark, sf).select("conv_id", "turn", F.col("english").alias("English"))
    writers.write_table(rows.orderBy("conv_id", "turn"), path, "csv")
    return readers.read_prompts(spark, path)


@query(
    "s9_read_labelled",
    f"""WITH {CTE_LABELLED} SELECT source, CASE comment WHEN 'n' THEN 0.0 WHEN 'b' THEN 0.5
    WHEN 'y' THEN 1.0 END::DOUBLE AS label FROM labelled""",
)
def s9(spark, sf):
    path = scratch_path(spark, "labelled")
    writers.write_table(map_labels(labelled(spark, sf)), path, "csv")
    return readers.read_labelled(spark, path)


@query(
    "k2_write_table_csv",
    f"WITH {CTE_TRANSLATIONS} SELECT doc_id::VARCHAR AS doc_id, translation, model, corpus FROM tr",
)
def k2_csv(spark, sf):
    path = scratch_path(spark, "table")
    rows = translations(spark, sf).select("doc_id", "translation", "model", "corpus")
    writers.write_table(rows, path, "csv", partition_by=("model", "corpus"))
    return readers.read_csv(spark, path)


@query(
    "k2_write_table_parquet",
    f"WITH {CTE_SENT} SELECT doc_id, sent_pos, sentence, source AS model FROM sent",
)
def k2_parquet(spark, sf):
    path = scratch_path(spark, "table")
    rows = translations(spark, sf).select(
        "doc_id", "sent_pos", F.col("translation").alias("sentence"), "model"
    )
    writers.write_table(rows, path, partition_by=("model",))
    return spark.read.parquet(path)


@query(
    "k3_write_splits",
    f"""WITH {CTE_LABELLED}, r AS (SELECT source, comment, row_number() OVER (PARTITION BY comment
    ORDER BY {sql_hash('doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY comment) AS n
    FROM labelled WHERE comment IS NOT NULL), c AS (SELECT *, round(0.1 * n) AS t FROM r)
    SELECT source, comment, CASE WHEN k <= t THEN 'test' WHEN k <= t + round(0.1 * (n - t))
    THEN 'val' ELSE 'train' END AS split FROM c""",
)
def k3(spark, sf):
    path = scratch_path(spark, "splits")
    splits = make_splits(labelled(spark, sf), ["doc_id"])
    writers.write_splits(splits.select("source", "comment", "split"), path)
    return spark.read.parquet(path)


@query(
    "k5_run_tags",
    """SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)\\z', 1), '(.)\\.[^.]*\\z', '\\1')
    AS base_name, replace(url, '/', '--') AS model_tag, CASE WHEN contains(url, 'europarl')
    THEN 'europarl' ELSE 'wikipedia' END AS corpus_tag FROM pages""",
)
def k5(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return writers.run_tags(pages, "url", "url").drop("url")
