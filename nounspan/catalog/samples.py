"""Queries on sample sets: merge, flatten, regroup, resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from nounspan.catalog.base import (
    CTE_DOCS,
    CTE_LABELLED,
    CTE_TURNS,
    cte_hits,
    documents,
    labelled,
    query,
    sql_tokens,
    table,
    terms,
    turns,
)
from nounspan.catalog.concordance import hits
from nounspan.functions.text import line_count, split_sentences, token_count, tokens
from nounspan.operators.concordance import term_stats
from nounspan.operators.inference import join_completions
from nounspan.operators.relevance import exclude_seen
from nounspan.operators.samples import (
    explode_pairs,
    explode_selected,
    flatten_translations,
    funnel,
    merge_sharded,
    non_empty_seeds,
    prepare_counted,
    prepare_passages,
    regroup_completions,
)
from nounspan.sources.bucketed import write_bucketed
from nounspan.sources.writers import add_model_column, add_model_columns
from nounspan.session import scratch_path, write_out
from nounspan.streaming.portions import PortionTable
from nounspan.streaming.resume import append_pending, pending_terms, stored

MODEL = "org/model-1"


def document_samples(spark, sf):
    """One sample record per document: its sentences, null if there is only one.

    Stored first, as sample sets are.
    """
    s = split_sentences(F.col("text"))
    chosen = documents(spark, sf).select("doc_id", s.alias("s"))
    many = F.size("s") > 1
    n = F.when(many, F.size("s")).otherwise(0)
    records = chosen.select(
        F.format_string("doc %08d", "doc_id").alias("term"),
        n.alias("total_matches"),
        n.alias("total_selected"),
        F.when(many, F.col("s")).alias("selected"),
    )
    return write_out(records, "samples")


CTE_SAMPLES = (
    f"{CTE_DOCS}, smp AS (SELECT 'doc ' || lpad(doc_id::VARCHAR, 8, '0') AS term, "
    "CASE WHEN len(s) > 1 THEN len(s) ELSE 0 END::INTEGER AS total_matches, "
    "CASE WHEN len(s) > 1 THEN len(s) ELSE 0 END::INTEGER AS total_selected, "
    "CASE WHEN len(s) > 1 THEN s END AS selected FROM docs)"
)
CTE_FLAT = (
    f"{CTE_SAMPLES}, flat AS (SELECT term AS seed, unnest(range(len(selected)))::INTEGER AS pos, "
    "unnest(selected) AS text FROM smp WHERE selected IS NOT NULL)"
)


@query(
    "p9_non_empty_seeds",
    f"WITH {CTE_SAMPLES} SELECT term, total_selected FROM smp WHERE total_selected <> 0",
)
def p9(spark, sf):
    return non_empty_seeds(document_samples(spark, sf)).select("term", "total_selected")


def paired_samples(spark, sf):
    """Sentences next to lines of the same document, lists of unequal length."""
    lines = documents(spark, sf).select(
        F.format_string("doc %08d", "doc_id").alias("term"), F.split("text", "\n").alias("translation")
    )
    return document_samples(spark, sf).join(lines, "term")


CTE_PAIRS = (
    f"{CTE_SAMPLES}, ln AS (SELECT 'doc ' || lpad(doc_id::VARCHAR, 8, '0') AS term, "
    "string_split(text, chr(10)) AS translation FROM documents), zp AS (SELECT s.term, s.selected, "
    "l.translation, least(len(s.selected), len(l.translation)) AS n FROM smp s JOIN ln l "
    "ON s.term = l.term WHERE s.selected IS NOT NULL), pairs AS (SELECT term AS seed, "
    "unnest(range(n))::INTEGER AS pos, unnest(list_slice(selected, 1, n)) AS source, "
    "unnest(list_slice(translation, 1, n)) AS translation FROM zp)"
)


@query("j5_explode_pairs", f"WITH {CTE_PAIRS} SELECT seed, pos, source, translation FROM pairs")
def j5(spark, sf):
    return explode_pairs(paired_samples(spark, sf))


@query(
    "j5_flatten_translations",
    f"""WITH {CTE_PAIRS} SELECT row_number() OVER (ORDER BY seed, pos) - 1 AS rid, seed, source,
    translation FROM pairs""",
)
def j5_flat(spark, sf):
    return flatten_translations(paired_samples(spark, sf))


CTE_PROMPTS = f"{CTE_TURNS}, pr AS (SELECT conv_id * 10000 + turn AS id, english, answer FROM turns)"


def prompts(spark, sf):
    return turns(spark, sf).select(
        (F.col("conv_id") * 10000 + F.col("turn")).alias("id"), "english", "answer"
    )


def completions(spark, sf):
    chat = table(spark, sf, "conversations").filter("role = 'assistant'")
    return chat.select(
        (F.col("conv_id") * 10000 + F.col("turn") - 1).alias("id"), F.col("text").alias("completion")
    )


@query(
    "j6_join_completions", f"WITH {CTE_PROMPTS} SELECT id, english, answer AS completion FROM pr"
)
def j6(spark, sf):
    asked = prompts(spark, sf).select("id", "english")
    return join_completions(asked, completions(spark, sf))


@query(
    "j6_join_completions_bucketed", f"WITH {CTE_PROMPTS} SELECT id, english, answer AS completion FROM pr"
)
def j6_bucketed(spark, sf):
    # Both tables are stored in the same buckets of the id, as runs that come back to them do.
    asked = write_bucketed(prompts(spark, sf).select("id", "english"), "id", buckets=8)
    return join_completions(asked, write_bucketed(completions(spark, sf), "id", buckets=8))


@query(
    "k4_add_model_column", f'WITH {CTE_PROMPTS} SELECT id, english, answer AS "org--model-1" FROM pr'
)
def k4(spark, sf):
    asked = prompts(spark, sf).select("id", "english")
    return add_model_column(asked, completions(spark, sf), MODEL)


@query(
    "k4_add_model_columns",
    f"""WITH {CTE_PROMPTS} SELECT id, english, answer AS "org--model-1",
    CASE WHEN answer IS NOT NULL THEN 'DE: ' || answer END AS "model-2" FROM pr""",
)
def k4_many(spark, sf):
    one = completions(spark, sf).withColumn("model", F.lit(MODEL))
    two = one.select("id", F.concat(F.lit("DE: "), "completion").alias("completion"), F.lit("model-2").alias("model"))
    asked = prompts(spark, sf).select("id", "english")
    return add_model_columns(asked, one.unionByName(two), [MODEL, "model-2"])


@query(
    "j7_regroup_completions",
    f"""WITH {CTE_SAMPLES} SELECT term, total_selected, array_to_string(selected, ' || ') AS selected,
    coalesce(array_to_string(list_transform(selected, lambda t: 'DE: ' || t), ' || '), '') AS translation
    FROM smp""",
)
def j7(spark, sf):
    samples = document_samples(spark, sf)
    done = explode_selected(samples).select("seed", "pos", F.concat(F.lit("DE: "), "text").alias("completion"))
    return regroup_completions(samples, done).select(
        "term",
        "total_selected",
        F.array_join("selected", " || ").alias("selected"),
        F.array_join("translation", " || ").alias("translation"),
    )


@query(
    "j7_regroup_completions_bucketed",
    f"""WITH {CTE_SAMPLES} SELECT term, total_selected,
    coalesce(array_to_string(list_transform(selected, lambda t: 'DE: ' || t), ' || '), '') AS translation FROM smp""",
)
def j7_bucketed(spark, sf):
    samples = document_samples(spark, sf)
    done = explode_selected(samples).select("seed", "pos", F.concat(F.lit("DE: "), "text").alias("completion"))
    grouped = regroup_completions(
        write_bucketed(samples, "term", buckets=8), write_bucketed(done, "seed", buckets=8)
    )
    return grouped.select("term", "total_selected", F.array_join("translation", " || ").alias("translation"))


@query(
    "j8_exclude_seen",
    f"""WITH {CTE_FLAT}, seen AS (SELECT string_split(regexp_replace(text,
    '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM benchmark)
    SELECT seed, pos, text FROM flat WHERE text NOT IN (SELECT unnest(s) FROM seen)""",
)
def j8(spark, sf):
    seen = table(spark, sf, "benchmark").select(
        F.explode(split_sentences(F.col("text"))).alias("source")
    )
    return exclude_seen(explode_selected(document_samples(spark, sf)), seen, "text")


@query(
    "j9_pending_terms",
    f"""WITH tk AS (SELECT lang, unnest({sql_tokens('text')}) AS term FROM documents),
    bt AS (SELECT unnest({sql_tokens('text')}) AS term FROM benchmark)
    SELECT DISTINCT term FROM tk WHERE term NOT IN (SELECT term FROM bt)""",
)
def j9(spark, sf):
    words = documents(spark, sf).select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    done = table(spark, sf, "benchmark").select(
        F.explode(tokens(F.col("text"))).alias("term")
    )
    return pending_terms(words, done.distinct())


@query(
    "j9_append_pending",
    f"""WITH tk AS (SELECT lang, unnest({sql_tokens('text')}) AS term FROM documents)
    SELECT term, count(*) AS total_matches FROM tk GROUP BY term""",
)
def j9_append(spark, sf):
    # The first run stores the words of the benchmark in two portions, the second the words that are missing.
    words = documents(spark, sf).select(F.explode(tokens(F.col("text"))).alias("term"))
    counts = words.groupBy("term").agg(F.count("*").alias("total_matches"))
    listed = table(spark, sf, "benchmark").select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    path = scratch_path(spark, "mined-terms")
    append_pending(listed, path, lambda todo: counts.join(todo, "term", "left_semi"), slices=2)
    append_pending(counts.select("term"), path, lambda todo: counts.join(todo, "term", "left_semi"))
    return stored(spark, path)


@query(
    "k2_atomic_portions",
    f"""SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::INTEGER AS n_lines,
    coalesce(len({sql_tokens('text')}), 0)::INTEGER AS n_tokens FROM documents""",
)
def k2_portions(spark, sf):
    # Four portions, written one after the other; the reader opens what the manifests name.
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf).select(
        "doc_id", line_count(text).alias("n_lines"), F.size(tokens(text)).alias("n_tokens")
    )
    grown = PortionTable(spark, scratch_path(spark, "portions"))
    for k in range(4):
        grown.write(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k), f"part-{k}")
    return grown.read()


@query(
    "set1_merge_samples",
    f"""WITH tk AS (SELECT lang, unnest({sql_tokens('text')}) AS term FROM documents),
    ct AS (SELECT lang, term, count(*) AS total_matches FROM tk GROUP BY lang, term)
    SELECT term, arg_max(total_matches, lang) AS total_matches, max(lang) AS shard
    FROM ct GROUP BY term""",
)
def set1(spark, sf):
    # One shard of word counts per language, in alphabetical order, from one scan.
    docs = documents(spark, sf, "lang", "text", "doc_id")
    words = docs.select(F.col("lang").alias("shard"), F.explode(tokens(F.col("text"))).alias("term"))
    counts = words.groupBy("shard", "term").agg(F.count("*").alias("total_matches"))
    return merge_sharded(counts, "shard")


@query(
    "e2_prepare_passages",
    f"""WITH {CTE_FLAT}, k AS (SELECT *, len(string_split(text, ' '))::INTEGER AS token_count
    FROM flat WHERE len(string_split(text, ' ')) <= 20)
    SELECT row_number() OVER (ORDER BY seed, pos) - 1 AS rid, seed, token_count, text FROM k""",
)
def e2(spark, sf):
    return prepare_passages(document_samples(spark, sf), max_tokens=20)


@query(
    "a6_funnel",
    """SELECT lang, count(*) AS total, count(*) FILTER (len(string_split(text, chr(10))) <= 40)
    AS few_lines, count(*) FILTER (len(string_split(text, chr(10))) <= 40
    AND len(string_split(text, ' ')) <= 256) AS few_tokens FROM documents GROUP BY lang""",
)
def a6(spark, sf):
    return funnel(
        documents(spark, sf, "doc_id", "text", "lang"),
        {
            "few_lines": line_count(F.col("text")) <= 40,
            "few_tokens": token_count(F.col("text")) <= 256,
        },
        seed="lang",
    )


@query(
    "a6_observed_preparation",
    f"""WITH {CTE_FLAT}, p AS (SELECT count(*) AS passages,
    count(*) FILTER (len(string_split(text, ' ')) <= 20) AS passages_kept FROM flat)
    SELECT count(*) AS seeds, count(*) FILTER (total_selected <> 0) AS seeds_with_passages,
    any_value(passages) AS passages, any_value(passages_kept) AS passages_kept FROM smp, p""",
)
def a6_observed(spark, sf):
    # Counted by the job that stores the passages.
    _, counts = prepare_counted(document_samples(spark, sf), max_tokens=20)
    names = ["seeds", "seeds_with_passages", "passages", "passages_kept"]
    return spark.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query(
    "a6_funnel_labels",
    f"""WITH {CTE_LABELLED} SELECT count(*) AS total, count(comment) AS commented,
    count(*) FILTER (comment IN ('b', 'y')) AS useful FROM labelled""",
)
def a6_labels(spark, sf):
    return funnel(
        labelled(spark, sf),
        {"commented": F.col("comment").isNotNull(), "useful": F.col("comment").isin("b", "y")},
    )


@query(
    "a1_term_stats_distinct",
    f"""WITH {cte_hits()} SELECT t.term, count(DISTINCT k.passage)::INTEGER AS total_matches,
    least(count(DISTINCT k.passage), 5)::INTEGER AS total_selected
    FROM terms t LEFT JOIN kept k ON k.term = t.term GROUP BY t.term""",
)
def a1_distinct(spark, sf):
    found = hits(spark, sf, mode="all").select("term", "passage").distinct()
    return term_stats(terms(spark), found, 5)
