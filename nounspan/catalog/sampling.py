"""Queries that draw, split, number and rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from nounspan.catalog.base import (
    CTE_LABELLED,
    CTE_SENT,
    cte_hits,
    documents,
    labelled,
    query,
    sentences,
    sql_draw,
    sql_hash,
    terms,
)
from nounspan.catalog.concordance import hits
from nounspan.operators.bottom_k import KeySample
from nounspan.operators.concordance import sentence_table, term_stats
from nounspan.operators.ids import with_rid
from nounspan.operators.sampling import (
    nest_samples,
    null_safe,
    preview,
    rank_passages,
    sample_per_key,
    stratified_split,
    weighted_sample_per_key,
)
from nounspan.plans.mining import ROW_ID, merge_mined, mine, mine_part
from nounspan.plans.relevance import make_splits
from nounspan.session import scratch_path, write_out

SENT_ID = ["doc_id", "sent_pos"]


def by_source(spark, sf):
    """All sentences with their source as the sampling key."""
    return sentence_table(documents(spark, sf, "doc_id", "text", "source"), "source")


def _uniform(n: int) -> str:
    h = sql_hash("source", "doc_id", "sent_pos")
    return (
        f"WITH {CTE_SENT}, r AS (SELECT source, doc_id, sent_pos, sentence, row_number() OVER "
        f"(PARTITION BY source ORDER BY {h}, doc_id, sent_pos)::INTEGER AS rank FROM sent) "
        f"SELECT source, doc_id, sent_pos, sentence, rank FROM r WHERE rank <= {n}"
    )


@query("w2_sample_per_key", _uniform(5))
def w2(spark, sf):
    drawn = sample_per_key(by_source(spark, sf), "source", 5, 42, SENT_ID)
    return drawn.select("source", *SENT_ID, "sentence", "rank")


@query("w2_sample_per_key_large", _uniform(1500))
def w2_large(spark, sf):
    drawn = sample_per_key(by_source(spark, sf), "source", 1500, 42, SENT_ID)
    return drawn.select("source", *SENT_ID, "sentence", "rank")


def _weighted(n: int) -> str:
    u = sql_draw(sql_hash("source", "doc_id", "sent_pos", seed=7))
    return (
        f"WITH {CTE_SENT}, w AS (SELECT source, doc_id, sent_pos, greatest(length(sentence) - 40, 0) "
        f"AS weight FROM sent), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY "
        f"-ln({u}) / weight, doc_id, sent_pos)::INTEGER AS rank FROM w WHERE weight > 0) "
        f"SELECT source, doc_id, sent_pos, weight::INTEGER AS weight, rank FROM r WHERE rank <= {n}"
    )


def weighted(spark, sf, n):
    rows = by_source(spark, sf).withColumn(
        "weight", F.greatest(F.length("sentence") - 40, F.lit(0))
    )
    drawn = weighted_sample_per_key(rows, "source", n, "weight", 7, SENT_ID)
    return drawn.select("source", *SENT_ID, "weight", "rank")


@query("w3_weighted_sample_per_key", _weighted(5))
def w3(spark, sf):
    return weighted(spark, sf, 5)


@query("w3_weighted_sample_per_key_large", _weighted(1200))
def w3_large(spark, sf):
    return weighted(spark, sf, 1200)


def merged_parts(spark, rows, n, seed, weight=None):
    """Draw from three parts of a table on their own, store each sample, and merge what was stored."""
    stored = []
    for part in range(3):
        mine = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == part)
        path = scratch_path(spark, "key-sample")
        KeySample.draw(mine, "source", n, seed, SENT_ID, weight).write(path)
        stored.append(KeySample.read(spark, path))
    whole = KeySample.merge(stored)
    return null_safe(whole.ranked(), whole.totals, ["source"])


def _with_total(sql: str, column: str) -> str:
    """The same sample, with the number of rows that each key has."""
    total = "count(*) OVER (PARTITION BY source) AS total"
    return sql.replace(f"AS {column} FROM sent", f"AS {column}, {total} FROM sent", 1).replace(
        ", rank FROM r", ", rank, total FROM r", 1
    )


@query("set1_merge_bottom_k", _with_total(_uniform(5), "rank"))
def set1_merge(spark, sf):
    # The merged samples of the parts are the sample of the whole.
    merged = merged_parts(spark, by_source(spark, sf), 5, 42)
    return merged.select("source", *SENT_ID, "sentence", "rank", "total")


@query("w3_merge_bottom_k", _with_total(_weighted(5), "weight"))
def w3_merge(spark, sf):
    rows = by_source(spark, sf).withColumn("weight", F.greatest(F.length("sentence") - 40, F.lit(0)))
    merged = merged_parts(spark, rows, 5, 7, "weight")
    return merged.select("source", *SENT_ID, "weight", "rank", "total")


@query(
    "w4_with_rid",
    f"""WITH {CTE_SENT} SELECT row_number() OVER (ORDER BY source, doc_id, sent_pos) - 1 AS rid,
    source, doc_id, sent_pos FROM sent""",
)
def w4(spark, sf):
    rows = by_source(spark, sf).select("source", *SENT_ID)
    return with_rid(rows, ["source", *SENT_ID])


def _split(id_hash: str, rows: str, label: str) -> str:
    return (
        f"r AS (SELECT doc_id, {label} AS label, row_number() OVER (PARTITION BY {label} ORDER BY "
        f"{id_hash}, doc_id) AS k, count(*) OVER (PARTITION BY {label}) AS n FROM {rows} "
        f"WHERE {label} IS NOT NULL), c AS (SELECT *, round(0.1 * n) AS t FROM r) "
        "SELECT doc_id, label, CASE WHEN k <= t THEN 'test' WHEN k <= t + round(0.1 * (n - t)) "
        "THEN 'val' ELSE 'train' END AS split FROM c"
    )


@query(
    "w5_stratified_split",
    f"""WITH {CTE_LABELLED}, l AS (SELECT doc_id, CASE comment WHEN 'n' THEN 0.0 WHEN 'b' THEN 0.5
    WHEN 'y' THEN 1.0 END::DOUBLE AS lab FROM labelled), {_split(sql_hash('doc_id'), 'l', 'lab')}""",
)
def w5(spark, sf):
    return make_splits(labelled(spark, sf), ["doc_id"]).select("doc_id", "label", "split")


@query(
    "w5_stratified_split_languages",
    "WITH " + _split(sql_hash("doc_id", seed=3), "documents", "lang"),
)
def w5_languages(spark, sf):
    rows = documents(spark, sf, "doc_id", "lang").withColumnRenamed("lang", "label")
    return stratified_split(rows, "label", ["doc_id"], seed=3).select("doc_id", "label", "split")


@query(
    "l1_rank_passages",
    f"""WITH {cte_hits()} SELECT term, doc_id, sent_pos, token_pos, length(passage)::DOUBLE AS score
    FROM kept ORDER BY score DESC, term, doc_id, sent_pos, token_pos""",
)
def l1(spark, sf):
    scored = hits(spark, sf, mode="all").withColumn("score", F.length("passage").cast("double"))
    return rank_passages(scored.drop("passage"), ["term", *ROW_ID])


@query(
    "l2_preview",
    f"""WITH {CTE_SENT} SELECT doc_id, sent_pos, sentence FROM sent
    ORDER BY length(sentence) DESC, doc_id, sent_pos LIMIT 3""",
)
def l2(spark, sf):
    return preview(
        sentences(spark, sf), [F.length("sentence").desc(), "doc_id", "sent_pos"], 3
    )


def _sampled(before: int, n: int) -> str:
    h = sql_hash("term", "doc_id", "sent_pos", "token_pos")
    return (
        f"{cte_hits(before=before)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY term "
        f"ORDER BY {h}, doc_id, sent_pos, token_pos) AS rank FROM kept), "
        f"nested AS (SELECT t.term, count(r.term)::INTEGER AS total_matches, "
        f"least(count(r.term), {n})::INTEGER AS total_selected, "
        f"list(r.passage ORDER BY r.rank) FILTER (r.rank <= {n}) AS selected "
        "FROM terms t LEFT JOIN ranked r ON r.term = t.term GROUP BY t.term)"
    )


NESTED = (
    "SELECT term, total_matches, total_selected, "
    "array_to_string(selected, ' || ') AS selected FROM nested"
)


def flat_nested(df):
    return df.select(
        "term", "total_matches", "total_selected", F.array_join("selected", " || ").alias("selected")
    )


@query("l3_cap_per_term", f"WITH {_sampled(2, 12)} SELECT term, len(selected)::INTEGER AS n FROM nested WHERE selected IS NOT NULL")
def l3(spark, sf):
    drawn = sample_per_key(hits(spark, sf, mode="all"), "term", 12, 42, ROW_ID)
    return drawn.groupBy("term").agg(F.count("*").cast("int").alias("n"))


@query("a7_nest_samples", f"WITH {_sampled(2, 5)} {NESTED}")
def a7(spark, sf):
    found = write_out(hits(spark, sf, mode="all"), "matches")
    wanted = terms(spark)
    drawn = sample_per_key(found, "term", 5, 42, ROW_ID)
    return flat_nested(nest_samples(term_stats(wanted, found, 5), drawn))


@query("e1_mine_parts", f"WITH {_sampled(3, 3)} {NESTED}")
def e1_parts(spark, sf):
    # Each part of the corpus is mined on its own; the stored samples become the records of the whole.
    docs, parts = documents(spark, sf), []
    for part in range(2):
        path = scratch_path(spark, "mined-part")
        mine_part(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part), terms(spark), mode="all").write(path)
        parts.append(KeySample.read(spark, path))
    return flat_nested(merge_mined(terms(spark), parts))


@query("e1_mine", f"WITH {_sampled(3, 3)} {NESTED}")
def e1(spark, sf):
    return flat_nested(mine(documents(spark, sf), terms(spark), mode="all"))
