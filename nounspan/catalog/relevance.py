"""Queries on labels and on the relevance regressor."""

from __future__ import annotations

from pyspark.sql import functions as F

from nounspan.catalog.base import CTE_LABELLED, labelled, query, table
from nounspan.catalog.concordance import hits
from nounspan.functions.text import line_count, token_count
from nounspan.operators.relevance import (
    attach_scores,
    fit_relevance,
    labelled_only,
    load_relevance,
    map_labels,
    mse,
    save_relevance,
    score_passages,
    value_counts,
)
from nounspan.operators.ridge import ridge_grid
from nounspan.plans.relevance import make_splits, score_unseen, train
from nounspan.session import scratch_path, write_out

LABEL_SQL = "CASE comment WHEN 'n' THEN 0.0 WHEN 'b' THEN 0.5 WHEN 'y' THEN 1.0 END::DOUBLE"


@query("p17_map_labels", f"WITH {CTE_LABELLED} SELECT doc_id, comment, {LABEL_SQL} AS label FROM labelled")
def p17(spark, sf):
    return map_labels(labelled(spark, sf)).select("doc_id", "comment", "label")


@query(
    "p18_labelled_only",
    f"""WITH {CTE_LABELLED} SELECT doc_id, source, comment FROM labelled
    WHERE source IS NOT NULL AND comment IS NOT NULL""",
)
def p18(spark, sf):
    return labelled_only(labelled(spark, sf)).select("doc_id", "source", "comment")


@query(
    "a5_value_counts",
    f"""WITH {CTE_LABELLED} SELECT 'label' AS what, {LABEL_SQL}::VARCHAR AS value, count(*) AS n
    FROM labelled GROUP BY 2 UNION ALL SELECT 'blank', (comment IS NULL)::VARCHAR, count(*)
    FROM labelled GROUP BY 2""",
)
def a5(spark, sf):
    rows = map_labels(labelled(spark, sf).select("comment"))
    counts = value_counts(rows, F.col("label").cast("string"))
    blanks = value_counts(rows, F.col("comment").isNull().cast("string"))
    return (
        counts.withColumn("what", F.lit("label"))
        .unionByName(blanks.withColumn("what", F.lit("blank")))
        .select("what", "value", "n")
    )


@query(
    "a8_mse",
    f"""WITH {CTE_LABELLED}, p AS (SELECT {LABEL_SQL} AS label,
    least(len(string_split(source, ' ')) / 1000.0, 1.0) AS prediction FROM labelled
    WHERE comment IS NOT NULL) SELECT round(avg(pow(label - prediction, 2)), 8) AS mse FROM p""",
)
def a8(spark, sf):
    rows = map_labels(labelled_only(labelled(spark, sf))).select(
        "label", F.least(token_count(F.col("source")) / 1000.0, F.lit(1.0)).alias("prediction")
    )
    return mse(rows).select(F.round("mse", 8).alias("mse"))


# Penalties of the small model.
PENALTIES = (0.0, 0.05, 0.5)


@query(
    "m1_ridge_grid",
    f"""WITH {CTE_LABELLED}, r AS (SELECT doc_id, {LABEL_SQL} AS y, len(string_split(source, ' ')) / 1000.0::DOUBLE AS a,
    len(string_split(source, chr(10))) / 10.0::DOUBLE AS b FROM labelled WHERE comment IS NOT NULL),
    t AS (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR), 1, 1))::INT < 12 AS train FROM r),
    m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(y) AS sy,
    corr(a, b) AS ab, corr(a, y) AS ya, corr(b, y) AS yb FROM t WHERE train),
    g AS (SELECT *, unnest({list(PENALTIES)}::DOUBLE[]) AS penalty FROM m), h AS (SELECT *, 1 + penalty / sy AS d FROM g),
    w AS (SELECT *, (ya * d - ab * yb) / (d * d - ab * ab) * sy / sa AS wa,
    (yb * d - ab * ya) / (d * d - ab * ab) * sy / sb AS wb FROM h),
    k AS (SELECT penalty, wa, wb, my - wa * ma - wb * mb AS w0 FROM w)
    SELECT penalty, round(w0, 7) AS intercept, round(wa, 7) AS words, round(wb, 7) AS lines,
    round(avg(pow(y - w0 - wa * a - wb * b, 2)), 7) AS mse FROM t, k WHERE NOT train GROUP BY penalty, w0, wa, wb""",
)
def m1_grid(spark, sf):
    # Two features, three penalties, one pass: the closed form is the oracle.
    rows = map_labels(labelled_only(labelled(spark, sf)))
    digit = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1), 16, 10).cast("int")
    table = rows.select(
        "label",
        F.array(token_count(F.col("source")) / 1000.0, line_count(F.col("source")) / 10.0).alias("x"),
        F.when(digit < 12, "train").otherwise("val").alias("split"),
    )
    found = ridge_grid(table, "x", "label", "split", PENALTIES)
    out = [(float(p), *(round(float(v), 7) + 0.0 for v in (*w, error))) for p, (error, w) in found.items()]
    return spark.createDataFrame(out, "penalty double, intercept double, words double, lines double, mse double")


# Where this application stored the splits of a table and the model fitted on them.
_fits: dict[tuple[str, str], tuple] = {}


def fitted(spark, sf):
    """Stored splits, path of the saved model, validation errors; one fit for all queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fits:
        splits = make_splits(labelled(spark, sf), ["doc_id"]).select("source", "label", "split")
        stored = write_out(splits, "splits")
        model, errors = fit_relevance(
            stored.filter("split = 'train'"), stored.filter("split = 'val'")
        )
        path = scratch_path(spark, "relevance")
        save_relevance(model, path)
        _fits[key] = (stored, path, errors)
    return _fits[key]


@query("m1_fit_relevance")
def m1(spark, sf):
    # Validation error per penalty and the test error of the chosen model.
    splits = make_splits(labelled(spark, sf), ["doc_id"])
    _, errors, test = train(splits)
    rows = [("val", float(p), float(e)) for p, e in errors.items()] + [("test", None, float(test))]
    return spark.createDataFrame(rows, "split string, penalty double, mse double")


@query(
    "m1_relevance_facts",
    f"""WITH {CTE_LABELLED}, n AS (SELECT count(*) AS n FROM labelled WHERE comment IS NOT NULL AND source IS NOT NULL)
    SELECT 'rows in splits' AS fact, n AS value FROM n
    UNION ALL SELECT 'penalties tried', 3 UNION ALL SELECT 'mean residual in training off zero', 0
    UNION ALL SELECT 'reloaded model off the least error', 0 UNION ALL SELECT 'rows scored below zero', 0""",
)
def m1_facts(spark, sf):
    # What must hold for any fit: counts, and deviations that must be zero.
    stored, path, errors = fitted(spark, sf)
    scored = load_relevance(path).transform(stored)
    by = {
        r["split"]: r
        for r in scored.groupBy("split")
        .agg(
            F.count("*").alias("n"),
            F.avg(F.col("label") - F.col("prediction")).alias("residual"),
            F.avg(F.pow(F.col("label") - F.col("prediction"), 2)).alias("mse"),
        )
        .collect()
    }
    below = attach_scores(scored, F.col("prediction")).filter("score < 0").count()
    rows = [
        ("rows in splits", sum(r["n"] for r in by.values())),
        ("penalties tried", len(errors)),
        ("mean residual in training off zero", int(abs(by["train"]["residual"]) > 1e-6)),
        ("reloaded model off the least error", int(abs(by["val"]["mse"] - min(errors.values())) > 1e-9)),
        ("rows scored below zero", below),
    ]
    return spark.createDataFrame(rows, "fact string, value long")


@query("u3_score_passages")
def u3(spark, sf):
    model = load_relevance(fitted(spark, sf)[1])
    scored = score_passages(hits(spark, sf, mode="all"), model, "passage")
    return scored.select("term", "doc_id", "sent_pos", "token_pos", F.round("score", 6).alias("score"))


@query("e5_score_unseen")
def e5(spark, sf):
    # Passages of labelled documents, and what was split, count as used before.
    stored, path, _ = fitted(spark, sf)
    passages = hits(spark, sf, mode="all").select(
        F.col("term").alias("seed"), "doc_id", "sent_pos", "token_pos", F.col("passage").alias("sentence")
    )
    passages = write_out(passages, "passages")
    used = passages.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    seen = stored.select("source").unionByName(used.select(F.col("sentence").alias("source")))
    ties = ["seed", "doc_id", "sent_pos", "token_pos"]
    ranked = score_unseen(passages, seen, load_relevance(path), ties)
    return ranked.select("seed", "sentence", F.round("score", 6).alias("score"))
