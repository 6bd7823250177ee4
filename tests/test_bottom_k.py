"""Merged samples of parts are the sample of the whole; large ranks are found by refinement."""

import random

import pytest
from pyspark.sql import functions as F

from nounspan.operators import sampling
from nounspan.operators.bottom_k import KeySample

IDS = ["i"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), i, rng.choice([0.0, -1.0, 0.5, 3.0, None, float("nan")])) for i in range(900)]
    data += [("lone", 5000, 2.0)]
    return spark.createDataFrame(data, "k string, i long, w double").cache()


@pytest.mark.parametrize("weight", [None, "w"])
def test_merge_of_three_parts_is_the_sample_of_all(spark, rows, weight, tmp_path):
    whole = KeySample.draw(rows, "k", 7, 42, IDS, weight)
    parts = []
    for p in range(3):
        KeySample.draw(rows.filter(F.col("i") % 3 == p).repartition(p + 1), "k", 7, 42, IDS, weight).write(f"{tmp_path}/{p}")
        parts.append(KeySample.read(spark, f"{tmp_path}/{p}"))
    merged = KeySample.merge([KeySample.merge(parts[:2]), parts[2]])
    for a, b in ((merged.ranked(), whole.ranked()), (merged.totals, whole.totals)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    uniform = sampling.sample_per_key(rows, "k", 7, 42, IDS) if weight is None else (
        sampling.weighted_sample_per_key(rows, "k", 7, "w", 42, IDS)
    )
    assert sorted((str(r["k"]), r["rank"], r["i"]) for r in merged.ranked().collect()) == sorted(
        (str(r["k"]), r["rank"], r["i"]) for r in uniform.collect()
    )
    smaller = KeySample.merge(parts, 3)
    assert {(str(r["k"]), r["i"]) for r in smaller.ranked().collect()} == {
        (str(r["k"]), r["i"]) for r in whole.ranked().filter("rank <= 3").collect()
    }


def test_samples_of_other_draws_are_refused(spark, rows):
    one = KeySample.draw(rows, "k", 3, 1, IDS)
    with pytest.raises(ValueError, match="different draws"):
        KeySample.merge([one, KeySample.draw(rows, "k", 3, 2, IDS)])
    with pytest.raises(ValueError, match="fewer than 5"):
        KeySample.merge([one], 5)
    with pytest.raises(ValueError):
        KeySample.merge([])
    none = KeySample.draw(rows.filter("false"), "k", 3, 1, IDS)
    assert KeySample.merge([none]).ranked().collect() == []


def test_a_sample_that_is_half_written_cannot_be_read(spark, rows, tmp_path):
    sample = KeySample.draw(rows, "k", 3, 1, IDS)
    sample.rows.write.parquet(f"{tmp_path}/s/rows")
    with pytest.raises(Exception):
        KeySample.read(spark, f"{tmp_path}/s")


@pytest.mark.parametrize("kind", ["hash", "log"])
def test_a_label_with_many_more_rows_ranks_no_more_of_them(spark, monkeypatch, kind):
    monkeypatch.setattr(sampling, "PREFIX", 1)
    monkeypatch.setattr(sampling, "LOG_STEPS", 4)
    monkeypatch.setattr(sampling, "LOG_SPLIT", 16)
    monkeypatch.setattr(sampling, "LOG_LEVELS", 6)
    df = spark.range(20_200).select(
        F.when(F.col("id") < 200, "small").otherwise("large").alias("label"),
        "id",
        F.md5(F.col("id").cast("string")).alias("h"),
    ).withColumn("v", F.conv(F.substring("h", 1, 8), 16, 10).cast("double") + 1)
    value = "h" if kind == "hash" else "v"
    buckets = sampling.hash_buckets("h") if kind == "hash" else sampling.log_buckets("v")
    ranks = {"x": F.round(F.col("_total") * 0.1), "y": F.round(F.col("_total") * 0.5)}
    held, _ = sampling.holding_buckets(df, ["label"], buckets, ranks, most=40)
    assert held.count() == 4 and max(r["_n"] for r in held.collect()) <= 40
    got = {r["label"]: (r["x"]["id"], r["y"]["id"]) for r in sampling.cut_points(df, ["label"], buckets, [value, "id"], ranks).collect()}
    by_label = {}
    for r in df.collect():
        by_label.setdefault(r["label"], []).append((r[value], r["id"]))
    for label, values in by_label.items():
        values.sort()
        n = len(values)
        assert got[label] == (values[round(n * 0.1) - 1][1], values[round(n * 0.5) - 1][1])


def test_equal_values_end_the_search(spark, monkeypatch):
    df = spark.range(100).select(F.lit("k").alias("label"), "id", F.lit("ab" * 16).alias("h"))
    cuts = sampling.cut_points(df, ["label"], sampling.hash_buckets("h"), ["h", "id"], {"c": F.lit(30)})
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 10)
    again = sampling.cut_points(df, ["label"], sampling.hash_buckets("h"), ["h", "id"], {"c": F.lit(30)})
    assert cuts.first()["c"]["id"] == again.first()["c"]["id"] == 29


def test_the_split_reads_its_input_once(spark, sf, plan, monkeypatch):
    inputs = []
    write = sampling.write_out

    def seen(df, label):
        inputs.append(plan(df).count("documents.parquet"))
        return write(df, label)

    monkeypatch.setattr(sampling, "write_out", seen)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    split = sampling.stratified_split(docs, "lang", ["doc_id"])
    assert sum(inputs) == 1 and "documents.parquet" not in plan(split)
    assert split.count() == docs.filter("lang IS NOT NULL").count()
