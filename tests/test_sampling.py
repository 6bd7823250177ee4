import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nounspan.operators import sampling as S
from nounspan.operators.ids import with_rid

IDS = ["id"]


@pytest.fixture(scope="module")
def rows(spark):
    # Key a holds most rows; key c has fewer rows than are drawn.
    data = [("a", i, float(i % 7)) for i in range(3000)]
    data += [("b", i, 1.0) for i in range(200)] + [("c", i, 2.0) for i in range(3)]
    return spark.createDataFrame(data, "key string, id long, w double").repartition(7)


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def picked(df):
    return sorted((r["key"], r["id"], r["rank"]) for r in df.collect())


def uniform(n, seed):
    out = []
    for key, size in (("a", 3000), ("b", 200), ("c", 3)):
        order = sorted((md5(seed, key, i), i) for i in range(size))[:n]
        out += [(key, i, k + 1) for k, (_, i) in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 5, 150, 1500])
def test_uniform_sample(rows, n):
    assert picked(S.sample_per_key(rows, "key", n, 42, IDS)) == uniform(n, 42)


def test_sample_ignores_partitioning(rows):
    want = picked(S.sample_per_key(rows, "key", 5, 1, IDS))
    assert picked(S.sample_per_key(rows.coalesce(1), "key", 5, 1, IDS)) == want
    assert picked(S.sample_per_key(rows.repartition(8, "key"), "key", 5, 1, IDS)) == want
    assert picked(S.sample_per_key(rows, "key", 5, 2, IDS)) != want


@pytest.mark.parametrize("n", [5, 1200])
def test_weighted_sample(rows, n):
    got = picked(S.weighted_sample_per_key(rows, "key", n, "w", 7, IDS))
    want = []
    for key, size in (("a", 3000), ("b", 200), ("c", 3)):
        weights = {i: {"a": i % 7, "b": 1, "c": 2}[key] for i in range(size)}

        def time(i):
            u = (int(md5(7, key, i)[:13], 16) + 1) / (2**52 + 1)
            return -math.log(u) / weights[i]

        drawn = sorted((i for i in weights if weights[i]), key=time)[:n]
        want += [(key, i, k + 1) for k, i in enumerate(drawn)]
    assert got == sorted(want)


def test_weights_that_are_never_drawn(spark):
    data = [(0, 0.0), (1, -1.0), (2, None), (3, float("nan")), (4, 0.5)]
    df = spark.createDataFrame([("k", i, w) for i, w in data], "key string, id long, w double")
    assert [r["id"] for r in S.weighted_sample_per_key(df, "key", 9, "w", 1, IDS).collect()] == [4]


def test_heavy_weights_win(spark):
    df = spark.range(1000).select(
        F.lit("k").alias("key"), "id", F.when(F.col("id") < 100, 1000.0).otherwise(1.0).alias("w")
    )
    drawn = S.weighted_sample_per_key(df, "key", 50, "w", 3, IDS).collect()
    assert sum(r["id"] < 100 for r in drawn) > 40


def test_tasks_cut_before_both_shuffles(rows, plan):
    assert plan(S.sample_per_key(rows, "key", 5, 42, IDS)).count("WindowGroupLimit") == 4


def test_stratified_split_sizes(spark):
    sizes = {"n": 1003, "b": 57, "y": 5, "x": 1}
    data = [(k, i) for k, size in sizes.items() for i in range(size)] + [(None, 9)]
    df = spark.createDataFrame(data, "label string, id long").repartition(5)
    split = S.stratified_split(df, "label", ["label", "id"]).collect()
    assert len(split) == sum(sizes.values())
    counts = Counter((r["label"], r["split"]) for r in split)
    for label, size in sizes.items():
        test = math.floor(0.1 * size + 0.5)
        val = math.floor(0.1 * (size - test) + 0.5)
        assert counts[(label, "test")] == test
        assert counts[(label, "val")] == val
        assert counts[(label, "train")] == size - test - val
    again = S.stratified_split(df.coalesce(1), "label", ["label", "id"]).collect()
    assert sorted(map(str, split)) == sorted(map(str, again))


def test_split_does_not_gather_a_label(spark, plan):
    df = spark.range(5000).select(F.lit("n").alias("label"), "id")
    assert "Window" not in plan(S.stratified_split(df, "label", ["id"]))


def test_with_rid(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("v"), F.lit("t").alias("hot"))
    got = sorted((r["rid"], r["v"]) for r in with_rid(df, ["hot", "v"]).collect())
    assert got == [(i, i) for i in range(5000)]
    assert with_rid(df.limit(0), ["v"]).count() == 0


def test_rank_and_preview(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.5)], "id long, score double")
    assert [r["id"] for r in S.rank_passages(df, ["id"]).collect()] == [2, 1, 3]
    assert [r["id"] for r in S.preview(df, ["id"], 2).collect()] == [1, 2]


def test_nest_samples(spark):
    stats = spark.createDataFrame(
        [("a", 3, 2), ("z", 0, 0)], "term string, total_matches int, total_selected int"
    )
    chosen = spark.createDataFrame([("a", 2, "q"), ("a", 1, "p")], "term string, rank int, passage string")
    got = {r["term"]: r["selected"] for r in S.nest_samples(stats, chosen).collect()}
    assert got == {"a": ["p", "q"], "z": None}
