import pytest
from pyspark.sql import functions as F

from nounspan.operators import relevance as R
from nounspan.plans.relevance import make_splits, score_unseen, train


@pytest.fixture(scope="module")
def labelled(spark):
    # Separable: each letter has a word of its own.
    words = {"n": "table chair", "b": "perhaps someone", "y": "tutors teach"}
    rows = [
        (i, f"{words[letter]} number {i % 13} here.", letter)
        for i in range(300)
        for letter in [list(words)[i % 3]]
    ]
    rows += [(900, None, "y"), (901, "text", None), (902, "text", "x")]
    return spark.createDataFrame(rows, "id long, source string, comment string")


def test_labels(spark, labelled):
    rows = spark.createDataFrame([("n",), ("b",), ("y",), ("x",), (None,)], "comment string")
    assert [r["label"] for r in R.map_labels(rows).collect()] == [0.0, 0.5, 1.0, None, None]
    assert R.labelled_only(labelled).count() == 301
    counts = {r["value"]: r["n"] for r in R.value_counts(rows, F.col("comment").isNull()).collect()}
    assert counts == {True: 1, False: 4}


def test_splits(labelled):
    rows = make_splits(labelled, ["id"]).collect()
    assert len(rows) == len({r["id"] for r in rows}) == 300
    assert sum(r["split"] == "test" for r in rows) == 30
    assert sum(r["split"] == "val" for r in rows) == 27


def test_model_beats_the_mean(labelled):
    splits = make_splits(labelled, ["id"])
    _, errors, error = train(splits, grid=(0.01, 0.1), features=256)
    assert set(errors) == {0.01, 0.1}
    mean = splits.filter("split = 'train'").agg(F.avg("label")).first()[0]
    base = R.mse(splits.filter("split = 'test'").withColumn("prediction", F.lit(mean))).first()["mse"]
    assert error < base / 4


def test_scoring_skips_seen_and_ranks(spark, labelled):
    splits = make_splits(labelled, ["id"])
    model, _, _ = train(splits, grid=(0.01,), features=256)
    rows = [("a", "tutors teach well"), ("a", "table chair"), ("b", "seen text"), ("b", None)]
    passages = spark.createDataFrame(rows, "seed string, sentence string")
    seen = spark.createDataFrame([("seen text",), ("seen text",), (None,)], "source string")
    got = score_unseen(passages, seen, model, ["seed", "sentence"]).collect()
    assert got[0]["sentence"] == "tutors teach well"
    assert {r["sentence"] for r in got} == {"tutors teach well", "table chair", None}
    assert all(r["score"] >= 0 for r in got)


def test_scores_below_zero(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,)], "x double")
    assert [r["score"] for r in R.attach_scores(df, F.col("x")).collect()] == [0.0, 0.5]


def test_mse(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.5), (None, 3.0)], "label double, prediction double")
    assert R.mse(df).first()["mse"] == pytest.approx(0.625)
