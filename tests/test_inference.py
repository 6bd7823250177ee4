import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from nounspan.operators.evaluation import verdict_by_forms
from nounspan.operators.inference import (
    CallPolicy,
    _Caller,
    judge,
    route_for_judging,
    translate,
    with_pos,
)
from nounspan.sources.writers import add_model_column

# The workers cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def marked():
    return lambda texts: [f" <{t}>\n" for t in texts]


def test_translate_keeps_rows_and_strips(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(50)], "id long, t string")
    got = {r["id"]: r for r in translate(df, "t", marked, "org/m", batch_size=4).collect()}
    assert len(got) == 50 and got[0]["translation"] == "<t0>" and got[0]["model"] == "org/m"
    assert got[3]["translation"] is None and got[3]["error"] is None


def refusing():
    def run(texts):
        if "bad" in texts:
            raise RuntimeError("refused")
        return [t.upper() for t in texts]

    return run


def no_wait(seconds):
    pass


def test_a_failing_row_does_not_fail_its_batch(spark):
    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "t string").coalesce(1)
    done = translate(df, "t", refusing, "m", policy=CallPolicy(sleep=no_wait))
    got = {r["t"]: (r["translation"], r["error"]) for r in done.collect()}
    assert got == {"a": ("A", None), "bad": (None, "RuntimeError: refused"), "c": ("C", None)}


def test_retries_wait_and_then_succeed():
    waits, calls = [], []

    def flaky(texts):
        calls.append(list(texts))
        if len(calls) < 3:
            raise OSError("busy")
        return texts

    caller = _Caller(flaky, CallPolicy(sleep=waits.append))
    assert list(caller.run(["a"], 16)) == [("a", None, 3, 0)]
    assert len(calls) == 3 and len(waits) == 2 and all(1 <= w <= 60 for w in waits)


def test_three_attempts_then_error():
    calls = []

    def broken(texts):
        calls.append(1)
        raise OSError("down")

    caller = _Caller(broken, CallPolicy(sleep=no_wait))
    assert list(caller.run(["a"], 16)) == [(None, "OSError: down", 3, 0)] and len(calls) == 3


def test_outputs_of_another_length_are_an_error():
    caller = _Caller(lambda texts: [], CallPolicy(max_attempts=1, sleep=no_wait))
    (result,) = caller.run(["a"], 16)
    assert result[0] is None and result[1].startswith("ValueError")


def test_quota_is_divided_between_tasks():
    waits = []
    policy = CallPolicy(calls=60, window=65, parallelism=4, sleep=waits.append)
    assert policy.tasks() == 4 and policy.quota() == 15
    done = list(_Caller(lambda t: t, policy).run(["x"] * 31, 1))
    assert [r[3] for r in done] == [0] * 15 + [1] * 15 + [2]
    assert waits == [65, 65]
    assert CallPolicy(calls=3, parallelism=10).tasks() == 3
    assert CallPolicy(parallelism=10).quota() is None


def test_quota_limits_tasks(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("t"))
    done = translate(df, "t", marked, "m", policy=CallPolicy(calls=1000, parallelism=3, sleep=no_wait))
    assert done.rdd.getNumPartitions() == 3 and done.count() == 100


JUDGE_ROWS = [(1, True, "tutors", "T"), (2, False, "tutors", "T"), (3, None, "tutors", "T")]


def test_only_rows_to_keep_are_judged(spark):
    df = spark.createDataFrame(JUDGE_ROWS, "id long, to_keep boolean, seed_noun string, translation string")
    prompts = {r["id"]: r["prompt"] for r in route_for_judging(df).collect()}
    assert "'tutors'" in prompts[1] and prompts[2] == prompts[3] == "N/A"

    def make():
        def run(texts):
            assert all(t != "N/A" for t in texts)
            return ["Masculine"] * len(texts)

        return run

    got = {r["id"]: (r["response"], r["error"]) for r in judge(df, make).collect()}
    assert got == {1: ("Masculine", None), 2: ("N/A", None), 3: ("N/A", None)}


def test_verdict_order(spark):
    columns = "gender_inclusive_count int, german_fp_count int, gender_neutral_count int, german_mp_count int"
    rows = [(1, 1, 1, 1), (0, 1, 1, 1), (0, 0, 1, 1), (0, 0, 0, 1), (0, 0, 0, 0)]
    got = spark.createDataFrame(rows, columns).coalesce(1).select(verdict_by_forms().alias("v")).collect()
    assert [r["v"] for r in got] == ["Gender-Inclusive", "Feminine", "Gender-Neutral", "Masculine", "None"]


def test_tagger_sees_token_and_text(spark):
    def make():
        return lambda rows: [f"{r['token']}|{len(r['text'])}" for r in rows]

    df = spark.createDataFrame([("a", "xyz")], "term string, passage string")
    assert with_pos(df, make, "passage").first()["pos"] == "a|3"


def test_rows_not_judged_stay_out_of_the_calling_tasks(spark):
    rows = [(i, "a", "b", i == 3) for i in range(9)] + [(9, "a", "b", None)]
    df = spark.createDataFrame(rows, "id long, seed_noun string, translation string, to_keep boolean")
    make = lambda: lambda texts: ["yes"] * len(texts)
    policy = CallPolicy(calls=1, sleep=no_wait)
    got = [judge(df, make, policy=p).orderBy("id").collect() for p in (None, policy)]
    assert got[0] == got[1] and [r["response"] for r in got[0]].count("yes") == 1


def test_models_run_once_per_row(spark, tmp_path):
    def make():
        def run(texts):
            with open(tmp_path / "calls", "a") as log:
                log.write("x" * len(texts))
            return texts

        return run

    df = spark.range(40).select(F.col("id").cast("string").alias("t"))
    translate(df, "t", make, "m").filter("error is null").select("translation", "model").collect()
    assert len((tmp_path / "calls").read_text()) == 40


def test_model_column(spark):
    prompts = spark.createDataFrame([(0, "a"), (1, None)], "id long, English string")
    done = spark.createDataFrame([(0, "A")], "id long, completion string")
    got = add_model_column(prompts, done, "org/m").orderBy("id")
    assert got.columns == ["id", "English", "org--m"] and [tuple(r) for r in got.collect()] == [(0, "a", "A"), (1, None, None)]
