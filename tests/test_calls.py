"""Calls are made once, whatever fails."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from nounspan.catalog import QUERIES
from nounspan.operators import calls
from nounspan.operators.calls import ask_once, logged_answers
from nounspan.operators.inference import CallPolicy
from nounspan.plans.translation import translate_prompts, translate_samples
from nounspan.session import write_out

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def counting(folder, stop_at=None, refuse=None):
    """A model that leaves a file for every input it was called for, and may end its task."""

    def make():
        import os
        import uuid

        def model(inputs):
            for text in inputs:
                if refuse and refuse in str(text):
                    raise ValueError("refused")
                if stop_at is not None and len(os.listdir(folder)) >= stop_at:
                    raise SystemExit("lost")
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(text))
            return [f"<{t}>" for t in inputs]

        return model

    return make


@pytest.fixture
def made(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return folder


@pytest.fixture
def asked(spark):
    # 400 rows, 40 distinct prompts, one of them in a third of all rows.
    rows = [(i, "common" if i % 3 == 0 else None if i % 50 == 1 else f"p{i % 39}", i) for i in range(400)]
    return spark.createDataFrame(rows, "id long, text string, digest_of int").repartition(6)


def texts(made):
    return sorted(f.read_text() for f in made.iterdir())


def test_equal_inputs_are_one_call_and_every_row_gets_it(spark, asked, made, tmp_path):
    done = ask_once(asked, ["text"], counting(made), "m", str(tmp_path / "log"), 3).collect()
    assert len(done) == 400
    assert all(r["completion"] == (r["text"] and f"<{r['text']}>") and r["error"] is None for r in done)
    assert texts(made) == sorted({r["text"] for r in done} - {None})


def test_a_run_that_fails_midway_repeats_no_committed_call(spark, asked, made, tmp_path):
    log = str(tmp_path / "log")
    distinct = asked.filter("text IS NOT NULL").select("text").distinct().count()
    with pytest.raises(Exception):
        ask_once(asked, ["text"], counting(made, stop_at=20), "m", log, 1, commit_rows=1)
    committed = logged_answers(spark, log).count()
    assert 0 < committed <= 20
    done = ask_once(asked, ["text"], counting(made), "m", log, 1, commit_rows=1).collect()
    assert len(done) == 400 and all(r["error"] is None for r in done)
    # Every answer was committed before the next call, so no call was made twice.
    assert len(texts(made)) == distinct == logged_answers(spark, log).count()
    ask_once(asked, ["text"], counting(made), "m", log)
    assert len(texts(made)) == distinct


def test_a_second_attempt_of_a_task_asks_only_for_the_rest(spark, made, tmp_path):
    log = str(tmp_path / "log")
    df = spark.createDataFrame([(f"t{i:02}",) for i in range(30)], "text string").coalesce(1)
    policy = CallPolicy(max_attempts=1, sleep=lambda s: None)
    first = ask_once(df, ["text"], counting(made, refuse="t07"), "m", log, 5, policy, commit_rows=10).collect()
    bad = [r for r in first if r["error"]]
    assert [r["text"] for r in bad] == ["t07"] and bad[0]["completion"] is None
    again = ask_once(df, ["text"], counting(made), "m", log, 5, policy, commit_rows=10).collect()
    assert all(r["completion"] == f"<{r['text']}>" and r["error"] is None for r in again)
    assert texts(made).count("t07") == 1


def test_models_and_records_have_calls_of_their_own(spark, made, tmp_path):
    log = str(tmp_path / "log")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 1)], "text string, n int")
    for model, calls in (("m", 2), ("other", 4), ("m", 4)):
        assert ask_once(df, ["text", "n"], counting(made), model, log).count() == 3
        assert len(texts(made)) == calls
    assert ask_once(df.filter("false"), ["text"], counting(made), "m", log).collect() == []


def test_plans_take_a_log(spark, made, tmp_path):
    log = str(tmp_path / "log")
    prompts = spark.createDataFrame([(0, "a"), (1, None), (2, "a")], "id long, English string")
    for _ in range(2):
        got = translate_prompts(prompts, counting(made), "org/m", log=log).orderBy("id").collect()
        assert [r["org--m"] for r in got] == ["<a>", None, "<a>"]
    assert len(texts(made)) == 1
    samples = spark.createDataFrame(
        [("t", 3, 3, ["x", "y", "x"])], "term string, total_matches int, total_selected int, selected array<string>"
    )
    done = translate_samples(samples, counting(made), "org/m", log=log)
    assert done.select(F.size("translation")).first()[0] == 3 and len(texts(made)) == 3


def test_the_rated_query_returns_every_prompt_with_its_translation(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", None if (c, t) == (3, 0) else f" text {c} {t} ") for c in range(40) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["u6_call_policy_rate"](spark, str(tmp_path)).collect()
    wanted = {c * 10000 + t: text and text.strip() for c, t, role, text in rows if role == "user"}
    assert len(got) == len(wanted) and {r["id"]: r["translation"] for r in got} == wanted
    assert {(r["calls"], r["over_quota"], r["gaps"]) for r in got} == {(79, 0, 0)}


def test_answers_are_read_from_the_log_and_not_stored_again(spark, asked, made, tmp_path, monkeypatch):
    stored = []
    monkeypatch.setattr(calls, "write_out", lambda df, label: (stored.append((label, df.columns)), write_out(df, label))[1])
    log = str(tmp_path / "log")
    ask_once(asked, ["text"], counting(made), "m", log)
    done = ask_once(asked, ["text"], counting(made), "m", log, digest="call").collect()
    # The second run looks for digests only.
    assert stored == [("failed-calls", ["digest", "error", "tried"]), ("missing-calls", ["_call"]), ("failed-calls", ["digest", "error", "tried"])]
    assert all((r["call"] is None) == (r["text"] is None) and len(r["call"] or b"x" * 16) == 16 for r in done)
    assert len(done) == 400 and len({r["call"] for r in done}) == len({r["text"] for r in done})
