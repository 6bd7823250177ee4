"""Sizes on both sides of a plan switch give the same rows."""

import pytest
from pyspark.sql import functions as F

from nounspan.operators import concordance as c
from nounspan.operators import sampling
from nounspan.operators.inference import CallPolicy, _Caller


@pytest.fixture
def lines(spark):
    rows = [(1, "The cat sat. A dog ran."), (1, "A cat, again."), (1, "A cat, again."), (2, "No hit."), (None, "cat")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture
def terms(spark):
    rows = [("cat", ["cat"]), ("dog", ["dog"])]
    return spark.createDataFrame(rows, "term string, term_tokens array<string>")


def test_filter_at_any_number_of_terms(spark, lines, terms, monkeypatch):
    few = c.with_any_term(lines, terms).collect()
    monkeypatch.setattr(c.first_tokens, "__defaults__", (1,))
    many = c.with_any_term(lines, terms).collect()
    assert sorted(map(str, few)) == sorted(map(str, many)) and len(few) == 4


def test_both_concordance_paths_on_lines(lines, terms):
    near = sorted(map(str, c.concordance(lines, terms).collect()))
    far = sorted(map(str, c.concordance(lines, terms, max_terms=1).collect()))
    assert near == far and len(near) == 5


def test_both_sentence_paths_on_lines(lines, terms, monkeypatch):
    more = lines.unionByName(lines.select("doc_id", F.lit("nothing here. But a cat.").alias("text")).limit(1))
    near = sorted(map(str, c.sentences_with_terms(more, terms).collect()))
    monkeypatch.setattr(c.first_tokens, "__defaults__", (1,))
    far = sorted(map(str, c.sentences_with_terms(more, terms).collect()))
    assert near == far and len(near) == 6 and not any("nothing" in row for row in far)


def test_only_tokens_that_pass_the_filter_are_shuffled(spark, tmp_path):
    """Of 20,000 tokens the 30 that start a term reach the join, and hardly any others."""
    text = " ".join(f"w{i}" for i in range(20_000))
    corpus = spark.createDataFrame([(1, f"{text}. " + "cat. " * 30)], "doc_id long, text string")
    terms = spark.createDataFrame([("cat", ["cat"]), ("dog", ["dog"])], "term string, term_tokens array<string>")
    keyed = terms.select("term", "term_tokens", F.get("term_tokens", F.lit(0)).alias("_first"))
    words = c.sentence_table(c.with_text_key(corpus), "_text").select(F.explode(c.tokens(F.col("sentence"))).alias("_word"))
    passed = words.filter(c.first_token_filter(keyed).may_hold("_word")).count()
    assert 30 <= passed <= 40
    joined = c.hits_by_shuffle(corpus, keyed)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    # The filter stands below the join with the terms, on the side of the corpus.
    assert "getbit" in plan.split("Generate posexplode")[0].split("Join Inner, (_word")[-1]
    assert joined.count() == 30


@pytest.mark.parametrize("n", [5, 60])
def test_null_keys_are_drawn_on_both_paths(spark, monkeypatch, n):
    monkeypatch.setattr(sampling, "TASK_CUT_LIMIT", 10)
    rows = [(None if i % 2 else "k", i) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, i long")
    drawn = sampling.sample_per_key(df, "key", n, 42, ["i"]).collect()
    assert sum(r["key"] is None for r in drawn) == n and len(drawn) == 2 * n
    assert sorted(r["rank"] for r in drawn if r["key"] is None) == list(range(1, n + 1))


def test_retries_count_against_the_quota():
    calls, pauses = [], []

    def model(batch):
        calls.append(len(batch))
        if "bad" in batch:
            raise ValueError("bad")
        return batch

    class Policy:
        max_attempts, window = 3, 65
        sleep = staticmethod(lambda s: pauses.append((len(calls), s)))
        quota = staticmethod(lambda: 4)
        pause = staticmethod(lambda attempt: 1)

    out = list(_Caller(model, Policy).run(["a", "bad", "c", "d"], 4))
    assert [e is None for _, e, *_ in out] == [True, False, True, True]
    made = 0
    windows = [k for k, s in pauses if s == 65]
    for start, end in zip([0, *windows], [*windows, len(calls)]):
        assert sum(calls[start:end]) <= 4
        made += end - start
    assert made == len(calls) and windows[-1] < len(calls) and CallPolicy
