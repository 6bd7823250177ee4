"""Jobs from file to file, counts beside writes, tables stored by key."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from nounspan.operators.inference import join_completions
from nounspan.operators.observed import Observed, observed_funnel
from nounspan.operators.samples import funnel, prepare_counted, prepare_passages, regroup_completions
from nounspan.plans import evaluation, mining, relevance, translation
from nounspan.sources.bucketed import write_bucketed
from nounspan.sources.readers import read_csv, read_samples

# The workers cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLES = {
    "a": {"total_matches": 3, "total_selected": 2, "selected": ["one two", "three"], "translation": ["eins zwei", "drei"]},
    "b": {"total_matches": 0, "total_selected": 0, "selected": None, "translation": None},
    "c": {"total_matches": 1, "total_selected": 1, "selected": ["x " * 300], "translation": ["y"]},
}


@pytest.fixture
def samples_path(tmp_path):
    path = tmp_path / "samples.json"
    path.write_text(json.dumps(SAMPLES, indent=4, ensure_ascii=False))
    return str(path)


def marked():
    return lambda texts: [f"<{t if isinstance(t, str) else t['text']}> " for t in texts]


def test_flatten(spark, samples_path, tmp_path):
    out = str(tmp_path / "flat")
    translation.run_flatten(spark, samples_path, out)
    got = sorted(tuple(r) for r in read_csv(spark, out).select("rid", "seed", "source", "translation").collect())
    assert got[:2] == [("0", "a", "one two", "eins zwei"), ("1", "a", "three", "drei")] and len(got) == 3


def test_translation_of_files(spark, samples_path, tmp_path):
    (tmp_path / "p.csv").write_text('English,n\nhello,1\n,2\n"two\nlines",3\n')
    path = translation.run_prompt_translation(spark, str(tmp_path / "p.csv"), str(tmp_path), marked, "org/m", suffix="_x")
    assert path.endswith("translations_org--m_x")
    got = {r["ID"]: r["org--m"] for r in read_csv(spark, path).collect()}
    assert got == {"0": "<hello>", "1": None, "2": "<two\nlines>"}
    out, log = str(tmp_path / "told"), str(tmp_path / "log")
    translation.run_sample_translation(spark, samples_path, out, marked, "org/m", log=log)
    told = {r["term"]: r["translation"] for r in read_samples(spark, out).collect()}
    assert told["a"] == ["<one two>", "<three>"] and not told["b"]


def test_splits_and_scores(spark, samples_path, tmp_path):
    rows = "".join(f"text number {i} of {'good' if i % 2 else 'bad'} words,{'yn'[i % 2]}\n" for i in range(60))
    (tmp_path / "labelled.csv").write_text("source,comment\n" + rows + "three,y\nno comment,\n")
    out = str(tmp_path / "splits")
    sizes = {(r["split"], r["label"]): r["n"] for r in relevance.run_splits(spark, str(tmp_path / "labelled.csv"), out).collect()}
    assert sum(sizes.values()) == 61 and sizes["test", 0.0] == 3
    stored = read_csv(spark, out)
    assert stored.count() == 61
    typed = stored.withColumn("label", F.col("label").cast("double"))
    model, errors, test = relevance.train(typed, features=1 << 6)
    assert set(errors) == {0.01, 0.1, 1.0} and test >= 0
    from nounspan.operators.relevance import save_relevance

    save_relevance(model, str(tmp_path / "model"))
    path = relevance.run_scoring(spark, samples_path, str(tmp_path / "labelled.csv"), str(tmp_path / "model"), str(tmp_path / "scores"))
    assert path.endswith("scores/samples")
    scored = read_csv(spark, path).collect()
    # "three" was used before; scores are fractions, best first.
    assert sorted(r["sentence"][:3] for r in scored) == ["one", "x x"]
    assert all(0.0 <= float(r["score"]) <= 1.0 for r in scored)


def test_preparation_counts_beside_its_write(spark, samples_path, tmp_path):
    counts = mining.run_preparation(spark, [samples_path], str(tmp_path / "out"))
    assert counts == {"seeds": 3, "seeds_with_passages": 2, "passages": 3, "passages_kept": 2}
    samples = read_samples(spark, samples_path)
    passages, again = prepare_counted(samples, 256)
    assert again == counts
    assert sorted(map(tuple, passages.collect())) == sorted(map(tuple, prepare_passages(samples, 256).collect()))


def test_judging_counts_beside_its_write(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("ID\tto_keep\tseed_noun\ttranslation\n1\ttrue\ta\tx\n2\tfalse\tb\ty\n3\ttrue\tc\tz\n")

    def judge():
        def run(prompts):
            if any("z" in p for p in prompts):
                raise ValueError("no")
            return ["None"] * len(prompts)

        return run

    from nounspan.operators.inference import CallPolicy

    policy = CallPolicy(max_attempts=1, sleep=lambda s: None)
    got = evaluation.run_judging(spark, str(tmp_path / "a.tsv"), str(tmp_path / "out"), judge, policy)
    assert got == {"rows": 3, "judged": 1, "failed": 1}


def test_observed_counts_equal_the_funnel_without_a_job_of_their_own(spark, tmp_path):
    df = spark.range(0, 1000, 1, 5).withColumn("x", F.when(F.col("id") % 7 > 0, F.col("id") % 10))
    stages = {"known": F.col("x").isNotNull(), "small": F.col("x") < 5, "even": F.col("id") % 2 == 0}
    seen = observed_funnel(df, stages)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("observed", "")
    seen.df.write.parquet(str(tmp_path / "o"))
    counts = seen.get()
    jobs = len(tracker.getJobIdsForGroup("observed"))
    spark.sparkContext.setJobGroup("plain", "")
    df.write.parquet(str(tmp_path / "p"))
    assert jobs == len(tracker.getJobIdsForGroup("plain"))
    assert counts == funnel(df, stages).first().asDict()
    assert spark.read.parquet(str(tmp_path / "o")).count() == counts["even"]
    plain = Observed(df)
    plain.df.write.parquet(str(tmp_path / "q"))
    assert plain.rows() == 1000


def test_tables_in_buckets_meet_without_an_exchange(spark, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(500).select("id", F.concat(F.lit("q"), "id").alias("english"))
        right = spark.range(0, 500, 3).select("id", F.lit("x").alias("completion"))
        joined = join_completions(write_bucketed(left, "id", buckets=4), write_bucketed(right, "id", buckets=4))
        assert "Exchange" not in plan(joined) and joined.filter("completion = 'x'").count() == 167
        samples = spark.createDataFrame([("t", 2, ["a", "b"]), ("u", 0, None)], "term string, total_selected int, selected array<string>")
        done = spark.createDataFrame([("t", 1, "B"), ("t", 0, "A")], "seed string, pos int, completion string")
        grouped = regroup_completions(write_bucketed(samples, "term", buckets=4), write_bucketed(done, "seed", buckets=4))
        assert "Exchange" not in plan(grouped)
        assert {r["term"]: r["translation"] for r in grouped.collect()} == {"t": ["A", "B"], "u": []}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
