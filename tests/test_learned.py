"""Learned abbreviations, repair to a fixed point, ridge over a grid."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nounspan.functions import text as X
from nounspan.operators import abbreviations as A
from nounspan.operators.concordance import concordance, sentence_table
from nounspan.operators.ridge import products, ridge_grid

TEXTS = [f"Dr. Smith met Mr. Jones, e.g. in town number {i}. They sat. The cat sat on a mat." for i in range(30)]
TEXTS += ["The mat was wet. A cat sat there. On a mat they met again, and a doctor came."] * 20 + [None, ""]


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


def test_scores_equal_a_plain_count(corpus):
    seen = [m for t in TEXTS for p in re.split(r"[ \t\r\n]+", t or "") if (m := re.match(r"""^[("']*([^\W\d_]+(?:[.][^\W\d_]+)*)([.]?)[,;:!?)"']*$""", p))]
    stop, whole = Counter(), Counter()
    for m in seen:
        whole[m[1].lower()] += 1
        stop[m[1].lower()] += m[2] != ""
    chance = sum(stop.values()) / len(seen)
    got = {r["word"]: r["score"] for r in A.abbreviation_scores(corpus).collect()}
    assert set(got) == {w for w in stop if stop[w] >= 3} and {"dr", "mr", "e.g"} <= set(got)
    for w, score in got.items():
        k, rest, n = stop[w], whole[w] - stop[w], len(w.replace(".", ""))
        rule = k * math.log(0.99) + rest * math.log(1 - 0.99)
        by_chance = k * math.log(chance) + rest * math.log(1 - chance)
        wanted = 2 * (rule - by_chance) * math.exp(-n) * (len(w) - n + 1) * float(n) ** -rest
        assert score == pytest.approx(wanted, rel=1e-9, abs=1e-12)


def test_a_title_ends_no_sentence(spark, corpus):
    learned = A.learned_abbreviations(corpus)
    assert {"dr", "mr", "e.g"} <= set(learned) and not {"sat", "mat"} & set(learned)
    first = sentence_table(corpus, abbreviations=learned).filter("doc_id = 0").orderBy("sent_pos").collect()
    assert [r["sentence"] for r in first] == [
        "Dr. Smith met Mr. Jones, e.g. in town number 0.", "They sat.", "The cat sat on a mat."
    ]
    cut = values(spark, ["X. Dr. Mr. Dr. A. B", "sdr. A", "DR. A\nE.g.\tB. C", "dr.", None], lambda c: X.split_sentences(c, ["dr", "mr", "e.g"]))
    assert cut == [["X.", "Dr. Mr. Dr. A.", "B"], ["sdr.", "A"], ["DR. A\nE.g.\tB.", "C"], ["dr."], None]


def test_passages_of_both_paths_follow_the_abbreviations(spark, corpus):
    terms = spark.createDataFrame([("smith", ["smith"]), ("town", ["town"])], "term string, term_tokens array<string>")
    few = concordance(corpus, terms, 0, 0, abbreviations=["dr", "mr", "e.g"])
    many = concordance(corpus, terms, 0, 0, abbreviations=["dr", "mr", "e.g"], max_terms=1)
    rows = sorted(map(str, few.collect()))
    assert rows == sorted(map(str, many.collect())) and len(rows) == 60
    assert all("Dr. Smith met Mr. Jones" in r for r in rows)


def test_texts_misread_again_and_again_come_back(spark):
    def misread(t):
        return "".join(bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in t.encode())

    clean = ["schön — “so”… für 5 €", "É Ñ ß ÿ ™ Œuvre", "plain", "Â", "Ã und Å allein", ""]
    once = [misread(t) for t in clean]
    twice = [misread(t) for t in once]
    wanted = values(spark, clean, X.repair_text)
    assert wanted[2:] == ["plain", "Â", "Ã und Å allein", ""]
    for damaged in (once, twice, [misread(t) for t in twice]):
        assert values(spark, damaged, X.repair_text) == wanted


def brute_ridge(x, y, penalty):
    mean, sd, sy = x.mean(0), x.std(0), y.std()
    used = sd > 0
    z = (x[:, used] - mean[used]) / sd[used]
    b = np.linalg.solve(z.T @ z / len(y) + penalty / sy * np.eye(used.sum()), z.T @ ((y - y.mean()) / sy) / len(y))
    w = np.zeros(x.shape[1])
    w[used] = b * sy / sd[used]
    return y.mean() - w @ mean, w


def test_grid_equals_the_solver_of_the_library(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    x[:, 3] = 7.0
    y = x @ np.array([1.0, -2.0, 0.0, 5.0, 0.5]) + rng.normal(size=400)
    rows = [([float(v) for v in a], float(b), "train" if i % 4 else "val") for i, (a, b) in enumerate(zip(x, y))]
    rows += [([0.0] * 5, None, "train"), ([0.0] * 5, 1.0, None), ([0.0] * 5, 1.0, "test")]
    df = spark.createDataFrame(rows, "x array<double>, y double, s string").repartition(70)
    grid = (0.01, 0.1, 1.0)
    got = ridge_grid(df, "x", "y", "s", grid)
    train = np.arange(400) % 4 != 0
    fit = df.filter("s = 'train' AND y IS NOT NULL").select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    check = df.filter("s = 'val'").select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    for penalty in grid:
        error, weights = got[penalty]
        intercept, w = brute_ridge(x[train], y[train], penalty)
        assert weights == pytest.approx([intercept, *w], rel=1e-9, abs=1e-9)
        model = LinearRegression(regParam=penalty, maxIter=30).fit(fit)
        theirs = model.transform(check).agg(F.avg(F.pow(F.col("label") - F.col("prediction"), 2))).first()[0]
        assert error == pytest.approx(theirs, abs=1e-9)
    assert products(df, "x", "y", "s")["train"].n == 300


def test_no_rows_to_fit_on(spark):
    df = spark.createDataFrame([([1.0], 1.0, "train")], "x array<double>, y double, s string")
    with pytest.raises(ValueError):
        ridge_grid(df, "x", "y", "s", [0.1])
    same = spark.createDataFrame([([1.0], 1.0, s) for s in ("train", "train", "val")], df.schema)
    assert ridge_grid(same, "x", "y", "s", [0.1])[0.1][0] == pytest.approx(0.0)


def test_products_copy_a_few_rows_at_a_time():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from nounspan.operators import ridge

    n, width = 10_000, 128
    x = np.random.default_rng(1).random((n, width))
    lists = pa.ListArray.from_arrays(pa.array(range(0, n * width + 1, width), pa.int32()), pa.array(x.reshape(-1)))
    batch = pa.RecordBatch.from_arrays([lists, pa.array(x[:, 0]), pa.array(["train", "val"] * (n // 2))], ["x", "y", "g"])
    tracemalloc.start()
    (sent,) = ridge._summed(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The whole batch is 10 MB.
    assert peak < 5_000_000
    whole = np.column_stack([np.ones(n), x, x[:, 0]])[::2]
    sums = dict(zip(sent.column("g").to_pylist(), sent.column("sums").to_pylist()))
    assert np.allclose(np.frombuffer(sums["train"]).reshape(width + 2, -1), whole.T @ whole)
