"""Fill-in-the-middle examples against a plain implementation."""

import hashlib
import random
import re

import pytest

pytest.importorskip("nounspan.llm")

from pyspark.sql import functions as F  # noqa: E402

from nounspan.llm import infill  # noqa: E402

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [0, 1, 5, 70, 5_000, 70_000])
def test_every_cut_ends_on_its_code_point(size, monkeypatch):
    monkeypatch.setattr(infill, "STEP", 1 << 10)
    rng = random.Random(size)
    text = "".join(rng.choice(["a", "Zz" * 40, " ", "é", "\n", "𝔘", "k" * 3000 if size < 100 else "k"]) for _ in range(size))
    units = UNIT.findall(text)
    lanes = infill.SkipList(text)
    assert len(lanes) == len(units)
    ends = [0]
    for unit in units:
        ends.append(ends[-1] + len(unit))
    for rank in {0, len(units), *(rng.randrange(len(units) + 1) for _ in range(300))}:
        assert lanes.point(rank) == ends[rank]


ROWS = [
    (1, "One two, three.", 1, "x"),
    (1, "One two, three.", 1, "x"),
    (2, None, None, None),
    (3, "", 1, "x"),
    (None, "some text without an id", 1, "x"),
    (4, "holds <M> a mark", 1, "x"),
    (5, "<P <S> <", 1, "x"),
    (6, "ends with <", 1, "x"),
    (7, "<" * 9, 1, "x"),
    (8, "x" * 300_000 + " é" * 50_000, 1, "x"),
    *[(i, f"<S{i} text {i} of P> words < and > 𝔘{i}" * (i % 4 + 1), None, None) for i in range(10, 120)],
]


def test_rows_equal_a_plain_implementation_and_come_back(spark, monkeypatch):
    monkeypatch.setattr(infill, "BATCH_CHARS", 1_000)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, n int, output string")
    out = infill.fill_in_middle(df).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = out.collect()
    wanted = [(i, *brute(i, t or ""), t or "") for i, t, _, _ in ROWS]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(df.filter("false")).collect() == []


def test_shares_follow_the_parameters(spark):
    df = spark.range(3000).select(F.col("id").alias("key"), F.lit("some words of text").alias("text"))
    forms = infill.fill_in_middle(df, "key", seed=7, plain_percent=50, spm_percent=50).groupBy("form").count()
    counts = dict(map(tuple, forms.collect()))
    assert abs(counts["plain"] - 1500) < 150 and abs(counts["psm"] - 750) < 150
