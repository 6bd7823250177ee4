"""Removal of repeated byte strings against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("nounspan.llm")

from nounspan.llm import repeats  # noqa: E402
from nounspan.llm.common import Scratch, text_of  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def brute(texts, depth):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + depth] for d in data for p in range(len(d) - depth + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for p in range(len(d) - depth + 1):
            if seen[d[p : p + depth]] > 1:
                gone[p + 1 : p + 1 + depth] = True
        edge = np.flatnonzero(np.diff(gone.astype(int)))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        kept = bytes(b for b, g in zip(d, gone[1:]) if not g)
        out.append((len(d), int(gone.sum()), spans, kept))
    return out


def run(spark, rows, depth):
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, who int, spans int")
    got = repeats.without_repeats(df, depth=depth).collect()
    return sorted(
        (repr(r["doc_id"]), r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got
    )


def wanted(rows, depth):
    return sorted((repr(r[0]), *b) for r, b in zip(rows, brute([r[1] for r in rows], depth)))


def edited(rng, text):
    at = rng.randrange(len(text))
    return text[:at] + rng.choice(["", "x", "éé", text[:9]]) + text[at + rng.randrange(4) :]


@pytest.mark.parametrize("depth, seed", [(5, 1), (24, 2), (24, 3), (100, 4), (400, 5)])
def test_equal_to_brute_force(spark, depth, seed):
    rng = random.Random(seed)
    words = ["lorem", "ipsum", "dolor", "sit", "é", "𝔘", "a", "\n", "amet,"]

    def text(n):
        return " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(n))

    shared = [text(rng.randrange(1, 80)) for _ in range(6)]
    rows = []
    for i in range(120):
        t = "".join(rng.choice([text(rng.randrange(1, 40)), rng.choice(shared)]) for _ in range(rng.randrange(4)))
        rows.append((i, t))
    rows += [(200 + i, edited(rng, rows[rng.randrange(len(rows))][1] or "empty")) for i in range(60)]
    rows += [
        (300, None), (301, ""), (None, shared[0] * 2), (None, shared[0] * 2), (302, "a" * 3 * depth),
        (303, "b" + "a" * depth), (304, "ab" * 2 * depth), (305, "c" * (depth - 1)), (306, "c" * depth),
        rows[5], rows[5],
    ]
    rows = [(*r, 1, 2, None) for r in rows]
    assert run(spark, rows, depth) == wanted(rows, depth)


def test_many_copies_with_edits(spark):
    rng = random.Random(9)
    base = " ".join(str(rng.randrange(10**6)) for _ in range(120))
    rows = [(i, base if i % 3 else edited(rng, edited(rng, base)), 1, 2, None) for i in range(300)]
    rows += [(1000 + i, f"{rng.random()} " * 9 + base[200:500] + f" {rng.random()}" * 9, 1, 2, None) for i in range(100)]
    assert run(spark, rows, 100) == wanted(rows, 100)


def test_no_rows_and_only_short_rows(spark):
    assert run(spark, [], 400) == []
    rows = [(1, "short", 1, 2, None), (2, "short", 1, 2, None), (3, None, 1, 2, None)]
    assert run(spark, rows, 400) == wanted(rows, 400)


@pytest.mark.parametrize("size", [0, 399, 400, 401, 3000, 9000])
def test_runs_cover_every_start_once_whatever_the_step(size, monkeypatch):
    rng = random.Random(size)
    data = bytes(rng.choice(b"abcd") for _ in range(size)) + b"z" * (size // 3)
    whole = [a.tolist() for a in repeats.Anchors(400).runs(data)]
    monkeypatch.setattr(repeats, "STEP", 700)
    assert [a.tolist() for a in repeats.Anchors(400).runs(data)] == whole
    starts = [p for lo, hi, _, _ in zip(*whole) for p in range(lo, hi + 1)]
    assert starts == list(range(max(len(data) - 399, 0)))
    for lo, hi, at, _ in zip(*whole):
        assert 0 <= at - hi and at - lo < repeats.first_width(400)


def test_rows_of_later_passes_follow_the_edges_not_the_group(spark, monkeypatch):
    """Twice the copies of a passage bring twice the rows, in every table that is stored."""
    counts = defaultdict(list)
    store = Scratch.store

    def counted(self, df, name):
        out = store(self, df, name)
        counts[name].append(out.count())
        return out

    monkeypatch.setattr(Scratch, "store", counted)
    rng = random.Random(3)
    base = " ".join(str(rng.randrange(10**6)) for _ in range(80))
    rows = [(i, f"{rng.random()} {base} {rng.random()}") for i in range(400)]
    for n in (200, 400):
        docs = spark.createDataFrame(rows[:n], "key long, text string").select(
            "key", text_of("text").alias("text"), F.xxhash64("key").alias("who"), F.xxhash64("text").alias("also")
        )
        with Scratch(spark, "t") as scratch:
            repeats.repeated_starts(docs, 100, scratch).count()
    assert all(b <= 2.3 * a + 20 for a, b in counts.values())
