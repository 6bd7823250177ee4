"""Large groups of near copies: links in proportion, decisions for each row, files deleted."""

import os

import numpy as np
import pytest

pytest.importorskip("nounspan.llm")

import pandas as pd  # noqa: E402

from nounspan.llm import jaccard  # noqa: E402
from nounspan.session import scratch_dir  # noqa: E402


def copies(n, edits, seed=5, length=60):
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(rng.integers(0, 10**6))
    base = [word() for _ in range(length)]
    out = []
    for i in range(n):
        copy = list(base)
        for at in rng.integers(0, length, edits):
            copy[at] = word()
        out.append((i, " ".join(copy)))
    return out


def brute(rows):
    sets = {i: jaccard.shingles(t.encode()) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if find(a) != find(b) and jaccard.linked(sets[a], sets[b]):
                low, high = sorted((find(a), find(b)))
                top[high] = low
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("edits", [1, 2])
def test_links_grow_in_proportion_to_the_copies(spark, monkeypatch, edits):
    made = []
    cross = jaccard._cross_links

    def counted(*args):
        out = jaccard.checkpointed(cross(*args))
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_cross_links", counted)
    monkeypatch.setattr(jaccard, "PIECE", 64)
    for n in (200, 400, 800):
        rows = copies(n, edits)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
        assert got == brute(rows)
    # A forest for each pair of pieces: never near the number of pairs, nor above the members by much.
    assert all(links <= 2 * n for links, n in zip(made, (200, 400, 800)))


def test_a_piece_gives_a_forest():
    rows = copies(60, 2)
    sets = [jaccard.shingles(t.encode()) for _, t in rows]
    frame = pd.DataFrame(
        {"node": [jaccard.node_of(s) for s in sets], "tokens": [s.tobytes() for s in sets], "leads": [i == 7 for i in range(60)]}
    )
    out = jaccard._open_own(frame)
    top = brute(rows)
    assert len(out) == 60 - len(set(top.values()))
    members = pd.DataFrame({"node": frame["node"], "component": range(60), "tokens": frame["tokens"]})
    assert len(jaccard._opened(members, members)) == 60 - len(set(top.values()))


def test_rows_of_one_id_are_decided_by_their_texts(spark):
    c, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "cb")
    near = lambda t: t + " more"
    rows = [(1, c), (3, b), (3, near(c)), (7, near(b)), (7, near(b)), (None, near(c)), (9, None), (10, ""), (9, None)]
    rows += [(20, b.upper() + " z"), (30, "x " * 40 + "y"), (30, "X " * 40 + "y"), (31, "x " * 40 + "Y")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, mark int")
    out = jaccard.one_of_each(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    kept = [(1, c), (3, b), (None, near(c)), (9, None), (9, None), (10, "")]
    thirty = [r for r in got if r[0] == 30]
    assert len(thirty) == 1 and thirty[0] in rows
    assert got == sorted(kept + thirty, key=repr)


def test_no_checkpoint_is_left(spark):
    def files():
        place = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = place.get().removeprefix("file:") if place.isDefined() else scratch_dir(spark)
        return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names}

    df = spark.createDataFrame(copies(30, 1), "doc_id long, text string")
    jaccard.jaccard_components(df).collect()
    before = files()
    jaccard.jaccard_components(df).collect()
    new = {f for f in files() - before if "/rdd-" in f}
    assert new == set()
