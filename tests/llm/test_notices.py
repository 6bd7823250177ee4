"""Licence labels and scores against a plain scan of every place."""

import random

import pytest

pytest.importorskip("nounspan.llm")

from nounspan.llm import licenses as L  # noqa: E402


def plain(words, weights):
    """Every template at every place: the key phrase in full, then the share of the weight."""
    out = []
    for number, (_, template, phrase) in enumerate(L.TEMPLATES):
        t, key = [w.encode() for w in template.split()], [w.encode() for w in phrase.split()]
        at = next(i for i in range(len(t)) if t[i : i + len(key)] == key)
        for start in range(-len(t), len(words)):
            lead = start + at
            if lead < 0 or words[lead : lead + len(key)] != key:
                continue
            if template == phrase:
                out.append((number, start, 1.0))
                continue
            total = sum(weights[w] for w in t)
            share = sum(weights[w] for i, w in enumerate(t) if 0 <= start + i < len(words) and words[start + i] == w) / total
            if share >= L.LEAST_SHARE:
                out.append((number, start, min(1.0, share)))
    return out


def texts():
    rng = random.Random(8)
    vocabulary = [w.decode() for w in L.vocabulary()]
    rows = ["", None, "gnu general public license", "mit mit license license mit license", "CC BY by cc by, cc-by"]
    for label, template, phrase in L.TEMPLATES:
        words = template.split()
        rows += [template, f"# {' * '.join(words)} trailing", f"see {phrase} here and again {phrase}"]
        for changed in (1, len(words) // 8 + 1, len(words) // 3 + 1):
            copy = list(words)
            for k in rng.sample(range(len(words)), min(changed, len(words))):
                copy[k] = rng.choice(["other", "word", words[k] + "s"])
            rows.append("Copyright 2024 Someone. " + " ".join(copy).upper() + " end")
        rows.append(" ".join(words[len(words) // 2 :]))
    rows += [" ".join(rng.choice(vocabulary) for _ in range(400)) for _ in range(40)]
    rows.append(" ".join(t for _, t, _ in L.TEMPLATES))
    return rows


def test_labels_and_scores_equal_a_plain_scan(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, labels string")
    weights = L.word_weights(df)
    got = {r["doc_id"]: r for r in L.scan_licenses(df).collect()}
    labels = set()
    for i, text in enumerate(rows):
        found = plain(L.words_of((text or "").encode()), weights)
        assert got[i]["labels"] == ",".join(sorted({L.TEMPLATES[k][0] for k, _, _ in found}))
        assert got[i]["score"] == pytest.approx(max((s for *_, s in found), default=0.0), abs=1e-12)
        assert sorted((p["label"], p["word"]) for p in got[i]["places"]) == sorted((L.TEMPLATES[k][0], s) for k, s, _ in found)
        labels |= {L.TEMPLATES[k][0] for k, _, _ in found}
    assert labels == {label for label, _, _ in L.TEMPLATES}


def test_a_file_is_looked_up_by_its_rarest_words():
    weights = {w: 1.0 for w in L.vocabulary()}
    weights |= {b"gnu": 9.0, b"public": 0.1, b"general": 8.0, b"license": 0.2, b"mit": 7.0}
    index = L.Index(weights)
    met = index.looked_up({b"gnu", b"general", b"public", b"license"})
    # The base phrase alone has all its key words here, and its two rarest are taken.
    assert met == {0: [b"gnu", b"general"]}
    assert index.looked_up({b"general", b"public", b"license"}) == {}
    # Words at other relative positions leave no start to compare.
    assert index.scan(b"general gnu public license".split()) == []
    assert [n for n, *_ in index.scan(b"gnu general public license".split())] == [0]
