"""Every row is decided by its own content: missing and repeated ids, copies, uniform places."""

import hashlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("nounspan.llm")

from pyspark.sql import functions as F  # noqa: E402

from nounspan.llm import pii, sharding, warc  # noqa: E402
from nounspan.llm.queries import QUERIES  # noqa: E402


def test_sanitise_keeps_every_row_and_leaks_none(spark):
    rows = [(1, "write joe@ex.org"), (1, "other text"), (None, "write ann@ex.org"), (None, None), (2, ""), (2, ""), (1, "write joe@ex.org")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, spans string, row int")
    got = [tuple(r) for r in pii.sanitise(df).collect()]
    wanted = [(1, "write [EMAIL]"), (1, "other text"), (None, "write [EMAIL]"), (None, None), (2, ""), (2, ""), (1, "write [EMAIL]")]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert pii.sanitise(df.filter("false")).collect() == []


def test_copies_are_one_piece_of_evidence(spark):
    common = " ".join(f"word{i}" for i in range(30))
    copy = "ask mellon at joe@ex.org for zarro"
    rows = [(i, copy) for i in range(5)] + [(10 + i, f"{common} {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert not any(s["kind"] == "term" for r in pii.find_personal_data(df).collect() for s in r["spans"])
    # Two different texts are evidence.
    more = df.unionByName(spark.createDataFrame([(99, "mellon wrote to joe@ex.org again")], df.schema))
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(more).collect()}
    assert [copy[s["start"] : s["end"]] for s in found[0] if s["kind"] == "term"] == ["mellon"]
    assert pii.distinct_evidence(more.select("text")).count() == 62


def brute_strengths(texts):
    """Normalised pointwise mutual information over distinct texts, the largest of each term."""
    texts = sorted({t or "" for t in texts})
    held = []
    for text in texts:
        spans = pii.base_spans(text)
        entities = {pii.entity_of(kind, text[a:b]) for kind, a, b in spans}
        words = {m[0].lower() for m in pii._WORD.finditer(text) if not any(a < m.end() and m.start() < b for _, a, b in spans)}
        held.append((entities, words))
    n = len(texts)
    entity, word, both = Counter(), Counter(), Counter()
    for entities, words in held:
        entity.update(entities)
        word.update(words)
        both.update((e, w) for e in entities for w in words)
    out = {}
    for (e, w), k in both.items():
        if k >= pii.LEAST_DOCS and np.log(n / entity[e]) > 0:
            strength = np.log(k * n / (word[w] * entity[e])) / np.log(n / entity[e])
            if strength >= pii.GENERALISE_AT:
                out[w] = max(out.get(w, 0.0), strength)
    return out


def test_strengths_equal_brute_force(spark, sf):
    rng = np.random.default_rng(3)
    names = [f"Name{chr(97 + i)}" for i in range(12)]
    texts = []
    for i in range(150):
        who = int(rng.integers(0, 12))
        said = " ".join(rng.choice([f"w{chr(97 + k)}ord" for k in range(26)], 8))
        texts.append(f"{said} {names[who] if rng.random() < 0.8 else ''} u{who}@ex.org" if i % 3 else said)
    texts += texts[:40] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["term"]: r["strength"] for r in pii.disclosing_terms(pii.distinct_evidence(df)).collect()}
    wanted = brute_strengths(texts)
    assert wanted and got.keys() == wanted.keys()
    assert all(got[w] == pytest.approx(wanted[w], rel=1e-9) for w in wanted)


def test_all_spans_are_shown(spark, sf):
    rows = QUERIES["op7_pii"](spark, sf).collect()
    for r in rows:
        shown = [s.split(":") for s in r["spans"].split(",") if s]
        kinds = Counter(kind for kind, _, _ in shown)
        assert all(kinds[k] == r[f"n_{k}"] for k in ("email", "ip", "card", "phone", "term"))
        base = ",".join(":".join(s) for s in shown if s[0] != "term")
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]


def test_payloads_of_one_id_or_of_none_are_kept_apart(spark, tmp_path):
    p, q = "p" * 1500, "q" * 1500
    rows = [(5, "u", p), (5, "u", q), (9, "u", q), (None, "a", q), (None, "b", None), (None, "c", p), (3, None, ""), (5, "u", p)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, key int")
    back = warc.through_warc(df, str(tmp_path / "w")).collect()
    assert len(back) == len(rows) and all(r["intact"] for r in back)
    got = sorted(((r["page_id"], r["payload_digest"][:8], r["record_type"], r["refers_to"]) for r in back), key=repr)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()[:8]
    wanted = [
        (5, sha(p), "response", None), (5, sha(p), "response", None), (5, sha(q), "revisit", 9), (9, sha(q), "response", None),
        (None, sha(q), "revisit", 9), (None, sha(None), "response", None), (None, sha(p), "revisit", 5), (3, sha(""), "response", None),
    ]
    assert got == sorted(wanted, key=repr)
    stored = {bytes(r["payload"]) for r in back if r["record_type"] == "response"}
    assert {p.encode(), q.encode(), b""} == stored
    empty = warc.through_warc(df.filter("false"), str(tmp_path / "e"))
    assert empty.collect() == []


def test_members_are_read_across_pieces(monkeypatch):
    import gzip

    records = [warc.record(i, f"http://h/{i}", bytes([65 + i % 26]) * (i * 37), None) for i in range(60)]
    content = b"".join(gzip.compress(r, 6, mtime=0) for r in records)
    whole = list(warc.records_of(content))
    assert [r["page_id"] for r in whole] == list(range(60)) and all(r["intact"] for r in whole)
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    assert list(warc.records_of(content)) == whole


def test_the_local_permutation_is_one_and_even():
    for n in (1, 2, 3, 17, 64, 1000):
        out = sharding.permuted(np.arange(n), n, sharding._key(1, n))
        assert sorted(out.tolist()) == list(range(n))
    # Each place of a small partition comes first, second, ... equally often.
    counts = np.zeros((6, 6))
    for seed in range(3000):
        counts[np.arange(6), sharding.permuted(np.arange(6), 6, sharding._key(seed)).astype(int)] += 1
    assert ((counts - 500) ** 2 / 500).sum() < 60  # 25 degrees of freedom, chance below 1e-4


def test_places_are_uniform_over_seeds(spark):
    rows = spark.range(0, 24, 1, 3).select("id", F.lit("same").alias("text"))
    counts, seeds = np.zeros((24, 4)), 60
    for seed in range(seeds):
        got = sharding.shuffle_into_shards(rows, 4, seed).select("row.id", "shard", "slot").collect()
        assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(4) for k in range(6)]
        for r in got:
            counts[r["id"], r["shard"]] += 1
    mean = seeds / 4
    assert ((counts - mean) ** 2 / mean).sum() < 125  # some 69 degrees of freedom, chance below 1e-4


def test_equal_rows_fill_all_shards(spark):
    rows = spark.range(0, 1000, 1, 5).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("row"))
    got = Counter(r["shard"] for r in sharding.shuffle_into_shards(rows, 7).collect())
    assert sorted(got.values()) == [142] * 1 + [143] * 6
    again = sharding.shuffle_into_shards(rows, 7).select("shard", "slot")
    assert sorted(map(tuple, again.collect())) == [(s, k) for s in range(7) for k in range(got[s])]
