"""The pipeline against plain versions of its stages; language distances against a plain implementation."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("nounspan.llm")
pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from nounspan.llm import jaccard, langid  # noqa: E402
from nounspan.llm.queries import QUERIES, default_vocabulary  # noqa: E402


def plain_grams(text):
    """Letter n-grams of one to three, words padded with a space, with their counts."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    line = " " + re.sub(" +", " ", low).strip(" ") + " "
    if line == "  ":
        return Counter()
    counts = Counter(c for c in line if c != " ")
    counts.update(line[i : i + 2] for i in range(len(line) - 1))
    counts.update(line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
    return counts


def plain_rank(counts, most):
    """Most frequent first; shorter n-grams and smaller code points first among equals."""
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][:most]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def plain_language(docs, size):
    counts = defaultdict(Counter)
    for d in docs:
        if d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2:
            counts[d["lang"]].update(plain_grams(d["text"] or ""))
    profiles = {lang: {g: i for i, g in enumerate(plain_rank(c, size))} for lang, c in sorted(counts.items())}

    def predict(text):
        own = plain_rank(plain_grams(text or ""), size)
        if not own:
            return "und", 0.0
        far = {
            lang: sum(abs(ranks[g] - i) if g in ranks else size for i, g in enumerate(own)) / (size * len(own))
            for lang, ranks in profiles.items()
        }
        best = min(far, key=lambda lang: (far[lang], lang))
        rest = min(v for lang, v in far.items() if lang != best)
        return best, (rest - far[best]) / rest if rest else 0.0

    return predict


def test_distances_equal_a_plain_implementation(spark, sf, docs):
    predict = plain_language(docs, langid.PROFILE)
    rows = {r["doc_id"]: r for r in QUERIES["op9_language"](spark, sf).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        lang, score = predict(d["text"])
        got = rows[d["doc_id"]]
        assert got["lang_pred"] == lang and got["score"] == pytest.approx(score, abs=1e-12)
        assert got["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)


def kept_by_near(rows):
    sets = {d["doc_id"]: jaccard.shingles((d["text"] or "").encode()) for d in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(i for i in sets if len(sets[i]))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if find(a) != find(b) and jaccard.linked(sets[a], sets[b]):
                low, high = sorted((find(a), find(b)))
                top[high] = low
    return [d for d in rows if find(d["doc_id"]) == d["doc_id"]]


def test_every_stage_works_on_what_the_one_before_kept(spark, sf, docs, monkeypatch):
    stored = []
    write = corpus_pipeline.write_out

    def seen(df, label):
        out = write(df, label)
        stored.append([r.asDict() for r in out.collect()])
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        return out

    monkeypatch.setattr(corpus_pipeline, "write_out", seen)
    pieces = corpus_pipeline.run(spark, sf).collect()
    language, exact, near, mixed = stored

    def same(got, wanted):
        assert sorted(map(repr, got)) == sorted(map(repr, wanted))

    predict = plain_language(docs, langid.PROFILE)
    same(language, [d for d in docs if predict(d["text"])[0] != "und"])

    best = {}
    for d in language:
        key = re.sub(r"[\x20\x09-\x0D]", "", d["text"] or "")
        rank = (-len(d["text"] or ""), d["doc_id"])
        best[key] = min(best.get(key, (rank, d)), (rank, d), key=lambda x: x[0])
    same(exact, [d for _, d in best.values()])

    same(near, kept_by_near(exact))

    words = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in near}
    times = Counter(d["doc_id"] for d in mixed)
    by_id = {d["doc_id"]: d for d in near}
    assert all(d == by_id[d["doc_id"]] for d in mixed) and max(times.values()) <= 2
    taken = sum(words[i] * n for i, n in times.items())
    assert abs(taken - 1.5 * sum(words.values())) <= 0.1 * sum(words.values())

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_vocabulary())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(times)
    for i, found in by_doc.items():
        ids = np.array(whole.encode(by_id[i]["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        assert sum(p["length"] for p in found) == len(ids) * times[i]
        for p in found:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(part.tobytes()) and len(part) == p["length"]
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
