"""The operators on the small tables, against brute force."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("nounspan.llm")

from nounspan.llm import jaccard, langid, licenses, mixing, packing, pii, sharding, warc  # noqa: E402
from nounspan.llm.queries import ORACLES, QUERIES, default_vocabulary  # noqa: E402
from tools.check import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]).startswith("ok")


def test_mixing_comes_near_its_targets(spark, sf, docs):
    rows = QUERIES["op3_mixing"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"] or "")
        assert r["size"] == len(words) and r["taken"] % max(r["size"], 1) == 0
        assert r["taken"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    wanted = brute_targets(size)
    longest = defaultdict(int)
    for r in rows:
        assert r["source_size"] == size[r["source"]]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for source in size:
        assert target[source] == pytest.approx(wanted[source], rel=1e-12)
        assert abs(taken[source] - wanted[source]) <= longest[source]
    again = QUERIES["op3_mixing"](spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def brute_targets(size):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * size[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return target


def test_rounding_keeps_words_and_is_unbiased():
    size = np.array([5.0, 9, 2, 30, 7, 1])
    part = np.array([0.3, 0.5, 0.9, 0.2, 0.65, 0.4])
    rng, seen = np.random.default_rng(1), np.zeros(6)
    for _ in range(4000):
        got = mixing.pivot(size, part, rng.random(6))
        assert got @ size == pytest.approx(part @ size)
        assert ((got > 0) & (got < 1)).sum() <= 1
        seen += got
    assert np.abs(seen / 4000 - part).max() < 0.03


def test_rounding_tree_with_many_blocks(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = QUERIES["op3_mixing"](spark, sf).collect()
    taken, target, most = Counter(), {}, Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert len(rows) == 200 and all(abs(taken[s] - target[s]) <= most[s] for s in target)


def test_licenses(spark, sf, docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    rows = {r["doc_id"]: r for r in QUERIES["op5_licenses"](spark, sf).collect()}
    assert set(rows) == set(docs)
    hits = 0
    for doc_id, row in rows.items():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), docs[doc_id]["text"] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        found = [
            (i, label)
            for phrase, label in phrases.items()
            for i in range(len(words))
            if words[i : i + len(phrase.split())] == phrase.split()
        ]
        hits += len(found)
        starts = [i for i, _ in found]
        labels = {label for _, label in found}
        assert row["n_words"] == len(words) and row["n_base"] == len(found)
        assert (row["first_word"], row["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert row["base_labels"] == ",".join(sorted(labels))
        assert labels <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1
    assert hits


def test_packing(spark, sf, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_vocabulary())
    rows = QUERIES["op6_packing"](spark, sf).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for doc_id, pieces in by_doc.items():
        ids = whole.encode(docs[doc_id]["text"] or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            part = np.array(ids[at : at + p["length"]], "<u4")
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
            at += p["length"]
        assert at == len(ids)
    tokens = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and len(pieces) <= 256
        tokens += at
    assert tokens / (2048 * len(by_sequence)) > 0.9


@pytest.mark.parametrize(
    "text",
    ["Word, word; WORD!", "don't it's", "ÀÉ café café, x", "İstanbul ΣΑΣ", "a<|endoftext|>b", "12 3.4 日本語。", " x y\tz\r\nq", "", "  \n ", "ªº ß ĳ ŉ ǅ"],
)
def test_word_ids_equal_the_whole_text(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_vocabulary()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.WordIds(default_vocabulary()).of(text), "<u4").tolist() == whole


def test_packing_keeps_all_three_limits(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        n = int(rng.integers(0, 90))
        rows.append((i, list(range(n)), [bool(x) for x in rng.random(n) < 0.4]))
    rows += [(300, list(range(101)), None), (301, [], None), (302, None, None)]
    df = spark.createDataFrame(rows, "id long, ids array<int>, bears_loss array<boolean>")
    got = packing.pack_examples(df, max_tokens=100, max_segments=4, max_loss=30).collect()
    assert sorted(r["id"] for r in got) == sorted(r[0] for r in rows)
    loss_of = {i: (sum(m) if m is not None else len(x or [])) for i, x, m in rows}
    bins = defaultdict(list)
    for r in got:
        if r["sequence_id"] is None:
            assert r["doc_tokens"] > 100 or loss_of[r["id"]] > 30
        else:
            bins[r["sequence_id"]].append(r)
    for pieces in bins.values():
        assert sum(p["length"] for p in pieces) <= 100 and len(pieces) <= 4
        assert sum(loss_of[p["id"]] for p in pieces) <= 30


def test_personal_data(spark, sf, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op7_pii"](spark, sf).collect()}
    assert set(rows) == set(docs)
    seen = Counter()
    for doc_id, row in rows.items():
        spans = brute_spans(docs[doc_id]["text"] or "")
        for kind in pii.KINDS:
            n = sum(s[0] == kind for s in spans)
            assert row[f"n_{kind}"] == n
            seen[kind] += n
        shown = ",".join(":".join(map(str, s)) for s in spans)
        assert row["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert row["spans"].startswith(shown)
        if not spans:
            assert row["spans"] == ""
    assert all(seen[k] for k in ("email", "ip", "card"))


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


@pytest.mark.parametrize(
    "text",
    ["a@b.c+d@e.f", "x@y@z.com", "@a.b", "a@b", "1.2.3.4.5.6.7.8", "1.2.3.999 9.9.9.9", "00001.2.3.4",
     "4111 1111 1111 1111", "4111-1111-1111-1111-1", "5 6", "+1 (2) 345-678-90)", "++12345678901", "é@b.cd a.b@c-d.e.f."],
)
def test_patterns_equal_plain_regular_expressions(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_a_disclosing_word_is_found_and_a_common_one_is_not(spark):
    rows = [(i, f"common words here {i} call zanzibar at joe@ex.org today") for i in range(4)]
    rows += [(i, "common words here today call at noon") for i in range(4, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(df).collect()}
    terms = {rows[i][1][s["start"] : s["end"]] for i in range(4) for s in found[i] if s["kind"] == "term"}
    assert terms == {"zanzibar"} and all(not found[i] for i in range(4, 60))
    clean = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(df).collect()}
    assert clean[0] == "common words here 0 call [REMOVED] at [EMAIL] today"


def test_shards_are_exact(spark, sf, docs):
    rows = QUERIES["op8_sharding"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    shards = defaultdict(list)
    for r in rows:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert r["size"] == len(text) + 16 and r["text_crc32"] == zlib.crc32(text)
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_hypergeometric_law():
    rng = np.random.default_rng(5)
    got = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20000)]
    assert abs(np.mean(got) - 6) < 0.05 and abs(np.var(got) - 20 * 0.3 * 0.7 * 80 / 99) < 0.12
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0
    assert abs(sharding.hypergeometric(rng, 10**9, 39 * 10**9, 10**7) - 250_000) < 5_000
    matrix = sharding.communication_matrix([7, 0, 13, 20], [14, 13, 13], 1)
    assert [sum(r) for r in matrix] == [7, 0, 13, 20] and [sum(c) for c in zip(*matrix)] == [14, 13, 13]


def test_language_of_held_out_documents(spark, sf, docs):
    rows = QUERIES["op9_language"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    out = [r for r in rows if r["held_out"]]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out)
    assert right / len(out) > 0.95


def test_ngrams():
    grams = langid.grams_of("Ab1 é")
    spelt = Counter("".join(chr(c) for c in (g >> 42, (g >> 21) & (2**21 - 1), g & (2**21 - 1)) if c) for g in grams.tolist())
    assert spelt == Counter(["a", "b", "é", " a", "ab", "b ", " é", "é ", " ab", "ab ", " é "])
    assert len(langid.grams_of("12 3")) == 0


def brute_components(texts):
    sets = {}
    for key, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if words:
            width = min(5, len(words))
            sets[key] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        else:
            sets[key] = set()
    root = {k: k for k in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {k: (len(sets[k]), top(k)) for k in texts}


def test_jaccard_components(spark, sf, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op10_jaccard"](spark, sf).collect()}
    assert got == brute_components({k: r["text"] for k, r in docs.items()})


def test_jaccard_components_of_hard_cases(spark, monkeypatch):
    """A large group of near copies, chains, a passage that all share, short and blank texts."""
    monkeypatch.setattr(jaccard, "PIECE", 8)
    monkeypatch.setattr(jaccard, "BUCKET_ENTRIES", 500)
    monkeypatch.setattr(jaccard, "HOT_GROUPS", 2)
    rng = np.random.default_rng(11)
    word = lambda: "w" + str(rng.integers(0, 10**6))
    passage = [word() for _ in range(40)]
    base = [word() for _ in range(60)]
    texts = []
    for _ in range(40):
        copy = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 3)):
            copy[at] = word()
        texts.append(" ".join(copy))
    for _ in range(30):
        texts.append(" ".join(passage + [word() for _ in range(int(rng.integers(0, 60)))]))
    chain = [word() for _ in range(50)]
    for _ in range(25):
        texts.append(" ".join(chain))
        chain = chain[2:] + [word(), word()]
    texts += ["", None, " \t ", "one two", "ONE  two", "one two three", "a b c d e", "a b c d e f", "x " * 30, "x " * 9]
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[k]) for i, k in enumerate(order)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute_components(dict(rows))


def test_normalised_word_ids_cover_unicode():
    assert unicodedata.is_normalized("NFC", "é") and packing.WordIds.plain("é") and not packing.WordIds.plain("é")


def test_warc_members_and_revisits(spark, tmp_path):
    big, other = "x" * 1500, "é" * 700
    rows = [(1, "http://a/ b", big), (5, None, big), (3, "http://c", big), (4, "u", "small"), (7, "u", "small"),
            (8, "v", None), (9, "w", other), (2, "w", other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_warc(df, str(tmp_path / "a"), file_bytes=300)
    first = sorted(map(tuple, manifest.collect()))
    back = {r["page_id"]: r for r in warc.read_warc(spark, str(tmp_path / "a")).collect()}
    assert len(back) == 8 and all(r["intact"] for r in back.values())
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if h == html]
        keeper = max(same) if len(payload) >= 1000 else page_id
        row = back[page_id]
        assert row["payload_bytes"] == len(payload) and row["payload_digest"] == hashlib.sha1(payload).hexdigest()
        assert row["refers_to"] == (None if keeper == page_id else keeper)
        assert row["record_type"] == ("response" if keeper == page_id else "revisit")
        assert bytes(row["payload"]) == (payload if keeper == page_id else b"")
    again = warc.write_warc(df.repartition(5), str(tmp_path / "b"), file_bytes=300)
    assert sorted(map(tuple, again.collect())) == first and len(first) > 1
