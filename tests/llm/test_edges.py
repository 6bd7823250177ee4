"""Nulls, blank and repeated rows, empty tables and clashing column names."""

import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("nounspan.llm")

from nounspan.llm import exact_dedup, fingerprints, jaccard, langid, licenses, mixing, packing, pii, sharding  # noqa: E402
from nounspan.llm.queries import QUERIES, default_vocabulary  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, kept int, row int, key int, piece int, label int"
ROWS = [
    (1, "a b c d e f", "en", "s", 1, 2, 3, 4, 5),
    (1, "a b c d e f", "en", "s", 1, 2, 3, 4, 5),
    (2, None, None, None, None, None, None, None, None),
    (None, "", "en", "s", 1, 2, 3, 4, 5),
    (None, "x" * 50_000, None, None, 1, 2, 3, 4, 5),
    (5, " \n\t ", "fr", "t", 1, 2, 3, 4, 5),
]

OPERATORS = {
    "fingerprints": fingerprints.compared,
    "exact": exact_dedup.exact_dedup,
    "mix": mixing.mix,
    "licenses": licenses.scan_licenses,
    "pii": pii.find_personal_data,
    "shards": lambda df: sharding.shuffle_into_shards(df, 3),
    "language": lambda df: langid.predict(df, langid.fit_profiles(df)),
    "jaccard": jaccard.jaccard_components,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_each_row_once_and_empty_tables(spark, name):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert len(OPERATORS[name](df).collect()) == len(ROWS)
    assert OPERATORS[name](df.filter("false")).collect() == []


def test_packing_of_edges(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    rows = packing.pack_texts(df, default_vocabulary()).collect()
    assert sum(r["start"] == 0 for r in rows) == len(ROWS)
    assert packing.pack_texts(df.filter("false"), default_vocabulary()).collect() == []


@pytest.mark.parametrize("stage", [exact_dedup.distinct_texts, jaccard.one_of_each, mixing.mixed_documents])
def test_stages_return_the_columns_of_documents(spark, stage):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = stage(df)
    assert out.columns == df.columns and set(map(tuple, out.collect())) <= set(ROWS)
    assert stage(df.filter("false")).collect() == []


@pytest.mark.parametrize("listed", [8_000_000, -1])
def test_a_disclosing_word_is_found_far_from_its_entity_and_without_it(spark, monkeypatch, listed):
    monkeypatch.setattr(pii, "LISTED_BYTES", listed)
    gap = "common words " * 20
    # The numbers make the texts different: copies would be one piece of evidence.
    rows = [(i, f"joe@ex.org {gap}{'Zanzibar zanzibar' if i else gap} {i}") for i in range(10)]
    rows += [(10, f"Zanzibar {gap}"), (11, None)] + [(i, f"{gap} {i}") for i in range(12, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(df).collect()}
    assert len(found) == 200
    for i, text in rows:
        places = [s["start"] for s in found[i] if s["kind"] == "term"]
        assert places == [m.start() for m in re.finditer("(?i)zanzibar", text or "")]
    assert "anzibar" not in "".join(r["sanitised"] or "" for r in pii.sanitise(df).collect())


LINE = " ".join(f"word{i}" for i in range(16))


@pytest.mark.parametrize(
    "a, b, least, most",
    [
        (LINE, LINE + " more", 0.9, 0.99),
        (LINE.replace(" ", "\t"), LINE.replace(" ", "\t").replace("word8", "other"), 0.6, 0.95),
        ("".join(map(chr, range(0x4E00, 0x4E64))), "".join(map(chr, [*range(0x4E00, 0x4E4B), *range(0x5000, 0x5019)])), 0.7, 0.8),
        ("abc", "abd", 0.6, 0.7),
        ("日本語文", "日本語字", 0.75, 0.75),
        ("ab cd ef gh ij", "ab cd ef gh kl", 0.6, 0.9),
        ("one two " * 3000, "one two " * 2250 + "three four " * 500, 0.7, 0.85),
        ("", None, 1.0, 1.0),
    ],
)
def test_likeness_follows_the_unchanged_share(spark, a, b, least, most):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(fingerprints.likeness(fingerprints.tree(df["a"]), fingerprints.tree(df["b"]))).first()[0]
    assert least <= got <= most


@pytest.mark.parametrize("full", [0, 3])
def test_every_empty_example_has_a_piece(spark, full):
    rows = [(i, [] if i % 2 else None, None) for i in range(50)] + [(50 + i, [7] * 10, None) for i in range(full)]
    df = spark.createDataFrame(rows, "id long, ids array<int>, bears_loss array<boolean>").coalesce(1)
    got = packing.pack_examples(df, max_tokens=10, max_segments=4, max_loss=10, pool_items=8).collect()
    assert sorted(r["id"] for r in got) == [r[0] for r in rows]
    assert max(Counter(r["sequence_id"] for r in got).values()) <= 4
    assert all(r["length"] == 0 and r["offset"] == 0 for r in got if r["id"] < 50)


def test_shards_receive_whole_documents(spark, sf, monkeypatch):
    arrived = []
    deal = sharding.shuffle_into_shards

    def seen(df, *more):
        arrived.append(deal(df, *more))
        return arrived[-1]

    monkeypatch.setattr(sharding, "shuffle_into_shards", seen)
    rows = QUERIES["op8_sharding"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in arrived[0].select("row.doc_id", "row.text").collect()}
    assert len(rows) == len(texts)
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
