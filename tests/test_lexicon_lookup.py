"""Seeds looked up by suffixes of the lexicon's phrases."""

import random

import pytest

from nounspan.operators import evaluation, lexicon


def words(rng, n):
    return ["".join(rng.choice("abé𝔘 ") for _ in range(rng.randrange(12))) for _ in range(n)]


@pytest.fixture
def phrases(spark):
    rng = random.Random(4)
    rows = [(i * 3 + 1, w.upper() if i % 4 else w) for i, w in enumerate(words(rng, 120))]
    rows += [(900, None), (901, ""), (902, "aaaaaaaaaaaa"), (0, "the long phrase of the lexicon"), (903, rows[7][1])]
    rng.shuffle(rows)
    return rows


def brute(rows, seed):
    return min((n for n, p in rows if p is not None and seed is not None and seed in p.lower()), default=None)


@pytest.mark.parametrize("key", [1, 3, 6, 40])
def test_equal_to_a_scan_in_file_order(spark, phrases, key):
    rng = random.Random(key)
    seeds = {w.strip() for w in words(rng, 80)} | {"", "a", "aaaaaa", "long phrase", "of the lexicon", "x" * 50}
    seeds |= {p.lower()[1:] for _, p in phrases if p} | {p.lower() for _, p in phrases if p}
    lex = spark.createDataFrame(phrases, "row_no long, english string")
    pieces = spark.createDataFrame([(s,) for s in sorted(seeds)], "piece string")
    got = {r["piece"]: r["row_no"] for r in lexicon.first_rows(pieces, lexicon.distinct_phrases(lex), key).collect()}
    assert got == {s: brute(phrases, s) for s in seeds if brute(phrases, s) is not None}


def test_the_table_has_a_bounded_row_for_each_character(spark, phrases):
    lex = spark.createDataFrame(phrases, "row_no long, english string")
    table = lexicon.suffix_table(lexicon.distinct_phrases(lex), 6).collect()
    assert len(table) == sum(len(p) for p in {p.lower() for _, p in phrases if p is not None})
    assert max(len(r["key"]) for r in table) == 6


def test_no_lexicon_and_no_seeds(spark):
    none = spark.createDataFrame([], "row_no long, english string")
    pieces = spark.createDataFrame([("a",), ("",)], "piece string")
    some = spark.createDataFrame([(1, "a")], "row_no long, english string")
    assert lexicon.first_rows(pieces, lexicon.distinct_phrases(none)).collect() == []
    assert lexicon.first_rows(pieces.filter("false"), lexicon.distinct_phrases(some)).collect() == []


def test_both_sides_of_the_switch(spark, phrases, monkeypatch):
    columns = "row_no long, english string, german_mp string, german_fp string, gender_neutral string, gender_inclusive string"
    lex = spark.createDataFrame([(n, p, "m", "f", "", "i") for n, p in phrases], columns)
    seeds = spark.createDataFrame([(s,) for s in ("a", "b", "ab", "", None, "zz", "long", "long")], "seed_noun string")
    near = sorted(map(str, evaluation.match_lexicon(seeds, lex).collect()))
    monkeypatch.setattr(evaluation.few_pieces, "__defaults__", (0,))
    far = sorted(map(str, evaluation.match_lexicon(seeds, lex).collect()))
    assert near == far and len(near) == 8


def test_the_lookup_of_a_large_lexicon_runs_once(spark, phrases, monkeypatch):
    columns = "row_no long, english string, german_mp string, german_fp string, gender_neutral string, gender_inclusive string"
    lex = spark.createDataFrame([(n, p, "m", "f", "", "i") for n, p in phrases], columns)
    seeds = spark.createDataFrame([("a",), ("long phrase",), ("zz",)], "seed_noun string")
    monkeypatch.setattr(evaluation.few_pieces, "__defaults__", (0,))
    stored, asked = [], []
    kept, probe = evaluation.write_out, evaluation.small_side
    monkeypatch.setattr(evaluation, "write_out", lambda df, label: (stored.append(label), kept(df, label))[1])
    monkeypatch.setattr(evaluation, "small_side", lambda df: (asked.append(df.inputFiles()), probe(df))[1])
    monkeypatch.setattr(evaluation, "MAX_SMALL_ROWS", 5)
    evaluation.match_lexicon(seeds, lex).collect()
    # What is probed for a broadcast is a stored table, and the forms of many phrases are not probed.
    assert "first-rows" in stored and len(asked) == 1 and all("first-rows" in f for f in asked[0])
