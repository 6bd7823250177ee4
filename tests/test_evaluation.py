import pytest
from pyspark.sql import functions as F

from nounspan.catalog.base import lexicon
from nounspan.functions.forms import form_columns
from nounspan.operators import evaluation as E
from nounspan.operators.annotations import common_annotations, valid_annotations


def translations(spark, rows):
    return spark.createDataFrame(rows, "seed_noun string, translation string")


def indicators(spark, rows, **options):
    hits = E.form_hits(translations(spark, rows), lexicon(spark), **options)
    names = [f"{c}_count" for c in form_columns("plural")]
    return {(r["seed_noun"], r["translation"]): tuple(r[n] for n in names) for r in hits.collect()}


def test_form_columns():
    assert form_columns("data/terms_plural.csv")[:2] == ("german_mp", "german_fp")
    assert form_columns("data/terms.csv") == ("german_ms", "german_fs", "gender_neutral", "gender_inclusive")


def test_first_row_in_file_order_wins(spark):
    got = indicators(
        spark,
        [
            ("reedes", "die EINHEIT"),  # row 0 precedes row 1
            ("thedones", "belich"),  # alternatives of a cell
            ("nosuchseed", "heit einheit"),
            ("Inges", "ung"),  # only the lexicon side is lower-cased
            ("inges", "die Schung"),
            ("", "heit"),  # the empty seed is in every row
            ("zzyzzes", "qqq*en"),  # no pattern syntax
        ],
    )
    assert got == {
        ("reedes", "die EINHEIT"): (1, 1, 0, 0),
        ("thedones", "belich"): (1, 0, 1, 0),
        ("nosuchseed", "heit einheit"): (0, 0, 0, 0),
        ("Inges", "ung"): (0, 0, 0, 0),
        ("inges", "die Schung"): (1, 1, 1, 0),
        ("", "heit"): (1, 0, 0, 0),
        ("zzyzzes", "qqq*en"): (1, 0, 0, 1),
    }


def test_exact_and_whole_word(spark):
    got = indicators(spark, [("reedes", "keit einkeit"), ("Inges", "Ungern")], exact=True)
    assert got[("reedes", "keit einkeit")] == (1, 1, 0, 0)
    assert got[("Inges", "Ungern")] == (1, 1, 0, 0)
    got = indicators(spark, [("thedones", "die erlich"), ("thedones", "so, Lich!"), ("thedones", "")], whole_word=True)
    assert got[("thedones", "die erlich")] == (0, 1, 0, 0)
    assert got[("thedones", "so, Lich!")] == (1, 0, 0, 0)
    assert got[("thedones", "")] == (0, 0, 0, 0)


def test_singular_lexicon(spark):
    lex = spark.createDataFrame(
        [(0, "The tutor", "Betreuer", "Betreuerin", "", "Betreuer*in")],
        "row_no long, english string, german_ms string, german_fs string, "
        "gender_neutral string, gender_inclusive string",
    )
    row = E.form_hits(translations(spark, [("tutor", "Die Betreuerin kommt")]), lex, "singular").first()
    assert (row["german_ms_count"], row["german_fs_count"], row["gender_inclusive_count"]) == (1, 1, 0)


def test_report_and_totals(spark):
    rows = spark.createDataFrame(
        [("m1", "c", "reedes", "heit"), ("m1", "c", "reedes", "x"), ("m2", "c", "reedes", "einheit")],
        "model string, corpus string, seed_noun string, translation string",
    )
    hits = E.form_hits(rows, lexicon(spark))
    assert tuple(E.form_totals(hits).first()) == (2, 1, 0, 0)
    report = {r["model"]: r for r in E.form_report(hits).collect()}
    assert report["m1"]["n"] == 2 and report["m1"]["german_mp_rate"] == 0.5
    assert report["m2"]["german_fp_total"] == 1
    long = E.long_hits(hits, ["model", "seed_noun"])
    assert long.count() == 12 and long.agg(F.sum("hit")).first()[0] == 3


def test_translations_are_not_shuffled(spark, plan):
    words = F.col("id").cast("string")
    df = spark.range(1000).select(words.alias("seed_noun"), words.alias("translation"))
    text = plan(E.form_hits(df, lexicon(spark)))
    assert "Exchange hashpartitioning" not in text and "NestedLoop" not in text
    assert "Cartesian" not in text and text.count("BroadcastHashJoin") == 2


def test_a_lexicon_too_large_to_copy(spark, monkeypatch, plan):
    rows = [("reedes", "die EINHEIT"), ("Inges", "ung"), ("", "heit")]
    want = indicators(spark, rows)
    monkeypatch.setattr(E, "small_side", lambda df: df)
    assert indicators(spark, rows) == want


def test_union_systems(spark):
    a, b = translations(spark, [("x", "1")]), translations(spark, [("x", "2")])
    got = {(r["model"], r["translation"]) for r in E.union_systems({"a": a, "b": b}).collect()}
    assert got == {("a", "1"), ("b", "2")}
    with pytest.raises(ValueError):
        E.union_systems({})


def test_valid_annotations(spark):
    rows = [
        (1, "A b. C d. The tutors e. F g.", "tutors"),
        (2, "A b. The tutors e. F g.", "tutors"),
        (3, "A b. The tutors. C d. F g.", "tutors"),
        (4, "A b. C d. Some team leaders e. F g.", "team leaders"),
        (5, "A b. C d. Some team of leaders e. F g.", "team leaders"),
        (6, "A b. C d. ... F g.", "tutors"),
    ]
    df = spark.createDataFrame(rows, "id long, source string, seed_noun string")
    assert sorted(r["id"] for r in valid_annotations(df).collect()) == [1, 4]


def test_common_annotations(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id long, label string")
    b = spark.createDataFrame([(1, "z"), (2, "z"), (3, None)], "id long, label string")
    assert [tuple(r) for r in common_annotations(a, b).collect()] == [(1, "x")]


def test_large_index_finds_the_same_rows(spark, monkeypatch):
    lexicon = spark.createDataFrame(
        [(0, "The bakers", "Die Bäcker", "Die Bäckerinnen", "", "")],
        "row_no long, english string, german_mp string, german_fp string, gender_neutral string, gender_inclusive string",
    )
    seeds = spark.createDataFrame([("bakers",), ("bakers",), ("Bakers",), (None,), ("",)], "seed_noun string")
    both = []
    for side in (E.hinted, lambda index: None):
        monkeypatch.setattr(E, "hinted", side)
        rows = E.match_lexicon(seeds, lexicon).select("seed_noun", "lexicon_row").collect()
        both.append(sorted(map(repr, rows)))
    assert both[0] == both[1] and len(both[0]) == 5
