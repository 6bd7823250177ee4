import pytest
from pyspark.sql import functions as F

from nounspan.catalog.base import lexicon, terms
from nounspan.operators import concordance as C
from nounspan.operators.lexicon import (
    distinct_terms,
    pluralise_lexicon,
    seed_terms,
    substring_index,
    term_range,
)

DOCS = [
    (1, "The thines met. A thines and thines. End of it. More."),
    (2, "Nothing here. Thinesque only. pre_thines too."),
    (3, "THE ESNDHA REEDES came"),
    (4, "One.\nTwo.\nThree thines.\nFour."),
    (5, "A\nB\nC thines\nD"),
    (6, ""),
    (7, None),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_every_token_counts(spark, corpus):
    found = rows(C.concordance(corpus, terms(spark)))
    assert [r[:4] for r in found if r[0] == "thines"] == [
        ("thines", 1, 0, 1),
        ("thines", 1, 1, 1),
        ("thines", 1, 1, 3),
        ("thines", 4, 2, 1),
    ]
    passages = {r[1:4]: r[4] for r in found}
    assert passages[(1, 0, 1)] == "The thines met. A thines and thines."
    assert passages[(1, 1, 1)] == "The thines met. A thines and thines. End of it."
    assert passages[(4, 2, 1)] == "One. Two. Three thines. Four."


def test_phrases_and_case(spark, corpus):
    found = rows(C.concordance(corpus, terms(spark), mode="phrase"))
    assert [r[:4] for r in found] == [("esndha reedes", 3, 0, 1)]
    both = rows(C.concordance(corpus, terms(spark), mode="all"))
    assert ("reedes", 3, 0, 2) in [r[:4] for r in both]
    with pytest.raises(ValueError):
        C.concordance(corpus, terms(spark), mode="other")


def test_line_limit(spark, corpus):
    # Document 5 is one sentence of four lines.
    assert not [r for r in rows(C.concordance(corpus, terms(spark))) if r[1] == 5]
    assert [r for r in rows(C.concordance(corpus, terms(spark), lines=4)) if r[1] == 5]


@pytest.mark.parametrize("options", [{"prefilter": False}, {"max_terms": 0}])
def test_all_paths_agree(spark, corpus, options):
    want = rows(C.concordance(corpus, terms(spark), mode="all"))
    assert rows(C.concordance(corpus, terms(spark), mode="all", **options)) == want


def test_no_terms(spark, corpus):
    none = terms(spark).limit(0)
    assert C.concordance(corpus, none).count() == 0
    assert C.with_any_term(corpus, none).count() == 0
    assert C.sentences_with_terms(corpus, none).count() == 0


def test_long_term_lists_shuffle(spark, corpus, monkeypatch):
    want = rows(C.sentences_with_terms(corpus, terms(spark)))
    monkeypatch.setattr(C, "first_tokens", lambda terms: None)
    assert rows(C.sentences_with_terms(corpus, terms(spark))) == want


def test_one_scan_and_no_shuffle(spark, sf, plan):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = plan(C.concordance(docs, terms(spark), mode="all"))
    assert text.count("FileScan") == 1 and "BroadcastHashJoin" in text
    assert "Exchange hashpartitioning" not in text and "Python" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_passages_are_built_above_the_join(spark, sf, plan):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = plan(C.concordance(docs, terms(spark)))
    below = text.split("Generate posexplode", 1)[1]
    assert text.count("array_join") == 1 and "array_join" not in below
    # Each text is cut into sentences in one place only.
    assert below.count("regexp_replace") == 1


def test_term_stats_keeps_terms_without_match(spark, corpus):
    found = C.concordance(corpus, terms(spark), mode="all")
    stats = {r[0]: r[1:] for r in rows(C.term_stats(terms(spark), found, 3))}
    assert stats["zzyzzes"] == (0, 0) and stats["thines"] == (4, 3) and len(stats) == 9


def test_filter_pos(spark, corpus):
    found = C.concordance(corpus, terms(spark))
    tags = spark.createDataFrame([("thines", "VERB"), ("reedes", "PROPN")], "token string, pos string")
    assert {r[0] for r in rows(C.filter_pos(found, tags))} == {"reedes"}
    tags = spark.createDataFrame([("thines", "NOUN"), ("thines", "VERB")], "token string, pos string")
    assert len(rows(C.filter_pos(found, tags))) == 4


def test_seed_terms(spark):
    got = {r["row_no"]: (r["term"], r["term_tokens"]) for r in seed_terms(lexicon(spark)).collect()}
    assert got[3] == ("anlyes", ["anlyes"]) and got[5] == ("Inges", ["inges"])
    assert got[0] == ("esndha reedes", ["esndha", "reedes"])
    first = {r["term"]: r["row_no"] for r in distinct_terms(seed_terms(lexicon(spark))).collect()}
    assert first["reedes"] == 1 and len(first) == 9


def test_term_range(spark):
    got = term_range(lexicon(spark).filter("row_no <> 2"), 1, 4).collect()
    assert sorted(r["row_no"] for r in got) == [1, 3, 4]


def test_substring_index(spark):
    df = spark.createDataFrame([(2, "The Ab"), (5, "xab"), (7, "")], "row_no long, english string")
    index = {r["piece"]: r["row_no"] for r in substring_index(df).collect()}
    phrases = [(2, "the ab"), (5, "xab"), (7, "")]
    pieces = {p[i:j] for _, p in phrases for i in range(len(p) + 1) for j in range(i, len(p) + 1)}
    assert index == {s: min(n for n, p in phrases if s in p) for s in pieces}


def test_pluralise_lexicon(spark):
    df = spark.createDataFrame([("team leader",)], "noun string")
    assert pluralise_lexicon(df, "noun").first()["plural"] == "team leaders"
    assert df.select(F.col("noun")).count() == 1


def test_phrases_as_written(spark):
    docs = [
        (1, "The team, leaders and staff."),
        (2, "The team (leaders) met."),
        (3, "Team leaders, the team, leaders and team leaders."),
        (4, "team  leaders and steam leaders"),
        (5, "(team leaders"),
    ]
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    wanted = spark.createDataFrame([("team leaders",)], "term string").withColumn(
        "term_tokens", F.split("term", " ")
    )
    for most in (10, 0):
        found = C.concordance(corpus, wanted, mode="phrase", max_terms=most)
        assert [r[1:4] for r in rows(found)] == [(3, 0, 0), (3, 0, 6), (5, 0, 0)]
