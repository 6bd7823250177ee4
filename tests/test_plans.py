import json

import pytest
from pyspark.sql import functions as F

from nounspan.catalog.base import lexicon, terms
from nounspan.operators.evaluation import translate_by_lexicon
from nounspan.operators.samples import explode_pairs
from nounspan.plans import evaluation, mining, translation
from nounspan.session import scratch_dir, small_rows, small_side, widen
from nounspan.sources.readers import read_csv, read_samples
from nounspan.sources.writers import export_samples, write_table
from nounspan.streaming.resume import append_pending
from nounspan.streaming.resume import stored as read_portions

LEXICON = (
    "ID,German_MP,German_FP,Gender-Neutral,Gender-Inclusive,English\n"
    "0,Die Leiter,Die Leiterinnen,Die Leitung,die Leiter*innen,The team leaders\n"
    "1,Die Betreuer,Die Betreuerinnen,,die Betreuer*innen,The tutors;\n"
    "2,Die Betreuer,Die Betreuerinnen,,die Betreuer*innen,The tutors\n"
    "3,Die Geister,Die Geister,,,The ghosts\n"
)
CORPUS = "Intro. The tutors came. They sat. Done.\nTeam leaders met tutors.\nTutors!\n"


def files(tmp_path):
    (tmp_path / "lexicon_plural.csv").write_text(LEXICON, encoding="utf-8")
    (tmp_path / "corpus.en").write_text(CORPUS, encoding="utf-8")
    return str(tmp_path / "lexicon_plural.csv"), str(tmp_path / "corpus.en")


def test_from_corpus_to_report(spark, tmp_path):
    lex, corpus = files(tmp_path)
    out = str(tmp_path / "samples")
    for _ in range(2):  # the second run finds nothing to do
        mining.run_mining(spark, lex, "europarl", corpus, out, n_samples=2, mode="all")
    records = {r["term"]: r for r in read_portions(spark, out).collect()}
    assert set(records) == {"team leaders", "tutors", "ghosts"}
    assert records["tutors"]["total_matches"] == 3 and len(records["tutors"]["selected"]) == 2
    assert records["ghosts"]["selected"] is None and records["ghosts"]["total_selected"] == 0

    exported = str(tmp_path / "object")
    export_samples(read_portions(spark, out), exported)
    prepared = str(tmp_path / "passages")
    mining.run_preparation(spark, [exported, exported], prepared)
    passages = read_csv(spark, prepared, "\t")
    assert passages.columns == ["rid", "seed", "token_count", "text"] and passages.count() == 3

    def make():
        return lambda rows: [r["text"].replace("utors", "utors: die Betreuerinnen") for r in rows]

    done = translation.translate_samples(read_samples(spark, exported), make, "org/m", "instruction")
    flat = explode_pairs(done).select(
        F.col("seed").alias("seed_noun"), "source", "translation",
        F.lit("m").alias("model"), F.lit("europarl").alias("corpus"),
    )
    stored = str(tmp_path / "translations")
    write_table(flat, stored, "csv", partition_by=("model", "corpus"))
    report = evaluation.run_form_evaluation(spark, lex, stored, str(tmp_path / "counts"))
    row = report.first()
    assert (row["model"], row["corpus"], row["n"]) == ("m", "europarl", 3)
    # Forms carry their article, so "die Betreuerinnen" counts for both genders.
    assert row["german_fp_total"] == row["german_mp_total"] >= 2
    assert read_csv(spark, str(tmp_path / "counts")).count() == 3


def test_slice_of_terms_and_tagger(spark, tmp_path):
    lex, corpus = files(tmp_path)

    def tag():
        return lambda rows: ["VERB" for _ in rows]

    out = str(tmp_path / "slice")
    mining.run_mining(spark, lex, "europarl", corpus, out, slice_of_terms=(1, 3), make_tagger=tag)
    assert [tuple(r) for r in read_portions(spark, out).collect()] == [("tutors", 0, 0, None)]


def test_distinct_passages(spark):
    corpus = spark.createDataFrame([(1, "Thines and thines."), (2, "Thines and thines.")], "doc_id long, text string")
    wanted = terms(spark).filter("term = 'thines'")
    assert mining.mine(corpus, wanted).first()["total_matches"] == 4
    assert mining.mine(corpus, wanted, distinct=True).first()["total_matches"] == 1


def test_judging(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(
        "ID\tto_keep\tseed_noun\ttranslation\n0\tTrue\ttutors\tDie Betreuer\n1\tFalse\ttutors\tx\n"
    )

    def make():
        return lambda prompts: ["Masculine" for _ in prompts]

    out = str(tmp_path / "judged")
    evaluation.run_judging(spark, str(tmp_path / "a.tsv"), out, make)
    rows = {r["id"]: r for r in read_csv(spark, out).collect()}
    assert rows["0"]["response"] == "Masculine" and rows["1"]["response"] == rows["1"]["prompt"] == "N/A"


def test_prompts_table(spark):
    prompts = spark.createDataFrame([(0, "a"), (1, None)], "id long, English string")

    def make():
        return lambda texts: [json.loads(t)[0]["content"] for t in texts]

    got = translation.translate_prompts(prompts, make, "Llama-x", template_id="flan").orderBy("id")
    assert [r["Llama-x"] for r in got.collect()] == ["a\n\nTranslate this to German?", None]


def test_translation_by_lexicon(spark):
    rows = [("reedes", "The Reedes came"), ("thhaes", "thhaes"), ("nosuchseed", "A nosuchseed"), (None, "X"), ("", "Y"), ("reedes", None)]
    df = spark.createDataFrame(rows, "seed string, text string")

    def told(style):
        done = translate_by_lexicon(df, "text", "seed", lexicon(spark), style)
        return {(r["seed"], r["text"]): r["translation"] for r in done.collect()}

    feminine, neutral = told("FP"), told("GN")
    assert feminine == {
        rows[0]: "the einheit came", rows[1]: "einver", rows[2]: "a nosuchseed", rows[3]: "x", rows[4]: "y", rows[5]: None
    }
    # A blank form falls back to the masculine one.
    assert neutral[rows[0]] == "the enlich came" and neutral[rows[1]] == "ver"


def test_small_sides_are_proven(spark, plan):
    df = spark.range(50)
    assert small_rows(df, 49) is None and len(small_rows(df, 50)) == 50
    assert "Broadcast" in plan(spark.range(10**6).join(small_side(df, 50), "id"))
    assert small_side(df, 49) is df


def test_narrow_scans_are_spread(spark):
    assert widen(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 64)
    assert widen(wide, "id") is wide


def test_scratch_needs_a_shared_folder(spark):
    assert scratch_dir(spark)


def test_failed_slice_keeps_the_slices_before(spark, tmp_path):
    terms = spark.createDataFrame([(f"t{i}",) for i in range(20)], "term string")
    path, made = str(tmp_path / "out"), []

    def records(todo):
        made.append(todo)
        if len(made) == 2:
            raise RuntimeError("stopped")
        return todo

    with pytest.raises(RuntimeError):
        append_pending(terms, path, records, slices=3)
    kept = read_portions(spark, path).count()
    assert 0 < kept < 20
    append_pending(terms, path, lambda todo: todo, slices=3)
    assert sorted(r["term"] for r in read_portions(spark, path).collect()) == sorted(f"t{i}" for i in range(20))
