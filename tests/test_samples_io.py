import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from nounspan.operators import samples as P
from nounspan.sources import readers as R
from nounspan.sources import writers as W
from nounspan.sources.schemas import SAMPLES
from nounspan.streaming.resume import append_pending, pending_terms, stored

RECORDS = {
    "tutors": {"total_matches": 9, "total_selected": 2, "selected": ['a "q"\n},\n    }', "ä – b"]},
    "Übungsleiter; x": {"total_matches": 1, "total_selected": 1, "selected": ["{\n    },\n}"]},
    'odd "key"': {"total_matches": 0, "total_selected": 0, "selected": None},
}


def as_dict(df):
    return {
        r["term"]: {k: r[k] for k in ("total_matches", "total_selected", "selected")}
        for r in df.collect()
    }


@pytest.mark.parametrize("indent", [2, 4])
def test_reads_an_indented_object(spark, tmp_path, indent):
    path = tmp_path / "s.json"
    path.write_text(json.dumps(RECORDS, indent=indent, ensure_ascii=False), encoding="utf-8")
    assert as_dict(R.read_samples(spark, str(path), indent)) == RECORDS


def test_reads_translations_and_an_empty_object(spark, tmp_path):
    record = {"x": {"total_matches": 1, "total_selected": 1, "selected": ["a"], "translation": ["b"]}}
    (tmp_path / "t.json").write_text(json.dumps(record, indent=4))
    assert R.read_samples(spark, str(tmp_path / "t.json")).first()["translation"] == ["b"]
    (tmp_path / "e.json").write_text("{}")
    assert R.read_samples(spark, str(tmp_path / "e.json")).count() == 0


def test_object_export_is_valid_json(spark, tmp_path):
    rows = [(k, v["total_matches"], v["total_selected"], v["selected"], None) for k, v in RECORDS.items()]
    df = spark.createDataFrame(rows, SAMPLES).drop("translation").repartition(3)
    W.export_samples(df, str(tmp_path / "x"))
    parts = sorted((tmp_path / "x").glob("part-*"))
    whole = "".join(p.read_text(encoding="utf-8") for p in parts)
    assert json.loads(whole) == RECORDS
    assert as_dict(R.read_samples(spark, str(tmp_path / "x"))) == RECORDS


def test_json_lines(spark, tmp_path):
    rows = [(k, v["total_matches"], v["total_selected"], v["selected"], None) for k, v in RECORDS.items()]
    W.write_samples(spark.createDataFrame(rows, SAMPLES), str(tmp_path / "l"))
    assert as_dict(R.read_samples(spark, str(tmp_path / "l"), None)) == RECORDS


def test_lexicon_csv(spark, tmp_path):
    path = tmp_path / "lexicon_plural.csv"
    path.write_text(
        "ID,German_MP,German_FP,Gender-Neutral,Gender-Inclusive,English\n"
        "0,Die A,Die Ainnen,,die A*innen,The as\n"
        '4,Die B,Die Binnen,"Die X, Y; die Z;",die B*innen,The bs;\n',
        encoding="utf-8",
    )
    rows = [r.asDict() for r in R.read_lexicon(spark, str(path)).orderBy("row_no").collect()]
    assert rows[0]["gender_neutral"] == "" and rows[0]["row_no"] == 0
    assert rows[1]["gender_neutral"] == "Die X, Y; die Z;" and rows[1]["id"] == 4


def test_lexicon_without_ids(spark, tmp_path):
    path = tmp_path / "singular.csv"
    path.write_text("English,German_MS,German_FS,Gender-Neutral,Gender-Inclusive\nThe b,x,y,,z\nThe a,u,v,w,\n")
    rows = R.read_lexicon(spark, str(path)).orderBy("row_no").collect()
    assert [(r["row_no"], r["english"], r["german_fs"]) for r in rows] == [(0, "The b", "y"), (1, "The a", "v")]


def test_csv_round_trip(spark, tmp_path):
    rows = [("a", 'x "q", y\nz', " lead "), ("b", None, "N/A"), ("c", "tab\t", "\\")]
    df = spark.createDataFrame(rows, "k string, v string, w string")
    for sep in (",", "\t"):
        path = str(tmp_path / f"t{ord(sep)}")
        W.write_table(df, path, "csv", sep=sep)
        assert sorted(map(tuple, R.read_csv(spark, path, sep).collect())) == sorted(rows)


def test_pandas_csv_is_read(spark, tmp_path):
    import pandas as pd

    frame = pd.DataFrame({"ID": [0, 1, 2], "to_keep": [True, False, None], "translation": ['a\n"b"', "c,d", None]})
    frame.to_csv(tmp_path / "a.tsv", sep="\t", index=False)
    got = R.read_annotations(spark, str(tmp_path / "a.tsv")).orderBy("id").collect()
    assert [(r["id"], r["to_keep"], r["translation"]) for r in got] == [
        (0, True, 'a\n"b"'),
        (1, False, "c,d"),
        (2, False, None),
    ]


def test_pandas_index_without_a_name(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"source": ["a", "b"], "label": [0.5, 1]}).to_csv(tmp_path / "l.csv")
    got = R.read_labelled(spark, str(tmp_path / "l.csv")).orderBy("label").collect()
    assert [tuple(r) for r in got] == [("a", 0.5), ("b", 1.0)]


def test_prompts_keep_file_order(spark, tmp_path):
    (tmp_path / "p.csv").write_text("English,Note\nzeta,1\n,2\nalpha,3\n")
    got = R.read_prompts(spark, str(tmp_path / "p.csv")).orderBy("id").collect()
    assert [(r["id"], r["English"]) for r in got] == [(0, "zeta"), (1, None), (2, "alpha")]
    assert P.has_text(R.read_prompts(spark, str(tmp_path / "p.csv")), "English").count() == 2


def test_corpora(spark, tmp_path):
    (tmp_path / "c.en").write_text(" one \ntwo\n\n", encoding="utf-8")
    lines = R.load_corpus(spark, "europarl", str(tmp_path / "c.en"))
    assert sorted(r["text"] for r in lines.collect()) == ["", "one", "two"]
    with pytest.raises(ValueError):
        R.load_corpus(spark, "other", "x")


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {i}\n" for i in range(500)))
    setting = "spark.sql.files.maxPartitionBytes"
    before, seen = spark.conf.get(setting), []
    try:
        for size in ("1k", "64m"):
            spark.conf.set(setting, size)
            seen.append(sorted(map(tuple, R.read_lines(spark, str(tmp_path)).collect())))
    finally:
        spark.conf.set(setting, before)
    wanted = [f"a {i}" for i in range(500)] + [f"b {i}" for i in range(500)]
    assert seen[0] == seen[1] == list(enumerate(wanted))


def test_lines_of_a_table_are_documents_of_their_own(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    rows = [(7, "the cat.\nthe cat."), (3, "a dog"), (None, "x"), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    lines = R.load_corpus(spark, "europarl", path).orderBy("doc_id")
    got = [(r["doc_id"], r["source_id"], r["line_no"], r["text"]) for r in lines.collect()]
    assert got == [(0, None, 0, "x"), (1, 3, 0, "a dog"), (2, 7, 0, "the cat."), (3, 7, 1, "the cat.")]


def test_tags(spark):
    df = spark.createDataFrame(
        [("/d/form.plural_europarl.csv", "org/m"), ("wiki/x", "m"), ("d/.csv", "a/b/c")], "p string, m string"
    )
    got = [tuple(r)[2:] for r in W.run_tags(df, "p", "m").collect()]
    assert got == [
        ("form.plural_europarl", "org--m", "europarl"),
        ("x", "m", "wikipedia"),
        (".csv", "a--b--c", "wikipedia"),
    ]


def test_partitioned_write_makes_few_files(spark, tmp_path):
    df = spark.range(0, 10_000, 1, 16).select("id", (F.col("id") % 5).alias("model"))
    W.write_table(df, str(tmp_path / "m"), partition_by=("model",))
    files = list(Path(tmp_path / "m").rglob("part-*.parquet"))
    assert len(files) <= 10 and spark.read.parquet(str(tmp_path / "m")).count() == 10_000


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "term string, selected array<string>, translation array<string>")
    return [tuple(r) for r in P.explode_pairs(df).orderBy("seed", "pos").collect()]


def test_shortest_list_ends_the_pairing(spark):
    assert pairs(
        spark,
        [
            ("a", ["1", "2", "3"], ["x", "y", "z"]),
            ("b", ["1", "2", "3"], ["x", "y"]),
            ("c", [], []),
            ("d", None, None),
            ("e", None, ["x"]),
        ],
    ) == [("a", 0, "1", "x"), ("a", 1, "2", "y"), ("a", 2, "3", "z"), ("b", 0, "1", "x"), ("b", 1, "2", "y")]


def samples(spark, rows):
    return spark.createDataFrame(
        rows, "term string, total_matches int, total_selected int, selected array<string>"
    )


def test_last_shard_wins(spark):
    shards = [
        samples(spark, [("a", i, i, [str(i)]), (f"only{i}", 1, 1, ["x"])]) for i in range(3)
    ]
    got = as_dict(P.merge_samples(*shards))
    assert got["a"] == {"total_matches": 2, "total_selected": 2, "selected": ["2"]} and len(got) == 4


def test_prepare_passages(spark):
    df = samples(spark, [("b", 2, 2, ["one two three", "schÃ¶n &amp; gut"]), ("a", 0, 0, None)])
    got = [tuple(r) for r in P.prepare_passages(df, 3).orderBy("rid").collect()]
    assert got == [(0, "b", 3, "one two three"), (1, "b", 3, "schön & gut")]


def test_regroup_by_key(spark):
    df = samples(spark, [("a", 5, 2, ["p", "q"]), ("z", 0, 0, None)])
    done = spark.createDataFrame([("a", 1, "Q"), ("a", 0, "P")], "seed string, pos int, completion string")
    got = {r["term"]: r["translation"] for r in P.regroup_completions(df, done).collect()}
    assert got == {"a": ["P", "Q"], "z": []}


def test_funnel(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "i int, t string")
    row = P.funnel(df, {"text": F.col("t").isNotNull(), "late": F.col("i") > 1}).first()
    assert tuple(row) == (3, 2, 1)


def test_resume(spark, tmp_path):
    path = str(tmp_path / "out")
    assert stored(spark, path) is None
    calls = []

    def make(todo):
        calls.append(sorted(r["term"] for r in todo.collect()))
        return todo.withColumn("total_matches", F.lit(1))

    first = spark.createDataFrame([("a",), ("b",)], "term string")
    append_pending(first, path, make)
    append_pending(first.union(spark.createDataFrame([("c",)], "term string")), path, make)
    assert calls == [["a", "b"], ["c"]]
    assert sorted(r["term"] for r in stored(spark, path).collect()) == ["a", "b", "c"]
    assert pending_terms(first, stored(spark, path)).count() == 0
