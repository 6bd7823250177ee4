"""What a Python worker holds follows the bounds of a piece, not the rows of a batch."""

import pyarrow as pa
import pytest

pytest.importorskip("nounspan.llm")

from pyspark import SparkContext  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from nounspan.llm import common, exact_dedup, jaccard, langid  # noqa: E402
from nounspan.operators.ids import with_rid  # noqa: E402


def texts(n):
    return [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(n)]


def test_pieces_hold_all_rows_in_order_and_a_bounded_number_of_bytes(monkeypatch):
    monkeypatch.setattr(common, "PIECE_BYTES", 100)
    values = ["a" * 40, None, "b" * 40, "c" * 500, "", "d" * 99, "e" * 99] * 3
    found = list(common.pieces(pa.RecordBatch.from_pydict({"text": values}), "text"))
    assert [v for p in found for v in p.column("text").to_pylist()] == values
    # A row more than the bound at most, and a longer row with what shares its place.
    assert all(sum(len(v or "") for v in p.column("text").to_pylist()[1:]) <= 200 for p in found)
    assert len(found) > 6
    assert [p.num_rows for p in common.pieces(pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}), "text")] == [0]


@pytest.mark.parametrize("made", [jaccard._fetched, jaccard._entries(3)])
def test_sets_and_entries_of_a_large_batch_go_out_in_pieces(made, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"text": texts(40)})
    monkeypatch.setattr(common, "PIECE_BYTES", len(batch.column("text")[0].as_py()) * 8)
    out = list(made(iter([batch])))
    assert len(out) >= 4
    if made is jaccard._fetched:
        assert sum(b.num_rows for b in out) == 40
        assert max(b.num_rows for b in out) <= 10


def test_numbers_and_heavy_texts_need_no_python_workers(spark, monkeypatch):
    def refused(*a, **b):
        raise AssertionError("a list of rows passes through Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    rows = spark.range(50).select("id", F.lit("the same text").alias("text"))
    assert sorted(r["rid"] for r in with_rid(rows, ["id"]).collect()) == list(range(50))
    assert with_rid(rows.filter("id < 0"), ["id"]).count() == 0
    docs = rows.withColumnRenamed("id", "doc_id")
    assert [r["doc_id"] for r in exact_dedup.distinct_texts(docs).collect()] == [0]


def test_texts_without_letters_have_no_language(spark):
    rows = [(1, "aaa bbb", "x"), (2, None, "x"), (3, "", "x"), (4, "123", "x"), (5, "éé aaa", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for profiles in (langid.fit_profiles(docs), {}):
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, profiles).collect()}
        assert [got[i] for i in (2, 3, 4)] == [("und", 0.0)] * 3
        assert got[1][0] == got[5][0] == ("x" if profiles else "und")
    assert langid.letters().nbytes <= 5_000_000
