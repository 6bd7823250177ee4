"""Delimited files split inside quoted cells give the same rows as read by one task."""

import csv
import random

import pytest

from nounspan.sources.quoted import records
from nounspan.sources.readers import read_csv, read_prompts


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(path, seed, rows=300, end="\n", longest=3, first="ID"):
    rng = random.Random(seed)
    cell = lambda: rng.choice(["", "plain", "a,b", 'say "x"', "two\nlines", '\n"\n', "é\n\n𝔘", "y" * 50]) * rng.randrange(longest)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow([first, "text", "more"])
        for i in range(rows):
            out.writerow([i, cell(), cell()])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0]))


@pytest.mark.parametrize("seed, end, longest", [(1, "\n", 3), (2, "\r\n", 3), (3, "\n", 200)])
def test_same_rows_from_many_tasks(spark, tmp_path, small_splits, seed, end, longest):
    for k in range(2):
        made(tmp_path / f"{k}.csv", seed + 10 * k, 120, end, longest)
    path = str(tmp_path)
    with open(tmp_path / "0.csv", newline="", encoding="utf-8") as a, open(tmp_path / "1.csv", newline="", encoding="utf-8") as b:
        wanted = [[c or None for c in r] for f in (a, b) for r in list(csv.reader(f))[1:]]
    large = read_csv(spark, path, large=True)
    got = sorted(([*r] for r in large.collect()), key=repr)
    assert got == sorted(wanted, key=repr)
    blocks = records(spark, path).select("file", "block").distinct().count()
    assert blocks > 4


def test_ids_follow_the_file(spark, tmp_path, small_splits):
    made(tmp_path / "p.csv", 5, 200, first="number")
    got = read_prompts(spark, str(tmp_path / "p.csv"), large=True).orderBy("id")
    assert [(r["id"], int(r["number"])) for r in got.collect()] == [(i, i) for i in range(200)]


def test_a_missing_quote_and_an_empty_file(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('ID,text,more\n1,x,y\n2,"open,z\n3,u,v\n')
    got = read_csv(spark, str(tmp_path / "a.csv"), large=True).collect()
    assert [r["ID"] for r in got] == ["1", "2"]
    (tmp_path / "b.csv").write_text("ID,text,more\n")
    assert read_csv(spark, str(tmp_path / "b.csv"), large=True).collect() == []


def test_lines_are_cut_where_they_are_read(spark, tmp_path, small_splits, plan):
    for k in range(2):
        made(tmp_path / f"{k}.csv", 20 + k)
    found = records(spark, str(tmp_path))
    # Between the scan and the cut there is no exchange and no sort of the lines.
    for part in plan(found).split("MapInArrow")[1:]:
        lines = part.split("Scan text")[0].split("BroadcastExchange")[0]
        assert "hashpartitioning" not in lines and "Sort " not in lines
    assert plan(found).count("MapInArrow") == 2


def test_a_record_over_many_blocks(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i} of a cell" for i in range(600))
    rows = [["ID", "text", "more"], ["1", "x", "y"], ["2", long, "y"], ["3", "x", long + "\n"], ["4", "a", "b"]]
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
    assert rows_of(read_csv(spark, str(tmp_path / "a.csv"), large=True)) == [tuple(r) for r in rows[1:]]
    got = records(spark, str(tmp_path / "a.csv")).orderBy("block", "line").collect()
    assert len(got) == 5 and [r["top"] for r in got] == [True] + [False] * 4
