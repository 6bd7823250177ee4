"""Portions are seen in full or not at all."""

import pytest
from pyspark.sql import functions as F

from nounspan.sources import storage
from nounspan.streaming.portions import PortionTable


def failing(df, at):
    """The rows, with an error when a given one is written."""
    return df.select(F.when(F.col("i") == at, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("i")).alias("i"))


def test_a_portion_that_fails_halfway_leaves_no_row_visible(spark, tmp_path):
    table = PortionTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.portions() == []
    one = spark.range(0, 100, 1, 4).toDF("i")
    assert table.write(one, "one") == 100
    with pytest.raises(Exception):
        table.write(failing(spark.range(100, 200, 1, 4).toDF("i"), 199), "two")
    # The tasks before the failing one have written their files, but nobody sees them.
    assert len(storage.names(spark, f"{table.path}/_data")) == 2
    assert sorted(r["i"] for r in table.read().collect()) == list(range(100))
    assert table.write(spark.range(100, 200).toDF("i"), "two") == 100
    assert sorted(r["i"] for r in table.read().collect()) == list(range(200))
    assert len(table.clean()) == 1 and table.clean() == []
    assert table.read().count() == 200


def test_a_published_name_is_not_written_again(spark, tmp_path):
    table = PortionTable(spark, str(tmp_path / "t"))
    assert table.write(spark.range(3).toDF("i"), "a") == 3
    assert table.write(spark.range(99).toDF("i"), "a") == 3
    assert table.read().count() == 3
    assert [(p["name"], p["rows"]) for p in table.portions()] == [("a", 3)]


def test_empty_portions_and_an_unreadable_folder(spark, tmp_path):
    table = PortionTable(spark, str(tmp_path / "t"))
    assert table.write(spark.range(0).toDF("i"), "none") == 0
    assert table.read().collect() == [] and table.read().columns == ["i"]


def test_publishing_is_one_step(spark, tmp_path):
    storage.make_folder(spark, str(tmp_path / "m"))
    storage.publish(spark, str(tmp_path / "m" / "x.json"), "ünï")
    assert storage.names(spark, str(tmp_path / "m")) == ["x.json"]
    assert storage.read_text(spark, str(tmp_path / "m" / "x.json")) == "ünï"
