import pytest
from pyspark.sql import functions as F

from nounspan.functions.bloom import BloomFilter


@pytest.mark.parametrize("bits", [64, 4096, 1 << 20])
def test_no_key_is_lost_and_few_others_pass(spark, bits):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("a"), (F.col("id") % 7).alias("b"))
    held = BloomFilter(keys, ["a", "b"], bits=bits)
    assert keys.filter(held.may_hold("a", "b")).count() == 3000
    others = keys.select(F.concat("a", F.lit("x")).alias("a"), "b")
    passed = others.filter(held.may_hold(F.col("a"), "b")).count()
    assert passed < 30 if bits == 1 << 20 else passed <= 3000
    assert 0 < held.share_set <= 1


def test_nulls_are_keys_and_an_empty_table_holds_none(spark):
    df = spark.createDataFrame([(None,), ("x",)], "a string")
    assert df.filter(BloomFilter(df, ["a"], bits=1024).may_hold("a")).count() == 2
    assert df.filter(BloomFilter(df.filter("false"), ["a"], bits=1024).may_hold("a")).count() == 0


def test_the_words_reach_the_tasks_as_one_literal(spark, plan):
    df = spark.range(100).select(F.col("id").cast("string").alias("a"))
    text = plan(df.filter(BloomFilter(df, ["a"], bits=1024).may_hold("a")))
    assert "Exchange" not in text.split("Subquery")[0] and "Python" not in text
