"""Sample sets: merge, filter, flatten, regroup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nounspan.functions.text import repair_text, token_count
from nounspan.operators.ids import with_rid
from nounspan.operators.observed import Observed, funnel_counts
from nounspan.session import write_out


def has_text(df: DataFrame, column: str) -> DataFrame:
    """Rows whose target column is not null."""
    return df.filter(F.col(column).isNotNull())


def non_empty(df: DataFrame, column: str) -> DataFrame:
    """Rows whose passage is neither null nor empty."""
    return df.filter(F.coalesce(F.col(column), F.lit("")) != "")


def non_empty_seeds(samples: DataFrame) -> DataFrame:
    """Terms for which something was selected."""
    return samples.filter(F.col("total_selected") != 0)


def limit_tokens(df: DataFrame, column: str, max_tokens: int = 256) -> DataFrame:
    """Add ``token_count`` and keep passages up to the limit."""
    return df.withColumn("token_count", token_count(F.col(column))).filter(
        F.col("token_count") <= max_tokens
    )


def merge_samples(*shards: DataFrame) -> DataFrame:
    """One record per term; if shards repeat a term, the last shard wins."""
    if not shards:
        raise ValueError("no shards to merge")
    columns = shards[0].columns
    numbered = [s.select(*columns, F.lit(i).alias("_shard")) for i, s in enumerate(shards)]
    return merge_sharded(reduce(DataFrame.unionByName, numbered), "_shard").drop("_shard")


def merge_sharded(samples: DataFrame, shard: str) -> DataFrame:
    """The same for shards in one table, read once: the record of the greatest ``shard``."""
    record = F.struct(*[c for c in samples.columns if c != "term"])
    return (
        samples.groupBy("term")
        .agg(F.max_by(record, shard).alias("_r"))
        .select(*[F.col("term") if c == "term" else F.col(f"_r.{c}") for c in samples.columns])
    )


def explode_selected(samples: DataFrame, text: str = "text") -> DataFrame:
    """One row per selected passage: ``seed, pos, text``."""
    # An outer explode: a plain one makes the optimizer evaluate the list twice.
    return samples.select(
        F.col("term").alias("seed"), F.posexplode_outer("selected").alias("pos", text)
    ).filter("pos is not null")


def explode_pairs(samples: DataFrame) -> DataFrame:
    """Passages and translations by position; the shorter list ends the pairing."""
    n = F.least(F.size("selected"), F.size("translation"))
    pairs = F.arrays_zip(
        F.slice("selected", F.lit(1), n).alias("source"),
        F.slice("translation", F.lit(1), n).alias("translation"),
    )
    return (
        samples.select(F.col("term").alias("seed"), F.posexplode_outer(pairs).alias("pos", "_p"))
        .filter("pos is not null")
        .select("seed", "pos", F.col("_p.source"), F.col("_p.translation"))
    )


def flatten_translations(samples: DataFrame) -> DataFrame:
    """Flat ``rid, seed, source, translation`` table, numbered by seed and position."""
    return with_rid(explode_pairs(samples), ["seed", "pos"]).drop("pos")


def prepare_passages(samples: DataFrame, max_tokens: int = 256) -> DataFrame:
    """Passages up to the limit, repaired after counting, with dense ids."""
    flat = explode_selected(non_empty_seeds(samples))
    return numbered_passages(limit_tokens(flat, "text", max_tokens))


def numbered_passages(kept: DataFrame) -> DataFrame:
    numbered = with_rid(kept, ["seed", "pos"])
    return numbered.select("rid", "seed", "token_count", repair_text(F.col("text")).alias("text"))


def prepare_counted(samples: DataFrame, max_tokens: int = 256) -> tuple[DataFrame, dict[str, int]]:
    """The same passages, and how many seeds and passages there were before and after each filter.

    The passages are stored once before they are numbered; the counts are taken
    by that job.
    """
    seeds = Observed(samples, seeds=F.count(F.lit(1)), seeds_with_passages=F.count_if(F.col("total_selected") != 0))
    flat = explode_selected(non_empty_seeds(seeds.df))
    short = token_count(F.col("text")) <= max_tokens
    passages = Observed(flat, passages=F.count(F.lit(1)), passages_kept=F.count_if(short))
    kept = write_out(limit_tokens(passages.df, "text", max_tokens), "passages")
    return numbered_passages(kept), seeds.get() | passages.get()


def regroup_completions(
    samples: DataFrame, completions: DataFrame, text: str = "completion"
) -> DataFrame:
    """Completions ``(seed, pos, text)`` back to their terms as ``translation``.

    Joined by key, never by running offsets.  A term without passages gets an
    empty list; a list is as long as the selection of its term.
    """
    lists = completions.groupBy("seed").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col(text).alias("text")))).alias("_c")
    )
    joined = samples.join(lists, F.col("term") == F.col("seed"), "left")
    kept = [c for c in samples.columns if c != "translation"]
    translation = F.coalesce(F.col("_c.text"), F.array().cast("array<string>"))
    return joined.select(*kept, translation.alias("translation"))


def funnel(df: DataFrame, stages: dict[str, Column], seed: str | None = None) -> DataFrame:
    """Rows left after each stage, in one pass.

    A row counts for a stage if it passed that stage and all before it.
    """
    counts = [c.alias(name) for name, c in funnel_counts(stages).items()]
    return df.groupBy(seed).agg(*counts) if seed else df.agg(*counts)
