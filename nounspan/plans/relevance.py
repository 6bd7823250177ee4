"""From labelled passages to scored passages."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nounspan.operators.relevance import (
    exclude_seen,
    fit_relevance,
    labelled_only,
    load_relevance,
    map_labels,
    mse,
    score_passages,
)
from nounspan.operators.samples import explode_selected
from nounspan.operators.sampling import rank_passages, stratified_split
from nounspan.session import write_out
from nounspan.sources.readers import in_file_order, read_csv, read_labelled, read_samples
from nounspan.sources.writers import write_splits, write_table


def make_splits(labelled: DataFrame, ids: list[str], seed: int = 42) -> DataFrame:
    """Labelled passages with their split; rows with an unknown letter are dropped."""
    return stratified_split(map_labels(labelled_only(labelled)), "label", ids, seed=seed)


def train(splits: DataFrame, **options) -> tuple[PipelineModel, dict[float, float], float]:
    """Fit on train, choose on validation, report the error on test."""
    stored = write_out(splits.select("source", "label", "split"), "splits")
    parts = {name: stored.filter(stored["split"] == name) for name in ("train", "val", "test")}
    model, errors = fit_relevance(parts["train"], parts["val"], **options)
    return model, errors, mse(model.transform(parts["test"])).first()["mse"]


def score_unseen(
    passages: DataFrame, seen: DataFrame, model: PipelineModel, ties: list[str]
) -> DataFrame:
    """Passages ``seed, sentence`` that were not used before, best first."""
    fresh = exclude_seen(passages, seen, "sentence")
    return rank_passages(score_passages(fresh, model, "sentence"), ties)


def run_splits(spark: SparkSession, labelled_path: str, output_path: str, seed: int = 42) -> DataFrame:
    """Write the three splits of a labelled table, numbered in file order; returns their sizes by label."""
    rows = in_file_order(read_csv(spark, labelled_path), "rid")
    splits = write_out(make_splits(rows, ["rid"], seed), "splits")
    write_splits(splits, output_path, "csv")
    return splits.groupBy("split", "label").agg(F.count("*").alias("n"))


def run_scoring(
    spark: SparkSession, samples_path: str, seen_path: str, model_path: str, output_folder: str
) -> str:
    """Score the passages of sample sets that were not used before and write them, best first.

    The table is named after the sample set; returns its path.
    """
    passages = explode_selected(read_samples(spark, samples_path), "sentence").drop("pos")
    seen = read_labelled(spark, seen_path, ("source",))
    scored = score_unseen(passages, seen, load_relevance(model_path), ["seed", "sentence"])
    name = samples_path.rstrip("/").rsplit("/", 1)[-1]
    path = f"{output_folder.rstrip('/')}/{name.rsplit('.', 1)[0] if '.' in name[1:] else name}"
    write_table(scored, path, "csv")
    return path
