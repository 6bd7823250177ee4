"""Relevance of passages: labels, error measures, a fitted regressor."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nounspan.functions.text import NON_WORD
from nounspan.operators.ridge import ridge_grid
from nounspan.session import small_side

# What the annotators' letters are worth.
LABELS = {"n": 0.0, "b": 0.5, "y": 1.0}


def label_value(comment: Column) -> Column:
    value = F.lit(None).cast("double")
    for letter, worth in LABELS.items():
        value = F.when(comment == letter, F.lit(worth)).otherwise(value)
    return value


def map_labels(df: DataFrame, column: str = "comment") -> DataFrame:
    """Add ``label``; a letter that is not known gives null."""
    return df.withColumn("label", label_value(F.col(column)))


def labelled_only(df: DataFrame) -> DataFrame:
    """Rows that have both a source and a comment."""
    return df.na.drop(subset=["source", "comment"])


def value_counts(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def mse(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean squared error over rows that have both values."""
    return df.agg(F.avg(F.pow(F.col(label) - F.col(prediction), 2)).alias("mse"))


def exclude_seen(df: DataFrame, seen: DataFrame, text: str = "sentence") -> DataFrame:
    """Drop sentences that occur in an exclusion set, compared by a digest of the whole string.

    Only digests of a fixed length are fetched, broadcast or shuffled for the set.
    """
    digest = lambda c: F.sha2(F.col(c), 256)
    known = seen.select(digest("source").alias("_seen")).filter("_seen is not null").distinct()
    return df.join(small_side(known), digest(text) == F.col("_seen"), "left_anti")


def attach_scores(matches: DataFrame, score: Column, most: float | None = None) -> DataFrame:
    """Add ``score`` in the row it belongs to; below zero counts as zero, above ``most`` as that."""
    bounded = F.greatest(score.cast("double"), F.lit(0.0))
    return matches.withColumn("score", bounded if most is None else F.least(bounded, F.lit(most)))


def fit_relevance(
    train: DataFrame,
    val: DataFrame,
    grid: Iterable[float] = (0.01, 0.1, 1.0),
    features: int = 1 << 9,
    source: str = "source",
) -> tuple[PipelineModel, dict[float, float]]:
    """Fit text -> label for several penalties; keep the one with the least validation error.

    Returns the model and the validation error per penalty.  One pass over both
    sets gives the errors of the whole grid, and one more fits the model of the
    chosen penalty.  Up to 4096 hashed features it sums the normal equations;
    with more, Spark turns to an iterative solver with a pass per step.
    """
    words = RegexTokenizer(
        inputCol=source, outputCol="_words", pattern=NON_WORD, gaps=True, toLowercase=True
    )
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features)
    weights = IDF(inputCol="_counts", outputCol="_features")
    slim = train.select(source, "label").na.drop()
    text_model = Pipeline(stages=[words, counts, weights]).fit(slim)
    named = lambda df, split: df.select(source, "label").na.drop().withColumn("split", F.lit(split))
    both = text_model.transform(named(train, "train").unionByName(named(val, "val")))
    tried = ridge_grid(
        both.select("label", "split", vector_to_array("_features").alias("x")), "x", "label", "split", grid
    )
    errors = {penalty: error for penalty, (error, _) in tried.items()}
    best = LinearRegression(
        featuresCol="_features",
        labelCol="label",
        predictionCol="prediction",
        regParam=min(errors, key=errors.get),
        maxIter=30,
    ).fit(text_model.transform(slim).select("_features", "label"))
    return PipelineModel([*text_model.stages, best]), errors


def save_relevance(model: PipelineModel, path: str) -> None:
    """Store a fitted model in a folder that every executor can reach."""
    model.write().overwrite().save(path)


def load_relevance(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_passages(df: DataFrame, model: PipelineModel, text: str = "source") -> DataFrame:
    """Add ``score`` by the fitted model, as a fraction: predictions are bounded by zero and one."""
    scored = model.transform(df.withColumn("source", F.coalesce(F.col(text), F.lit(""))))
    kept = [F.col(f"`{c}`") for c in df.columns]
    return attach_scores(scored, F.col("prediction"), 1.0).select(*kept, "score")
