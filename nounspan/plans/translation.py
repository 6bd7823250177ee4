"""Translate prompts or sample sets with a plugged-in translator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nounspan.functions.prompts import fill_template, wants_chat
from nounspan.functions.text import as_chat, clean_completion, token_count
from nounspan.operators.calls import ask_once
from nounspan.operators.inference import CallPolicy, translate
from nounspan.operators.samples import explode_selected, flatten_translations, has_text, regroup_completions
from nounspan.session import write_out
from nounspan.sources.readers import read_prompts, read_samples
from nounspan.sources.writers import add_model_column, export_samples, model_tag_text, write_table


def build_prompts(
    df: DataFrame, column: str, template_id: str | None = None, name: str = "prompt"
) -> DataFrame:
    """Add the prompt for each passage."""
    return df.withColumn(name, fill_template(F.col(column), template_id))


def passage_stats(df: DataFrame, column: str) -> DataFrame:
    """Number of passages and their mean length in words."""
    return df.agg(
        F.count(column).alias("n_passages"), F.avg(token_count(F.col(column))).alias("mean_words")
    )


def as_model_input(df: DataFrame, model_id: str, column: str = "prompt") -> DataFrame:
    """Wrap prompts into chat messages (as JSON) for models that want them."""
    if not wants_chat(model_id):
        return df
    return df.withColumn(column, F.to_json(as_chat(F.col(column))))


def completions(
    asked: DataFrame,
    keys: list[str],
    make_translator: Callable,
    model_id: str,
    policy: CallPolicy | None,
    extra: tuple[str, ...] = (),
    log: str | None = None,
) -> DataFrame:
    """``keys, completion`` for all prompts, stored; with a ``log`` no call is ever repeated."""
    if log is None:
        done = translate(asked, "prompt", make_translator, model_id, policy=policy, extra=extra)
        answer = F.col("translation")
    else:
        done = ask_once(asked, ["prompt", *extra], make_translator, model_id, log, policy=policy)
        answer = clean_completion(F.col("completion"))
    return write_out(done.select(*keys, answer.alias("completion")), "completions")


def translate_prompts(
    prompts: DataFrame,
    make_translator: Callable,
    model_id: str,
    target: str = "English",
    template_id: str | None = None,
    policy: CallPolicy | None = None,
    log: str | None = None,
) -> DataFrame:
    """Prompts table plus one column of completions; rows without text stay null."""
    asked = build_prompts(has_text(prompts, target), target, template_id)
    asked = as_model_input(asked, model_id).select("id", "prompt")
    done = completions(asked, ["id"], make_translator, model_id, policy, log=log)
    return add_model_column(prompts, done, model_id)


def translate_samples(
    samples: DataFrame,
    make_translator: Callable,
    model_id: str,
    template_id: str | None = None,
    policy: CallPolicy | None = None,
    log: str | None = None,
) -> DataFrame:
    """Sample records plus ``translation``, in the order of ``selected``."""
    asked = build_prompts(explode_selected(samples), "text", template_id)
    asked = as_model_input(asked, model_id)
    done = completions(asked, ["seed", "pos"], make_translator, model_id, policy, ("seed", "text"), log)
    return regroup_completions(samples, done)


def run_flatten(spark: SparkSession, samples_path: str, output_path: str) -> None:
    """Translated sample sets as a flat table ``rid, seed, source, translation``."""
    write_table(flatten_translations(read_samples(spark, samples_path)), output_path, "csv")


def run_prompt_translation(
    spark: SparkSession,
    prompts_path: str,
    output_folder: str,
    make_translator: Callable,
    model_id: str,
    target: str = "English",
    suffix: str = "",
    **options,
) -> str:
    """Translate a table of prompts and write it with the model's column; returns its path."""
    told = translate_prompts(read_prompts(spark, prompts_path), make_translator, model_id, target, **options)
    path = f"{output_folder.rstrip('/')}/translations_{model_tag_text(model_id)}{suffix}"
    write_table(told.withColumnRenamed("id", "ID"), path, "csv")
    return path


def run_sample_translation(
    spark: SparkSession, samples_path: str, output_path: str, make_translator: Callable, model_id: str, **options
) -> None:
    """Translate sample sets and write them with their translations, one record for each term."""
    export_samples(translate_samples(read_samples(spark, samples_path), make_translator, model_id, **options), output_path)
