"""Writers for sample sets, flat tables, splits and per-model columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Corpus tags found in paths.
CORPUS_TAG, OTHER_TAG = "europarl", "wikipedia"


def write_samples(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON record per line and term; UTF-8 is written as it is."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def export_samples(df: DataFrame, path: str, indent: int = 4) -> None:
    """One JSON object keyed by term, over part files.

    The part files, concatenated in name order, are one indented JSON object.
    Terms are unique, so the first and last term tell where the braces go.
    """
    pad = " " * indent
    fields = [c for c in df.columns if c != "term"]
    first, last = df.agg(F.min("term"), F.max("term")).first()

    def quoted(c: Column) -> Column:
        # A one-element array renders the string with JSON escapes.
        text = F.to_json(F.array(c))
        return F.substring(text, F.lit(2), F.length(text) - 2)

    record = F.array_join(
        F.array(
            *[
                F.concat(
                    F.lit(f'{pad}{pad}"{c}": '),
                    F.coalesce(
                        F.to_json(c) if c in ("selected", "translation") else F.col(c).cast("string"),
                        F.lit("null"),
                    ),
                )
                for c in fields
            ]
        ),
        ",\n",
    )
    line = F.concat(
        F.when(F.col("term") == F.lit(first), F.lit("{\n")).otherwise(F.lit("")),
        F.lit(pad),
        quoted(F.col("term")),
        F.lit(": {\n"),
        record,
        F.lit(f"\n{pad}}}"),
        F.when(F.col("term") == F.lit(last), F.lit("\n}")).otherwise(F.lit(",")),
    )
    df.orderBy("term").select(line.alias("value")).write.text(path)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    sep: str = ",",
    partition_by: tuple[str, ...] = (),
    mode: str = "errorifexists",
) -> None:
    """Flat table as Parquet or delimited text, one folder per system and corpus.

    Rows of one folder are brought together first, so that tasks do not each
    write a file into every folder; AQE splits a folder that is too large for
    one task and merges small ones.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer = (
            writer.option("sep", sep)
            .option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .option("nullValue", "")
            .option("emptyValue", "")
        )
    writer.format(fmt).save(path)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Train, validation and test rows in one pass, one folder per split."""
    write_table(df, path, fmt, partition_by=("split",))


def add_model_column(prompts: DataFrame, completions: DataFrame, model_id: str) -> DataFrame:
    """Prompts with one new column per model, null where nothing was translated."""
    named = completions.select("id", F.col("completion").alias(model_tag_text(model_id)))
    return prompts.join(named, "id", "left")


def add_model_columns(
    prompts: DataFrame, completions: DataFrame, model_ids: list[str]
) -> DataFrame:
    """The same for several models at once, from ``(id, model, completion)``."""
    wide = (
        completions.groupBy("id")
        .pivot("model", model_ids)
        .agg(F.first("completion", ignorenulls=True))
        .select("id", *[F.col(f"`{m}`").alias(model_tag_text(m)) for m in model_ids])
    )
    return prompts.join(wide, "id", "left")


def model_tag_text(model_id: str) -> str:
    return model_id.replace("/", "--")


def base_name(path: Column) -> Column:
    """File name without folders and without its last extension."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    return F.regexp_replace(name, r"(.)\.[^.]*\z", "$1")


def model_tag(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("--"))


def corpus_tag(path: Column) -> Column:
    return F.when(F.contains(path, F.lit(CORPUS_TAG)), CORPUS_TAG).otherwise(OTHER_TAG)


def run_tags(df: DataFrame, path_col: str, model_col: str) -> DataFrame:
    """Output names derived from inputs: base name, model tag, corpus tag."""
    path = F.col(path_col)
    return df.select(
        "*",
        base_name(path).alias("base_name"),
        model_tag(F.col(model_col)).alias("model_tag"),
        corpus_tag(path).alias("corpus_tag"),
    )
