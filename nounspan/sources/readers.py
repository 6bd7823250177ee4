"""Readers for lexicons, corpora, sample sets and annotation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nounspan.functions.text import strip
from nounspan.operators.ids import with_rid
from nounspan.sources import schemas
from nounspan.sources.quoted import PLACE, read_large_csv

# Corpora by name, each with the style of its files.
CORPORA = {"europarl": "lines", "wikipedia": "documents"}
TRUE_WORDS = ("true", "1", "1.0", "y", "yes")


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", columns: list[str] | None = None, large: bool = False
) -> DataFrame:
    """Delimited file with a header row, all columns as strings, blanks as null.

    Quoted cells may hold separators, doubled quotes and line breaks, so one
    file is one task, unless it is ``large``: then it is split at true ends of
    records, which costs a shuffle of its lines.  The header is taken from the
    first line, so column order is free.
    """
    header = (
        spark.read.text(path).limit(1).select(F.regexp_replace("value", '"', "")).first()
    )
    names = header[0].strip("﻿\r").split(sep) if header else []
    schema = T.StructType([T.StructField(n or "_row", T.StringType()) for n in names])
    if large:
        df = read_large_csv(spark, path, schema, sep)
        return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df
    df = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", True)
        # Column names are checked against every file, unless one is blank.
        .option("enforceSchema", "" in names)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("maxCharsPerColumn", -1)
        .csv(path)
    )
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Form lexicon, plural or singular; blank cells become ``""``.

    ``row_no`` is the file order, which the ascending ids of the file carry.
    """
    df = read_csv(spark, path)
    if "ID" not in df.columns:
        df = in_file_order(df, "ID")
    known = [h for h in schemas.LEXICON_HEADERS if h in df.columns]
    df = df.select(*[F.col(f"`{h}`").alias(schemas.LEXICON_HEADERS[h]) for h in known])
    df = df.na.fill("").withColumn("id", F.col("id").cast("long"))
    return df.withColumn("row_no", F.col("id"))


def corpus_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every line of a text column is a document of its own, stripped."""
    lines = df.select(
        id_col, F.posexplode_outer(F.split(text_col, "\n")).alias("line_no", "line")
    ).filter("line is not null")
    return lines.select(id_col, "line_no", strip(F.col("line")).alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line corpus from text files: a dense number by file and place in the file, stripped line.

    The numbers are the same however the files are split into tasks.
    """
    lines = in_file_order(spark.read.text(path), "doc_id")
    return lines.select("doc_id", strip(F.col("value")).alias("text"))


def corpus_documents(
    spark: SparkSession, path: str, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Document corpus from Parquet; only the two needed columns are read."""
    return spark.read.parquet(path).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")
    )


def load_corpus(
    spark: SparkSession, name: str, path: str, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Corpus by name.  A line corpus may be stored as text files or as a table.

    Every line is a document with a dense number of its own; lines of a table
    keep the row they come from as ``source_id, line_no``.
    """
    if name not in CORPORA:
        raise ValueError(f"no corpus is called {name!r}; there are {', '.join(sorted(CORPORA))}")
    if CORPORA[name] == "documents":
        return corpus_documents(spark, path, text_col, id_col)
    if path.rstrip("/").endswith(".parquet"):
        lines = corpus_lines(corpus_documents(spark, path, text_col, id_col))
        lines = lines.withColumnRenamed("doc_id", "source_id")
        return with_rid(lines, ["source_id", "line_no", "text"], "doc_id")
    return read_lines(spark, path)


def read_samples(spark: SparkSession, path: str, indent: int | None = 4) -> DataFrame:
    """Sample sets: one top-level JSON object keyed by term, one row per term.

    An indented file is cut at the line that closes each entry, so it splits
    across tasks like any text file; a line break inside a string is escaped
    and can never look like that line.  ``indent=None`` reads JSON lines.
    """
    if indent is None:
        return spark.read.schema(schemas.SAMPLES).json(path)
    pad = " " * indent
    entry = T.MapType(T.StringType(), schemas.SAMPLE_RECORD)
    pieces = spark.read.option("lineSep", f"\n{pad}}},\n").text(path)
    # What is left of an entry: no outer braces, and perhaps no closing brace.
    body = F.regexp_replace("value", r"\A\s*\{?\s*(?=\")", "")
    last = body.rlike(rf"\n{pad}\}}\s*\}}?\s*\z")
    body = F.when(last, F.regexp_replace(body, rf"\n{pad}\}}\s*\}}?\s*\z", "")).otherwise(body)
    parsed = pieces.select(body.alias("body")).filter(F.contains("body", F.lit(":")))
    one = F.from_json(F.concat(F.lit("{"), F.col("body"), F.lit("}}")), entry)
    return parsed.select(F.explode(one).alias("term", "r")).select("term", "r.*")


def read_annotations(spark: SparkSession, path: str, sep: str = "\t", large: bool = False) -> DataFrame:
    """Annotated table keyed by ``ID``; ``to_keep`` becomes a boolean, blank is false."""
    df = read_csv(spark, path, sep, large=large)
    keep = F.lower(F.trim("to_keep")).isin(*TRUE_WORDS)
    rest = [c for c in df.columns if c not in ("ID", "to_keep")]
    return df.select(
        F.col("ID").cast("long").alias("id"),
        F.coalesce(keep, F.lit(False)).alias("to_keep"),
        *rest,
    )


def read_translations(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    """Translations keyed by ``seed_noun`` (``seed`` is accepted), blanks as ``""``."""
    df = read_csv(spark, path, large=large).na.fill("")
    if "seed" in df.columns and "seed_noun" not in df.columns:
        df = df.withColumnRenamed("seed", "seed_noun")
    return df.withColumn("rid", F.col("rid").cast("long")) if "rid" in df.columns else df


def in_file_order(df: DataFrame, name: str) -> DataFrame:
    """Dense number from 0 by file path and place in the file.

    A task reads a block in order, so its running number orders the rows of a
    block, and the start of the block orders the blocks of a file.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    order = ["_file", "_block", "_at"]
    return with_rid(placed, order, name).drop(*order)


def read_prompts(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    """Prompts table with a dense ``id`` from 0 in file order."""
    if large:
        rows = read_large_csv(spark, path, read_csv(spark, path).schema, place=True)
        return with_rid(rows, PLACE, "id").drop(*PLACE)
    return in_file_order(read_csv(spark, path), "id")


def read_labelled(
    spark: SparkSession, path: str, columns: tuple = ("source", "label"), large: bool = False
) -> DataFrame:
    """Labelled or exclusion table, cut to the needed columns."""
    df = read_csv(spark, path, columns=list(columns), large=large)
    return df.withColumn("label", F.col("label").cast("double")) if "label" in columns else df
