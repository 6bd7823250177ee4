"""Declared schemas of the files that the readers accept."""

from __future__ import annotations

from pyspark.sql import types as T


# Files carry these headers; the readers rename them.
LEXICON_HEADERS = {
    "ID": "id",
    "German_MP": "german_mp",
    "German_FP": "german_fp",
    "German_MS": "german_ms",
    "German_FS": "german_fs",
    "Gender-Neutral": "gender_neutral",
    "Gender-Inclusive": "gender_inclusive",
    "English": "english",
}

SAMPLE_FIELDS = [
    T.StructField("total_matches", T.IntegerType()),
    T.StructField("total_selected", T.IntegerType()),
    T.StructField("selected", T.ArrayType(T.StringType())),
    T.StructField("translation", T.ArrayType(T.StringType())),
]
SAMPLE_RECORD = T.StructType(SAMPLE_FIELDS)
SAMPLES = T.StructType([T.StructField("term", T.StringType()), *SAMPLE_FIELDS])
