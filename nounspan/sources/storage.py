"""Files in the shared store, through the file system that Spark itself uses."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def make_folder(spark: SparkSession, path: str) -> None:
    store, place = _at(spark, path)
    store.mkdirs(place)


def full_name(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as workers need it."""
    store, place = _at(spark, path)
    return store.makeQualified(place).toString()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    store, place = _at(spark, path)
    if not store.exists(place):
        return []
    return sorted(status.getPath().getName() for status in store.listStatus(place))


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _at(spark, path)
    return store.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    store, place = _at(spark, path)
    store.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str:
    store, place = _at(spark, path)
    stream = store.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file at once: it is there in full or not at all.

    It is written under a temporary name, which readers skip, and renamed.
    """
    store, place = _at(spark, path)
    _, hidden = _at(spark, f"{place.getParent().toString()}/.{uuid.uuid4().hex}")
    stream = store.create(hidden)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not store.rename(hidden, place):
        store.delete(hidden, False)
        raise OSError(f"cannot publish {path}")
