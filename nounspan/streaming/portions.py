"""Tables that grow by whole portions: written aside, then published by a manifest.

A folder holds ``_data``, one folder of Parquet files for each portion that was
ever begun, and ``_manifest``, one small file for each that was finished.  A
reader opens only what the manifests name, so a portion that fails halfway is
never seen, whatever the committer of the store leaves behind.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from nounspan.operators.observed import Observed
from nounspan.sources import storage


class PortionTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def portions(self) -> list[dict]:
        """Manifests of the published portions: name, folder, rows and schema, in order of name."""
        folder = f"{self.path}/_manifest"
        found = [n for n in storage.names(self.spark, folder) if n.endswith(".json")]
        return [json.loads(storage.read_text(self.spark, f"{folder}/{n}")) for n in found]

    def write(self, df: DataFrame, name: str) -> int:
        """Store a portion under a name and return its rows; a published name is left as it is.

        The rows are counted as they are written.  Two writers of one name each
        write a folder of their own; the manifest of the later one stands.
        """
        for done in self.portions():
            if done["name"] == name:
                return done["rows"]
        # Spark skips names with an underscore, so nobody reads the folder past its manifests.
        folder = f"_data/{name}-{uuid.uuid4().hex}"
        seen = Observed(df)
        seen.df.write.parquet(f"{self.path}/{folder}")
        rows = seen.rows()
        storage.make_folder(self.spark, f"{self.path}/_manifest")
        entry = {"name": name, "folder": folder, "rows": rows, "schema": json.loads(df.schema.json())}
        storage.publish(self.spark, f"{self.path}/_manifest/{name}.json", json.dumps(entry))
        return rows

    def read(self) -> DataFrame | None:
        """All published rows, or None before the first portion."""
        done = self.portions()
        if not done:
            return None
        schema = StructType.fromJson(done[0]["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{d['folder']}" for d in done])

    def clean(self) -> list[str]:
        """Delete the folders of portions that were never published; only while nobody writes."""
        kept = {d["folder"] for d in self.portions()}
        lost = [f"_data/{n}" for n in storage.names(self.spark, f"{self.path}/_data")]
        lost = [folder for folder in lost if folder not in kept]
        for folder in lost:
            storage.delete(self.spark, f"{self.path}/{folder}")
        return lost
