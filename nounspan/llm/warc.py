"""Deterministic sharded WARC writer and reader.

Records are sorted by id in shards of bounded size; borders are exact ranks,
so the same table gives the same files on any cluster.  A task streams the
records of its shards into files of one gzip member per record and begins a
new file when the compressed size is reached.  A file is written under a
temporary name and renamed when complete; a table of all files, the manifest,
is written last, and readers open only what it names.  A lost task writes the
same bytes again.

Of equal payloads of some size only one is stored; the others are revisit records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nounspan.llm.common import id_key
from nounspan.operators.ids import with_rid
from nounspan.session import scratch_path

LEAST_REVISIT = 1000
FILE_BYTES = 8 * 1024 * 1024
SHARD_ROWS = 2048
READ_BYTES = 64 * 1024
MOST_SHARDS = 65536
DATE = "2025-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, shard long, records long, bytes long, sha256 string"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        fs.LocalFileSystem(), folder
    )


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, headers and digests made anew."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    name = "none" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: {_base32(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: {_base32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        shown = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
        head.insert(3, f"WARC-Target-URI: {shown}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Files:
    """The file that is being written, and the manifest rows of those complete."""

    def __init__(self, folder: str, file_bytes: int):
        self.system, self.path = _system(folder)
        self.file_bytes, self.shard, self.roll = file_bytes, None, 0
        self.parts: list[bytes] = []
        self.size, self.done = 0, []

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.roll = shard, 0
        member = gzip.compress(data, 6, mtime=0)
        if self.parts and self.size + len(member) > self.file_bytes:
            self.close()
        self.parts.append(member)
        self.size += len(member)

    def close(self) -> None:
        if not self.parts:
            return
        name = f"part-{self.shard:07d}-{self.roll:05d}.warc.gz"
        temporary = f"{self.path}/.{name}.{uuid.uuid4().hex}.tmp"
        content = b"".join(self.parts)
        with self.system.open_output_stream(temporary) as out:
            out.write(content)
        self.system.move(temporary, f"{self.path}/{name}")
        self.done.append((name, self.shard, len(self.parts), self.size, hashlib.sha256(content).hexdigest()))
        self.roll, self.parts, self.size = self.roll + 1, [], 0


def _writer(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, told = _Files(folder, file_bytes), (None, None)
        for batch in batches:
            for row in batch.to_pylist():
                which = row["key"], row["digest"]
                if row["kind"] == 0:
                    # What was decided about the records of this id and payload, just before them.
                    told = (which, row["refers_to"])
                    continue
                refers_to = told[1] if told[0] == which else None
                files.add(row["shard"], record(row["page_id"], row["url"], row["payload"], refers_to))
        files.close()
        columns = list(zip(*files.done)) or [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in MANIFEST.split(", ")]
        )

    return run


def decisions(pages: DataFrame) -> DataFrame:
    """``key, digest, refers_to`` of the revisit records: pages are grouped by SHA-256 and size.

    The largest id of a group is reduced before the shuffle; groups of one
    never meet again.
    """
    large = pages.filter("digest IS NOT NULL").select(
        "key", "page_id", "digest", F.octet_length("payload").alias("n")
    )
    best = (
        large.groupBy("digest", "n")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("k"))
        .filter("k > 1 AND refers_to IS NOT NULL")
        .drop("k")
    )
    return (
        large.join(best, ["digest", "n"])
        .filter("page_id IS NULL OR page_id <> refers_to")
        .select("key", "page_id", "digest", "refers_to")
    )


def write_warc(
    df: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record for each row and return the manifest, which is stored beside the files.

    Null html is an empty payload, a null url leaves out the target.  Rows
    without an id come first.  Of equal payloads of at least 1000 bytes the one
    with the largest id is the response; repeated rows of that id are all
    responses.  Rows of one id, or without one, are decided each by their
    payload; their records have one name.  An empty table writes an empty
    manifest.
    """
    spark = df.sparkSession
    pages = df.select(
        id_key(id_col).alias("key"),
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.when(F.octet_length("payload") >= LEAST_REVISIT, F.sha2("payload", 256)))
    ranks = with_rid(pages.select("key"), [F.col("key")], name="at")
    total = ranks.count()
    rows = max(SHARD_ROWS, -(-total // MOST_SHARDS))
    # At most MOST_SHARDS numbers, whatever the input.
    borders = [r["key"] for r in ranks.filter((F.col("at") % rows == 0) & (F.col("at") > 0)).select("key").collect()]
    borders = sorted(set(borders))

    @F.pandas_udf("long")
    def shard_of(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(borders, k)).astype("int64")

    whole = pages.select("key", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "digest", "page_id", "url", "payload")
    told = decisions(pages).groupBy("key", "digest").agg(F.max("refers_to").alias("refers_to")).select(
        "key",
        F.lit(0).alias("kind"),
        "refers_to",
        "digest",
        F.lit(None).cast("long").alias("page_id"),
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("binary").alias("payload"),
    )
    # Decisions travel with the pages: one exchange, and the sort puts them before their page.
    placed = whole.unionByName(told).withColumn("shard", shard_of("key"))
    system, path = _system(folder)
    system.create_dir(path, recursive=True)
    # A task for each shard, whatever the session's shuffle partitions.
    parts = placed.repartitionById(len(borders) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "key", "digest", "kind", "url")
    manifest = f"{folder.rstrip('/')}/manifest"
    parts.mapInArrow(_writer(folder, file_bytes), MANIFEST.replace("path", "name")).withColumnRenamed(
        "name", "path"
    ).write.mode("overwrite").parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, intact boolean, payload binary"
)


def records_of(content: bytes) -> Iterator[dict]:
    """Records of one file, member by member; digests are computed anew."""
    view, at = memoryview(content), 0
    while at < len(view):
        # Given in pieces, or what is left of the file would be copied after every member.
        member, parts = zlib.decompressobj(31), []
        while not member.eof and at < len(view):
            piece = view[at : at + READ_BYTES]
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        data = b"".join(parts)
        head, _, tail = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = tail[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        said = base64.b32decode(fields["WARC-Payload-Digest"][5:])
        kind = fields["WARC-Type"]
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        whole = _base32(hashlib.sha1(block).digest()) == fields["WARC-Block-Digest"]
        if kind == "response":
            whole = whole and hashlib.sha1(payload).digest() == said and len(payload) == length
        number = lambda name: None if (x := fields[name][10:-1]) == "none" else int(x)
        yield {
            "page_id": number("WARC-Record-ID"),
            "url": fields.get("WARC-Target-URI"),
            "payload_bytes": length,
            "payload_digest": said.hex(),
            "record_type": kind,
            "refers_to": number("WARC-Refers-To") if "WARC-Refers-To" in fields else None,
            "intact": whole,
            "payload": payload,
        }


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the files that the manifest names.

    ``intact`` tells whether digests and lengths agree with the content.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    named = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("path"), "content")
    strays = named.select("path").join(manifest.select("path"), "path", "left_anti")
    if not strays.isEmpty():
        # Left by a write that never ended; without them no content need be matched.
        named = named.join(manifest.select("path"), "path", "left_semi")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def read(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                found = list(records_of(content))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[n] for r in found], k) for n, k in zip(names, kinds)], names
                )

    return named.select("content").mapInArrow(read, RECORDS)


def through_warc(df: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write a table as archives and read them back."""
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "warc")
    write_warc(df, folder, **columns)
    return read_warc(spark, folder)
