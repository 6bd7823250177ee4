"""Model calls that are never repeated: distinct inputs, and a log of their answers.

Equal inputs are one call.  Its answer is committed to a log in the shared
store together with its batch, and rows get their answers from the log.  A task
that is run again, on another executor or in a later run, finds the batches
that were committed before and makes only the calls that are missing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nounspan.operators.inference import Batch, CallPolicy, _Caller
from nounspan.session import write_out
from nounspan.sources import storage

LOG = "digest string, completion string, attempts int"
_LOG = pa.schema([("digest", pa.string()), ("completion", pa.string()), ("attempts", pa.int32())])
# Rows of one commit: as many calls at most are lost with an executor.
COMMIT_ROWS = 256


def call_digest(model_id: str, columns: list[str]) -> Column:
    """What identifies a call: the model and all that is sent; null if an input is null."""
    sent = F.sha2(F.to_json(F.struct(F.lit(model_id).alias("_model"), *columns)), 256)
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return F.when(whole, sent)


def short_digest(digest: Column) -> Column:
    """The first 128 bits of a digest as bytes: what rows and answers meet by, a quarter of its size."""
    return F.substring(F.unhex(digest), 1, 16)


def logged_answers(spark: SparkSession, log: str, short: bool = False) -> DataFrame:
    """``digest, completion, attempts`` of all committed batches, one row for each digest, which may be ``short``."""
    storage.make_folder(spark, log)
    rows = spark.read.schema(LOG).parquet(log)
    if short:
        rows = rows.withColumn("digest", short_digest(F.col("digest")))
    # Two tasks may have answered one input at the same time; the same answer holds for all rows.
    return rows.groupBy("digest").agg(F.min(F.struct("attempts", "completion")).alias("a")).select(
        "digest", "a.completion", "a.attempts"
    )


def _commit(store: fs.FileSystem, path: str, rows: list[tuple]) -> None:
    """Write a batch under a name that readers skip, then rename it."""
    folder, name = path.rsplit("/", 1)
    hidden = f"{folder}/_{uuid.uuid4().hex}"
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _LOG)]
    pq.write_table(pa.table(columns, schema=_LOG), hidden, filesystem=store)
    store.move(hidden, path)


def name_of(folder: str, batch: pd.DataFrame) -> str:
    return f"{folder}/{hashlib.sha256(''.join(batch['digest']).encode()).hexdigest()}.parquet"


def call_pending(
    pending: DataFrame,
    columns: list[str],
    make_model: Callable[[], Batch],
    log: str,
    batch_size: int = 16,
    policy: CallPolicy | None = None,
    commit_rows: int = COMMIT_ROWS,
) -> DataFrame:
    """Call the model for ``digest`` and ``columns``; commits answers, returns the failures.

    The batches of a task follow from its rows, so a second attempt looks for
    the same names in the log and does not call for those that are there.
    """
    rules = policy or CallPolicy()
    place = storage.full_name(pending.sparkSession, log)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = fs.FileSystem.from_uri(place)
        caller = None
        for part in parts:
            for at in range(0, len(part), commit_rows):
                batch = part.iloc[at : at + commit_rows]
                path = name_of(folder, batch)
                while len(batch) and store.get_file_info(path).type != fs.FileType.NotFound:
                    # An earlier attempt committed this batch; what it could not answer is left.
                    done = set(pq.read_table(path, columns=["digest"], filesystem=store)["digest"].to_pylist())
                    batch = batch[~batch["digest"].isin(done)]
                    path = name_of(folder, batch)
                if not len(batch):
                    continue
                caller = caller or _Caller(make_model(), rules)
                inputs = batch[columns[0]].tolist() if len(columns) == 1 else batch[columns].to_dict("records")
                out = list(zip(batch["digest"], caller.run(inputs, batch_size)))
                answered = [(d, completion, tried) for d, (completion, error, tried, _) in out if error is None]
                if answered:
                    _commit(store, path, answered)
                failed = [(d, error, tried) for d, (_, error, tried, _) in out if error is not None]
                if failed:
                    yield pd.DataFrame(failed, columns=["digest", "error", "tried"])

    dealt = pending
    if rules.calls:
        dealt = dealt.repartition(rules.tasks(), "digest")
    order = dealt.sortWithinPartitions("digest").select("digest", *columns)
    return order.mapInPandas(run, "digest string, error string, tried int")


def ask_once(
    df: DataFrame,
    columns: list[str],
    make_model: Callable[[], Batch],
    model_id: str,
    log: str,
    batch_size: int = 16,
    policy: CallPolicy | None = None,
    commit_rows: int = COMMIT_ROWS,
    digest: str | None = None,
) -> DataFrame:
    """Add ``completion, error, attempts``: every distinct input is sent once, ever.

    ``columns`` are sent to the model, one as a list of values, several as a
    list of dicts; a row with a null among them is not sent and gets nulls.
    Failed calls carry their error and are tried again by the next run.  The
    calls are made when this function is called; the rows then read the log as
    it is.  ``digest`` names a column for the short digest of a row's call, by
    which the rows stand together.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_call", short_digest(call_digest(model_id, columns)))
    asked = keyed.filter("_call IS NOT NULL")
    if storage.exists(spark, log):
        # Digests alone tell what is missing; inputs are shuffled only for that.
        committed = spark.read.schema(LOG).parquet(log).select(short_digest(F.col("digest")).alias("_call"))
        missing = asked.select("_call").distinct().join(committed, "_call", "left_anti")
        missing = write_out(missing, "missing-calls")
        asked = asked.filter("false") if missing.isEmpty() else asked.join(missing, "_call", "left_semi")
    storage.make_folder(spark, log)
    inputs = asked.groupBy("_call").agg(*[F.first(c).alias(c) for c in columns])
    pending = inputs.select(call_digest(model_id, columns).alias("digest"), *columns)
    failed = write_out(call_pending(pending, columns, make_model, log, batch_size, policy, commit_rows), "failed-calls")
    answers = logged_answers(spark, log, short=True).withColumnRenamed("digest", "_call")
    known = answers.withColumn("error", F.lit(None).cast("string"))
    if not failed.isEmpty():
        # What failed here may have been answered by another run meanwhile.
        errors = failed.withColumn("_call", short_digest(F.col("digest"))).join(answers.select("_call"), "_call", "left_anti")
        known = known.unionByName(
            errors.select("_call", F.lit(None).cast("string").alias("completion"), F.col("tried").alias("attempts"), "error")
        )
    return keyed.join(known, "_call", "left").select(
        *[F.col(f"`{c}`") for c in df.columns], "completion", "error", "attempts",
        *([F.col("_call").alias(digest)] if digest else []),
    )
