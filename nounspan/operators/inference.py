"""Pluggable batched inference: translators, judges and taggers.

These are the only operators that use Python workers.  The model column goes
to Python over Arrow; all other columns stay in the JVM.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nounspan.functions.prompts import NOT_JUDGED, build_prompt
from nounspan.functions.text import clean_completion

Batch = Callable[[list], list]
REPORT = ("attempts", "pauses")


@dataclass(frozen=True)
class CallPolicy:
    """Retries and rate limit around a remote model.

    A call is tried ``max_attempts`` times with random exponential pauses.
    After ``calls`` calls a pause of ``window`` seconds follows; the quota is
    divided by ``parallelism``, the number of tasks that call at once.
    """

    max_attempts: int = 3
    min_wait: float = 1.0
    max_wait: float = 60.0
    calls: int | None = None
    window: float = 65.0
    parallelism: int = 1
    sleep: Callable[[float], None] = time.sleep

    def tasks(self) -> int:
        """Tasks that may call at once without exceeding the quota."""
        return min(self.parallelism, self.calls) if self.calls else self.parallelism

    def quota(self) -> int | None:
        return self.calls // self.tasks() if self.calls else None

    def pause(self, attempt: int) -> float:
        return min(self.max_wait, random.uniform(self.min_wait, self.min_wait * 2**attempt))


class _Caller:
    """Applies a policy to a batch function inside one task.

    ``pauses`` counts the full windows that the task has waited for.
    """

    def __init__(self, model: Batch, policy: CallPolicy):
        self.model, self.policy, self.made, self.pauses = model, policy, 0, 0

    def _try(self, inputs: list) -> tuple[list | None, str | None, int]:
        error, attempt = None, 0
        for attempt in range(1, self.policy.max_attempts + 1):
            # Every attempt is a call; a full window pauses the next one, not the last.
            self._spend(len(inputs))
            try:
                outputs = self.model(inputs)
                if len(outputs) != len(inputs):
                    raise ValueError("the model returned a list of another length")
                return outputs, None, attempt
            except Exception as exc:  # noqa: BLE001 - any model failure is a row error
                error = f"{type(exc).__name__}: {exc}"
                if attempt < self.policy.max_attempts:
                    self.policy.sleep(self.policy.pause(attempt))
        return None, error, attempt

    def _spend(self, n: int) -> None:
        quota = self.policy.quota()
        if quota is None:
            return
        if self.made and self.made + n > quota:
            self.policy.sleep(self.policy.window)
            self.made, self.pauses = 0, self.pauses + 1
        self.made += n

    def run(
        self, inputs: list, batch_size: int
    ) -> Iterator[tuple[str | None, str | None, int, int]]:
        """Per input: output, error, attempts it was part of, pauses of the task so far."""
        quota = self.policy.quota()
        step = min(batch_size, quota) if quota else batch_size
        for at in range(0, len(inputs), step):
            batch = inputs[at : at + step]
            outputs, error, tried = self._try(batch)
            if outputs is not None:
                yield from ((o, None, tried, self.pauses) for o in outputs)
            elif len(batch) == 1:
                yield None, error, tried, self.pauses
            else:
                # One bad input must not fail its neighbours.
                for one in batch:
                    outputs, error, again = self._try([one])
                    yield outputs[0] if outputs else None, error, tried + again, self.pauses


def run_model(
    make_model: Callable[[], Batch], batch_size: int = 16, policy: CallPolicy | None = None
) -> Callable[..., Column]:
    """Column function ``inputs -> struct<completion, error, attempts, pauses>``.

    ``make_model`` is called once per task and returns a function from a list
    of inputs to a list of outputs of the same length.  An input is a text, or
    a dict if several columns are passed as a struct.  Null inputs are not
    sent.  A row that fails after all attempts carries its error.
    """
    rules = policy or CallPolicy()
    fields = ["completion", "error", *REPORT]

    def task(columns):
        caller = _Caller(make_model(), rules)
        for part in columns:
            if isinstance(part, pd.DataFrame):
                sent = part.notna().all(axis=1)
                inputs = part[sent].to_dict("records")
            else:
                sent = part.notna()
                inputs = part[sent].tolist()
            out = pd.DataFrame({f: None for f in fields}, index=part.index, dtype=object)
            done = list(caller.run(inputs, batch_size))
            if done:
                out.loc[sent, fields] = pd.DataFrame(
                    done, columns=fields, index=part.index[sent], dtype=object
                )
            yield out

    def on_texts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from task(parts)

    def on_records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from task(parts)

    returns = "completion string, error string, attempts int, pauses int"

    def apply(*columns: Column, names: tuple[str, ...] = ()) -> Column:
        # Nondeterministic, so that the optimizer never calls a model twice.
        if len(columns) == 1 and not names:
            return F.pandas_udf(on_texts, returns).asNondeterministic()(columns[0])
        record = F.struct(*[c.alias(n) for c, n in zip(columns, names)])
        return F.pandas_udf(on_records, returns).asNondeterministic()(record)

    return apply


def limit_tasks(df: DataFrame, policy: CallPolicy | None) -> DataFrame:
    """As many partitions as tasks may call at once, if the policy has a rate."""
    return df.repartition(policy.tasks()) if policy and policy.calls else df


def translate(
    df: DataFrame,
    column: str,
    make_translator: Callable[[], Batch],
    model_id: str,
    batch_size: int = 16,
    policy: CallPolicy | None = None,
    extra: tuple[str, ...] = (),
    report: bool = False,
) -> DataFrame:
    """Add ``model, translation, error``.  ``extra`` columns go along to the translator.

    ``report`` adds the ``attempts`` made for a row and the ``pauses`` its task had made.
    """
    columns = [column, *extra]
    model = run_model(make_translator, batch_size, policy)
    names = tuple(columns) if extra else ()
    called = limit_tasks(df, policy).withColumn("_out", model(*map(F.col, columns), names=names))
    return called.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.lit(model_id).alias("model"),
        clean_completion(F.col("_out.completion")).alias("translation"),
        F.col("_out.error").alias("error"),
        *[F.col(f"_out.{c}").alias(c) for c in REPORT if report],
    )


def to_judge() -> Column:
    """The keep flag, with null as false."""
    return F.coalesce(F.col("to_keep"), F.lit(False))


def route_for_judging(df: DataFrame) -> DataFrame:
    """Add ``prompt``: the question for rows to keep, the literal N/A for the others."""
    asked = build_prompt(F.col("seed_noun"), F.col("translation"))
    return df.withColumn(
        "prompt", F.when(to_judge(), asked).otherwise(F.lit(NOT_JUDGED))
    )


def judge(
    df: DataFrame,
    make_judge: Callable[[], Batch],
    batch_size: int = 1,
    policy: CallPolicy | None = None,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``prompt, response, error``; only rows to keep reach the judge.

    Under a rate, the few tasks that may call get these rows and no others.
    """
    routed, others = route_for_judging(df), None
    if policy and policy.calls:
        others = routed.filter(~to_judge()).withColumns(
            {"response": F.lit(NOT_JUDGED), "error": F.lit(None).cast("string")}
        )
        routed = limit_tasks(routed.filter(to_judge()), policy)
    sent = F.when(to_judge(), F.col("prompt"))
    model = run_model(make_judge, batch_size, policy)
    if extra:
        names = ("prompt", *extra)
        out = model(sent, *map(F.col, extra), names=names)
    else:
        out = model(sent)
    judged = routed.withColumn("_out", out).select(
        *[F.col(f"`{c}`") for c in df.columns],
        "prompt",
        F.when(to_judge(), F.col("_out.completion"))
        .otherwise(F.lit(NOT_JUDGED))
        .alias("response"),
        F.col("_out.error").alias("error"),
    )
    return judged if others is None else judged.unionByName(others)


def with_pos(
    matches: DataFrame,
    make_tagger: Callable[[], Batch],
    text: str,
    token: str = "term",
    place: str | None = None,
) -> DataFrame:
    """Add ``pos`` by a plugged-in tagger, which sees token and text of each match.

    With ``place``, the column of the token's position in the text, it can tell
    two occurrences apart.  The tagger is loaded once per task and tags a whole
    batch at a time.
    """
    model = run_model(make_tagger, batch_size=1_000)
    named = {"token": token, "text": text} | ({"place": place} if place else {})
    out = model(*map(F.col, named.values()), names=tuple(named))
    return matches.withColumn("_out", out).select(
        *[F.col(f"`{c}`") for c in matches.columns], F.col("_out.completion").alias("pos")
    )


def join_completions(df: DataFrame, completions: DataFrame, key: str = "id") -> DataFrame:
    """Completions back to their rows; a row without one keeps null."""
    return df.join(completions, key, "left")
