"""Queries that run plugged-in models; the offline stand-ins have exact oracles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from nounspan.catalog.base import (
    CTE_SENT,
    cte_hits,
    documents,
    lexicon,
    query,
    sentences,
    sql_forms,
    sql_strip,
    terms,
)
from nounspan.catalog.evaluation import CTE_FORM_HITS
from nounspan.catalog.evaluation import hits as form_rows
from nounspan.catalog.passages import CTE_JUDGE, JUDGE_SQL, judge_input
from nounspan.catalog.samples import CTE_PROMPTS, CTE_SAMPLES, document_samples, prompts
from nounspan.functions.prompts import NOT_JUDGED
from nounspan.functions.text import clean_completion
from nounspan.operators.calls import ask_once, logged_answers
from nounspan.operators.concordance import concordance, own_sentence
from nounspan.operators.evaluation import STYLES, translate_by_lexicon, verdict_by_forms
from nounspan.operators.inference import (
    CallPolicy,
    judge,
    to_judge,
    translate,
    with_pos,
)
from nounspan.plans.translation import translate_prompts, translate_samples
from nounspan.session import scratch_path, write_out


def _translated(style: str) -> str:
    first = {s: f"{sql_forms('l.' + c)}[1]" for s, c in STYLES.items()}
    return (
        f"WITH {cte_hits()}, seeds AS (SELECT DISTINCT term FROM kept), "
        "fm AS (SELECT s.term, min(l.row_no) AS row_no FROM seeds s JOIN lex l "
        "ON contains(lower(l.english), lower(s.term)) GROUP BY 1), "
        f"f AS (SELECT fm.term, coalesce({first[style]}, {first['MP']}) AS form "
        "FROM fm JOIN lex l ON l.row_no = fm.row_no) "
        f"SELECT k.term AS seed, k.doc_id, k.sent_pos, k.token_pos, 'lexicon/{style}' AS model, "
        + sql_strip("replace(lower(k.passage), lower(k.term), lower(f.form))")
        + " AS translation FROM kept k JOIN f ON f.term = k.term"
    )


def translated(spark, sf, style):
    found = concordance(documents(spark, sf), terms(spark), mode="all")
    rows = found.select(
        F.col("term").alias("seed"), F.col("passage").alias("text"), "doc_id", "sent_pos", "token_pos"
    )
    done = translate_by_lexicon(rows, "text", "seed", lexicon(spark), style)
    return done.select("seed", "doc_id", "sent_pos", "token_pos", "model", "translation")


@query("u1_translate", _translated("FP"))
def u1(spark, sf):
    return translated(spark, sf, "FP")


@query("u1_translate_neutral", _translated("GN"))
def u1_neutral(spark, sf):
    return translated(spark, sf, "GN")


@query(
    "u2_judge",
    f"""WITH {CTE_FORM_HITS} SELECT doc_id, sent_pos, CASE WHEN corpus <> 'de' THEN 'N/A'
    WHEN gender_inclusive_count = 1 THEN 'Gender-Inclusive' WHEN german_fp_count = 1 THEN 'Feminine'
    WHEN gender_neutral_count = 1 THEN 'Gender-Neutral' WHEN german_mp_count = 1 THEN 'Masculine'
    ELSE 'None' END AS response FROM fh""",
)
def u2(spark, sf):
    rows = form_rows(spark, sf).withColumn("to_keep", F.col("corpus") == "de")
    response = F.when(to_judge(), verdict_by_forms()).otherwise(F.lit(NOT_JUDGED))
    return rows.select("doc_id", "sent_pos", response.alias("response"))


def _prompt_length():
    return lambda texts: [str(len(t)) for t in texts]


@query(
    "e4_judge_rows",
    f"""WITH {CTE_JUDGE} SELECT id, CASE WHEN to_keep THEN {JUDGE_SQL} ELSE 'N/A' END AS prompt,
    CASE WHEN to_keep THEN length({JUDGE_SQL})::VARCHAR ELSE 'N/A' END AS response FROM ji""",
)
def e4(spark, sf):
    judged = judge(judge_input(spark, sf), _prompt_length)
    return judged.select("id", "prompt", "response")


def _neighbour_tagger():
    # A test double: what stands before the token in its sentence decides.
    def tag(record):
        words = re.findall(r"\w+", record["text"].lower())
        before = words[record["place"] - 1] if record["place"] else None
        return "PROPN" if before is None else "NOUN" if len(before) <= 5 else "X"

    return lambda records: [tag(r) for r in records]


@query(
    "u4_with_pos",
    f"""WITH {cte_hits(sizes='= 1')} SELECT k.term, k.doc_id, k.sent_pos, k.token_pos,
    CASE WHEN k.token_pos = 0 THEN 'PROPN' WHEN length(x.w[k.token_pos]) <= 5 THEN 'NOUN'
    ELSE 'X' END AS pos FROM kept k JOIN words x ON x.doc_id = k.doc_id AND x.sent_pos = k.sent_pos""",
)
def u4(spark, sf):
    found = concordance(documents(spark, sf), terms(spark), context_before=2, with_sentences=True)
    found = found.select("term", "doc_id", "sent_pos", "token_pos", own_sentence(2).alias("sentence"))
    return with_pos(found, _neighbour_tagger, "sentence", place="token_pos").drop("sentence")


def _no_wait(seconds):
    """Stands in for time.sleep where a query should not pause."""


def _fussy():
    # A test double: refuses long prompts, and middling ones when it first sees them.
    met = set()

    def run(records):
        for r in records:
            size, new = len(r["english"]), r["id"] not in met
            met.add(r["id"])
            if size > 200 or (size > 100 and new):
                raise RuntimeError("refused")
        return ["DE: " + r["english"] for r in records]

    return run


@query(
    "u5_call_policy_retry",
    f"""WITH {CTE_PROMPTS} SELECT id, CASE WHEN length(english) <= 200
    THEN {sql_strip("'DE: ' || english")} END AS translation,
    CASE WHEN length(english) > 200 THEN 'RuntimeError: refused' END AS error,
    CASE WHEN length(english) > 200 THEN 3 WHEN length(english) > 100 THEN 2
    WHEN english IS NOT NULL THEN 1 END::INTEGER AS attempts FROM pr""",
)
def u5(spark, sf):
    policy = CallPolicy(max_attempts=3, sleep=_no_wait)
    done = translate(
        prompts(spark, sf), "english", _fussy, "echo", 1, policy, extra=("id",), report=True
    )
    return done.select("id", "translation", "error", "attempts")


def _marked_once():
    return lambda texts: ["DE: " + t for t in texts]


@query(
    "u5_call_log",
    f"""WITH {CTE_SENT}, n AS (SELECT sentence, count(*) AS rows_served FROM sent GROUP BY sentence)
    SELECT doc_id, sent_pos, {sql_strip("'DE: ' || sentence")} AS translation, 1::BIGINT AS calls,
    rows_served FROM sent JOIN n USING (sentence)""",
)
def u5_log(spark, sf):
    # Every sentence is a prompt; equal ones share one call, and the second run makes none.
    asked = sentences(spark, sf)
    log = scratch_path(spark, "call-log")
    ask_once(asked, ["sentence"], _marked_once, "echo", log, batch_size=64)
    done = ask_once(asked, ["sentence"], _marked_once, "echo", log, batch_size=64, digest="digest")
    # Rows, answers and counts all stand by the digest of the call, so texts are shuffled once.
    served = done.groupBy("digest").agg(F.count("*").alias("rows_served"))
    calls = logged_answers(spark, log, short=True).groupBy("digest").agg(F.sum("attempts").alias("calls"))
    return done.drop("attempts").join(served, "digest").join(calls, "digest").select(
        "doc_id", "sent_pos", clean_completion(F.col("completion")).alias("translation"), "calls", "rows_served"
    )


def _echo():
    return lambda texts: list(texts)


# Tasks that share a quota of 60 calls, 15 each.
CALLERS = 4


@query(
    "u6_call_policy_rate",
    f"""WITH {CTE_PROMPTS}, k AS (SELECT count(*) AS calls FROM pr WHERE english IS NOT NULL)
    SELECT id, {sql_strip('english')} AS translation, calls, 0::BIGINT AS over_quota, 0::BIGINT AS gaps FROM pr, k""",
)
def u6(spark, sf):
    # No task makes more than its share between two pauses, and it pauses only when that is spent.
    policy = CallPolicy(calls=60, parallelism=CALLERS, sleep=_no_wait)
    done = translate(prompts(spark, sf), "english", _echo, "echo", 5, policy, report=True)
    # Stored once, with the task that made the call: the rows and their figures are of the same calls.
    done = done.select("id", "translation", "english", "pauses", F.spark_partition_id().alias("task"))
    done = write_out(done.withColumn("sent", F.col("english").isNotNull()).drop("english"), "translated")
    windows = done.filter("sent").groupBy("task", "pauses").agg(F.count("*").alias("calls"))
    tasks = windows.groupBy("task").agg(
        F.sum("calls").alias("calls"),
        F.count_if(F.col("calls") > 60 // CALLERS).alias("over"),
        # Windows that are not full, the last one of the task apart.
        (F.ceil(F.sum("calls") / (60 // CALLERS)) - F.count("*")).alias("gap"),
    )
    figures = tasks.agg(
        F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
        F.coalesce(F.sum("over"), F.lit(0)).alias("over_quota"),
        F.coalesce(F.sum(F.abs("gap")), F.lit(0)).alias("gaps"),
    )
    return done.select("id", "translation").crossJoin(F.broadcast(figures))


def _marked():
    return lambda texts: ["DE: " + t for t in texts]


@query(
    "e2_translate_prompts",
    f"""WITH {CTE_PROMPTS} SELECT id, answer, {sql_strip("'DE: ' || answer || chr(10) || chr(10) || 'Translate this to German?'")}
    AS "org--flan" FROM pr""",
)
def e2_prompts(spark, sf):
    asked = prompts(spark, sf).select("id", "answer")
    return translate_prompts(asked, _marked, "org/flan", target="answer", template_id="flan")


def _marked_records():
    return lambda records: ["DE: " + r["text"] for r in records]


@query(
    "e2_translate_samples",
    f"""WITH {CTE_SAMPLES} SELECT term, total_matches, total_selected,
    coalesce(array_to_string(list_transform(selected, lambda t: {sql_strip("'DE: ' || t")}), ' || '), '')
    AS translation FROM smp""",
)
def e2_samples(spark, sf):
    done = translate_samples(document_samples(spark, sf), _marked_records, "org/marked")
    return done.select(
        "term", "total_matches", "total_selected",
        F.array_join("translation", " || ").alias("translation"),
    )

