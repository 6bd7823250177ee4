"""Queries on passages: projections, predicates, repair, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from nounspan.catalog.base import (
    CTE_LABELLED,
    CTE_SENT,
    CTE_TURNS,
    cte_hits,
    documents,
    labelled,
    query,
    seed_of,
    sentences,
    sql_seed,
    sql_sentences,
    sql_str,
    sql_strip,
    sql_tokens,
    table,
    terms,
    turns,
)
from nounspan.functions.prompts import (
    JUDGE_HEAD,
    JUDGE_MIDDLE,
    JUDGE_TAIL,
    TEMPLATES,
    build_prompt,
)
from nounspan.functions.text import (
    CONTROLS,
    CURLY,
    ENTITIES,
    LIGATURES,
    LINE_BREAKS,
    MISREAD_LEAD,
    MOJIBAKE,
    STRAIGHT,
    as_chat,
    clean_completion,
    context_window,
    line_count,
    max_lines,
    repair_text,
    split_sentences,
    strip_article,
    tokens,
)
from nounspan.operators import abbreviations
from nounspan.operators.annotations import valid_annotations
from nounspan.operators.concordance import concordance, sentence_passages, sentence_table
from nounspan.operators.inference import route_for_judging
from nounspan.operators.lexicon import pluralise_lexicon
from nounspan.operators.samples import has_text, limit_tokens, non_empty
from nounspan.plans.translation import build_prompts, passage_stats
from nounspan.session import widen


@query(
    "p1_strip_article",
    f"""WITH {CTE_SENT} SELECT doc_id, sent_pos,
    regexp_replace(sentence, '\\A[^ ]* ?', '') AS term FROM sent""",
)
def p1(spark, sf):
    return sentences(spark, sf).select(
        "doc_id", "sent_pos", strip_article(F.col("sentence")).alias("term")
    )


@query(
    "p3_has_text",
    f"WITH {CTE_TURNS} SELECT conv_id, turn, english, answer FROM turns WHERE answer IS NOT NULL",
)
def p3(spark, sf):
    return has_text(turns(spark, sf), "answer").select("conv_id", "turn", "english", "answer")


@query(
    "p7_max_lines",
    """SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS n_lines FROM documents
    WHERE len(string_split(text, chr(10))) <= 3""",
)
def p7(spark, sf):
    docs = documents(spark, sf).filter(max_lines(F.col("text"), 3))
    return docs.select("doc_id", line_count(F.col("text")).alias("n_lines"))


@query(
    "p8_non_empty",
    """SELECT doc_id, line_no::INTEGER AS line_no, line FROM (SELECT doc_id,
    unnest(range(len(string_split(text, chr(10))))) AS line_no,
    unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''""",
)
def p8(spark, sf):
    lines = documents(spark, sf).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return non_empty(lines, "line")


@query(
    "p10_limit_tokens",
    """SELECT doc_id, text, len(string_split(text, ' '))::INTEGER AS token_count FROM documents
    WHERE len(string_split(text, ' ')) <= 256""",
)
def p10(spark, sf):
    return limit_tokens(documents(spark, sf), "text", 256)


def sql_repair(text: str) -> str:
    def chain(value: str, pairs) -> str:
        for old, new in pairs:
            value = f"replace({value}, {sql_str(old)}, {sql_str(new)})"
        return value

    a = f"SELECT k, CASE WHEN regexp_matches(t, '{MISREAD_LEAD}') THEN {chain('t', MOJIBAKE)} ELSE t END AS t FROM ({text})"
    b = (
        "SELECT k, CASE WHEN contains(t, '&') AND NOT contains(t, '<') THEN "
        f"{chain('t', ENTITIES)} ELSE t END AS t FROM ({a})"
    )
    c = f"SELECT k, translate({chain('t', LIGATURES)}, {sql_str(CURLY)}, {sql_str(STRAIGHT)}) AS t FROM ({b})"
    return (
        f"SELECT k AS id, regexp_replace(regexp_replace(t, '{LINE_BREAKS}', chr(10), 'g'), "
        f"'{CONTROLS}', '', 'g') AS fixed FROM ({c})"
    )


@query("p11_repair_text", sql_repair("SELECT doc_id AS k, text AS t FROM documents"))
def p11(spark, sf):
    return documents(spark, sf).select(
        F.col("doc_id").alias("id"), repair_text(F.col("text")).alias("fixed")
    )


@query(
    "p11_repair_text_pages",
    sql_repair("SELECT page_id AS k, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages"),
)
def p11_pages(spark, sf):
    # Pages without their tags hold entities, which plain documents do not.
    pages = widen(table(spark, sf, "pages").select("page_id", "html"), "page_id").select(
        F.col("page_id").alias("id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text")
    )
    return pages.select("id", repair_text(F.col("text")).alias("fixed"))


# What the bytes 80 to 9F are read as, where that is not a control character.
_HIGH = [(chr(b), bytes([b]).decode("cp1252", errors="ignore")) for b in range(0x80, 0xA0)]


def _misread(text):
    """A text as it looks after its UTF-8 bytes were read as Windows-1252."""
    pairs = [(c, read) for c, read in _HIGH if read]
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.translate(latin, "".join(c for c, _ in pairs), "".join(read for _, read in pairs))


@query("p11_repair_damaged", "SELECT doc_id, text AS read_once, text AS read_twice FROM documents")
def p11_damaged(spark, sf):
    # What was misread once and twice comes back as it was.
    docs = documents(spark, sf).select("doc_id", _misread(F.col("text")).alias("once"))
    once = F.col("once")
    return docs.select("doc_id", repair_text(once).alias("read_once"), repair_text(_misread(once)).alias("read_twice"))


def _template_sql(template_id: str) -> str:
    head, tail = TEMPLATES[template_id]
    tail = "' || chr(10) || '".join(tail.replace("'", "''").split("\n"))
    return f"{sql_str(head)} || english || '{tail}'"


@query(
    "p12_build_prompts",
    f"""WITH {CTE_TURNS} SELECT conv_id, turn, {_template_sql('instruction')} AS instruction,
    {_template_sql('flan')} AS flan, english AS raw FROM turns""",
)
def p12(spark, sf):
    df = turns(spark, sf)
    for name, template in (("instruction", "instruction"), ("flan", "flan"), ("raw", None)):
        df = build_prompts(df, "english", template, name)
    return df.select("conv_id", "turn", "instruction", "flan", "raw")


JUDGE_SQL = (
    f"{sql_str(JUDGE_HEAD)} || seed_noun || {sql_str(JUDGE_MIDDLE)} || translation "
    f"|| {sql_str(JUDGE_TAIL)}"
)


@query(
    "p13_build_prompt",
    f"""WITH {CTE_TURNS}, q AS (SELECT conv_id, turn, {sql_seed('conv_id + turn')} AS seed_noun,
    answer AS translation FROM turns) SELECT conv_id, turn, {JUDGE_SQL} AS prompt FROM q""",
)
def p13(spark, sf):
    return turns(spark, sf).select(
        "conv_id",
        "turn",
        build_prompt(seed_of(F.col("conv_id") + F.col("turn")), F.col("answer")).alias("prompt"),
    )


@query(
    "p14_as_chat",
    f"""WITH {CTE_TURNS} SELECT conv_id, turn, 1 AS n, 'user' AS role, english AS content
    FROM turns""",
)
def p14(spark, sf):
    chat = turns(spark, sf).withColumn("m", as_chat(F.col("english")))
    return chat.select(
        "conv_id", "turn", F.size("m").alias("n"), F.col("m")[0]["role"].alias("role"),
        F.col("m")[0]["content"].alias("content"),
    )


@query(
    "p15_clean_completion",
    f"""SELECT doc_id, line_no::INTEGER AS line_no, {sql_strip('line')} AS line FROM (SELECT doc_id,
    unnest(range(len(string_split(text, '.')))) AS line_no,
    unnest(string_split(text, '.')) AS line FROM documents)""",
)
def p15(spark, sf):
    parts = documents(spark, sf).select(
        "doc_id", F.posexplode(F.split("text", r"\.")).alias("line_no", "line")
    )
    return parts.select("doc_id", "line_no", clean_completion(F.col("line")).alias("line"))


def judge_input(spark, sf):
    """Labelled documents as judge rows: keep the good ones, unlabelled is null."""
    return labelled(spark, sf).select(
        F.col("doc_id").alias("id"),
        (F.col("quality") == 1).alias("to_keep"),
        seed_of(F.col("doc_id")).alias("seed_noun"),
        F.col("source").alias("translation"),
    )


CTE_JUDGE = (
    f"{CTE_LABELLED}, ji AS (SELECT doc_id AS id, quality = 1 AS to_keep, "
    f"{sql_seed('doc_id')} AS seed_noun, source AS translation FROM labelled)"
)


@query(
    "p16_route_for_judging",
    f"""WITH {CTE_JUDGE} SELECT id, CASE WHEN to_keep THEN {JUDGE_SQL} ELSE 'N/A' END AS prompt
    FROM ji""",
)
def p16(spark, sf):
    return route_for_judging(judge_input(spark, sf)).select("id", "prompt")


@query(
    "p22_valid_annotations",
    f"""WITH {cte_hits()}, parts AS (SELECT term, doc_id, sent_pos, token_pos,
    {sql_sentences('passage')} AS p, {sql_tokens('term')} AS w FROM kept),
    third AS (SELECT *, {sql_tokens('p[3]')} AS t FROM parts WHERE len(p) = 4)
    SELECT term, doc_id, sent_pos, token_pos FROM third WHERE len(list_filter(range(len(t)),
    lambda i: list_slice(t, i + 1, i + len(w)) = w)) > 0""",
)
def p22(spark, sf):
    hits = concordance(documents(spark, sf), terms(spark), mode="all")
    return valid_annotations(hits, "passage", "term").select(
        "term", "doc_id", "sent_pos", "token_pos"
    )


def _plural_sql(word: str) -> str:
    """Plurals in SQL, written on their own; hyphenated heads do not occur in the texts."""
    cut = lambda n, end: f"left({word}, len({word}) - {n}) || '{end}'"
    ends = lambda pattern: f"regexp_matches({word}, '(?i)({pattern})\\z')"
    return (
        f"CASE WHEN {word} = '' THEN {word} "
        f"WHEN {ends('human|german|roman|norman|ottoman|shaman|talisman|brahman')} THEN {word} || 's' "
        f"WHEN {ends('monarch|patriarch|matriarch|oligarch|hierarch|eunuch|czech|stomach|epoch')} "
        f"THEN {word} || 's' "
        f"WHEN {ends('^foot')} THEN {cut(3, 'eet')} WHEN {ends('^tooth')} THEN {cut(4, 'eeth')} "
        f"WHEN {ends('^goose')} THEN {cut(4, 'eese')} WHEN {ends('^ox')} THEN {word} || 'en' "
        f"WHEN {ends('alumnus')} THEN {cut(2, 'i')} WHEN {ends('child')} THEN {word} || 'ren' "
        f"WHEN {ends('hero')} THEN {word} || 'es' WHEN {ends('man')} THEN {cut(2, 'en')} "
        f"WHEN {ends('mouse')} THEN {cut(4, 'ice')} WHEN {ends('person')} THEN {cut(4, 'ople')} "
        f"WHEN {ends('thief')} THEN {cut(1, 'ves')} WHEN {ends('wife')} THEN {cut(2, 'ves')} "
        f"WHEN regexp_matches({word}, '(s|x|z|ch|sh)\\z') THEN {word} || 'es' "
        f"WHEN regexp_matches({word}, '[^aeiouAEIOU]y\\z') THEN {cut(1, 'ies')} "
        f"ELSE {word} || 's' END"
    )


@query(
    "p23_pluralise_lexicon",
    f"""WITH {CTE_SENT}, ph AS (SELECT doc_id, sent_pos,
    regexp_replace(sentence, '[^\\p{{L}}]+\\z', '') AS phrase FROM sent),
    la AS (SELECT *, string_split(phrase, ' ')[-1] AS word FROM ph)
    SELECT doc_id, sent_pos, left(phrase, len(phrase) - len(word)) || {_plural_sql('word')} AS plural
    FROM la""",
)
def p23(spark, sf):
    phrases = sentences(spark, sf).select(
        "doc_id", "sent_pos", F.regexp_replace("sentence", r"[^\p{L}]+\z", "").alias("phrase")
    )
    return pluralise_lexicon(phrases, "phrase").select("doc_id", "sent_pos", "plural")


@query(
    "f1_split_sentences",
    f"WITH {CTE_SENT} SELECT doc_id, sent_pos, sentence FROM sent",
)
def f1(spark, sf):
    return sentences(spark, sf)


CTE_ABBREVIATIONS = (
    f"piece AS (SELECT unnest(string_split_regex(text, '{abbreviations.SPACES}')) AS piece FROM documents), "
    f"found AS (SELECT lower(regexp_extract(piece, {sql_str(abbreviations.WORD)}, 1)) AS word, "
    f"(regexp_extract(piece, {sql_str(abbreviations.WORD)}, 2) <> '')::BIGINT AS stop FROM piece), "
    "met AS (SELECT * FROM found WHERE word <> ''), "
    "sums AS (SELECT sum(stop) AS stops, count(*) AS words FROM met), "
    "counted AS (SELECT word, sum(stop)::BIGINT AS n_stop, (count(*) - sum(stop))::BIGINT AS n_plain, "
    "length(replace(word, '.', '')) AS letters FROM met GROUP BY word "
    f"HAVING sum(stop) >= {abbreviations.LEAST}), "
    "scored AS (SELECT word, n_stop, n_plain, 2 * ((n_stop * ln(0.99) + n_plain * ln(1 - 0.99::DOUBLE)) "
    "- (n_stop * ln(stops / words) + n_plain * ln(1 - stops / words))) * exp(-letters) "
    "* (length(word) - letters + 1) * pow(letters::DOUBLE, -n_plain) AS score FROM counted, sums)"
)


@query(
    "f1_abbreviation_scores",
    f"WITH {CTE_ABBREVIATIONS} SELECT word, n_stop, n_plain, round(score, 6) + 0.0 AS score FROM scored",
)
def f1_scores(spark, sf):
    scores = abbreviations.abbreviation_scores(documents(spark, sf))
    return scores.select("word", "n_stop", "n_plain", (F.round("score", 6) + 0.0).alias("score"))


@query(
    "f1_split_with_abbreviations",
    rf"""WITH {CTE_ABBREVIATIONS}, listed AS (SELECT coalesce('(^|[^\p{{L}}.])(' || string_agg(replace(word, '.', '\.'), '|')
    || ')\.([ \t\r\n])', '[^\s\S]') AS stop FROM scored WHERE score >= {abbreviations.THRESHOLD}),
    held AS (SELECT doc_id, regexp_replace(regexp_replace(text, stop, '\1\2.' || chr(2) || '\3', 'gi'),
    stop, '\1\2.' || chr(2) || '\3', 'gi') AS t FROM documents, listed),
    cut AS (SELECT doc_id, {sql_sentences('t')} AS s FROM held)
    SELECT doc_id, unnest(range(len(s)))::INTEGER AS sent_pos,
    replace(unnest(s), '.' || chr(2), '.') AS sentence FROM cut""",
)
def f1_learned(spark, sf):
    docs = documents(spark, sf)
    return sentence_table(docs, abbreviations=abbreviations.learned_abbreviations(docs))


@query(
    "f2_tokens",
    f"""SELECT word, count(*) AS n FROM (SELECT unnest({sql_tokens('text')}) AS word
    FROM documents) GROUP BY word""",
)
def f2(spark, sf):
    words = documents(spark, sf).select(F.explode(tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


@query(
    "w1_context_window",
    f"""WITH {CTE_SENT} SELECT doc_id, sent_pos,
    array_to_string(list_slice(s, greatest(sent_pos - 3, 0) + 1, sent_pos + 2), ' ') AS passage
    FROM sent""",
)
def w1(spark, sf):
    docs = documents(spark, sf).select("doc_id", split_sentences(F.col("text")).alias("s"))
    at = docs.select("doc_id", "s", F.posexplode_outer("s").alias("sent_pos", "_"))
    return at.select(
        "doc_id", "sent_pos", context_window(F.col("s"), F.col("sent_pos"), 3, 1).alias("passage")
    )


@query(
    "w1_sentence_passages",
    f"""WITH {CTE_SENT} SELECT doc_id, sent_pos,
    array_to_string(list_slice(s, greatest(sent_pos - 2, 0) + 1, sent_pos + 2), ' ') AS passage
    FROM sent""",
)
def w1_window(spark, sf):
    return sentence_passages(sentences(spark, sf)).drop("sentence")


@query(
    "a4_passage_stats",
    """SELECT count(*) AS n_passages,
    round(avg(len(string_split(text, ' '))), 6) AS mean_words FROM documents""",
)
def a4(spark, sf):
    stats = passage_stats(documents(spark, sf), "text")
    return stats.select("n_passages", F.round("mean_words", 6).alias("mean_words"))
