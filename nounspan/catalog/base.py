"""Registry, input views and the SQL fragments that the oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nounspan.functions.text import NON_WORD, STRIP, tokens
from nounspan.operators.concordance import sentence_table
from nounspan.operators.lexicon import distinct_terms, seed_terms
from nounspan.session import widen

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# ---------------------------------------------------------------- inputs

# The test lexicon, one row per edge case of form matching.
LEXICON_COLUMNS = (
    "row_no",
    "english",
    "german_mp",
    "german_fp",
    "gender_neutral",
    "gender_inclusive",
)
LEXICON_ROWS = [
    (0, "The esndha reedes", "heit", "einheit", "enlich; belich", "enkeit"),
    (1, "The reedes", "keit", "einkeit", "", "schkeit"),
    (2, "The thedones", "lich", "erlich", "verlich;  belich;", "unglich"),
    (3, "The anlyes;", "ung", "einung", "schung", "enung"),
    (4, "The thhaes", "ver", "einver", "", "schver"),
    (5, "The Inges", "ung", "ung", "schung", "einung"),
    (6, "The thines", "heit", "schheit", "enheit", "einheit"),
    (7, "The reedes", "lich", "lich", "", ""),
    (8, "The zzyzzes", "qqq", "qqqen", "", "qqq*en"),
    (9, "The ananble anlyes", "heit", "einheit", "", "enheit"),
]
# Seeds that translations are labelled with; two have no lexicon row.
SEEDS = [
    "reedes",
    "thedones",
    "anlyes",
    "thhaes",
    "inges",
    "thines",
    "zzyzzes",
    "esndha reedes",
    "ananble anlyes",
    "nosuchseed",
    "Inges",
]
# Part of speech of the tokens of the single-word test terms.
POS_ROWS = [
    ("reedes", "NOUN"),
    ("thedones", "NOUN"),
    ("anlyes", "PROPN"),
    ("thhaes", "VERB"),
    ("inges", "PROPN"),
    ("thines", "ADJ"),
    ("zzyzzes", "NOUN"),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(
    spark: SparkSession, sf: str, *columns: str, where: Column | None = None
) -> DataFrame:
    """Columns of the documents table, over all cores even if it is one row group."""
    docs = table(spark, sf, "documents")
    if where is not None:
        docs = docs.filter(where)
    return widen(docs.select(*(columns or ("doc_id", "text"))), "doc_id")


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_table(documents(spark, sf))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        LEXICON_ROWS, "row_no long, " + ", ".join(f"{c} string" for c in LEXICON_COLUMNS[1:])
    )


def terms(spark: SparkSession) -> DataFrame:
    return distinct_terms(seed_terms(lexicon(spark)))


# Letters of the words that make the long term list.
LONG_WORD = 8


def long_terms(spark: SparkSession, sf: str) -> DataFrame:
    """A term list beyond every literal: all words of the conversations with so many letters or more."""
    words = table(spark, sf, "conversations").select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    return words.filter(F.length("term") >= LONG_WORD).select("term", F.array("term").alias("term_tokens"))


def seed_of(number: Column) -> Column:
    """Seed assigned to a row by its number."""
    return F.element_at(F.array(*[F.lit(s) for s in SEEDS]), (number % len(SEEDS) + 1).cast("int"))


def translations(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence as a translation: system = source, corpus = language."""
    docs = documents(spark, sf, "doc_id", "text", "source", "lang")
    split = sentence_table(docs, "source", "lang")
    return split.select(
        "doc_id",
        "sent_pos",
        F.col("source").alias("model"),
        F.col("lang").alias("corpus"),
        seed_of(F.col("doc_id") + F.col("sent_pos")).alias("seed_noun"),
        F.col("sentence").alias("translation"),
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with an annotator's letter; null where the table has no label."""
    docs = documents(spark, sf)
    letter = (
        F.when(F.col("quality") == 0, "n")
        .when((F.col("quality") == 1) & (F.col("toxic") == 1), "b")
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), "y")
    )
    return docs.join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.col("text").alias("source"), letter.alias("comment"), "quality", "toxic"
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as prompts, each with the next assistant turn or null."""
    chat = table(spark, sf, "conversations")
    answers = chat.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return chat.filter("role = 'user'").join(answers, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.col("text").alias("english"), "answer"
    )


def row_number_of(*parts: Column) -> Column:
    """Row number in a file whose rows stand in the order of a hash: 60 bits, so no two are equal."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")


def derived_lexicon(spark: SparkSession, sf: str, source: str = "documents") -> DataFrame:
    """A lexicon of all words of all whole texts of a table, one row for each language that has the word.

    Some rows are phrases, some end with a semicolon, and a form may be blank.
    """
    texts = table(spark, sf, source)
    if source == "documents":
        texts = widen(texts.select("doc_id", "text", "lang"), "doc_id")
    lang = F.col("lang") if "lang" in texts.columns else F.lit("")
    words = texts.select(
        lang.alias("lang"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("w0")
    ).distinct()
    n = F.length("w0")
    less = lambda k: F.substring(F.col("w0"), F.lit(k + 1), n)
    phrase = F.when(n % 3 == 0, F.concat_ws(" ", F.col("w0"), less(1))).otherwise(F.col("w0"))
    neutral = (
        F.when(n % 5 == 0, F.lit(None).cast("string"))
        .when(n % 5 == 1, F.concat(F.lit("Die "), less(1), F.lit("enden;  die "), less(2), F.lit("kräfte;")))
        .otherwise(F.concat(F.lit("Die "), less(1), F.lit("enden")))
    )
    return words.select(
        row_number_of(F.col("lang"), F.col("w0")).alias("row_no"),
        F.concat(F.lit("The "), phrase, F.when(n % 7 == 0, ";").otherwise("")).alias("english"),
        F.concat(F.lit("Die "), less(1), F.lit("er")).alias("german_mp"),
        F.concat(F.lit("Die "), less(1), F.lit("erinnen")).alias("german_fp"),
        neutral.alias("gender_neutral"),
        F.concat(F.lit("die "), less(1), F.lit("er*innen")).alias("gender_inclusive"),
    )


# ---------------------------------------------------------------- SQL fragments


def sql_str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{NON_WORD}'), lambda t: t <> '')"


def sql_sentences(text: str) -> str:
    return (
        f"string_split(regexp_replace({text}, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1))"
    )


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '{STRIP}', '', 'g')"


def sql_seed(number: str) -> str:
    return "[" + ", ".join(map(sql_str, SEEDS)) + f"][({number}) % {len(SEEDS)} + 1]"


def sql_forms(cell: str) -> str:
    return (
        f"list_filter(list_transform(string_split(coalesce({cell}, ''), ';'), "
        f"lambda f: {sql_strip('f')}), lambda f: f <> '')"
    )


def sql_hash(*parts: str, seed: int = 42) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(parts)}))"


def sql_draw(digest: str) -> str:
    return f"((('0x' || substr({digest}, 1, 13))::BIGINT + 1) / {float(2**52 + 1)!r})"


def _values(rows: list[tuple]) -> str:
    return ", ".join(
        "(" + ", ".join(sql_str(v) if isinstance(v, str) else str(v) for v in row) + ")"
        for row in rows
    )


# Documents with their sentence arrays, then one row per sentence.
CTE_DOCS = f"docs AS (SELECT doc_id, source, lang, {sql_sentences('text')} AS s FROM documents)"
CTE_SENT = (
    f"{CTE_DOCS}, sent AS (SELECT doc_id, source, lang, s, "
    "unnest(range(len(s)))::INTEGER AS sent_pos, unnest(s) AS sentence FROM docs)"
)
CTE_LEX = (
    f"lex AS (SELECT * REPLACE (row_no::BIGINT AS row_no) FROM (VALUES {_values(LEXICON_ROWS)}) "
    f"AS v({', '.join(LEXICON_COLUMNS)}))"
)
CTE_TERMS = (
    f"{CTE_LEX}, named AS (SELECT row_no, rtrim(substr(english, 5), '; ') AS term FROM lex), "
    "terms AS (SELECT term, min(row_no) AS row_no, any_value("
    + sql_tokens("term")
    + ") AS w FROM named GROUP BY term)"
)


CTE_LONG_TERMS = (
    f"bw AS (SELECT DISTINCT unnest({sql_tokens('text')}) AS term FROM conversations), "
    f"terms AS (SELECT term, [term] AS w FROM bw WHERE length(term) >= {LONG_WORD})"
)


def cte_hits(
    before: int = 2, after: int = 1, lines: int = 3, sizes: str = ">= 1", terms: str = CTE_TERMS
) -> str:
    """Occurrences of the test terms: token slices, and the stretch of the raw sentence."""
    raw = "lower(x.s[x.sent_pos + 1])"
    start = f"CASE WHEN regexp_matches({raw}, '^[\\p{{L}}\\p{{N}}_]') THEN 1 ELSE 2 END + 2 * x.token_pos"
    stretch = (
        f"array_to_string(list_slice(regexp_extract_all({raw}, '[\\p{{L}}\\p{{N}}_]+|{NON_WORD}'), "
        f"{start}, {start} + 2 * len(t.w) - 2), '')"
    )
    return (
        f"{CTE_SENT}, {terms}, "
        f"words AS (SELECT doc_id, sent_pos, s, {sql_tokens('sentence')} AS w FROM sent), "
        "word AS (SELECT doc_id, sent_pos, s, w, unnest(range(len(w)))::INTEGER AS token_pos FROM words), "
        "hits AS (SELECT t.term, x.doc_id, x.sent_pos, x.token_pos, "
        f"array_to_string(list_slice(x.s, greatest(x.sent_pos - {before}, 0) + 1, "
        f"x.sent_pos + {after + 1}), ' ') AS passage "
        f"FROM word x JOIN terms t ON x.w[x.token_pos + 1] = t.w[1] WHERE len(t.w) {sizes} "
        "AND list_slice(x.w, x.token_pos + 1, x.token_pos + len(t.w)) = t.w "
        f"AND (len(t.w) = 1 OR {stretch} = lower(t.term))), "
        f"kept AS (SELECT * FROM hits WHERE len(string_split(passage, chr(10))) <= {lines} "
        "AND passage <> '')"
    )


CTE_TRANSLATIONS = (
    f"{CTE_SENT}, tr AS (SELECT doc_id, sent_pos, source AS model, lang AS corpus, "
    f"{sql_seed('doc_id + sent_pos')} AS seed_noun, sentence AS translation FROM sent)"
)
CTE_LABELLED = (
    "labelled AS (SELECT d.doc_id, d.text AS source, CASE WHEN quality = 0 THEN 'n' "
    "WHEN quality = 1 AND toxic = 1 THEN 'b' WHEN quality = 1 AND toxic = 0 THEN 'y' END AS comment, "
    "quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)
CTE_TURNS = (
    "turns AS (SELECT u.conv_id, u.turn, u.text AS english, a.text AS answer FROM conversations u "
    "LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
    "AND a.role = 'assistant' WHERE u.role = 'user')"
)


def cte_derived(source: str = "documents", lang: str = "lang") -> str:
    """``dlex``, the lexicon of all words of a table."""
    return (
        f"dw AS (SELECT DISTINCT {lang} AS lang, unnest({sql_tokens('text')}) AS w FROM {source}), "
        "dn AS (SELECT *, length(w) AS n, substr(w, 2) AS w1, substr(w, 3) AS w2 FROM dw), "
        "dlex AS (SELECT ('0x' || substr(md5(concat_ws('|', lang, w)), 1, 15))::BIGINT AS row_no, "
        "'The ' || CASE WHEN n % 3 = 0 THEN w || ' ' || w1 ELSE w END "
        "|| CASE WHEN n % 7 = 0 THEN ';' ELSE '' END AS english, 'Die ' || w1 || 'er' AS german_mp, "
        "'Die ' || w1 || 'erinnen' AS german_fp, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 = 1 THEN "
        "'Die ' || w1 || 'enden;  die ' || w2 || 'kräfte;' ELSE 'Die ' || w1 || 'enden' END AS gender_neutral, "
        "'die ' || w1 || 'er*innen' AS gender_inclusive FROM dn)"
    )


CTE_DERIVED = cte_derived()
