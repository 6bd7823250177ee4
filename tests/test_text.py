import pytest
from pyspark.sql import functions as F

from nounspan.functions import text as X
from nounspan.functions.inflect import pluralise
from nounspan.functions.prompts import build_prompt, fill_template, wants_chat


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_strip_article(spark):
    rows = ["The team leaders", "Workers", "", "The  x", "the\nx y"]
    assert values(spark, rows, X.strip_article) == ["team leaders", "", "", " x", "y"]


def test_split_sentences(spark):
    rows = ["A b. C d!  E?\nF", "no end", "", "v1.2 is out. Yes"]
    assert values(spark, rows, X.split_sentences) == [
        ["A b.", "C d!", "E?", "F"],
        ["no end"],
        [""],
        ["v1.2 is out.", "Yes"],
    ]


def test_tokens(spark):
    rows = ["Übungsleiter, e-mail & children's_x", "...", "«Ça»"]
    assert values(spark, rows, X.tokens) == [
        ["übungsleiter", "e", "mail", "children", "s_x"],
        [],
        ["ça"],
    ]


def test_strip_like_python(spark):
    rows = [" \t\nx y  ", "\x85x\x1c", "", "   ", "x\n"]
    assert values(spark, rows, X.strip) == [r.strip() for r in rows]


@pytest.mark.parametrize(
    "text,n", [("", 1), ("a  b ", 4), (" ".join("x" * 256), 256), (" ".join("x" * 257), 257)]
)
def test_token_count(spark, text, n):
    assert values(spark, [text], X.token_count) == [n] == [len(text.split(" "))]


def test_max_lines(spark):
    rows = ["a", "a\nb\nc", "a\nb\nc\nd", "a\nb\nc\n"]
    assert values(spark, rows, X.max_lines) == [True, True, False, False]


@pytest.mark.parametrize("size", [1, 2, 3, 6])
def test_context_window_is_clamped(spark, size):
    sents = [f"s{i}" for i in range(size)]
    df = spark.createDataFrame([(sents,)], "s array<string>").select(
        "s", F.posexplode("s").alias("i", "x")
    )
    for before in (0, 2, 3):
        got = df.orderBy("i").select(X.context_window(F.col("s"), F.col("i"), before, 1)).collect()
        assert [r[0] for r in got] == [
            " ".join(sents[max(0, i - before) : i + 2]) for i in range(size)
        ]


def test_repair_text(spark):
    rows = {
        "schÃ¶n": "schön",
        "GrÃ¼ÃŸe": "Grüße",
        "a &amp; b &lt;c&gt;": "a & b <c>",
        "<p>&amp;</p>": "<p>&amp;</p>",
        "“x” ‘y’": "\"x\" 'y'",
        "a\r\nb\rc": "a\nb\nc",
        "schön": "schön",
        "a—b": "a—b",
        "donâ€™t â€“ 5 â‚¬": "don't – 5 €",
        "ﬁn\x00e": "fine",
        "tab\tand\nbreak": "tab\tand\nbreak",
    }
    assert values(spark, list(rows), X.repair_text) == list(rows.values())


def test_pluralise(spark):
    rows = {
        "worker": "workers",
        "city": "cities",
        "boss": "bosses",
        "child": "children",
        "team leader": "team leaders",
        "person": "people",
        "salesperson": "salespeople",
        "boy": "boys",
        "fireman": "firemen",
        "human": "humans",
        "German": "Germans",
        "Woman": "Women",
        "monarch": "monarchs",
        "coach": "coaches",
        "midwife": "midwives",
        "grandchild": "grandchildren",
        "stepchild": "stepchildren",
        "mother-in-law": "mothers-in-law",
        "passer-by": "passers-by",
        "man-at-arms": "men-at-arms",
        "co-worker": "co-workers",
        "Person": "People",
        "fox": "foxes",
        "ox": "oxen",
        "": "",
    }
    assert values(spark, list(rows), pluralise) == list(rows.values())


def test_prompts(spark):
    assert values(spark, ["x"], lambda c: fill_template(c, "instruction")) == [
        "Translate the following sentence into German. "
        'Reply only with the translation. Sentence: "x"'
    ]
    assert values(spark, ["x"], lambda c: fill_template(c, "flan")) == [
        "x\n\nTranslate this to German?"
    ]
    assert values(spark, ["x"], lambda c: fill_template(c, None)) == ["x"]
    with pytest.raises(NotImplementedError):
        fill_template(F.lit("x"), "other")
    (asked,) = values(spark, ["Satz"], lambda c: build_prompt(F.lit("tutors"), c))
    assert asked.startswith("\nIf the following") and asked.endswith("\nSentence: 'Satz'\n")
    assert "English word 'tutors'" in asked


def test_chat(spark):
    assert wants_chat("org/Mixtral-8x7B") and wants_chat("Llama-2") and not wants_chat("opus")
    (chat,) = values(spark, ["x"], X.as_chat)
    assert [m.asDict() for m in chat] == [{"role": "user", "content": "x"}]


def test_a_misread_text_is_read_once_for_each_round(spark, plan):
    mixed = "Ã¤ ÃƒÂ¤ â‚¬\nÃ \u4e2d\u6587 ÃŸ Ãƒ"
    assert values(spark, [mixed, "\u4e2d\u6587", None], X.reread) == ["ä ä €\nÃ \u4e2d\u6587 ß Ã", "\u4e2d\u6587", None]
    df = spark.createDataFrame([(mixed,)], "t string")
    # The chain does not stand in the plan for each use of what it reads.
    assert plan(df.select(X.reread(F.col("t")))).count("replace(") <= 2 * len(X.MOJIBAKE)
