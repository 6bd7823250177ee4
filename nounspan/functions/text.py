"""Text expressions: tokens, sentences, passages, repair."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a maximal run of letters, digits and underscores.  The same
# pattern means the same thing to Java and to RE2, unlike \b and \w.
NON_WORD = r"[^\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"([.!?])[ \t\r\n]+"
SENTENCE_MARK = "\u0001"
# Stands after the full stop of an abbreviation while sentences are cut.
NO_END = "\u0002"
# White space as Python's str.strip understands it.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
STRIP = rf"\A[{SPACE}]+|[{SPACE}]+\z"


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order, blanks dropped."""
    return F.array_remove(F.split(F.lower(text), NON_WORD), "")


def has_any_token(text: Column, wanted: list[str]) -> Column:
    """True if the text holds one of the wanted tokens on word boundaries."""
    return F.arrays_overlap(tokens(text), F.array(*[F.lit(w) for w in wanted]))


def between_tokens(text: Column) -> Column:
    """What stands before, between and after the tokens, in order."""
    return F.split(F.lower(text), TOKEN)


def split_sentences(text: Column, abbreviations: Sequence[str] = ()) -> Column:
    """Sentences as an array: cut after . ! ? where white space follows.

    The full stop of an abbreviation ends no sentence.  ``abbreviations`` are
    lower-cased words without their last full stop.
    """
    if abbreviations:
        listed = "|".join(re.escape(a) for a in abbreviations)
        stop = rf"(?iu)(?<![\p{{L}}.])({listed})\.(?=[ \t\r\n])"
        text = F.regexp_replace(text, stop, "$1." + NO_END)
    cut = F.split(F.regexp_replace(text, SENTENCE_END, "$1" + SENTENCE_MARK), SENTENCE_MARK)
    if not abbreviations:
        return cut
    return F.transform(cut, lambda s: F.replace(s, F.lit("." + NO_END), F.lit(".")))


def strip_article(term: Column) -> Column:
    """Drop the first space-delimited piece; a one-piece cell becomes empty."""
    return F.regexp_replace(term, r"\A[^ ]* ?", "")


def strip(text: Column) -> Column:
    """Remove white space at both ends, line breaks included."""
    return F.regexp_replace(text, STRIP, "")


clean_completion = strip


def context_window(sentences: Column, at: Column, before: int = 2, after: int = 1) -> Column:
    """``before`` sentences, the one at index ``at``, ``after`` sentences.

    Clamped at the edges of the document and joined by one space.
    """
    first = F.greatest(at - F.lit(before), F.lit(0))
    return F.array_join(F.slice(sentences, first + 1, at + F.lit(after + 1) - first), " ")


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def max_lines(text: Column, limit: int = 3) -> Column:
    """Predicate: the passage has at most ``limit`` lines."""
    return line_count(text) <= limit


def token_count(text: Column) -> Column:
    """Number of pieces between single spaces; the empty text counts one."""
    return F.size(F.split(text, " "))


def as_chat(text: Column) -> Column:
    """A one-message conversation, as chat models expect it."""
    return F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))


def ngram_at(words: Column, at: Column, length: Column) -> Column:
    """The ``length`` tokens that start at index ``at``."""
    return F.slice(words, at + 1, length)


def _seen(byte: int) -> str:
    """What a byte looks like in Windows-1252; unassigned ones are control characters."""
    return bytes([byte]).decode("cp1252", errors="ignore") or chr(byte)


def _misread(ch: str) -> str:
    """What a UTF-8 character looks like after being read as Windows-1252."""
    return "".join(map(_seen, ch.encode("utf-8")))


# Characters whose misread form is repaired: all that a byte from 80 on can look like, so
# that a text misread again can be read back.  Longer misread forms come first.
REPAIRABLE = sorted(map(_seen, range(0x80, 0x100)), key=lambda ch: -len(ch.encode()))
MOJIBAKE = [(_misread(ch), ch) for ch in REPAIRABLE]

# Basic entities, in the order in which they are replaced.
ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&auml;", "ä"),
    ("&ouml;", "ö"),
    ("&uuml;", "ü"),
    ("&Auml;", "Ä"),
    ("&Ouml;", "Ö"),
    ("&Uuml;", "Ü"),
    ("&szlig;", "ß"),
    ("&amp;", "&"),
]
LIGATURES = [
    ("ﬀ", "ff"),
    ("ﬁ", "fi"),
    ("ﬂ", "fl"),
    ("ﬃ", "ffi"),
    ("ﬄ", "ffl"),
]
CURLY = "‘’‚‛“”„‟"
STRAIGHT = "''''\"\"\"\""
LINE_BREAKS = r"\r\n|[\r\x{85}\x{2028}\x{2029}]"
# All that ligatures, curly quotes, odd line breaks and control characters are made of.
ODD = r"[\x00-\x08\x0b-\x1f\x7f\x{85}\x{2018}-\x{201f}\x{2028}\x{2029}\x{fb00}-\x{fb04}\x{feff}]"
CONTROLS = r"[\x00-\x08\x0b\x0e-\x1f\x7f\x{feff}]"
# The first characters of misread forms.
MISREAD_LEAD = r"[\x{c2}\x{c3}\x{c5}\x{c6}\x{cb}]|\x{e2}[\x{20ac}\x{201a}\x{201e}]"
# A misread form as a whole: its lead, and what a continuation byte looks like.
MISREAD = f"(?:{MISREAD_LEAD})[" + "".join(f"\\x{{{ord(_seen(b)):x}}}" for b in range(0x80, 0xC0)) + "]"
# Where misread forms can stand: they are of two or three characters, none of them ASCII.
SUSPECT = r"[^\x00-\x7f]{2,}"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def _read_back(text: Column) -> Column:
    """All misread forms replaced in their order; those of a lead that is not there are passed over."""
    for lead, forms in groupby(MOJIBAKE, key=lambda pair: pair[0][0]):
        pairs = list(forms)
        text = _once(
            text, lambda t: F.when(F.contains(t, F.lit(lead)), _replace_all(t, pairs)).otherwise(t)
        )
    return text


def misread_count(text: Column) -> Column:
    """What a reading costs: sequences that look like misread UTF-8."""
    return F.regexp_count(text, F.lit(MISREAD))


def reread(text: Column) -> Column:
    """Misread characters replaced, again and again as long as that leaves fewer of them.

    A text that was misread twice needs two rounds.  Every round but the last
    removes one at least, so there are no more rounds than misread characters.
    """

    def again(state: Column, _: Column) -> Column:
        kept = F.struct(state["text"].alias("text"), state["cost"].alias("cost"), F.lit(False).alias("falls"))
        tried = _once(
            _read_back(state["text"]),
            lambda read: _once(
                misread_count(read),
                lambda cost: F.when(
                    cost < state["cost"], F.struct(read.alias("text"), cost.alias("cost"), (cost > 0).alias("falls"))
                ).otherwise(kept),
            ),
        )
        return F.when(state["falls"], tried).otherwise(state)

    def read(marks: Column, cost: Column) -> Column:
        start = F.struct(marks.alias("text"), cost.alias("cost"), F.lit(True).alias("falls"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(cost, F.lit(1))), start, again)["text"]

    # Neither forms nor what stands for them hold an ASCII character, so only the runs of others
    # are read, all at once, with a line break between them; the rest is put back around them.
    marks = F.array_join(F.regexp_extract_all(text, F.lit(SUSPECT), F.lit(0)), "\n")
    fixed = _once(marks, lambda m: _once(misread_count(m), lambda cost: read(m, cost)))
    runs = F.concat(F.split(fixed, "\n"), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(text, SUSPECT), runs, lambda plain, run: F.concat(plain, run)), "")


def repair_text(text: Column) -> Column:
    """Repair the usual damage: misread UTF-8, entities, quotes, line breaks.

    A chosen subset of what a general text fixer does, in this order: misread
    characters (however often they were misread), entities (only in text
    without a literal ``<``, so that markup stays as it is), ligatures, curly
    quotes, line breaks, control characters.  The chains of replacements run
    only on rows that hold a lead character.
    """
    text = _once(text, lambda t: F.when(t.rlike(MISREAD), reread(t)).otherwise(t))
    text = _once(
        text,
        lambda t: F.when(
            F.contains(t, F.lit("&")) & ~F.contains(t, F.lit("<")), _replace_all(t, ENTITIES)
        ).otherwise(t),
    )
    return _once(text, lambda t: F.when(t.rlike(ODD), _plain(t)).otherwise(t))


def _plain(text: Column) -> Column:
    text = _replace_all(text, LIGATURES)
    text = F.translate(text, CURLY, STRAIGHT)
    text = F.regexp_replace(text, LINE_BREAKS, "\n")
    return F.regexp_replace(text, CONTROLS, "")
