"""English plurals by rule, for turning singular seed nouns into plural ones."""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column
from pyspark.sql import functions as F

# Irregular words, irregular endings, and words that a rule must leave alone.
WORDS = {"foot": "feet", "goose": "geese", "ox": "oxen", "tooth": "teeth"}
ENDINGS = {
    "alumnus": "alumni",
    "child": "children",
    "hero": "heroes",
    "man": "men",
    "mouse": "mice",
    "person": "people",
    "thief": "thieves",
    "wife": "wives",
}
REGULAR_MAN = "brahman|german|human|norman|ottoman|roman|shaman|talisman"
HARD_CH = "czech|epoch|eunuch|hierarch|matriarch|monarch|oligarch|patriarch|stomach"
# The head of a hyphenated noun is inflected: mothers-in-law, passers-by.
TAILS = (r"(?i)\A[^-]+(-(?:at|in|of|to)-.+)\z", r"(?i)\A[^-]+er(-(?:by|up))\z")


def _word(word: Column) -> Column:
    plural_ = F.when(word == "", word).when(
        word.rlike(rf"(?i)(?:{REGULAR_MAN}|{HARD_CH})\z"), F.concat(word, F.lit("s"))
    )
    for start, pairs in ((r"\A", WORDS), ("", ENDINGS)):
        for one, many in pairs.items():
            # What both share keeps its case.
            same = len(commonprefix((one, many)))
            pattern = rf"(?i){start}({one[:same]}){one[same:]}\z"
            plural_ = plural_.when(word.rlike(pattern), F.regexp_replace(word, pattern, "$1" + many[same:]))
    return (
        plural_.when(word.rlike(r"(s|x|z|ch|sh)\z"), F.concat(word, F.lit("es")))
        .when(word.rlike(r"[^aeiouAEIOU]y\z"), F.regexp_replace(word, r"y\z", "ies"))
        .otherwise(F.concat(word, F.lit("s")))
    )


def plural(word: Column) -> Column:
    """Plural of one word: irregular nouns, then sibilants, -y, -s; a hyphenated noun by its head."""
    tail = F.concat(*[F.regexp_extract(word, pattern, 1) for pattern in TAILS])
    head = F.substring(word, F.lit(1), F.length(word) - F.length(tail))
    return F.concat(_word(head), tail)


def pluralise(phrase: Column) -> Column:
    """Plural of a phrase: its last space-delimited word is inflected."""
    last = F.substring_index(phrase, " ", -1)
    head = F.substring(phrase, F.lit(1), F.length(phrase) - F.length(last))
    return F.concat(head, plural(last))
