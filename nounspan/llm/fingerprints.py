"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line; its leaf is the SHA-256 of its text.  A section ends
after a paragraph whose leaf ends in one of two hex digits, so an inserted
paragraph moves no border but its own.  A section's hash covers its leaves and
the root covers the sections.  Equal texts have equal roots; where roots
differ, differing sections and then differing leaves locate the edits.

Below the paragraphs lie pieces, which grade how much of two documents agrees:
the first eight code points from the start of every word, a word being up to
eight ASCII letters and digits, and of every other code point.  The text alone
chooses the places, so an edit changes only the pieces that touch it; pieces
that a text holds several times count as often.  Two short texts, of less than 56
code points, are compared by pieces from every code point on, which are the
shorter the shorter the texts are, so that they are graded like long ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nounspan.llm.common import NO_ID, id_key, text_of
from nounspan.operators.ids import with_rid

PIECE_POINTS = 8
# Texts below this have pieces at every code point, one code point longer for each eight of the text.
SHORT_TEXT = 56
# A word with the space after it, or one other code point.
PLACE = "[A-Za-z0-9]{1,8} ?|[^A-Za-z0-9]"
# Hex digits of a leaf.
LEAF = 64


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _pieces(text: Column, place: str) -> Column:
    """What stands at every place, PIECE_POINTS code points or what is left of the text.

    The lookahead takes the piece, the match after it leads to the next place.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{PIECE_POINTS}}}))(?:{place})"), F.lit(1))


def _hashes(pieces: Column, width: Column, side: int) -> Column:
    """Hashes of the pieces cut to a width, without those at the end that are shorter.

    The last bit tells which of two texts a hash comes from.
    """

    def marked(piece: Column) -> Column:
        hashed = F.xxhash64(piece)
        return hashed.bitwiseOR(F.lit(1)) if side else hashed.bitwiseAND(F.lit(-2))

    def kept(n: Column) -> Column:
        last = F.slice(pieces, F.greatest(n - PIECE_POINTS, F.lit(0)) + 1, F.lit(PIECE_POINTS))
        short = F.size(F.filter(last, lambda p: F.length(p) < width))
        whole = F.slice(pieces, F.lit(1), n - short)
        return F.when(width == PIECE_POINTS, F.transform(whole, marked)).otherwise(
            F.transform(whole, lambda p: marked(F.left(p, width)))
        )

    return _bound(F.size(pieces), kept)


def _shared(a: Column, b: Column) -> Column:
    """Pieces of side 0 and of side 1 that go together, each one once.

    In the sorted list equal hashes stand together, those of side 0 first.
    """
    start = F.struct(
        F.lit(None).cast("long").alias("hash"), F.lit(0).alias("left"), F.lit(0).alias("both")
    )

    def step(state: Column, value: Column) -> Column:
        this = value.bitwiseAND(F.lit(-2))
        same = state["hash"].eqNullSafe(this)
        second = value != this
        waiting = F.when(same, state["left"]).otherwise(0)
        meets = second & (waiting > 0)
        return F.struct(
            this.alias("hash"),
            F.when(second, F.when(meets, waiting - 1).otherwise(waiting)).otherwise(waiting + 1).alias("left"),
            F.when(meets, state["both"] + 1).otherwise(state["both"]).alias("both"),
        )

    return F.aggregate(F.sort_array(F.concat(a, b)), start, step)["both"]


def _parts(leaves: Column) -> Column:
    """The leaves of each section in one string; a mark stands after each leaf that ends one."""
    marked = F.transform(leaves, lambda leaf: F.regexp_replace(leaf, "([08])$", "$1|"))
    return F.filter(F.split(F.array_join(marked, ""), "[|]"), lambda part: part != "")


def tree(text: Column) -> Column:
    """Struct ``root, sections, sizes, leaves, pieces, close, points`` of a text; null counts as empty.

    ``sizes`` are the paragraphs of each section, ``close`` the pieces of a short
    text (null for others), ``points`` the code points.
    """
    given = F.coalesce(text, F.lit(""))

    def whole(leaves: Column, parts: Column) -> Column:
        sections = F.transform(parts, lambda part: F.sha2(part, 256))
        return F.struct(
            F.sha2(F.array_join(sections, ""), 256).alias("root"),
            sections.alias("sections"),
            F.transform(parts, lambda part: (F.length(part) / LEAF).cast("int")).alias("sizes"),
            leaves.alias("leaves"),
            _pieces(given, PLACE).alias("pieces"),
            F.when(F.length(given) < SHORT_TEXT, _pieces(given, ".")).alias("close"),
            F.length(given).alias("points"),
        )

    leaves = F.transform(F.split(given, "\n"), lambda line: F.sha2(line, 256))
    return _bound(leaves, lambda l: _bound(_parts(l), lambda parts: whole(l, parts)))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the Dice coefficient of the trees' pieces."""

    def dice(left: Column, right: Column) -> Column:
        return 2.0 * _shared(left, right) / (F.size(left) + F.size(right))

    def graded(width: Column, kind: str) -> Column:
        return _bound(
            F.struct(_hashes(a[kind], width, 0).alias("l"), _hashes(b[kind], width, 1).alias("r")),
            lambda h: dice(h["l"], h["r"]),
        )

    least, most = F.least(a["points"], b["points"]), F.greatest(a["points"], b["points"])
    short = _bound(F.floor(least / PIECE_POINTS).cast("int") + 1, lambda width: graded(width, "close"))
    return (
        F.when(a["root"] == b["root"], 1.0)
        .when(most < SHORT_TEXT, short)
        .otherwise(graded(F.lit(PIECE_POINTS), "pieces"))
    )


def _first_unequal(a: Column, b: Column) -> Column:
    """Place (from 0) of the first element that differs or that only one has; null for equal lists."""
    place = F.array_position(
        F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"].eqNullSafe(z["b"])), False
    )
    return F.when(place > 0, (place - 1).cast("int"))


def first_difference(a: Column, b: Column) -> Column:
    """Place (from 0) of the first paragraph that differs; null for equal trees.

    Down from the roots: the first section that differs holds it, so of the
    paragraphs only those of that section are compared.
    """

    def inside(section: Column) -> Column:
        before = F.aggregate(F.slice(a["sizes"], F.lit(1), section), F.lit(0), lambda n, size: n + size)
        most = F.greatest(F.get(a["sizes"], section), F.get(b["sizes"], section))
        return _bound(
            before,
            lambda n: n + _first_unequal(F.slice(a["leaves"], n + 1, most), F.slice(b["leaves"], n + 1, most)),
        )

    found = _bound(_first_unequal(a["sections"], b["sections"]), lambda k: F.when(k.isNotNull(), inside(k)))
    return F.when(a["root"] != b["root"], found.cast("long"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, tree`` for every row; null text counts as empty."""
    return df.select(id_col, tree(F.col(text_col)).alias("tree"))


def compared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint against those of an edited text and of the next document.

    The edited text has the last quarter of the code points replaced by as many
    (or all) of the next document by id; after the last comes the first.  A row
    without an id comes before all ids.  Rows with the same id all have the
    same next document; of several next rows the one with the smallest text
    counts.  Texts are shuffled by their own id and by that of the document
    before.
    """
    docs = df.select(id_key(id_col).alias("key"), text_of(text_col).alias("text"))
    kind = df.schema[id_col].dataType
    own_id = F.when(F.col("key") != NO_ID, F.col("key")).cast(kind)
    order = with_rid(docs.select("key").distinct(), [F.col("key")], name="at")
    total = order.count()
    before = order.select(
        ((F.col("at") + 1) % max(total, 1)).alias("at"), F.col("key").alias("taker")
    )
    takers = order.select("at", "key").join(before, "at").select("key", "taker")
    given = (
        docs.join(takers, "key")
        .groupBy(F.col("taker").alias("key"))
        .agg(F.min("text").alias("next"))
    )
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.left("text", F.length("text") - quarter), F.left("next", quarter))
    return (
        docs.join(given, "key")
        .select(own_id.alias("id"), "text", "next", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))
        .select(
            "id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            tree(F.col("text")).alias("own"),
            tree(F.col("edited")).alias("new"),
            tree(F.col("next")).alias("next"),
        )
        .select(
            F.col("id").alias(id_col),
            "n_chars",
            "edited_sha256",
            F.col("own.root").alias("fingerprint"),
            F.col("new.root").alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("new")).alias("near_edited"),
            likeness(F.col("own"), F.col("next")).alias("near_next"),
            F.size("own.sections").cast("long").alias("n_sections"),
            F.size("own.leaves").cast("long").alias("n_paragraphs"),
            first_difference(F.col("own"), F.col("new")).alias("first_edited_paragraph"),
        )
    )
