"""Information-theoretic sanitisation of personal data.

Patterns find the protected entities: e-mail and network addresses, cards,
phone numbers.  Words of a document may give its entities away.  How much a word
reveals is measured on the whole corpus: the pointwise mutual information of word and
entity over the information that the entity carries, 1 for a word that stands
only in documents with that entity.  Words that disclose too much are removed in
all documents; those that disclose a good part are generalised.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nounspan.functions.bloom import BloomFilter
from nounspan.llm.common import checkpointed

KINDS = ("email", "ip", "card", "phone")
LEAST_DOCS = 2
GENERALISE_AT = 0.85
REMOVE_AT = 0.95
# Words counted before a task hands its sums on; a bound of its memory.
HELD_WORDS = 400_000
# A list of up to so many bytes goes to the tasks whole; a longer one is joined.
LISTED_BYTES = 8_000_000
COMMON_WORDS = 20_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match can begin inside a run of digits: the run's start would have matched.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")


def emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def _part_ok(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for place, char in enumerate(reversed(digits)):
        value = int(char) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of all kinds, in the order of kinds and then of places."""
    spans = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(map(_part_ok, m[0].split("."))):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def entity_of(kind: str, found: str) -> str:
    return f"{kind}:{found.lower() if kind in ('email', 'ip') else _digits(found)}"


def outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """The words of the text that touch no entity, in their order."""
    borders: list[list[int]] = []
    for start, end in sorted((a, b) for _, a, b in spans):
        if borders and start < borders[-1][1]:
            borders[-1][1] = max(borders[-1][1], end)
        else:
            borders.append([start, end])
    at = 0
    for m in _WORD.finditer(text):
        while at < len(borders) and borders[at][1] <= m.start():
            at += 1
        if at == len(borders) or m.end() <= borders[at][0]:
            yield m


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    if not spans:
        return set(map(str.lower, set(_WORD.findall(text))))
    return {m[0].lower() for m in outside(text, spans)}


def entities_of(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    return {entity_of(kind, text[a:b]) for kind, a, b in spans}


COUNTED = "entity string, term string, docs long"


def _sums(seen: Counter) -> pa.RecordBatch:
    """What a task has counted so far by entity and term; the counter starts anew."""
    keys, docs = list(seen), list(seen.values())
    seen.clear()
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(docs, pa.int64())],
        ["entity", "term", "docs"],
    )


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each entity, of each word, and in all (both null)."""
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            spans = base_spans(text) if text else []
            seen[None, None] += 1
            seen.update((entity, None) for entity in entities_of(text, spans))
            seen.update((None, term) for term in terms_of(text or "", spans))
            if len(seen) > HELD_WORDS:
                yield _sums(seen)
    yield _sums(seen)


def _together(only: frozenset | None, common: frozenset):
    """Documents of each pair of an entity and a word, wherever in them the two stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                spans = base_spans(text) if text else []
                entities = entities_of(text, spans)
                if only is not None:
                    entities &= only
                terms = terms_of(text, spans) - common if entities else ()
                for entity in entities:
                    seen.update((entity, term) for term in terms)
                    if len(seen) > HELD_WORDS:
                        yield _sums(seen)
        yield _sums(seen)

    return run


def _listed(df: DataFrame, name: str) -> list | None:
    """The rows of a list that is small by its counted size, else None."""
    size = df.agg(F.sum(F.octet_length(name) + 64)).first()[0] or 0
    return df.collect() if size <= LISTED_BYTES else None


def distinct_evidence(texts: DataFrame) -> DataFrame:
    """``text``, each once: copies of a document are no independent evidence.

    Digests are counted first; only texts whose digest may be repeated move, to
    meet their copies.
    """
    marked = texts.select("text", F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two"))
    repeated = marked.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1")
    maybe = BloomFilter(repeated, ["one", "two"]).may_hold("one", "two")
    met = marked.filter(maybe).groupBy("one", "two").agg(F.first("text").alias("text"))
    return marked.filter(~maybe).select("text").unionByName(met.select("text"))


def disclosing_terms(texts: DataFrame) -> DataFrame:
    """``term, strength`` of the terms that disclose an entity enough.

    ``texts`` are distinct.  A pair counts if it occurs in LEAST_DOCS of them or
    more: one document is no evidence.  Both may stand anywhere in them.  A term that discloses
    several entities has the largest strength.
    """
    counted = texts.mapInArrow(_each, COUNTED).groupBy("entity", "term").agg(F.sum("docs").alias("docs"))
    counted = checkpointed(
        counted.filter((F.col("docs") >= LEAST_DOCS) | (F.col("entity").isNull() & F.col("term").isNull()))
    )
    first = counted.filter("entity IS NULL AND term IS NULL").first()
    total = float(first["docs"] if first else 1)
    entities = counted.filter("entity IS NOT NULL").select("entity", F.col("docs").alias("with_entity"))
    words = counted.filter("term IS NOT NULL").select("term", F.col("docs").alias("with_term"))

    # No pair is stronger than if all documents of the entity held the term.
    def most(with_entity: Column) -> Column:
        return F.pow(with_entity, GENERALISE_AT) * (total ** (1 - GENERALISE_AT)) * (1 + 1e-9)

    bound = entities.agg(most(F.max("with_entity"))).first()[0] or 0.0
    repeated = _listed(entities, "entity")
    # The commonest words beyond the bound need not be paired; the join drops the others.
    common = words.filter((F.col("with_term") > bound) & (F.octet_length("term") <= 64)).orderBy(
        F.desc("with_term"), "term"
    )
    run = _together(
        None if repeated is None else frozenset(r["entity"] for r in repeated),
        frozenset(r["term"] for r in common.limit(COMMON_WORDS).collect()),
    )
    together = texts.mapInArrow(run, COUNTED).groupBy("entity", "term").agg(F.sum("docs").alias("both"))
    information = F.ln(F.lit(total) / F.col("with_entity"))
    mutual = F.ln(
        F.col("both") * F.lit(total) / (F.col("with_term").cast("double") * F.col("with_entity"))
    )
    strength = F.when(information > 0, mutual / information).otherwise(0.0)
    return checkpointed(
        together.filter(F.col("both") >= LEAST_DOCS)
        .join(words.filter(F.col("with_term") <= bound), "term")
        .join(entities, "entity")
        .select("term", strength.alias("strength"))
        .filter(F.col("strength") >= GENERALISE_AT)
        .groupBy("term")
        .agg(F.max("strength").alias("strength"))
    )


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strength", pa.float64())])
_PLACE = pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
MARKED = (
    "row long, text string, spans array<struct<kind:string,start:long,end:long,strength:double>>, "
    "words array<struct<term:string,start:long,end:long>>"
)


def _marked(kind, strength: dict[str, float] | None):
    """The text with its spans; without a list of the terms also with the places of all its words."""

    def marked(text: str) -> tuple[list[tuple], list[tuple]]:
        spans = base_spans(text)
        out, words = [(*s, 1.0) for s in spans], []
        if strength is None:
            words = [(m[0].lower(), *m.span()) for m in outside(text, spans)]
        elif not strength.keys().isdisjoint(terms_of(text, spans)):
            places = ((m, strength.get(m[0].lower())) for m in outside(text, spans))
            out += [("term", *m.span(), s) for m, s in places if s is not None]
        return out, words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            found = [marked(text) if text else ([], []) for text in batch.column("text").to_pylist()]
            names = [f.name for f in _SPAN], [f.name for f in _PLACE]
            spans, words = ([[dict(zip(names[i], x)) for x in f[i]] for f in found] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").cast(to_arrow_type(kind)),
                    batch.column("row"),
                    batch.column("text"),
                    pa.array(spans, pa.list_(_SPAN)),
                    pa.array(words, pa.list_(_PLACE)),
                ],
                ["key", "row", "text", "spans", "words"],
            )

    return run


def _found(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, text, spans`` of every row."""
    spark_type = df.schema[id_col].dataType
    rows = df.select(
        F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")
    )
    schema = f"key {spark_type.simpleString()}, {MARKED}"
    terms = disclosing_terms(distinct_evidence(df.select(F.col(text_col).alias("text"))))
    listed = _listed(terms, "term")
    if listed is not None:
        strength = {r["term"]: r["strength"] for r in listed}
        return rows.mapInArrow(_marked(spark_type, strength), schema).select("key", "text", "spans")
    # A long list meets the words by a shuffle.
    marked = checkpointed(rows.mapInArrow(_marked(spark_type, None), schema))
    flagged = (
        marked.select("row", F.explode("words").alias("w"))
        .select("row", "w.*")
        .join(terms, "term")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "strength"))).alias("terms"))
    )
    more = F.transform(
        "terms",
        lambda s: F.struct(
            F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["strength"].alias("strength")
        ),
    )
    return marked.join(flagged, "row", "left").select(
        "key",
        "text",
        F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.concat("spans", more)).alias("spans"),
    )


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, spans`` for every row: the protected entities, then disclosing words.

    Spans are structs ``kind, start, end, strength`` in code points, the end
    exclusive; kind ``term`` marks a word that discloses an entity, at all its
    places in all documents, also in those that do not hold the entity.  Null
    text counts as empty; repeated rows are documents like others, but equal
    texts are one piece of evidence.  No rows, no result.
    """
    return _found(df, id_col, text_col).select(F.col("key").alias(id_col), "spans")


def sanitised(text: str, spans: list[dict]) -> str:
    """The text with entities replaced by their kind and terms removed or generalised."""
    out, end = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] < end:
            continue
        if span["kind"] != "term":
            mark = f"[{span['kind'].upper()}]"
        elif span["strength"] >= REMOVE_AT:
            mark = "[REMOVED]"
        else:
            word = text[span["start"] : span["end"]]
            mark = "[NAME]" if word[:1].isupper() else "[WORD]"
        out += [text[end : span["start"]], mark]
        end = span["end"]
    return "".join(out) + text[end:]


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, sanitised`` for every row, whatever its id; null text stays null."""
    clean = F.udf(lambda text, found: None if text is None else sanitised(text, [s.asDict() for s in found]), "string", useArrow=True)
    return _found(df, id_col, text_col).select(
        F.col("key").alias(id_col), clean(F.col("text"), F.col("spans")).alias("sanitised")
    )
