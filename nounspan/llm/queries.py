"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nounspan.llm import (
    exact_dedup,
    fingerprints,
    infill,
    jaccard,
    langid,
    licenses,
    mixing,
    packing,
    pii,
    prefix_trie,
    repeats,
    sharding,
    warc,
)
from nounspan.llm.common import table

SHARDS = 40


def default_vocabulary() -> str:
    """Place of the public vocabulary file; another path can be passed instead."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.exact_dedup(docs, carry=["doc_id"]).select(
        "row.doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "source",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_warc(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("places")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), default_vocabulary())


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))

    def shown(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select(
        "doc_id",
        *[n(kind) for kind in pii.KINDS],
        n("term"),
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), SHARDS)
    return sharding.described(shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out("doc_id")
    profiles = langid.fit_profiles(docs.filter(~out))
    return langid.predict(docs, profiles).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    return examples.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_exact_dedup,
        op3_mixing,
        op4_warc,
        op5_licenses,
        op6_packing,
        op7_pii,
        op8_sharding,
        op9_language,
        op10_jaccard,
        op11_prefix_trie,
        op12_infill,
        op13_repeats,
    )
}


# ---------------------------------------------------------------- SQL


def _sql_root(leaves: str) -> str:
    marked = f"array_to_string(list_transform({leaves}, lambda h: regexp_replace(h, '([08])$', '\\1|')), '')"
    parts = f"list_filter(string_split({marked}, '|'), lambda p: p <> '')"
    return f"sha256(array_to_string(list_transform({parts}, lambda p: sha256(p)), ''))"


def _sql_leaves(text: str) -> str:
    return f"list_transform(string_split({text}, chr(10)), lambda l: sha256(l))"


def _sql_parts(leaves: str) -> str:
    marked = f"array_to_string(list_transform({leaves}, lambda h: regexp_replace(h, '([08])$', '\\1|')), '')"
    return f"len(list_filter(string_split({marked}, '|'), lambda p: p <> ''))"


_SQL_NEXT = "unit" + "".join(
    f" || coalesce(lead(unit, {i}) OVER w, '')" for i in range(1, fingerprints.PIECE_POINTS)
)

OP1 = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS r, "
    "count(*) OVER () AS c FROM documents), "
    "e AS (SELECT d.doc_id, d.t, n.t AS nt, length(d.t)::BIGINT AS n_chars, "
    "left(d.t, (length(d.t) - length(d.t) // 4)::BIGINT) || left(n.t, (length(d.t) // 4)::BIGINT) AS et "
    "FROM d JOIN d AS n ON n.r = d.r % d.c + 1), "
    "texts AS (SELECT doc_id, 'own' AS which, t FROM e UNION ALL SELECT doc_id, 'new', et FROM e "
    "UNION ALL SELECT doc_id, 'next', nt FROM e), "
    f"units AS (SELECT doc_id, which, false AS short, regexp_extract_all(t, '{fingerprints.PLACE}') AS u FROM texts "
    "UNION ALL SELECT doc_id, which, true, regexp_extract_all(t, '(?s).') FROM texts "
    f"WHERE length(t) < {fingerprints.SHORT_TEXT}), "
    "unit AS (SELECT doc_id, which, short, unnest(u) AS unit, unnest(range(len(u))) AS i FROM units), "
    f"pieces AS (SELECT doc_id, which, short, left({_SQL_NEXT}, {fingerprints.PIECE_POINTS}) AS piece FROM unit "
    "WINDOW w AS (PARTITION BY doc_id, which, short ORDER BY i)), "
    f"pairs AS (SELECT a.doc_id, b.which, greatest(length(a.t), length(b.t)) < {fingerprints.SHORT_TEXT} AS short, "
    f"CASE WHEN greatest(length(a.t), length(b.t)) < {fingerprints.SHORT_TEXT} "
    f"THEN 1 + least(length(a.t), length(b.t)) // {fingerprints.PIECE_POINTS} ELSE {fingerprints.PIECE_POINTS} END AS k "
    "FROM texts AS a JOIN texts AS b ON a.doc_id = b.doc_id AND a.which = 'own' AND b.which <> 'own'), "
    "cut AS MATERIALIZED (SELECT q.doc_id, q.which, p.which = 'own' AS mine, left(piece, k::BIGINT) AS piece, count(*) AS c "
    "FROM pairs AS q JOIN pieces AS p ON p.doc_id = q.doc_id AND p.short = q.short AND p.which IN ('own', q.which) "
    "WHERE length(piece) >= k GROUP BY ALL), "
    "together AS (SELECT a.doc_id, a.which, sum(least(a.c, b.c)) AS n FROM cut AS a JOIN cut AS b "
    "ON a.doc_id = b.doc_id AND a.which = b.which AND a.piece = b.piece AND a.mine AND NOT b.mine GROUP BY ALL), "
    "near AS (SELECT c.doc_id, c.which, 2.0::DOUBLE * coalesce(any_value(n), 0) / sum(c) AS likeness "
    "FROM cut AS c LEFT JOIN together AS b ON b.doc_id = c.doc_id AND b.which = c.which GROUP BY ALL), "
    f"l AS (SELECT *, {_sql_leaves('t')} AS lv, {_sql_leaves('et')} AS el, {_sql_leaves('nt')} AS nl FROM e), "
    f"f AS (SELECT *, {_sql_root('lv')} AS ro, {_sql_root('el')} AS re, {_sql_root('nl')} AS rn FROM l), "
    "g AS (SELECT *, list_position(list_transform(range(1, greatest(len(lv), len(el)) + 1), "
    "lambda i: lv[i] IS NOT DISTINCT FROM el[i]), false) AS fp FROM f) "
    "SELECT g.doc_id, n_chars, sha256(et) AS edited_sha256, ro AS fingerprint, re AS edited_fingerprint, "
    "CASE WHEN ro = re THEN 1.0::DOUBLE ELSE x.likeness END AS near_edited, "
    "CASE WHEN ro = rn THEN 1.0::DOUBLE ELSE y.likeness END AS near_next, "
    f"{_sql_parts('lv')}::BIGINT AS n_sections, len(lv)::BIGINT AS n_paragraphs, "
    "CASE WHEN fp > 0 THEN (fp - 1)::BIGINT END AS first_edited_paragraph FROM g "
    "LEFT JOIN near AS x ON x.doc_id = g.doc_id AND x.which = 'new' LEFT JOIN near AS y ON y.doc_id = g.doc_id AND y.which = 'next'"
)

OP2 = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, "
    "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents), "
    "g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) "
    "AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d) "
    "SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g"
)

OP4 = (
    "WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages), "
    "g AS (SELECT page_id, h, n, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) "
    "ELSE page_id END AS best FROM p) "
    "SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest, "
    "CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type, "
    "CASE WHEN best <> page_id THEN best END AS refers_to FROM g"
)


# CRC-32 bit by bit, over the decimal digits of the id.
_SQL_CRC = (
    "xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: unicode(s[i])::BIGINT), "
    "lambda c, b: list_reduce(range(8), lambda k, i: xor(k // 2, 3988292384 * (k % 2)), xor(c, b)), "
    "4294967295::BIGINT), 4294967295)"
)

OP11 = (
    "WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations "
    "WHERE conv_id IS NOT NULL), "
    "u AS (SELECT c, turn, sha256(length(r) || ':' || r || ':' || x) AS h, length(x) AS n FROM t), "
    "g AS (SELECT c, c::VARCHAR AS s, list(h ORDER BY turn NULLS FIRST, h) AS hs, "
    "list(n ORDER BY turn NULLS FIRST, h) AS ns FROM u GROUP BY c), "
    f"k AS (SELECT *, {_SQL_CRC} % 6 AS k FROM g), "
    "b AS (SELECT a.c, list_concat(list_slice(coalesce(l.hs, []), 1, a.k), list_slice(a.hs, a.k + 1, len(a.hs))) AS hs, "
    "list_concat(list_slice(coalesce(l.ns, []), 1, a.k), list_slice(a.ns, a.k + 1, len(a.ns))) AS ns "
    "FROM k AS a LEFT JOIN g AS l ON l.c = a.c - a.c % 100), "
    "p AS (SELECT c, hs, ns, unnest(range(0, len(hs) + 1)) AS d FROM b), "
    "q AS (SELECT c, d, CASE WHEN d > 0 THEN array_to_string(list_slice(hs, 1, d), '') ELSE '' END AS key, "
    "CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS chars, len(hs) = d AS ended FROM p), "
    "v AS (SELECT key, d, min(c) AS conv_id, count(*) AS n, max(chars) AS chars, "
    "sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends FROM q GROUP BY key, d), "
    "w AS (SELECT left(key, 64 * (d - 1)) AS key, count(*) AS kids FROM v WHERE d > 0 GROUP BY 1), "
    "a AS (SELECT v.*, coalesce(kids, 0) AS kids FROM v LEFT JOIN w USING (key)), "
    "z AS (SELECT left(key, 64 * j) AS key, sum((n - 1) * chars) AS saved, count(*) FILTER (kids = 0) AS leaves "
    "FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM a) GROUP BY 1) "
    "SELECT a.conv_id, a.d AS depth, m.conv_id AS parent_conv_id, a.n AS n_convs, a.kids AS n_children, "
    "leaves AS n_leaves, saved::BIGINT AS saved_tokens, a.ends AS ends_sha256 "
    "FROM a JOIN z USING (key) LEFT JOIN v AS m ON m.key = left(a.key, 64 * (a.d - 1)) AND a.d > 0"
)


def _sql_units(first: str, last: str) -> str:
    return f"array_to_string(list_slice(u, {first}, {last}), '')"


OP12 = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id::VARCHAR) AS s FROM documents), "
    "e AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, "
    + ", ".join(f"('0x' || substr(s, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    + " FROM d), "
    "f AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, "
    "greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b, "
    "CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' "
    "WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e), "
    f"g AS (SELECT *, {_sql_units('1', 'a')} AS p, {_sql_units('a + 1', 'b')} AS m, "
    f"{_sql_units('b + 1', 'n')} AS x FROM f) "
    "SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, "
    "CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars, "
    "sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m "
    "ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, "
    "sha256(t) AS restored_sha256 FROM g"
)

OP13 = (
    "WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS x, (strlen(coalesce(text, '')))::BIGINT AS n FROM documents), "
    "w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 800)) AS k FROM "
    "(SELECT doc_id, x, unnest(range(n - 399)) AS p FROM d WHERE n >= 400)), "
    "r AS (SELECT doc_id, p FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) AS g ON w.k = g.k), "
    "i AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 400 AS gap FROM r), "
    "j AS (SELECT doc_id, p, count(*) FILTER (gap) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM i), "
    "s AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS b FROM j GROUP BY doc_id, run), "
    "t AS (SELECT doc_id, run, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM s), "
    "k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, "
    "string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head "
    "FROM t JOIN d USING (doc_id) GROUP BY doc_id) "
    "SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, "
    "sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"
)

ORACLES = {"op11_prefix_trie": OP11, "op13_repeats": OP13, "op12_infill": OP12, "op1_fingerprints": OP1, "op2_exact_dedup": OP2, "op4_warc": OP4}
