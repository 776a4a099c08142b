"""The registered queries of this folder: each operator on its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm import bpe, chat, decontaminate, divergence, exchange, jaccard, language, quality, secrets, sketches, tokenfiles, vectors, warc
from mensura.llm.batches import tokenizer_file
from mensura.llm.files import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hex_sha256(text: Column) -> Column:
    return F.sha2(text, 256)


# --- 1: language ---------------------------------------------------------------------------------


@query("op1_language")
def op1(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    sample = language.labelled_sample(documents.filter(~language.held_out()), "text", "lang")
    network = language.fit(sample) if sample else None
    found = language.predict(documents.select("doc_id", "text"), network, keep=["doc_id"])
    return found.withColumn("doc_id", F.col("row.doc_id")).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


# --- 2: sharding ---------------------------------------------------------------------------------


@query("op2_shards")
def op2(spark, folder):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return exchange.shuffled(rows, 24).select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# --- 3: chat formatting --------------------------------------------------------------------------


@query("op3_chat_format", """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(1) || sha256(text) || chr(2), '' ORDER BY turn NULLS FIRST, role, sha256(text)) AS k,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, sha256(text)) AS rendered
  FROM t GROUP BY conv_id
), classes AS (
  SELECT k, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_logged, any_value(rendered) AS rendered,
    string_split(k, chr(2))[1] AS head
  FROM whole GROUP BY k
)
SELECT conv_id, CAST(0 AS INTEGER) AS part, n_turns, n_logged, rendered FROM classes a
WHERE NOT EXISTS (SELECT 1 FROM classes b WHERE b.head = a.head AND b.n_turns > a.n_turns AND starts_with(b.k, a.k))
""")
def op3(spark, folder):
    return chat.format_conversations(table(spark, folder, "conversations"))


# --- 4: byte-level BPE -----------------------------------------------------------------------------


@query("op4_bpe")
def op4(spark, folder):
    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), ranks, keep=["doc_id"])
    decoded = bpe.decode(encoded, ranks)
    return decoded.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        hex_sha256(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"), hex_sha256(F.col("bytes")).alias("decoded_sha256"))


# --- 5: n-gram Jaccard join ------------------------------------------------------------------------


@query("op5_jaccard_join", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + greatest(0, least(len(w), 3) - 1)], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM d)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 90 * (na.n + nb.n - o)
), r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
""")
def op5(spark, folder):
    return jaccard.linked_documents(table(spark, folder, "documents").select("doc_id", "text"))


# --- 6: token files --------------------------------------------------------------------------------


@query("op6_token_files")
def op6(spark, folder):
    target = new_folder(spark, "tokens")
    manifest = tokenfiles.write_tokens(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), target)
    return tokenfiles.read_documents(spark, target, manifest)


# --- 7: benchmark decontamination ------------------------------------------------------------------

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op7_decontaminate", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM documents
), b AS (SELECT item_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM benchmark
), items AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, w[i:i + least(13, len(w)) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT rid, n, i, w[i:i + n - 1] AS g
  FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)
), hits AS (SELECT rid, i, n, item_id FROM grams JOIN items USING (n, g)
), marked AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), found AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM hits GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN found USING (rid)
""")
def op7(spark, folder):
    found = decontaminate.scan(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        hex_sha256(F.array_join("items", ",")).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


# --- 8: secret scans -------------------------------------------------------------------------------


def _rule_sql(rule: secrets.Rule) -> str:
    """(rid, rule, start, end) of a rule's matches."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
SELECT rid, '{rule.name}' AS kind, {secrets.RULES.index(rule)} AS ord, i,
  CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
  length(found[i]) AS n, length(vals[i]) AS v
FROM (
  SELECT rid, found, vals, gaps, unnest(range(1, len(found) + 1)) AS i FROM (
    SELECT rid, regexp_extract_all(t, '{pattern}', 0) AS found, regexp_extract_all(t, '{pattern}', {rule.group}) AS vals,
      string_split_regex(t, '{pattern}') AS gaps FROM d))
WHERE length(vals[i]) >= {rule.least}"""


@query("op8_secrets", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(_rule_sql(r) for r in secrets.RULES)}),
shown AS (SELECT rid, kind, ord, s, kind || ':' || s || ':' || (s + n) AS x FROM m)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY s, ord) FILTER (kind IN ('assign', 'access', 'hex')), '')) AS base_sha256,
  coalesce(string_agg(x, ',' ORDER BY s, ord), '') AS spans
FROM d LEFT JOIN shown USING (rid) GROUP BY rid, doc_id
""")
def op8(spark, folder):
    found = secrets.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id", *[F.size(f"found_{r.name}").cast("long").alias(f"n_{r.name}") for r in secrets.BASE],
        hex_sha256(secrets.ordered(secrets.BASE)).alias("base_sha256"), secrets.ordered().alias("spans"),
    )


# --- 9: web archives -------------------------------------------------------------------------------


@query("op9_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), d AS (
  SELECT page_id, strlen(h) AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
      lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(5 * g + 1 AS INTEGER), 5) AS INTEGER) >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest
  FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
""")
def op9(spark, folder):
    source, target = new_folder(spark, "warc"), new_folder(spark, "warc-members")
    files = warc.write_monolithic(table(spark, folder, "pages"), source)
    return warc.read_pages(spark, target, warc.normalise(spark, source, files, target))


# --- 10: quality rules -----------------------------------------------------------------------------

QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (SELECT rid, i, w[i:i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (SELECT rid, g FROM g GROUP BY rid, g HAVING count(*) > 1
), rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g JOIN twice USING (rid, g)) GROUP BY rid
), m AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM l LEFT JOIN rep USING (rid)
), f AS (
  SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT)
    + 4 * CAST(n_symbols > n_words AS BIGINT) + 8 * CAST(word_chars < 2 * n_words AS BIGINT)
    + 16 * CAST(word_chars > 20 * n_words AS BIGINT) + 32 * CAST(10 * n_dup_lines > 7 * n_lines AS BIGINT) AS fail_bits
  FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM f
"""


@query("op10_quality", QUALITY_SQL)
def op10(spark, folder):
    rows = quality.ledger(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    return rows.select("row.doc_id", *[c for c in rows.columns if c != "row"], (~quality.passes("base")).alias("base_failed"), quality.passes().alias("kept"))


# --- 11: HyperMinHash near-duplicates --------------------------------------------------------------


@query("op11_near_duplicates", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + greatest(0, least(len(w), 3) - 1)], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM d)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)
), r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
""")
def op11(spark, folder):
    return sketches.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


# --- 12: vector codes ------------------------------------------------------------------------------


def _nearest(name: str, books: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT rid, part, x, m.e AS entry, m.d AS d FROM (
    SELECT rid, part, any_value(x) AS x, min({{'d': d, 'e': entry}}) AS m FROM (
      SELECT rid, part, x, entry, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
      FROM p JOIN {books} USING (part)) GROUP BY rid, part))"""


def _means(name: str, books: str, nearest: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT part, entry, CASE WHEN n IS NULL THEN c ELSE list_transform(t, lambda s: (s - ((s % n) + n) % n) // n) END AS c FROM {books}
  LEFT JOIN (SELECT part, entry, n, list(s ORDER BY j) AS t FROM (
    SELECT part, entry, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS j FROM {nearest})
    GROUP BY part, entry, j) GROUP BY part, entry, n) USING (part, entry))"""


@query("op12_vector_codes", f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, e) - 1 AS rid, vec_id, label, e FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), p AS MATERIALIZED (SELECT rid, part, e[part * (len(e) // 16) + 1:(part + 1) * (len(e) // 16)] AS x FROM (SELECT rid, e, unnest(range(0, 16)) AS part FROM v)
), b0 AS MATERIALIZED (SELECT part, rid AS entry, x AS c FROM p WHERE rid < 64),
{_nearest('a0', 'b0')}, {_means('b1', 'b0', 'a0')}, {_nearest('a1', 'b1')}, {_means('b2', 'b1', 'a1')}, {_nearest('a2', 'b2')},
coded AS (SELECT rid, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS digest FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM v JOIN coded USING (rid), books
""")
def op12(spark, folder):
    return vectors.codes(table(spark, folder, "embeddings"))


# --- 13: source divergence -------------------------------------------------------------------------


@query("op13_source_divergence", r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS MATERIALIZED (SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(*) >= 10
), c AS MATERIALIZED (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, CAST(coalesce(sum(n), 0) AS BIGINT) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY lang, source
), dense AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + CAST((1000000000 * CAST(coalesce(c.n, 0) + 2 AS HUGEINT)) // (g.total + 2 * g.v) AS BIGINT) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), whole AS (SELECT lang, term, 1 + CAST((1000000000 * CAST(sum(n) + 2 AS HUGEINT)) // (any_value(total) + 2 * any_value(v)) AS BIGINT) AS q
  FROM dense JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY lang, term
), sums AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM dense JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f
QUALIFY part = 'pair' OR rank <= 10
""")
def op13(spark, folder):
    return divergence.audit(table(spark, folder, "documents").select("text", "lang", "source"))
