"""Queries over activity records: pruning, validity, units, transforms, ranges, consensus, full curation."""

from pyspark.sql import functions as F

from mensura import fixed_values as fixed
from mensura.functions import columns as fn
from mensura.operators import consensus as con
from mensura.operators import curation as cur
from mensura.plans import curation as plan
from mensura.registry.core import query, r, rounded

TEXTS = "('Values appear to be an order of magnitude different from previously reported, so units may be incorrect'," \
        "'Potential transcription error')"
DESCRIPTIONS = "('Values for this activity type are unusually large/small, so may not be accurate'," \
               "'Values appear to be an order of magnitude different from previously reported, so units may be incorrect')"
VALID = f"""SELECT * FROM records
    WHERE NOT (coalesce(data_validity_comment IN {TEXTS}, false)
               OR coalesce(data_validity_description IN {DESCRIPTIONS}, false))"""
FACTOR = """CASE standard_units WHEN '10''5pM' THEN 100.0::DOUBLE WHEN '10''6pM' THEN 1000.0::DOUBLE
    WHEN '10''3pM' THEN 1.0::DOUBLE WHEN 'nM' THEN 1.0::DOUBLE END"""
UNITS = "('10''5pM','10''6pM','10''3pM','nM')"


def converted_ctes(default: str) -> str:
    """Validity, identity, flag, unit and transform steps as SQL."""
    return f"""
valid AS ({VALID}),
clean AS (SELECT *, CASE WHEN trim(canonical_smiles) <> '' THEN array_to_string(list_filter(
            string_split(canonical_smiles, '.'), lambda p: p <> 'Cl'), '.') END AS cleaned_smiles FROM valid),
keyed AS (SELECT *, CASE WHEN trim(cleaned_smiles) <> '' THEN upper(md5(cleaned_smiles)) END AS "InChIkey" FROM clean),
unflagged AS (SELECT * FROM keyed WHERE potential_duplicate IS DISTINCT FROM 1),
scaled AS (SELECT *, TRY_CAST(standard_value AS DOUBLE) AS num, TRY_CAST(standard_value AS DOUBLE) * {FACTOR} AS "IC50_nM"
           FROM unflagged WHERE standard_units IN {UNITS}),
converted AS (SELECT *, round(CASE WHEN standard_type = 'IC50' AND "IC50_nM" > 0 THEN -log10("IC50_nM" * 1e-9)
                WHEN standard_type = 'Log IC50' THEN -num WHEN standard_type = 'pIC50' THEN num
                WHEN standard_type = 'Log IC50(nM)' THEN 9 - num ELSE {default} END, 5) AS "PIC50" FROM scaled)"""


PRODUCTION = converted_ctes("NULL") + """,
ranged AS (SELECT * FROM converted WHERE "PIC50" IS NOT NULL AND standard_relation = '=' AND "IC50_nM" > 0
           AND "IC50_nM" <= 10000 AND "InChIkey" IS NOT NULL),
med AS (SELECT *, median("PIC50") OVER (PARTITION BY "InChIkey") AS m FROM ranged),
dev AS (SELECT *, median(abs("PIC50" - m)) OVER (PARTITION BY "InChIkey") AS mad,
               row_number() OVER (PARTITION BY "InChIkey" ORDER BY source_index) AS rn FROM med),
final AS (SELECT * FROM dev WHERE mad <= 1.0 AND rn = 1)"""

AUDIT = converted_ctes("0") + """,
med AS (SELECT *, median("PIC50") OVER (PARTITION BY "InChIkey") AS m FROM converted WHERE "InChIkey" IS NOT NULL),
dev AS (SELECT *, median(abs("PIC50" - m)) OVER (PARTITION BY "InChIkey") AS mad FROM med),
consistent AS (SELECT * REPLACE (m AS "PIC50") FROM dev WHERE mad <= 1.0),
deduplicated AS (SELECT * FROM consistent QUALIFY row_number() OVER (
    PARTITION BY "InChIkey", cleaned_smiles, "PIC50" ORDER BY source_index) = 1),
exact AS (SELECT * FROM deduplicated WHERE standard_relation = '='),
final AS (SELECT * FROM exact WHERE num <= 10000)"""


@query("drop_all_null_columns", "SELECT * EXCLUDE (upper_value) FROM records")
def _(t):
    return cur.drop_all_null_columns(t.records)


@query("drop_if_present", "SELECT * EXCLUDE (activity_comment, upper_value) FROM records")
def _(t):
    return cur.drop_if_present(t.records)


@query("with_optional", "SELECT source_index, standard_units, CAST(NULL AS VARCHAR) AS assay_note FROM records")
def _(t):
    rows = cur.require_columns(t.records, ["source_index", "standard_units"])
    return cur.with_optional(rows, "assay_note").select("source_index", "standard_units", "assay_note")


@query("filter_validity", f"SELECT source_index, data_validity_comment FROM ({VALID}) v")
def _(t):
    return plan.valid_records(t.records).select("source_index", "data_validity_comment")


@query("filter_flag", "SELECT source_index, potential_duplicate FROM records WHERE potential_duplicate IS DISTINCT FROM 1")
def _(t):
    return cur.filter_flag(t.records, "potential_duplicate").select("source_index", "potential_duplicate")


@query("filter_allowed", f"SELECT source_index, standard_units FROM records WHERE standard_units IN {UNITS}")
def _(t):
    return cur.filter_allowed(t.records, "standard_units", list(fixed.UNIT_FACTORS)).select("source_index", "standard_units")


@query("normalize_units", f"""
SELECT source_index, standard_units AS original_standard_units, 'nM' AS standard_units,
       round(TRY_CAST(standard_value AS DOUBLE) * {FACTOR}, 6) + 0.0 AS nano_value FROM records""")
def _(t):
    out = cur.normalize_units(t.records, "standard_value", "standard_units")
    return rounded(out, "nano_value").select("source_index", "original_standard_units", "standard_units", "nano_value")


@query("to_number", "SELECT source_index, round(TRY_CAST(standard_value AS DOUBLE), 6) + 0.0 AS x FROM records")
def _(t):
    return t.records.select("source_index", r(fn.to_number("standard_value")).alias("x"))


NEG_LOG = """
WITH s AS (SELECT *, TRY_CAST(standard_value AS DOUBLE) AS num, TRY_CAST(standard_value AS DOUBLE) * {factor} AS nano
           FROM records)
SELECT source_index, round(CASE WHEN standard_type = 'IC50' AND nano > 0 THEN -log10(nano * 1e-9)
    WHEN standard_type = 'Log IC50' THEN -num WHEN standard_type = 'pIC50' THEN num
    WHEN standard_type = 'Log IC50(nM)' THEN 9 - num ELSE {default} END, 5) + 0.0 AS target FROM s"""


@query("neg_log_transform", NEG_LOG.format(factor=FACTOR, default="NULL"))
def _(t):
    rows = cur.normalize_units(t.records, "standard_value", "standard_units")
    out = cur.neg_log_transform(rows, "standard_type", "standard_value", "nano_value")
    return out.select("source_index", (F.col("target") + 0.0).alias("target"))


@query("neg_log_transform_default_zero", NEG_LOG.format(factor=FACTOR, default="0"))
def _(t):
    rows = cur.normalize_units(t.records, "standard_value", "standard_units")
    out = cur.neg_log_transform(rows, "standard_type", "standard_value", "nano_value", default=0.0)
    return out.select("source_index", (F.col("target") + 0.0).alias("target"))


NONFINITE = """
SELECT source_index, CASE WHEN isfinite(x) THEN round(x, 6) ELSE x END AS x FROM (SELECT source_index, CASE WHEN x < 7.2 THEN 'nan'::DOUBLE WHEN x > 9 THEN 'inf'::DOUBLE
    WHEN key IS NOT NULL THEN x END AS x FROM measures) s"""


def _nonfinite(t):
    x = F.when(F.col("x") < 7.2, float("nan")).when(F.col("x") > 9, float("inf")).when(F.col("key").isNotNull(), F.col("x"))
    return t.measures.select("source_index", "kind", F.when(fn.is_finite(x), F.round(x, 6)).otherwise(x).alias("x"))


@query("drop_nonfinite", NONFINITE + " WHERE isfinite(x)")
def _(t):
    return cur.drop_nonfinite(_nonfinite(t), "x").select("source_index", "x")


@query("round_value", "SELECT event_id, round(-log10(value * 1e-9), 5) + 0.0 AS x FROM events")
def _(t):
    return t.events.select("event_id", fn.round_value(-F.log10(F.col("value") * 1e-9)).alias("x"))


@query("filter_censored", "SELECT source_index, standard_relation FROM records WHERE standard_relation = '='")
def _(t):
    return cur.filter_censored(t.records, "standard_relation").select("source_index", "standard_relation")


@query("filter_range", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_extendedprice > 0 AND l_extendedprice <= 10000""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return cur.filter_range(rows, "l_extendedprice")


@query("sanitize_name", """
SELECT doc_id, regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}\\p{M}_]+', '_', 'g'), '^_+|_+$', '', 'g') AS name
FROM documents""")
def _(t):
    return t.documents.select("doc_id", fn.sanitize_name("text").alias("name"))


@query("null_label", "SELECT source_index, coalesce(standard_units, '<NULL>') AS unit FROM records")
def _(t):
    return t.records.select("source_index", fn.null_label("standard_units").alias("unit"))


@query("fill_group", "SELECT source_index, coalesce(key, '__NO_SCAFFOLD__') AS grp FROM measures")
def _(t):
    return t.measures.select("source_index", fn.fill_group("key").alias("grp"))


@query("one_hot", """
SELECT source_index, CASE WHEN standard_units = 'nM' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "unit_nm",
       CASE WHEN standard_units = '10''6pM' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "unit_10'6pm" FROM records""")
def _(t):
    return t.records.select("source_index", *fn.one_hot("standard_units", ["nM", "10'6pM"], "unit"))


@query("clip_shift", """
SELECT l_orderkey, l_linenumber, l_partkey, greatest(least(CAST(l_quantity AS INT) - 25, 5), -5) + 5 AS code FROM lineitem""")
def _(t):
    low, high, shift = fixed.VERTEX_RANGES["formal_charge"]
    code = fn.clip_shift(F.col("l_quantity").cast("int") - 25, low, high, shift)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", code.alias("code"))


@query("partition_rejects", """
SELECT source_index, CASE WHEN canonical_smiles IS NULL OR trim(canonical_smiles) = '' THEN 'missing structure'
    WHEN TRY_CAST(standard_value AS DOUBLE) IS NULL THEN 'invalid value' END AS reason
FROM records WHERE canonical_smiles IS NULL OR TRY_CAST(standard_value AS DOUBLE) IS NULL""")
def _(t):
    gone = F.col("canonical_smiles").isNull() | (F.trim("canonical_smiles") == "")
    return cur.partition_rejects(t.records, {
        "missing structure": gone, "invalid value": ~fn.is_finite(fn.to_number("standard_value")),
    }, minimum=fixed.MIN_RECORDS)[1]


@query("partition_rejects_usable", """
SELECT source_index FROM records WHERE canonical_smiles IS NOT NULL AND TRY_CAST(standard_value AS DOUBLE) IS NOT NULL""")
def _(t):
    return cur.partition_rejects(t.records, {
        "missing structure": F.col("canonical_smiles").isNull(),
        "invalid value": ~fn.is_finite(fn.to_number("standard_value")),
    })[0].select("source_index")


@query("is_close", """
SELECT source_index, abs(round(x, 4) - x) <= 1e-8 + 1e-5 * abs(x) AS near,
       CASE WHEN key IS NULL THEN true ELSE abs(round(x, 4) - x) <= 1e-8 + 1e-5 * abs(x) END AS near_or_both_null FROM measures""")
def _(t):
    some = F.when(F.col("key").isNotNull(), F.col("x"))
    return t.measures.select(
        "source_index", fn.is_close(F.round("x", 4), "x").alias("near"),
        fn.is_close(F.round(some, 4), some, equal_nan=True).alias("near_or_both_null"),
    )


# --- replicates --------------------------------------------------------------------------------

MAD = """
WITH m AS (SELECT *, median(x) OVER (PARTITION BY key) AS med FROM measures WHERE key IS NOT NULL),
d AS (SELECT *, median(abs(x - med)) OVER (PARTITION BY key) AS mad FROM m)"""


@query("with_replicate_mad", MAD + """
SELECT m.source_index, round(d.med, 6) AS median, round(abs(d.x - d.med), 6) AS deviation, round(d.mad, 6) AS mad
FROM measures m LEFT JOIN d ON m.source_index = d.source_index""")
def _(t):
    out = con.with_replicate_mad(t.measures.select("source_index", "key", "x"), "key", "x")
    return rounded(out, "median", "deviation", "mad").select("source_index", "median", "deviation", "mad")


@query("replicate_filter", MAD + " SELECT source_index, key, round(med, 6) AS x FROM d WHERE mad <= 0.3")
def _(t):
    return rounded(con.replicate_filter(t.measures.select("source_index", "key", "x"), "key", "x", 0.3), "x")


CONSENSUS = MAD + """
SELECT source_index, key, kind, round(med, 6) AS x, raw FROM d WHERE mad <= 0.3
QUALIFY row_number() OVER (PARTITION BY key ORDER BY source_index) = 1"""


@query("replicate_consensus", CONSENSUS)
def _(t):
    return rounded(con.replicate_consensus(t.measures, "key", "x", "source_index", 0.3), "x")


@query("replicate_consensus_heavy_keys", CONSENSUS)
def _(t):
    return rounded(con.replicate_consensus(t.measures, "key", "x", "source_index", 0.3), "x")


@query("keep_first", """
SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    return con.keep_first(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("exact_dedup", """
SELECT min(doc_id) AS doc_id, lang, md5(text) AS digest FROM documents GROUP BY lang, text""")
def _(t):
    out = con.exact_dedup(t.documents.select("doc_id", "lang", "text"), ["lang", "text"], ["doc_id"])
    return out.select("doc_id", "lang", F.md5("text").alias("digest"))


@query("representative_row", """
SELECT source_index, kind, x FROM measures
QUALIFY row_number() OVER (PARTITION BY kind ORDER BY (x > 9) DESC, source_index) = 1""")
def _(t):
    return con.representative_row(t.measures.select("source_index", "kind", "x"), "kind", F.col("x") > 9)


# --- full curation -----------------------------------------------------------------------------


@query("curate_production", "WITH " + PRODUCTION.strip() + """
SELECT source_index, cleaned_smiles, "InChIkey", round(m, 6) AS "PIC50", round("IC50_nM", 6) AS "IC50_nM",
       standard_units AS original_standard_units FROM final""")
def _(t):
    return rounded(plan.curate(t.records), "PIC50", "IC50_nM").select(
        "source_index", "cleaned_smiles", "InChIkey", "PIC50", "IC50_nM", "original_standard_units")


@query("curate_audit", "WITH " + AUDIT.strip() + """
SELECT source_index, cleaned_smiles, "InChIkey", round("PIC50", 6) AS "PIC50", round("IC50_nM", 6) AS "IC50_nM",
       standard_units AS original_standard_units FROM final""")
def _(t):
    return rounded(plan.curate(t.records, "audit"), "PIC50", "IC50_nM").select(
        "source_index", "cleaned_smiles", "InChIkey", "PIC50", "IC50_nM", "original_standard_units")


