"""Queries for statistics and audit tables."""

from pyspark.sql import functions as F

from mensura import fixed_values as fixed
from mensura.functions import columns as fn
from mensura.operators import stats as st
from mensura.plans import curation as plan
from mensura.registry.core import query, rounded
from mensura.registry.curation import AUDIT, FACTOR, MAD, NONFINITE, UNITS, VALID, _nonfinite, converted_ctes

NUMBER = """count(*) FILTER (WHERE isfinite({x})) AS {p}count, count(*) FILTER (WHERE {x} IS NULL OR isnan({x})) AS {p}missing,
    count(*) FILTER (WHERE isinf({x})) AS {p}nonfinite, round(min({x}) FILTER (WHERE isfinite({x})), 6) AS {p}min,
    round(max({x}) FILTER (WHERE isfinite({x})), 6) AS {p}max, round(avg({x}) FILTER (WHERE isfinite({x})), 6) AS {p}mean,
    round(stddev_samp({x}) FILTER (WHERE isfinite({x})), 6) AS {p}std, round(median({x}) FILTER (WHERE isfinite({x})), 6) AS {p}median"""
MEASURES = ["min", "max", "mean", "std", "median"]


def number_sql(x, prefix=""):
    return NUMBER.format(x=x, p=prefix)


@query("number_stats", f"SELECT {number_sql('x')} FROM ({NONFINITE}) n")
def _(t):
    return rounded(st.number_stats(_nonfinite(t), "x"), *MEASURES)


BY_KIND = f"""SELECT kind, {number_sql('n.x')} FROM ({NONFINITE}) n JOIN measures m ON n.source_index = m.source_index GROUP BY kind"""


@query("number_stats_by_group", BY_KIND)
def _(t):
    return rounded(st.number_stats(_nonfinite(t), "x", ["kind"]), *MEASURES)


@query("number_stats_heavy_keys", BY_KIND)
def _(t):
    return rounded(st.number_stats(_nonfinite(t), "x", ["kind"]), *MEASURES)


TARGET_SCOPES = """
s AS (SELECT 'all' AS scope, x FROM measures UNION ALL SELECT 'named', x FROM measures WHERE key IS NOT NULL
      UNION ALL SELECT 'clicks', x FROM measures WHERE kind = 'click')"""
STATISTICS = ["count(*)", "0", "0", "min(x)", "max(x)", "avg(x)", "median(x)", "stddev_samp(x)"] + [
    f"quantile_cont(x, {q})" for q in fixed.QUANTILES]
STAT_NAMES = ["rows", "missing", "nonfinite", "min", "max", "mean", "median", "std"] + [
    f"quantile_{round(q * 100)}%" for q in fixed.QUANTILES]


TARGET = f"WITH {TARGET_SCOPES.strip()}\n" + "\nUNION ALL ".join(
    f"SELECT scope, '{n}' AS statistic, round(CAST({e} AS DOUBLE), 6) AS value FROM s GROUP BY scope"
    for n, e in zip(STAT_NAMES, STATISTICS))


def _scopes():
    return {"all": F.lit(True), "named": F.col("key").isNotNull(), "clicks": F.col("kind") == "click"}


@query("target_stats", TARGET)
def _(t):
    return rounded(st.target_stats(t.measures, "x", _scopes()), "value")


@query("target_stats_heavy_keys", TARGET)
def _(t):
    return rounded(st.target_stats(t.measures, "x", _scopes()), "value")


@query("key_counts", """
SELECT 'l_partkey' AS "column", count(DISTINCT l_partkey) AS unique_values FROM lineitem
UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem""")
def _(t):
    return st.key_counts(t.lineitem, ["l_partkey", "l_suppkey"])


def stage_sql(order, name, body, key, smiles, missing, raw="TRY_CAST(standard_value AS DOUBLE)", target="NULL::DOUBLE"):
    miss = ", ".join(
        (f"count(*) FILTER (WHERE {e} IS NULL)" if e else "NULL::BIGINT") + f" AS missing_{n}" for n, e in missing.items())
    stats = NUMBER.format(x="_v", p="standard_value_") + ", " + (
        NUMBER.format(x="_t", p="PIC50_") if target != "NULL::DOUBLE" else ", ".join(
            f"NULL::{'BIGINT' if p in ('count', 'missing', 'nonfinite') else 'DOUBLE'} AS \"PIC50_{p}\""
            for p in ("count", "missing", "nonfinite", "min", "max", "mean", "std", "median")))
    stats = stats.replace("AS PIC50_", 'AS "PIC50_').replace('_count,', '_count,')
    import re
    stats = re.sub(r'AS "?(PIC50_\w+)"?', r'AS "\1"', stats)
    return f"""SELECT {order} AS stage_order, '{name}' AS stage, count(*) AS rows_after, {miss},
        count(DISTINCT {key}) AS unique_InChIkey, count(DISTINCT {smiles}) AS unique_cleaned_smiles, {stats}
        FROM (SELECT *, {raw} AS _v, {target} AS _t FROM {body}) b"""


def lineage_sql():
    full = {"cleaned_smiles": "cleaned_smiles", "InChIkey": '"InChIkey"', "standard_units": "standard_units", "standard_value": "_v"}
    early = {"cleaned_smiles": None, "InChIkey": None, "standard_units": "standard_units", "standard_value": "_v"}
    key, smiles = '"InChIkey"', "cleaned_smiles"
    later = {"target": '"PIC50"'}
    parts = [
        stage_sql(1, "raw", "(SELECT * FROM records)", "NULL", "NULL", early),
        stage_sql(2, "valid", "valid", "NULL", "NULL", early),
        stage_sql(3, "identified", "keyed", key, smiles, full),
        stage_sql(4, "unflagged", "unflagged", key, smiles, full),
        stage_sql(5, "converted", "converted", key, smiles, full, **later),
        stage_sql(6, "consistent", "consistent", key, smiles, full, **later),
        stage_sql(7, "deduplicated", "deduplicated", key, smiles, full, **later),
        stage_sql(8, "exact", "exact", key, smiles, full, **later),
        stage_sql(9, "in range", "final", key, smiles, full, **later),
    ]
    union = "\nUNION ALL ".join(parts).replace("unique_InChIkey", '"unique_InChIkey"').replace("missing_InChIkey", '"missing_InChIkey"')
    union = union.replace('""', '"')
    return f"""WITH {AUDIT.strip()},
u AS ({union}),
b AS (SELECT *, coalesce(lag(rows_after) OVER (ORDER BY stage_order), rows_after) AS before_rows FROM u)
SELECT *, greatest(0, before_rows - rows_after) AS rows_removed,
       round(CASE WHEN before_rows = 0 THEN 0 ELSE 100.0::DOUBLE * greatest(0, before_rows - rows_after) / before_rows END, 6) AS percent_removed FROM b"""


@query("stage_lineage", lineage_sql())
def _(t):
    ledger = plan.audit_ledger(t.records)
    table = st.stage_lineage(ledger.rows, ledger.columns, ["InChIkey", "cleaned_smiles"], ["standard_value", "PIC50"],
                             ["cleaned_smiles", "InChIkey", "standard_units", "standard_value"], replaced={"PIC50": ("_median", 6)})
    names = [f"{c}_{m}" for c in ("standard_value", "PIC50") for m in MEASURES]
    return rounded(table, "percent_removed", *names)


UNIT_DIST = f"""
WITH u AS (SELECT 'raw' AS scope, coalesce(standard_units, '<NULL>') AS unit, TRY_CAST(standard_value AS DOUBLE) AS v,
                  coalesce(standard_units IN {UNITS}, false) AS supported FROM records
           UNION ALL SELECT 'unflagged', coalesce(standard_units, '<NULL>'), TRY_CAST(standard_value AS DOUBLE),
                  coalesce(standard_units IN {UNITS}, false) FROM ({VALID}) v WHERE potential_duplicate IS DISTINCT FROM 1)
SELECT scope, unit, supported, count(*) AS records, round(min(v), 6) AS value_min, round(max(v), 6) AS value_max,
       round(median(v), 6) AS value_median, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY scope), 6) AS percent
FROM u GROUP BY scope, unit, supported"""


@query("unit_distribution", UNIT_DIST)
def _(t):
    scopes = dict(plan.record_stages(t.records))
    table = st.unit_distribution({"raw": scopes["raw"], "unflagged": scopes["unflagged"]}, "standard_units", "standard_value",
                                 list(fixed.UNIT_FACTORS))
    return rounded(table, "value_min", "value_max", "value_median", "percent")


@query("relation_distribution", """
SELECT coalesce(standard_relation, '<NULL>') AS relation, count(*) AS records,
       round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent, coalesce(standard_relation = '=', false) AS retained,
       CAST(sum(CASE WHEN coalesce(standard_relation = '=', false) THEN 0 ELSE count(*) END) OVER () AS BIGINT) AS rejected_total
FROM records GROUP BY standard_relation""")
def _(t):
    return rounded(st.relation_distribution(t.records, "standard_relation"), "percent")


STATS_CTE = MAD + """,
g AS (SELECT key, count(*) AS measurements, max(med) AS median, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max,
             max(mad) AS mad, max(x) - min(x) AS range, arg_min(kind, source_index) AS label, max(mad) > 0.3 AS mad_over
      FROM d GROUP BY key)"""
REPLICATE = STATS_CTE + """
SELECT key, measurements, round(median, 6) AS median, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(mad, 6) AS mad,
       round(range, 6) AS range, label, mad_over FROM g"""


def _replicates(t, **kw):
    return st.replicate_stats(t.measures, "key", "x", "kind", mad_max=0.3, **kw)


@query("replicate_stats", REPLICATE)
def _(t):
    return rounded(_replicates(t), *MEASURES, "mad", "range")


@query("replicate_stats_heavy_keys", REPLICATE)
def _(t):
    return rounded(_replicates(t), *MEASURES, "mad", "range")


@query("replicate_count_distribution", STATS_CTE + " SELECT measurements, count(*) AS groups FROM g GROUP BY measurements")
def _(t):
    return st.replicate_count_distribution(_replicates(t))


@query("high_variability", STATS_CTE + """
SELECT key, label, measurements, round(min, 6) AS min, round(max, 6) AS max, round(median, 6) AS median, round(mad, 6) AS mad, round(range, 6) AS range
FROM g ORDER BY g.range DESC, key LIMIT 20""")
def _(t):
    return rounded(st.high_variability(_replicates(t), "key"), "min", "max", "median", "mad", "range")


@query("mad_summary", STATS_CTE + f"""
SELECT count(*) AS groups, count(*) FILTER (WHERE mad_over) AS groups_over,
       CAST(coalesce(sum(measurements) FILTER (WHERE mad_over), 0) AS BIGINT) AS measurements_over, max(measurements) AS largest_group,
       round(100.0::DOUBLE * count(*) FILTER (WHERE mad_over) / count(*), 6) AS percent_groups_over,
       round(100.0::DOUBLE * coalesce(sum(measurements) FILTER (WHERE mad_over), 0) / (SELECT count(*) FROM measures), 6) AS percent_measurements_over,
       {number_sql('mad', 'mad_')}, {number_sql('range', 'range_')} FROM g""")
def _(t):
    names = [f"{c}_{m}" for c in ("mad", "range") for m in MEASURES]
    return rounded(st.mad_summary(_replicates(t), t.measures), "percent_groups_over", "percent_measurements_over", *names)


def signature_sql():
    parts = []
    for phase, body in (("converted", "converted"), ("deduplicated", "deduplicated"), ("final", "final")):
        for name, cols in (("structure", "cleaned_smiles"), ("key", '"InChIkey"'), ("target", '"PIC50"'),
                           ("structure + target", 'cleaned_smiles, "PIC50"'), ("key + target", '"InChIkey", "PIC50"')):
            parts.append(f"""SELECT '{phase}' AS phase, '{name}' AS signature, (SELECT count(*) FROM {body}) AS rows,
                (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {body}) q) AS distinct_signatures""")
    return f"WITH {AUDIT.strip()}, u AS (" + "\nUNION ALL ".join(parts) + ") SELECT *, rows - distinct_signatures AS excess_rows FROM u"


@query("duplicate_signatures", signature_sql())
def _(t):
    stages = dict(plan.audit_stages(t.records))
    return st.duplicate_signatures(
        {"converted": stages["converted"], "deduplicated": stages["deduplicated"], "final": stages["in range"]},
        {"structure": ["cleaned_smiles"], "key": ["InChIkey"], "target": ["PIC50"],
         "structure + target": ["cleaned_smiles", "PIC50"], "key + target": ["InChIkey", "PIC50"]})


@query("identity_mappings", """
WITH p AS (SELECT DISTINCT p_name, p_type FROM part)
SELECT 'p_name_to_many_p_type' AS direction, p_name, p_type FROM p WHERE p_name IN (SELECT p_name FROM p GROUP BY p_name HAVING count(*) > 1)
UNION ALL SELECT 'p_type_to_many_p_name', p_name, p_type FROM p WHERE p_type IN (SELECT p_type FROM p GROUP BY p_type HAVING count(*) > 1)""")
def _(t):
    return st.identity_mappings(t.part, "p_name", "p_type")


@query("identity_mapping_counts", """
WITH p AS (SELECT DISTINCT key, kind FROM measures)
SELECT 'key' AS "column", count(*) AS unique_values, count(*) FILTER (WHERE n > 1) AS with_several FROM (SELECT key, count(kind) AS n FROM p WHERE key IS NOT NULL GROUP BY key) a
UNION ALL SELECT 'kind', count(*), count(*) FILTER (WHERE n > 1) FROM (SELECT kind, count(key) AS n FROM p WHERE kind IS NOT NULL GROUP BY kind) b""")
def _(t):
    return st.identity_mapping_counts(t.measures, "key", "kind")


def _ab():
    return F.col("l_extendedprice") <= 30000, F.col("l_extendedprice") * (1 - F.col("l_discount")) <= 28500


A, B = "l_extendedprice <= 30000", "l_extendedprice * (1 - l_discount) <= 28500"


@query("compare_filters_by", f"""
SELECT coalesce(l_returnflag, '<NULL>') AS l_returnflag, count(*) AS candidates, count(*) FILTER (WHERE {A}) AS retained_a,
       count(*) FILTER (WHERE {B}) AS retained_b, count(*) FILTER (WHERE {A} AND NOT ({B})) AS only_a,
       count(*) FILTER (WHERE {B} AND NOT ({A})) AS only_b, count(*) FILTER (WHERE NOT ({A}) AND {B}) AS removed_only_a,
       count(*) FILTER (WHERE NOT ({B}) AND {A}) AS removed_only_b FROM lineitem GROUP BY l_returnflag""")
def _(t):
    return st.compare_filters_by(t.lineitem, *_ab(), "l_returnflag")


def _compare(name, cond):
    return f"""SELECT '{name}' AS filter, count(*) AS retained, count(DISTINCT l_partkey) AS unique_keys, round(min(l_extendedprice), 6) AS min,
    round(max(l_extendedprice), 6) AS max, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 6) AS median,
    round(stddev_samp(l_extendedprice), 4) AS std FROM lineitem WHERE {cond}"""


@query("compare_filters", _compare("raw", A) + " UNION ALL " + _compare("discounted", B))
def _(t):
    a, b = _ab()
    table = st.compare_filters(t.lineitem, {"raw": a, "discounted": b}, "l_partkey", "l_extendedprice")
    return rounded(rounded(table, "min", "max", "median"), "mean", "std", digits=4)


@query("compare_filters_summary", f"""
SELECT count(*) AS candidates, count(*) FILTER (WHERE ({A}) <> ({B})) AS different,
       count(DISTINCT CASE WHEN ({A}) <> ({B}) THEN l_partkey END) AS unique_keys_affected,
       round(100.0::DOUBLE * count(*) FILTER (WHERE ({A}) <> ({B})) / count(*), 6) AS percent_different FROM lineitem""")
def _(t):
    return rounded(st.compare_filters_summary(t.lineitem, *_ab(), "l_partkey"), "percent_different")


@query("threshold_boundary_counts", """
SELECT count(*) FILTER (WHERE abs(l_extendedprice - 10000) <= 100) AS within_1_percent,
       count(*) FILTER (WHERE abs(l_extendedprice - 10000) <= 500) AS within_5_percent,
       count(*) FILTER (WHERE abs(l_extendedprice - 10000) <= 1000) AS within_10_percent FROM lineitem""")
def _(t):
    return st.threshold_boundary_counts(t.lineitem, "l_extendedprice", fixed.RANGE_MAX)


@query("value_sanity", f"""
SELECT count(*) FILTER (WHERE v = 0) AS zero, count(*) FILTER (WHERE v < 0) AS negative, count(*) FILTER (WHERE v < 0 OR v > 20) AS extreme,
       count(*) FILTER (WHERE v IS NULL) AS missing, 0::BIGINT AS nonfinite
FROM (SELECT TRY_CAST(standard_value AS DOUBLE) AS v FROM records) s""")
def _(t):
    return st.value_sanity(t.records.select(fn.to_number("standard_value").alias("v")), "v")


@query("dataset_hash", """
WITH h AS (SELECT md5(coalesce(length(CAST(o_orderkey AS VARCHAR)) || ':' || CAST(o_orderkey AS VARCHAR), 'null:')
                  || coalesce(length(o_orderstatus) || ':' || o_orderstatus, 'null:')
                  || coalesce(length(o_orderpriority) || ':' || o_orderpriority, 'null:')) AS h FROM orders),
s AS (SELECT count(*) AS rows, sum(('0x' || substr(h, 1, 6))::BIGINT) AS a, sum(('0x' || substr(h, 7, 6))::BIGINT) AS b,
             sum(('0x' || substr(h, 13, 6))::BIGINT) AS c, sum(('0x' || substr(h, 19, 6))::BIGINT) AS d FROM h)
SELECT rows, md5(concat_ws('-', CAST(rows AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR), CAST(c AS VARCHAR), CAST(d AS VARCHAR))) AS hash FROM s""")
def _(t):
    return st.dataset_hash(t.orders, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("unit_conversion_check", "WITH " + converted_ctes("0").strip() + f"""
, f AS (SELECT standard_units AS unit, source_index, num AS raw, "IC50_nM" AS scaled, "PIC50" AS target, {FACTOR} AS factor FROM converted
        QUALIFY row_number() OVER (PARTITION BY standard_units ORDER BY coalesce(num > 0, false) DESC, source_index) = 1),
e AS (SELECT *, raw * factor AS expected, round(CASE WHEN raw * factor > 0 THEN -log10(raw * factor * 1e-9) END, 5) AS recomputed FROM f)
SELECT unit, source_index, raw, round(scaled, 6) AS scaled, round(target, 6) AS target, factor, round(expected, 6) AS expected,
       round(recomputed, 6) AS recomputed, coalesce(abs(scaled - expected) <= 1e-8 + 1e-5 * abs(expected), scaled IS NULL AND expected IS NULL) AS scaled_matches,
       coalesce(abs(target - recomputed) <= 1e-8 + 1e-5 * abs(recomputed), false) AS target_matches FROM e""")
def _(t):
    converted = dict(plan.record_stages(t.records))["converted"]
    table = st.unit_conversion_check(converted, "original_standard_units", "standard_value", "IC50_nM", "PIC50")
    return rounded(table, "scaled", "target", "expected", "recomputed")


@query("unit_prefix_check", """
SELECT DISTINCT standard_units AS unit, CASE standard_units WHEN 'nM' THEN 1.0 WHEN '10''3pM' THEN 1.0 WHEN '10''5pM' THEN 100.0 ELSE 1000.0 END::DOUBLE AS factor,
       CASE standard_units WHEN 'nM' THEN 1.0 WHEN '10''3pM' THEN 1.0 WHEN '10''5pM' THEN 100.0 ELSE 1000.0 END::DOUBLE AS implied_factor, true AS matches
FROM records WHERE standard_units IN ('nM','10''3pM','10''5pM','10''6pM')""")
def _(t):
    return st.unit_prefix_check(t.records.select("standard_units").distinct(), "standard_units")


FINDINGS = f"""
WITH f AS (
SELECT 'WARNING' AS severity, 'null key' AS check_name, count(*) FILTER (WHERE key IS NULL) AS affected FROM measures
UNION ALL SELECT 'CRITICAL', 'nonfinite value', count(*) FILTER (WHERE NOT isfinite(x)) FROM measures
UNION ALL SELECT 'WARNING', 'rejected relation', count(*) FILTER (WHERE standard_relation IS DISTINCT FROM '=') FROM records),
v AS (SELECT CASE WHEN affected > 0 THEN severity ELSE 'PASS' END AS severity, check_name AS "check", affected,
             affected || ' rows have a ' || check_name || '.' AS message,
             CASE WHEN affected > 0 THEN 'Remove or repair them.' ELSE 'No action required.' END AS recommendation FROM f)"""


def _findings(t):
    told = ("{} rows have a %s.", "Remove or repair them.")
    checks = [
        ("null key", "WARNING", t.measures.agg(F.count_if(F.col("key").isNull()).alias("n")), "n"),
        ("nonfinite value", "CRITICAL", t.measures.agg(F.count_if(~fn.is_finite("x")).alias("n")), "n"),
        ("rejected relation", "WARNING", t.records.agg(F.count_if(~F.col("standard_relation").eqNullSafe("=")).alias("n")), "n"),
    ]
    return st.findings([(name, *rest, told[0] % name, told[1]) for name, *rest in checks])


@query("findings", FINDINGS + ' SELECT severity, "check", affected, message, recommendation FROM v')
def _(t):
    return _findings(t)


@query("gate", FINDINGS + """ SELECT count(*) AS checks, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical,
    count(*) FILTER (WHERE severity = 'WARNING') AS warnings, count(*) FILTER (WHERE severity = 'CRITICAL') = 0 AS passed FROM v""")
def _(t):
    return st.gate(_findings(t))


