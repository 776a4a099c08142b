"""Queries for text features, imputation, scaling, selection and feature audits."""

from pyspark.sql import functions as F

from mensura.operators import features as ft
from mensura.operators import stats as st
from mensura.plans.reduction import reduce_features
from mensura.registry.core import query, r, rounded

WIDTH = 64
DIMS = [f"d{i}" for i in range(WIDTH)]


def wide(t, null_from=None):
    """Embeddings as 64 columns with a hash split; a column may get nulls where its value is above a bound."""
    rows = t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(DIMS)])
    rows = rows.withColumn("split", F.when(F.col("label") < 8, "train").otherwise("test"))
    if null_from is not None:
        rows = rows.withColumns({c: F.when(F.col(c) < null_from, F.col(c)) for c in DIMS[:4]})
    return rows


LONG = """
long AS (SELECT vec_id, label, CASE WHEN label < 8 THEN 'train' ELSE 'test' END AS split, 'd' || CAST(i AS VARCHAR) AS feature, i,
                CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(i))"""
NULLED = LONG + """,
holes AS (SELECT vec_id, split, feature, i, CASE WHEN i >= 4 OR x < 0.1::DOUBLE THEN x END AS x FROM long),
means AS (SELECT feature, coalesce(avg(x) FILTER (WHERE split = 'train'), 0) AS m FROM holes GROUP BY feature),
filled AS (SELECT vec_id, split, h.feature, i, coalesce(x, m) AS x FROM holes h JOIN means ON h.feature = means.feature)"""


def narrow(df):
    return rounded(df.select("vec_id", *DIMS).unpivot("vec_id", DIMS, "feature", "x"), "x")


@query("token_fingerprint", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda s: s <> '') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
b AS (SELECT doc_id, list_sort(list_distinct(list_transform(g, lambda s: ('0x' || substr(md5(s), 1, 8))::BIGINT % 1024))) AS b FROM g)
SELECT doc_id, array_to_string(b, ',') AS bits FROM b""")
def _(t):
    marked = ft.token_fingerprint(t.documents.select("doc_id", "text"), "text", 2)
    return marked.select("doc_id", F.array_join("bits", ",").alias("bits"))


NOTATION = ("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', "
            "'CCCNOcnocSPFB()=1234[]+-HNCCCNOcnocSPFB()=1234[]+-HN')")


@query("notation_descriptors", f"""
WITH s AS (SELECT doc_id, {NOTATION} AS s FROM documents),
a AS (SELECT doc_id, s, regexp_extract_all(s, '\\[[^\\[\\]]*\\]|Br|Cl|[BCNOPSFIbcnops]') AS atoms FROM s),
e AS (SELECT doc_id, s, list_filter(list_transform(atoms, lambda x: regexp_extract(x, '^\\[?[0-9]*([A-Z][a-z]?|[a-z][a-z]?|\\*)', 1)),
             lambda y: y NOT IN ('H', 'D', 'T', '')) AS e,
      list_transform(regexp_extract_all(s, '\\[[^\\[\\]]*\\]'), lambda x: regexp_extract(x, '([+-]+[0-9]*)\\]$', 1)) AS signs FROM a),
c AS (SELECT doc_id, s, e, list_transform(signs, lambda g: CASE WHEN g = '' THEN 0 ELSE (CASE WHEN g LIKE '-%' THEN -1 ELSE 1 END) *
      (CASE WHEN regexp_extract(g, '([0-9]+)', 1) <> '' THEN TRY_CAST(regexp_extract(g, '([0-9]+)', 1) AS INTEGER) ELSE length(g) END) END) AS ch FROM e)
SELECT doc_id, CAST(len(e) AS BIGINT) AS heavy_atoms, CAST(len(list_filter(e, lambda y: y NOT IN ('C', 'c'))) AS BIGINT) AS heteroatoms,
       CAST(len(list_filter(e, lambda y: y = 'N')) AS BIGINT) AS aliphatic_nitrogens,
       CAST(floor(len(regexp_extract_all(regexp_replace(s, '\\[[^\\[\\]]*\\]', ' ', 'g'), '%[0-9][0-9]|[0-9]')) / 2) AS BIGINT) AS ring_closures,
       CAST(coalesce(list_sum(list_transform(ch, lambda v: coalesce(v, 0))), 0) AS BIGINT) AS formal_charge FROM c""")
def _(t):
    rows = t.documents.select("doc_id", F.expr(NOTATION).alias("s"))
    return rows.select("doc_id", *[c.cast("bigint").alias(n) for n, c in ft.notation_descriptors("s").items()])


@query("strip_components", """
SELECT o_orderkey, array_to_string(list_filter(string_split(o_orderstatus || '.' || o_orderpriority || '.' || CAST(o_custkey % 10 AS VARCHAR), '.'),
       lambda p: p NOT IN ('O', '5-LOW', '3')), '.') AS kept FROM orders""")
def _(t):
    text = F.concat_ws(".", "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 10).cast("string"))
    return t.orders.select("o_orderkey", ft.strip_components(text, ["O", "5-LOW", "3"]).alias("kept"))


@query("notation_key", "SELECT doc_id, upper(md5(text)) AS key FROM documents WHERE trim(text) <> ''")
def _(t):
    from mensura.functions.columns import notation_key
    return t.documents.select("doc_id", notation_key("text").alias("key")).filter(F.col("key").isNotNull())


@query("impute_train_mean", f"WITH {NULLED} SELECT vec_id, feature, round(x, 6) + 0.0 AS x FROM filled")
def _(t):
    return narrow(ft.impute_train_mean(wide(t, 0.1), DIMS))


@query("imputed_counts", f"WITH {NULLED} SELECT split, feature, count(*) FILTER (WHERE x IS NULL) AS imputed FROM holes GROUP BY split, feature")
def _(t):
    return ft.imputed_counts(wide(t, 0.1), DIMS)


SCALED = NULLED + """,
scale AS (SELECT feature, avg(x) FILTER (WHERE split = 'train') AS m, stddev_pop(x) FILTER (WHERE split = 'train') AS s FROM filled GROUP BY feature)"""


@query("scale_train", f"""
WITH {SCALED} SELECT vec_id, f.feature, round((x - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 6) + 0.0 AS x
FROM filled f JOIN scale ON f.feature = scale.feature""")
def _(t):
    return narrow(ft.scale_train(wide(t, 0.1), DIMS))


@query("unscale", "SELECT event_id, round(value, 6) + 0.0 AS back FROM events")
def _(t):
    rows = t.events.select("event_id", "value", F.lit("train").alias("split"))
    scaled = ft.scale_train(rows, ["value"]).withColumnRenamed("value", "back")
    return rounded(ft.unscale(scaled, "back", rows, "value"), "back").select("event_id", "back")


VARIANCE = f"WITH {LONG} SELECT feature, round(var_pop(x), 8) AS variance, var_pop(x) > 0.0156 AS kept FROM long WHERE split = 'train' GROUP BY feature"


@query("variance_filter", VARIANCE)
def _(t):
    return rounded(ft.variance_filter(wide(t), DIMS, 0.0156), "variance", digits=8)


TOKENS = """
w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda s: s <> '') AS w FROM documents),
g AS (SELECT doc_id, lang, list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
b AS (SELECT doc_id, lang, list_sort(list_distinct(list_transform(g, lambda s: ('0x' || substr(md5(s), 1, 8))::BIGINT % 256))) AS b FROM g)"""


def _bits(t):
    return ft.token_fingerprint(t.documents.select("doc_id", "lang", "text"), "text", 2, 256).drop("text")


@query("bit_variance_filter", f"""
WITH {TOKENS}, n AS (SELECT count(*) AS n FROM b WHERE lang <> 'de'),
o AS (SELECT CAST(unnest(b) AS INTEGER) AS bit FROM b WHERE lang <> 'de'), c AS (SELECT bit, count(*) AS c FROM o GROUP BY bit)
SELECT bit, round(c::DOUBLE / n * (1 - c::DOUBLE / n), 8) AS variance, c::DOUBLE / n * (1 - c::DOUBLE / n) > 0.24 AS kept FROM c, n""")
def _(t):
    rows = _bits(t).withColumn("split", F.when(F.col("lang") == "de", "test").otherwise("train"))
    return rounded(ft.bit_variance_filter(rows, "bits", 0.24), "variance", digits=8)


@query("correlation_filter", f"""
WITH {LONG}, p AS (SELECT b.feature, max(abs(c)) AS highest FROM (
    SELECT a.i AS ia, b.feature, b.i AS ib, corr(a.x, b.x) AS c FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.i < b.i
    WHERE a.split = 'train' GROUP BY a.i, b.feature, b.i) b GROUP BY b.feature)
SELECT f.feature, round(highest, 6) AS highest, coalesce(highest <= 0.11, true) AS kept
FROM (SELECT DISTINCT feature FROM long) f LEFT JOIN p ON f.feature = p.feature""")
def _(t):
    return rounded(ft.correlation_filter(wide(t), DIMS, 0.11), "highest")


@query("feature_reduction", f"""
WITH {LONG}, v AS (SELECT feature, i FROM long WHERE split = 'train' GROUP BY feature, i HAVING var_pop(x) > 0.0156),
k AS (SELECT l.* FROM long l JOIN v ON l.feature = v.feature WHERE l.split = 'train'),
p AS (SELECT feature, max(abs(c)) AS highest FROM (
    SELECT b.feature, corr(a.x, b.x) AS c FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.feature) c GROUP BY feature)
SELECT f.feature, CAST(f.i AS INTEGER) AS place, CASE WHEN v.feature IS NULL THEN 'variance' WHEN highest > 0.11 THEN 'correlation' END AS dropped_by
FROM (SELECT DISTINCT feature, i FROM long) f LEFT JOIN v ON f.feature = v.feature LEFT JOIN p ON f.feature = p.feature""")
def _(t):
    """The last step, by forest importance, is not SQL's: what it drops counts as left here."""
    _, report = reduce_features(wide(t), DIMS, "label", variance_min=0.0156, correlation_max=0.11, trees=10)
    return report.withColumn("dropped_by", F.when(F.col("dropped_by") != "importance", F.col("dropped_by")))


@query("attach_selected", f"""
WITH {LONG}, v AS (SELECT feature FROM long WHERE split = 'train' GROUP BY feature HAVING var_pop(x) > 0.0156)
SELECT e.vec_id, e.label, CASE WHEN e.label = 3 THEN '__NO_SCAFFOLD__' ELSE 'g' || CAST(e.label AS VARCHAR) END AS grp,
       (SELECT count(*) FROM v) AS selected, round(s.total, 6) + 0.0 AS total
FROM embeddings e JOIN (SELECT vec_id, sum(x) AS total FROM long WHERE feature IN (SELECT feature FROM v) GROUP BY vec_id) s ON e.vec_id = s.vec_id""")
def _(t):
    rows = wide(t)
    names = ft.kept_features(ft.variance_filter(rows, DIMS, 0.0156), DIMS)
    base = t.embeddings.select("vec_id", "label", F.when(F.col("label") != 3, F.concat(F.lit("g"), F.col("label").cast("string"))).alias("grp"))
    out = ft.attach_selected(base, rows.select("vec_id", *names), "grp", "vec_id")
    total = sum((F.col(c) for c in names), F.lit(0.0))
    return out.select("vec_id", "label", "grp", F.lit(len(names)).cast("bigint").alias("selected"), r(total).alias("total"))


@query("feature_sanity", f"""
WITH {LONG} SELECT feature, count(*) AS count, 0::BIGINT AS missing, 0::BIGINT AS nonfinite, round(min(x), 6) AS min, round(max(x), 6) AS max,
    round(avg(x), 6) + 0.0 AS mean, round(median(x), 6) + 0.0 AS median, round(stddev_samp(x), 6) AS std, round(var_pop(x), 6) AS variance,
    var_pop(x) = 0 AS zero_variance, var_pop(x) < 1e-8 AS near_zero_variance, max(abs(x)) >= 1e6 AS huge_magnitude FROM long GROUP BY feature""")
def _(t):
    table = st.feature_sanity(st.long_features(wide(t), "vec_id", DIMS))
    return rounded(table, "min", "max", "mean", "median", "std", "variance")


@query("describe_columns", f"""
WITH {LONG} SELECT feature, count(*) AS count, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min,
    round(quantile_cont(x, 0.25), 6) + 0.0 AS p25, round(quantile_cont(x, 0.5), 6) + 0.0 AS p50, round(quantile_cont(x, 0.75), 6) + 0.0 AS p75,
    round(max(x), 6) AS max FROM long GROUP BY feature""")
def _(t):
    table = st.describe_columns(st.long_features(wide(t), "vec_id", DIMS))
    return rounded(table, "mean", "std", "min", "p25", "p50", "p75", "max")


@query("bit_sanity", f"""
WITH {TOKENS}, n AS (SELECT count(*) AS n FROM b), c AS (SELECT bit, count(*) AS c FROM (SELECT unnest(b) AS bit FROM b) o GROUP BY bit),
k AS (SELECT CAST(i AS INTEGER) AS bit, coalesce(c, 0) AS c, n FROM range(256) r(i) LEFT JOIN c ON i = c.bit CROSS JOIN n)
SELECT bit, c AS "on", round(c::DOUBLE / n, 6) AS mean, CASE WHEN c * 2 > n THEN 1.0 WHEN c * 2 = n THEN 0.5 ELSE 0.0 END::DOUBLE AS median,
       round(c::DOUBLE / n * (1 - c::DOUBLE / n), 6) AS variance, round(sqrt(c::DOUBLE / n * (1 - c::DOUBLE / n) * n / (n - 1)), 6) AS std,
       c = 0 OR c = n AS zero_variance FROM k""")
def _(t):
    return rounded(st.bit_sanity(_bits(t), "bits", 256), "mean", "variance", "std")


@query("fingerprint_stats", f"""
WITH {TOKENS}, u AS (SELECT array_to_string(b, ',') AS k, count(*) AS n, min(len(b)) AS o FROM b GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS fingerprints, count(*) AS unique_fingerprints, CAST(sum(n - 1) AS BIGINT) AS duplicate_excess,
       CAST(coalesce(sum(n) FILTER (WHERE o = 0), 0) AS BIGINT) AS all_zero, round(sum(n * o)::DOUBLE / sum(n), 6) AS mean_active,
       CAST(min(o) AS INTEGER) AS min_active, CAST(max(o) AS INTEGER) AS max_active FROM u""")
def _(t):
    return rounded(st.fingerprint_stats(_bits(t), "bits"), "mean_active")


@query("leakage_audit", """
SELECT 'value' AS feature, false AS is_identifier, false AS target_like_name, true AS equals_target
UNION ALL SELECT 'record_id', true, false, (SELECT bool_and(CAST(event_id AS DOUBLE) = value) FROM events)
UNION ALL SELECT 'activity_rank', false, true, (SELECT bool_and(CAST(user_id AS DOUBLE) = value) FROM events)""")
def _(t):
    rows = t.events.select("value", F.col("event_id").alias("record_id"), F.col("user_id").alias("activity_rank"))
    return st.leakage_audit(rows, ["value", "record_id", "activity_rank"], "value")
