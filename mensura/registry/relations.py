"""Queries for joins, guards and set operations."""

from pyspark.sql import functions as F

from mensura.operators import joins as jn
from mensura.registry.core import query


@query("lookup_join", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, p_brand, p_size
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey"), "l_extendedprice")
    return jn.lookup_join(rows, t.part.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", ["p_brand", "p_size"])


@query("lookup_map", """
SELECT event_id, CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN 100.0::DOUBLE END AS factor FROM events""")
def _(t):
    return jn.lookup_map(t.events.select("event_id", "event_type"), "event_type", {"click": 1.0, "view": 100.0}, "factor").drop("event_type")


ATTACH = """
SELECT o_orderkey, o_custkey, o_totalprice, count(*) OVER (PARTITION BY o_custkey) AS orders_of_customer,
       max(o_totalprice) OVER (PARTITION BY o_custkey) AS largest FROM orders"""


def _attach(t, **kw):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return jn.attach_group_stats(rows, ["o_custkey"], [
        F.count(F.lit(1)).alias("orders_of_customer"), F.max("o_totalprice").alias("largest")], **kw)


@query("attach_group_stats", ATTACH)
def _(t):
    return _attach(t)


@query("attach_group_stats_heavy_keys", ATTACH)
def _(t):
    return _attach(t)


@query("align_features", """
SELECT d.doc_id, d.n_chars, l.quality, l.toxic, length(d.lang) AS lang_chars
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def _(t):
    blocks = [t.documents.select("doc_id", "n_chars"), t.labels, t.documents.select("doc_id", F.length("lang").cast("bigint").alias("lang_chars"))]
    return jn.align_features(blocks, "doc_id")


@query("join_one_to_one", """
SELECT d.doc_id, d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(t):
    return jn.join_one_to_one(t.documents.select("doc_id", "n_chars"), t.labels.select("doc_id", "quality"), ["doc_id"])


@query("select_by_ids", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _(t):
    ids = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return jn.select_by_ids(t.customer.select("c_custkey", "c_name"), ids, "c_custkey")


@query("exclusive_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity <= 30 AS kept_by_a FROM lineitem
WHERE (l_quantity <= 30) <> (l_extendedprice <= 30000)""")
def _(t):
    out = jn.exclusive_rows(t.lineitem, F.col("l_quantity") <= 30, F.col("l_extendedprice") <= 30000)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "kept_by_a")


@query("split_overlap", """
SELECT l_partkey, string_agg(f, '|' ORDER BY f) AS splits FROM (SELECT DISTINCT l_partkey, l_returnflag AS f FROM lineitem) s
GROUP BY l_partkey HAVING count(*) > 1""")
def _(t):
    return jn.split_overlap(t.lineitem, "l_returnflag", "l_partkey")


@query("split_overlap_counts", """
SELECT 'text' AS key_column, count(*) AS shared FROM (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT lang) > 1) a
UNION ALL SELECT 'source', count(*) FROM (SELECT source FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1) b""")
def _(t):
    return jn.split_overlap_counts(t.documents, "lang", ["text", "source"])


@query("same_id_set", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left only' ELSE 'right only' END AS side
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def _(t):
    return jn.same_id_set(t.documents, t.labels, "doc_id")


@query("union_runs", """
SELECT 'customer' AS model, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def _(t):
    return jn.union_runs({
        "customer": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        "supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")),
    })


@query("shared_values", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(t):
    return jn.shared_values(t.customer.select(F.col("c_nationkey").alias("nation")),
                            t.supplier.select(F.col("s_nationkey").alias("nation")), "nation")


@query("distinct_values", "SELECT DISTINCT standard_units, standard_relation FROM records")
def _(t):
    return jn.distinct_values(t.records, ["standard_units", "standard_relation"])


@query("missing_values", "SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40")
def _(t):
    used = t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40))
    return jn.missing_values(t.part.select(F.col("p_partkey").alias("id")), used.select(F.col("l_partkey").alias("id")), "id")


