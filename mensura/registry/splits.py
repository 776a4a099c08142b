"""Queries for group splits, folds, row splits, early stopping and ranks."""

from pyspark.sql import functions as F

from mensura.operators import ranking as rk
from mensura.operators import splits as sp
from mensura.operators import stats as st
from mensura.registry.core import query, r, rounded

GROUPS = """
g AS (SELECT p_partkey, p_brand || '/' || CAST(p_size AS VARCHAR) AS grp FROM part),
s AS (SELECT grp, count(*) AS size FROM g GROUP BY grp),
o AS (SELECT grp, size, coalesce(sum(size) OVER (ORDER BY size DESC, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             row_number() OVER (ORDER BY size DESC, grp) - 1 AS place, sum(size) OVER () AS total FROM s)"""
GROUP_SPLIT = f"""
WITH {GROUPS}
SELECT p_partkey, g.grp, size AS group_size, CASE WHEN before < floor(0.8::DOUBLE * total) THEN 'train' ELSE 'test' END AS split
FROM g JOIN o ON g.grp = o.grp"""


def parts(t):
    return t.part.select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("grp"))


@query("group_split", GROUP_SPLIT)
def _(t):
    return sp.group_split(parts(t), "grp").select("p_partkey", "grp", "group_size", "split")


@query("group_split_heavy_keys", GROUP_SPLIT)
def _(t):
    return sp.group_split(parts(t), "grp").select("p_partkey", "grp", "group_size", "split")


@query("group_split_customers", """
WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey),
o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY size DESC, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(size) OVER () AS total FROM s)
SELECT CASE WHEN before < floor(0.8::DOUBLE * total) THEN 'train' ELSE 'test' END AS split, count(*) AS groups,
       CAST(sum(size) AS BIGINT) AS rows FROM o GROUP BY 1""")
def _(t):
    table = sp.split_groups(t.orders, "o_custkey")
    return table.groupBy("split").agg(F.count(F.lit(1)).alias("groups"), F.sum("group_size").alias("rows"))


@query("seeded_group_holdout", f"""
WITH {GROUPS},
h AS (SELECT grp, size, total, coalesce(sum(size) OVER (ORDER BY md5('50:' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
             row_number() OVER (ORDER BY md5('50:' || grp), grp) AS n, count(*) OVER () AS groups FROM o)
SELECT p_partkey, g.grp, CASE WHEN b < greatest(1, floor(total * 0.15::DOUBLE)) AND n < groups THEN 'validation' ELSE 'train' END AS split
FROM g JOIN h ON g.grp = h.grp""")
def _(t):
    return sp.seeded_group_holdout(parts(t), "grp")


@query("grouped_kfold", f"""
WITH RECURSIVE {GROUPS},
m AS MATERIALIZED (SELECT grp, size, place FROM o),
r AS (SELECT CAST(0 AS BIGINT) AS n, [0::BIGINT, 0, 0] AS loads, CAST(NULL AS INTEGER) AS fold
      UNION ALL SELECT n + 1, list_transform(loads, lambda l, i: CASE WHEN i = f THEN l + size ELSE l END), f - 1
      FROM (SELECT n, loads, size, CAST(list_position(loads, list_min(loads)) AS INTEGER) AS f FROM r JOIN m ON m.place = r.n))
SELECT p_partkey, g.grp, fold FROM g JOIN m ON g.grp = m.grp JOIN r ON r.n = m.place + 1""")
def _(t):
    return sp.grouped_kfold(parts(t), "grp", 3)


@query("random_split", """
SELECT event_id, CASE WHEN ('0x' || substr(md5('50:' || CAST(event_id AS VARCHAR)), 1, 6))::BIGINT < 3355443 THEN 'test' ELSE 'train' END AS split
FROM events""")
def _(t):
    return sp.random_split(t.events.select("event_id"), "event_id")


@query("group_size_summary", f"""
WITH {GROUPS},
a AS (SELECT p_partkey, g.grp, size, CASE WHEN before < floor(0.8::DOUBLE * total) THEN 'train' ELSE 'test' END AS split, total
      FROM g JOIN o ON g.grp = o.grp)
SELECT split, count(DISTINCT grp) AS groups, count(*) AS rows, max(size) AS largest, round(avg(size), 6) AS mean_size,
       CAST(median(size) AS DOUBLE) AS median_size, round(count(*)::DOUBLE / max(total), 6) AS fraction FROM a GROUP BY split
UNION ALL SELECT 'all groups', count(*), CAST(sum(size) AS BIGINT), max(size), round(avg(size), 6), CAST(median(size) AS DOUBLE), 1.0 FROM s""")
def _(t):
    rows = sp.group_split(parts(t), "grp")
    return rounded(st.group_size_summary(rows, "grp", "split"), "mean_size", "median_size", "fraction")


@query("top_share", """
WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey),
o AS (SELECT size, row_number() OVER (ORDER BY size DESC) AS n, count(*) OVER () AS groups, sum(size) OVER () AS total FROM s)
SELECT round(sum(size) FILTER (WHERE n <= greatest(1, ceil(groups * 1 / 100)))::DOUBLE / max(total), 6) AS top_1_percent,
       round(sum(size) FILTER (WHERE n <= greatest(1, ceil(groups * 5 / 100)))::DOUBLE / max(total), 6) AS top_5_percent,
       round(sum(size) FILTER (WHERE n <= greatest(1, ceil(groups * 10 / 100)))::DOUBLE / max(total), 6) AS top_10_percent FROM o""")
def _(t):
    return rounded(st.top_share(t.orders, "o_custkey"), "top_1_percent", "top_5_percent", "top_10_percent")


@query("group_sizes", "SELECT l_suppkey, count(*) AS size FROM lineitem GROUP BY l_suppkey")
def _(t):
    return st.group_sizes(t.lineitem, "l_suppkey")


@query("early_stopping", """
WITH h AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n,
                  min(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM history),
i AS (SELECT *, best_before IS NULL OR metric < best_before AS improved FROM h),
s AS (SELECT *, n - max(CASE WHEN improved THEN n END) OVER (PARTITION BY run ORDER BY epoch) AS stale FROM i),
e AS (SELECT run, coalesce(min(epoch) FILTER (WHERE stale >= 6), max(epoch)) AS stop_epoch, bool_or(stale >= 6) AS stopped_early FROM s GROUP BY run)
SELECT s.run, max(s.epoch) FILTER (WHERE s.improved) AS best_epoch, min(s.metric) AS best_value, e.stop_epoch, e.stopped_early
FROM s JOIN e ON s.run = e.run WHERE s.epoch <= e.stop_epoch GROUP BY s.run, e.stop_epoch, e.stopped_early""")
def _(t):
    return rk.early_stopping(t.history, "run", "epoch", "metric", 6)


RANK = """
SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS rank FROM events"""


@query("average_rank", RANK)
def _(t):
    return rk.average_rank(t.events.select("event_id", "value"), "value").select("event_id", r("rank").alias("rank"))


@query("average_rank_by_group", """
SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY value)
       + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS rank FROM events""")
def _(t):
    out = rk.average_rank(t.events.select("event_id", "event_type", "value"), "value", ["event_type"])
    return out.select("event_id", "event_type", r("rank").alias("rank"))
