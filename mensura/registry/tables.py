"""Queries that read, land, look up and write tables."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from mensura.plans import ingest as plan
from mensura.registry.core import query, rounded
from mensura.session import shared_folder
from mensura.sources import records as rec
from mensura.sources import sinks
from mensura.streaming import landed


def scratch(t) -> str:
    """A new folder inside the cluster's shared checkpoint folder."""
    return f"{shared_folder(t.spark)}/run-{uuid.uuid4().hex}"


@query("select_records", "SELECT event_id, user_id, event_type, value FROM events WHERE user_id = 8 AND value IS NOT NULL AND event_type IN ('click', 'view')")
def _(t):
    return rec.select_records(t.events, "user_id", 8, "event_type", ["click", "view"], "value").select("event_id", "user_id", "event_type", "value")


@query("preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def _(t):
    return rec.preview(t.orders.select("o_orderkey", "o_totalprice"), 5, [F.desc("o_totalprice"), "o_orderkey"])


@query("register_table", """
SELECT 'view' AS kind, c_mktsegment, count(*) AS customers FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'saved', c_mktsegment, count(*) FROM customer WHERE c_custkey % 2 = 0 GROUP BY c_mktsegment""")
def _(t):
    """A session view, and a saved table that replaces one of its name."""
    name = f"saved_customer_{uuid.uuid4().hex[:12]}"
    rec.register_table(t.customer, "registered_customer")
    rec.register_table(t.customer, name, saved=True)
    rec.register_table(t.customer.filter("c_custkey % 2 = 0"), name, saved=True)
    parts = [t.spark.sql(f"SELECT '{kind}' AS kind, c_mktsegment, count(*) AS customers FROM {n} GROUP BY c_mktsegment")
             for kind, n in (("view", "registered_customer"), ("saved", name))]
    return parts[0].union(parts[1])


@query("search_entities", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_name, p_partkey LIMIT 10")
def _(t):
    return rec.search_entities(t.part.select("p_partkey", "p_name"), "p_name", " Ring ", 10, ["p_partkey"])


@query("select_entity", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, trim(regexp_replace(customer.c_name, '[^A-Za-z0-9_]+', '_', 'g'), '_') AS c_name, c_mktsegment FROM customer ORDER BY c_name, customer.c_custkey LIMIT 1 OFFSET 3""")
def _(t):
    return rec.select_entity(t.customer, 3, "c_custkey", ["c_name", "c_mktsegment"], ["c_name", "c_custkey"])


@query("read_records_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(t):
    path = scratch(t)
    sinks.write_csv(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    return rec.read_records_csv(t.spark, path).withColumns(
        {"o_orderkey": F.col("o_orderkey").cast("bigint"), "o_custkey": F.col("o_custkey").cast("bigint")})


@query("malformed_rows", """
SELECT doc_id, text, n_chars, CAST(NULL AS VARCHAR) AS line FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT NULL, NULL, NULL, CAST(doc_id AS VARCHAR) || ',bad ' || CAST(doc_id AS VARCHAR) || ',x' || CAST(n_chars AS VARCHAR) FROM documents WHERE doc_id % 7 = 0""")
def _(t):
    """Whole documents with quotes and line ends in their text, every seventh with a bad number in place of a good text."""
    path = scratch(t)
    bad = F.col("doc_id") % 7 == 0
    rows = t.documents.select("doc_id", "text", "n_chars")
    sinks.write_csv(rows.select(
        "doc_id", F.when(bad, F.concat(F.lit("bad "), F.col("doc_id").cast("string"))).otherwise(F.col("text")).alias("text"),
        F.concat(F.when(bad, "x").otherwise(""), F.col("n_chars").cast("string")).alias("n_chars")), path)
    good, lines = rec.malformed_rows(t.spark, path, rows.schema)
    return good.withColumn("line", F.lit(None).cast("string")).unionByName(lines, allowMissingColumns=True)


@query("land_records", "SELECT event_id, user_id, event_type, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS source_index FROM events")
def _(t):
    """Three files of different sizes, the smallest first: ids follow the files' names and the places in them."""
    base = scratch(t)
    rows = t.spark.read.parquet(t.path("events")).select("event_id", "user_id", "event_type")
    last = F.lit(rows.agg(F.max("event_id")).scalar())
    for name, low, high in (("a", 0.0, 0.05), ("b", 0.05, 0.8), ("c", 0.8, 1.1)):
        part = rows.filter((F.col("event_id") >= last * low) & (F.col("event_id") < last * high))
        part.coalesce(1).sortWithinPartitions("event_id").write.parquet(f"{base}/in/part={name}")
    source = t.spark.read.option("recursiveFileLookup", True).parquet(f"{base}/in")
    return rec.land_records(source, f"{base}/landed")


@query("export_parquet", "SELECT * FROM supplier")
def _(t):
    path = scratch(t)
    sinks.export_parquet(t.supplier, path)
    return t.spark.read.parquet(path)


@query("write_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(t):
    path = scratch(t)
    rows = t.documents.select("doc_id", "text", "lang", "source", "n_chars")
    sinks.write_csv(rows, path)
    return rec.read_records_csv(t.spark, path, rows.schema)


@query("json_safe", """
SELECT event_id, CASE WHEN value < 5 THEN NULL WHEN value > 100 THEN NULL ELSE value END AS x FROM events""")
def _(t):
    odd = F.when(F.col("value") < 5, float("nan")).when(F.col("value") > 100, float("inf")).otherwise(F.col("value"))
    return sinks.json_safe(t.events.select("event_id", odd.alias("x")))


@query("write_json", "SELECT event_id, CASE WHEN value < 5 THEN NULL ELSE value END AS x FROM events")
def _(t):
    path = scratch(t)
    odd = F.when(F.col("value") < 5, float("nan")).otherwise(F.col("value"))
    sinks.write_json(t.events.select("event_id", odd.alias("x")), path)
    return t.spark.read.schema("event_id bigint, x double").json(path)


@query("write_run", "SELECT l_returnflag, count(*) AS rows FROM lineitem GROUP BY l_returnflag")
def _(t):
    table = t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"))
    return t.spark.read.parquet(sinks.write_run(table, scratch(t), "first", "flags"))


@query("materialize_if_absent", """
SELECT turn, o_orderpriority, count(*) AS orders FROM orders, (VALUES ('built'), ('met')) v(turn) GROUP BY turn, o_orderpriority""")
def _(t):
    """The first call finds no table and builds it; the second meets it under another name and builds nothing."""
    name = f"priorities_{uuid.uuid4().hex[:12]}"

    def build():
        return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))

    def refuse():
        raise AssertionError("the table is there")

    built = rec.materialize_if_absent(t.spark, [name, f"{name}_other"], build)
    met = rec.materialize_if_absent(t.spark, [f"{name}_other", name], refuse)
    return built.withColumn("turn", F.lit("built")).unionByName(met.withColumn("turn", F.lit("met")))


@query("stream_landed_records", """
SELECT event_id, nullif(event_id, CASE WHEN event_id % 50 = 0 THEN event_id END) AS record, user_id, event_type, CAST(ts AS VARCHAR) AS ts, round(value, 6) AS value, props
FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 50 = 0 AND event_id % 3 = 0) e WHERE event_type <> 'error'""")
def _(t):
    """Four files in descending time order, one per trigger, and a fifth that repeats a share of the records; some records have no id.

    The last batch is run twice, as after a failure between its write and its commit.
    """
    base = scratch(t)
    rows = t.spark.read.parquet(t.path("events")).withColumn("record", F.when(F.col("event_id") % 50 != 0, F.col("event_id")))
    ranked = rows.withColumn("_part", F.ntile(4).over(Window.partitionBy(F.pmod("event_id", F.lit(7))).orderBy(F.desc("ts"))))
    ranked.write.partitionBy("_part").parquet(f"{base}/parts")
    parts = t.spark.read.schema(ranked.schema).parquet(f"{base}/parts")
    for i in range(1, 5):
        parts.filter(F.col("_part") == i).drop("_part").coalesce(1).write.parquet(f"{base}/in/{i}")
    rows.filter("event_id % 3 = 0").repartition(1).write.parquet(f"{base}/in/5")

    def run():
        stream = landed.landed_records(t.spark, f"{base}/in/*", rows.schema, files_per_trigger=1).filter(F.col("event_type") != "error")
        return landed.ingest_available(stream, base + "/data", base + "/checkpoint", "record")

    run()
    jvm = t.spark.sparkContext._jvm
    commit = jvm.org.apache.hadoop.fs.Path(f"{base}/checkpoint/commits/4")
    commit.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).delete(commit, False)
    return rounded(run(), "value").withColumn("ts", F.col("ts").cast("string"))


@query("ingest", """
SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('click', 'view') AND user_id =
       (SELECT c_custkey FROM customer WHERE contains(lower(c_name), 'customer') ORDER BY c_name, c_custkey LIMIT 1 OFFSET 8)""")
def _(t):
    rows, name = plan.ingest(
        t.customer, t.events, "customer", 8, entity_key="c_custkey", entity_name="c_name", record_entity="user_id",
        kind="event_type", kinds=["click", "view"], value="value", folder=scratch(t))
    return t.spark.table(name).select("event_id", "user_id", "event_type", "value")


