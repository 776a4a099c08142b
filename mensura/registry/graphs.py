"""Queries for graph jobs; the graphs are ship dates, their vertices brands and nations."""

from pyspark.sql import functions as F

from mensura import fixed_values as fixed
from mensura.operators import graphs as gr
from mensura.registry.core import query, rounded


def pieces(h: str, name: str) -> str:
    """Sums of the four 24-bit pieces of a hash."""
    return ", ".join(f"sum(('0x' || substr({h}, {1 + 6 * i}, 6))::BIGINT) AS {name}{i}" for i in range(4))


def hash_rounds(n: int, vertices="graph_vertices", both="graph_both", prefix="h") -> str:
    """CTEs prefix0 .. prefixN with the neighbourhood hashes."""
    text = f"{prefix}0 AS (SELECT graph, v, md5(label) AS h FROM {vertices})"
    for i in range(1, n + 1):
        text += f""",
{prefix}m{i} AS (SELECT b.graph, b.a AS v, md5('S:' || h.h) AS m FROM {both} b JOIN {prefix}{i - 1} h ON b.graph = h.graph AND b.b = h.v),
{prefix}s{i} AS (SELECT graph, v, count(*) AS n, {pieces('m', 's')} FROM {prefix}m{i} GROUP BY graph, v),
{prefix}{i} AS MATERIALIZED (SELECT h.graph, h.v, md5(concat_ws(':', h.h, CAST(coalesce(n, 0) AS VARCHAR), CAST(coalesce(s0, 0) AS VARCHAR),
        CAST(coalesce(s1, 0) AS VARCHAR), CAST(coalesce(s2, 0) AS VARCHAR), CAST(coalesce(s3, 0) AS VARCHAR))) AS h FROM {prefix}{i - 1} h LEFT JOIN {prefix}s{i} s ON h.graph = s.graph AND h.v = s.v)"""
    return text


def key_of(table: str, placed: str) -> str:
    """Key per graph from a table of hashes and one of vertices with their component."""
    return f"""SELECT n.graph, md5(concat_ws(':', n, s0, s1, s2, s3, c, z0, z1, z2, z3)) AS key
FROM (SELECT graph, count(*) AS n, {pieces('h', 's')} FROM {table} GROUP BY graph) n
JOIN (SELECT graph, count(*) AS c, {pieces('md5(CAST(size AS VARCHAR))', 'z')}
      FROM (SELECT graph, component, count(*) AS size FROM {placed} GROUP BY graph, component) a GROUP BY graph) c ON n.graph = c.graph"""


def reach(vertices: str, both: str, name: str) -> str:
    """Vertices with the smallest vertex of their component."""
    return f"""{name}_walk AS (
    SELECT graph, v, v AS root FROM {vertices}
    UNION SELECT b.graph, b.b, r.root FROM {name}_walk r JOIN {both} b ON r.graph = b.graph AND r.v = b.a WHERE r.root < b.b),
{name} AS (SELECT graph, v, min(root) AS component FROM {name}_walk GROUP BY graph, v)"""


BITS = f"""WITH {hash_rounds(2)},
b AS (SELECT DISTINCT graph, ('0x' || substr(h, 1, 8))::BIGINT % 1024 AS bit
      FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) u)
SELECT graph, string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit) AS bits FROM b GROUP BY graph"""


@query("neighborhood_fingerprint", BITS)
def _(t):
    out = gr.neighborhood_fingerprint(t.graph_vertices, t.graph_edges)
    return out.select("graph", F.array_join("bits", ",").alias("bits"))


PLACED = reach("graph_vertices", "graph_both", "placed")


@query("graph_key", f"WITH RECURSIVE {PLACED},\n{hash_rounds(3)}\n{key_of('h3', 'placed')}")
def _(t):
    return gr.graph_key(t.graph_vertices, t.graph_edges, 3)


@query("graph_key_classes", f"""WITH RECURSIVE {PLACED},
{hash_rounds(8)},
k AS ({key_of('h8', 'placed')})
SELECT graph, count(*) OVER (PARTITION BY key) AS equal_graphs FROM k""")
def _(t):
    keys = gr.graph_key(t.graph_vertices, t.graph_edges)
    return keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("equal_graphs")), "key").select("graph", "equal_graphs")


REACH = f"WITH RECURSIVE {PLACED}"


@query("components", REACH + " SELECT graph, v, component FROM placed")
def _(t):
    return gr.components(t.graph_vertices, t.graph_edges)


@query("component_counts", REACH + """
SELECT graph, CAST(sum(size) AS BIGINT) AS vertices, count(*) AS components, max(size) AS largest
FROM (SELECT graph, component, count(*) AS size FROM placed GROUP BY graph, component) s GROUP BY graph""")
def _(t):
    return gr.component_counts(gr.components(t.graph_vertices, t.graph_edges))


@query("largest_component", REACH + """,
s AS (SELECT graph, component FROM placed GROUP BY graph, component QUALIFY row_number() OVER (PARTITION BY graph ORDER BY count(*) DESC, component) = 1)
SELECT p.graph, p.v FROM placed p JOIN s ON p.graph = s.graph AND p.component = s.component""")
def _(t):
    return gr.largest_component(t.graph_vertices, t.graph_edges)


def peeling(n: int) -> str:
    text = "c0 AS (SELECT graph, least(src, dst) AS src, greatest(src, dst) AS dst FROM graph_edges)"
    for i in range(1, n + 1):
        text += f""",
k{i} AS (SELECT graph, v FROM (SELECT graph, src AS v FROM c{i - 1} UNION ALL SELECT graph, dst FROM c{i - 1}) u GROUP BY graph, v HAVING count(*) > 1),
c{i} AS MATERIALIZED (SELECT c.graph, c.src, c.dst FROM c{i - 1} c JOIN k{i} a ON c.graph = a.graph AND c.src = a.v
        JOIN k{i} b ON c.graph = b.graph AND c.dst = b.v)"""
    return text


@query("core_graph", f"WITH {peeling(18)} SELECT graph, src, dst FROM c18")
def _(t):
    return gr.core_graph(t.graph_edges)


CORE = f"""WITH RECURSIVE {peeling(18)},
core_both AS (SELECT graph, src AS a, dst AS b FROM c18 UNION ALL SELECT graph, dst, src FROM c18),
core_vertices AS (SELECT graph, v, label FROM graph_vertices WHERE (graph, v) IN (SELECT (graph, a) FROM core_both)),
{reach('core_vertices', 'core_both', 'core_placed')},
{hash_rounds(3, 'core_vertices', 'core_both', 'q')},
keys AS ({key_of('q3', 'core_placed')})
SELECT g.graph, coalesce(k.key, '__NO_SCAFFOLD__') AS key FROM (SELECT DISTINCT graph FROM graph_vertices) g LEFT JOIN keys k ON g.graph = k.graph"""


@query("core_keys", CORE)
def _(t):
    return gr.core_keys(t.graph_vertices, t.graph_edges, 3)


@query("graph_descriptors", REACH + """,
w AS (SELECT graph, count(*) AS vertices, sum(CASE label WHEN 'B' THEN 10.81 ELSE 14.007 END::DOUBLE) AS weight,
             count(*) FILTER (WHERE label <> 'B') AS hetero, count(*) FILTER (WHERE label = 'N') AS counted FROM graph_vertices GROUP BY graph),
e AS (SELECT graph, count(*) AS edges FROM graph_edges GROUP BY graph),
c AS (SELECT graph, count(DISTINCT component) AS components FROM placed GROUP BY graph)
SELECT w.graph, round(weight, 4) AS weight, hetero, counted, 0::BIGINT AS charge, vertices, edges, components, edges - vertices + components AS rings
FROM w JOIN e ON w.graph = e.graph JOIN c ON w.graph = c.graph""")
def _(t):
    weights = t.spark.createDataFrame([("B", 10.81), ("N", 14.007)], "label string, weight double")
    return rounded(gr.graph_descriptors(t.graph_vertices, t.graph_edges, weights, plain=("B",)), "weight", digits=4)


RAW_VERTICES = """
SELECT l_orderkey AS graph, l_linenumber AS v, l_partkey, CAST(l_quantity AS INT) * 4 AS atomic_number, l_linenumber AS degree,
       CAST(l_quantity AS INT) - 25 AS formal_charge, l_linenumber - 1 AS hybridization,
       CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS aromaticity, CAST(l_quantity AS INT) AS hydrogen_count,
       CASE WHEN l_linestatus = 'F' THEN 2 ELSE 0 END AS ring_membership FROM lineitem"""


@query("vertex_categories", f"""
SELECT graph, v, l_partkey, greatest(least(atomic_number, 118), 0) AS atomic_number, greatest(least(degree, 6), 0) AS degree,
       greatest(least(formal_charge, 5), -5) + 5 AS formal_charge, greatest(least(hybridization, 5), 0) AS hybridization,
       greatest(least(aromaticity, 1), 0) AS aromaticity, greatest(least(hydrogen_count, 6), 0) AS hydrogen_count,
       greatest(least(ring_membership, 1), 0) AS ring_membership FROM ({RAW_VERTICES}) r""")
def _(t):
    return gr.vertex_categories(t.sql(RAW_VERTICES))


RAW_EDGES = """
SELECT o_custkey AS graph, 'o' || CAST(o_orderkey AS STRING) AS src, 'c' || CAST(o_custkey AS STRING) AS dst,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'SINGLE' WHEN '2-HIGH' THEN 'DOUBLE' WHEN '3-MEDIUM' THEN 'TRIPLE' WHEN '5-LOW' THEN 'AROMATIC'
            ELSE 'DATIVE' END AS kind,
       CASE o_orderstatus WHEN 'F' THEN 'STEREONONE' WHEN 'O' THEN 'STEREOZ' ELSE CAST(NULL AS STRING) END AS stereo,
       o_totalprice > 100000 AS conjugated, o_totalprice > 200000 AS aromatic, o_orderstatus = 'P' AS in_ring FROM orders"""
_kinds = ", ".join(f"CASE WHEN kind = '{k}' THEN 1.0 ELSE 0.0 END::DOUBLE AS kind_{k.lower()}" for k in fixed.BOND_TYPES)
_stereos = ", ".join(f"CASE WHEN stereo = '{k}' THEN 1.0 ELSE 0.0 END::DOUBLE AS stereo_{k.lower()}" for k in fixed.BOND_STEREO)


@query("edge_features", f"""
WITH r AS ({RAW_EDGES})
SELECT graph, a, b, {_kinds}, CAST(conjugated AS DOUBLE) AS conjugated, CAST(aromatic AS DOUBLE) AS aromatic, CAST(in_ring AS DOUBLE) AS in_ring, {_stereos}
FROM (SELECT *, src AS a, dst AS b FROM r UNION ALL SELECT *, dst AS a, src AS b FROM r) d""")
def _(t):
    return gr.edge_features(t.sql(RAW_EDGES))


def passing(n: int) -> str:
    text = "x0 AS (SELECT graph, v, sqrt(length(v)) AS x FROM graph_vertices)"
    for i in range(1, n + 1):
        text += f""",
y{i} AS (SELECT b.graph, b.b AS v, avg(x.x) AS m FROM graph_both b JOIN x{i - 1} x ON b.graph = x.graph AND b.a = x.v GROUP BY b.graph, b.b),
x{i} AS MATERIALIZED (SELECT x.graph, x.v, x.x + coalesce(m, 0) AS x FROM x{i - 1} x LEFT JOIN y{i} y ON x.graph = y.graph AND x.v = y.v)"""
    return text


def _states(t):
    start = t.graph_vertices.withColumn("x", F.sqrt(F.length("v")))
    return gr.message_passing(start, t.graph_edges, ["x"], 3)


@query("message_passing", f"WITH {passing(3)} SELECT graph, v, round(x, 6) AS x FROM x3")
def _(t):
    return rounded(_states(t), "x")


@query("graph_readout", f"""WITH {passing(3)}
SELECT x.graph, round(avg(x.x), 6) AS mean_x, round(max(x.x), 6) AS max_x, e.edges FROM x3 x
JOIN (SELECT graph, count(*) AS edges FROM graph_edges GROUP BY graph) e ON x.graph = e.graph GROUP BY x.graph, e.edges""")
def _(t):
    globals_ = t.graph_edges.groupBy("graph").agg(F.count(F.lit(1)).alias("edges"))
    return rounded(gr.graph_readout(_states(t), ["x"], globals_), "mean_x", "max_x")


ALL_GRAPHS = """SELECT CAST(CAST(l_shipdate AS DATE) AS STRING) AS graph FROM lineitem UNION ALL SELECT r_name AS graph FROM region"""
SIZES = REACH + f""",
k AS (SELECT g.graph, vertices, components FROM (SELECT DISTINCT graph FROM ({ALL_GRAPHS}) a) g LEFT JOIN
      (SELECT graph, count(*) AS vertices, count(DISTINCT component) AS components FROM placed GROUP BY graph) s ON g.graph = s.graph)"""


@query("structure_warnings", SIZES + """
SELECT graph, 'no vertices' AS warning FROM k WHERE vertices IS NULL
UNION ALL SELECT graph, 'disconnected parts' FROM k WHERE components > 1
UNION ALL SELECT graph, 'more than 30 vertices' FROM k WHERE vertices > 30
UNION ALL SELECT DISTINCT graph, 'unusual label: N' FROM graph_vertices WHERE label = 'N'""")
def _(t):
    return gr.structure_warnings(t.sql(ALL_GRAPHS), t.graph_vertices, t.graph_edges, ["B"], 30)


@query("structure_summary", SIZES + """
SELECT count(*) AS graphs, count(*) FILTER (WHERE vertices IS NULL) AS empty, count(*) FILTER (WHERE components > 1) AS disconnected,
       min(vertices) AS min_vertices, max(vertices) AS max_vertices, count(*) FILTER (WHERE vertices > 30) AS over_limit,
       median(vertices)::DOUBLE AS median_vertices FROM k""")
def _(t):
    return gr.structure_summary(t.sql(ALL_GRAPHS), t.graph_vertices, t.graph_edges, 30)
