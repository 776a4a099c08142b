"""Graph jobs on small graphs with known answers."""

from conftest import rows
from pyspark.sql import functions as F

from mensura.operators import graphs as gr


def _graph(spark, edges, single=()):
    e = spark.createDataFrame([(g, a, b, "S") for g, a, b in edges], "graph string, src string, dst string, label string")
    v = [(g, x) for g, a, b in edges for x in (a, b)] + list(single)
    return spark.createDataFrame(sorted({(g, x, "C") for g, x in v}), "graph string, v string, label string"), e


TAILED = [("t", "a", "b"), ("t", "b", "c"), ("t", "a", "c"), ("t", "c", "d"), ("t", "d", "e")]
PATH = [("p", "a", "b"), ("p", "b", "c")]


def test_core_is_the_ring(spark):
    v, e = _graph(spark, TAILED + PATH)
    assert rows(gr.core_graph(e)) == [("t", "a", "b"), ("t", "a", "c"), ("t", "b", "c")]
    keys = dict(rows(gr.core_keys(v, e), "graph", "key"))
    assert keys["p"] == "__NO_SCAFFOLD__" and keys["t"] != "__NO_SCAFFOLD__"


def test_components(spark):
    v, e = _graph(spark, [("g", "b", "c")], [("g", "a")])
    assert rows(gr.component_counts(gr.components(v, e))) == [("g", 3, 2, 2)]
    long = [("l", f"{i:04d}", f"{i + 1:04d}") for i in range(70)]
    v, e = _graph(spark, long)
    assert rows(gr.components(v, e).select("graph", "component").distinct()) == [("l", "0000")]


def test_key_ignores_names_and_order(spark):
    v1, e1 = _graph(spark, TAILED)
    renamed = {"a": "z", "b": "y", "c": "x", "d": "w", "e": "u"}
    v2, e2 = _graph(spark, [(g, renamed[b], renamed[a]) for g, a, b in reversed(TAILED)])
    assert rows(gr.graph_key(v1, e1)) == rows(gr.graph_key(v2, e2))
    v3, e3 = _graph(spark, TAILED[:-1])
    assert rows(gr.graph_key(v1, e1)) != rows(gr.graph_key(v3, e3))
    assert rows(gr.neighborhood_fingerprint(v1, e1)) == rows(gr.neighborhood_fingerprint(v2.repartition(3), e2))


def test_descriptors_count_rings(spark):
    v, e = _graph(spark, TAILED + PATH, [("p", "z")])
    weights = spark.createDataFrame([("C", 12.0)], "label string, weight double")
    got = rows(gr.graph_descriptors(v, e, weights), "graph", "weight", "vertices", "edges", "components", "rings")
    assert got == [("p", 48.0, 4, 2, 2, 0), ("t", 60.0, 5, 5, 1, 1)]


def test_messages_average_neighbours(spark):
    v, e = _graph(spark, PATH, [("p", "z")])
    start = v.withColumn("x", F.when(F.col("v") == "b", 4.0).otherwise(1.0))
    assert rows(gr.message_passing(start, e, ["x"], 1), "v", "x") == [("a", 5.0), ("b", 5.0), ("c", 5.0), ("z", 1.0)]


def test_warnings(spark):
    v, e = _graph(spark, PATH, [("p", "z")])
    graphs = spark.createDataFrame([("p",), ("empty",)], "graph string")
    assert rows(gr.structure_warnings(graphs, v, e, ["C"], 3)) == [
        ("empty", "no vertices"), ("p", "disconnected parts"), ("p", "more than 3 vertices")]


def _named(name, pairs, marks=()):
    edges = [(name, f"v{a}", f"v{b}", "S") for a, b in pairs]
    names = sorted({v for p in pairs for v in p})
    return [(name, f"v{v}", "X" if v in marks else "C") for v in names], edges


def test_keys_tell_far_marks_and_rings_apart(spark):
    path = [(i, i + 1) for i in range(24)]
    ring = lambda n, at=0: [(at + i, at + (i + 1) % n) for i in range(n)]
    graphs = [("p1", path, (4, 12)), ("p2", path, (4, 14)), ("p3", [(b, a) for a, b in path], (20, 12)), ("r1", ring(12), ()), ("r2", ring(6) + ring(6, 50), ())]
    vertices, edges = [], []
    for name, pairs, marks in graphs:
        v, e = _named(name, pairs, marks)
        vertices += v
        edges += e
    keys = dict(rows(gr.graph_key(spark.createDataFrame(vertices, "graph string, v string, label string"),
                                  spark.createDataFrame(edges, "graph string, src string, dst string, label string"))))
    assert keys["p1"] == keys["p3"] and len(set(keys.values())) == 4


def test_core_of_a_long_tail_and_a_long_ring(spark):
    tail = [("t", i, i + 1, "S") for i in range(2000)] + [("t", 2000, 2001, "S"), ("t", 2001, 2002, "S"), ("t", 2002, 2000, "S")]
    ring = [("r", i, (i + 1) % 500, "S") for i in range(500)] + [("r", 0, 900, "S"), ("r", 100, 300, "S")]
    bare = [("b", i, i + 1, "S") for i in range(700)]
    edges = spark.createDataFrame(tail + ring + bare, "graph string, src long, dst long, label string")
    core = rows(gr.core_graph(edges), "graph", "src", "dst")
    assert [r for r in core if r[0] == "t"] == [("t", 2000, 2001), ("t", 2000, 2002), ("t", 2001, 2002)]
    assert sum(r[0] == "r" for r in core) == 501 and not any(r[0] == "b" for r in core)
