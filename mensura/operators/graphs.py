"""Jobs over collections of graphs held as two flat tables.

``vertices(graph, v, label, ...)`` and ``edges(graph, src, dst, label, ...)`` with every edge stored once. Neighbour
information is always combined by sums, minima or means, which merge before the shuffle, so a hub vertex or a giant
graph is never gathered. Edges meet vertices by ``join_by_key``, whose hot partitions adaptive execution can split. Loops
cut their lineage to the shared folder and go on until nothing changes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura import fixed_values as fixed
from mensura.functions import columns as fn
from mensura.session import cut
from mensura.skew import aggregate, join_by_key


def both_directions(edges: DataFrame) -> DataFrame:
    """Each edge as ``a -> b`` and ``b -> a``; one pass over the edges."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))
    )
    return edges.select(*rest, F.explode(ends).alias("_e")).select(*rest, "_e.a", "_e.b")


def vertex_categories(
    vertices: DataFrame, ranges: Mapping[str, tuple[int, int, int]] = fixed.VERTEX_RANGES
) -> DataFrame:
    """Clamp vertex columns into their category ranges and shift them to non-negative codes."""
    return vertices.withColumns({c: fn.clip_shift(F.col(c).cast("int"), *spec) for c, spec in ranges.items()})


def edge_features(
    edges: DataFrame, kind: str = "kind", stereo: str = "stereo", flags: Sequence[str] = ("conjugated", "aromatic", "in_ring"),
    kinds: Sequence[str] = tuple(fixed.BOND_TYPES), stereos: Sequence[str] = tuple(fixed.BOND_STEREO),
) -> DataFrame:
    """13 numeric channels per edge (4 kinds, 3 flags, 6 stereo classes), each edge in both directions."""
    directed = both_directions(edges)
    return directed.select(
        "graph", "a", "b", *fn.one_hot(kind, kinds, "kind"), *[F.col(c).cast("double").alias(c) for c in flags],
        *fn.one_hot(stereo, stereos, "stereo"),
    )


# --- hashed neighbourhoods ---------------------------------------------------------------------


def _start(vertices: DataFrame) -> DataFrame:
    return vertices.select("graph", "v", F.md5(F.coalesce(F.col("label").cast("string"), F.lit(""))).alias("h"))


PIECES = range(4)  # of 24 bits each, in which hashes are added up


def _sums(h: str, name: str) -> list[Column]:
    return [F.sum(fn.chunk(F.col(h), i)).alias(f"{name}{i}") for i in PIECES]


def neighborhood_round(state: DataFrame, directed: DataFrame) -> DataFrame:
    """New hash of every vertex from its own and the multiset of (edge label, neighbour hash).

    The multiset enters through its size and four sums of hash pieces, so the order of neighbours does not matter.
    """
    neighbours = state.select("graph", F.col("v").alias("b"), F.col("h").alias("_hb"))
    seen = join_by_key(directed, neighbours, ["graph", "b"], "inner").withColumn(
        "_m", F.md5(F.concat_ws(":", F.coalesce(F.col("label").cast("string"), F.lit("")), "_hb"))
    )
    sums = seen.groupBy("graph", F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("_n"), *_sums("_m", "_s"))
    zero = F.lit(0).cast("long")
    parts = [F.coalesce(F.col(c), zero).cast("string") for c in ("_n", *[f"_s{i}" for i in PIECES])]
    return state.join(sums, ["graph", "v"], "left").select(
        "graph", "v", F.md5(F.concat_ws(":", F.col("h"), *parts)).alias("h")
    )


def _directed(edges: DataFrame) -> DataFrame:
    return both_directions(cut(edges.select("graph", "src", "dst", "label")))


def neighborhood_hashes(vertices: DataFrame, edges: DataFrame, rounds: int) -> list[DataFrame]:
    """Vertex hashes after 0, 1, ... ``rounds`` rounds."""
    directed = _directed(edges)
    states = [cut(_start(vertices))]
    for _ in range(rounds):
        states.append(cut(neighborhood_round(states[-1], directed)))
    return states


def fold(h: Column, bits: int = fixed.BITS) -> Column:
    """Bit position of a hash."""
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % bits).cast("int")


def neighborhood_fingerprint(
    vertices: DataFrame, edges: DataFrame, radius: int = fixed.RADIUS, bits: int = fixed.BITS
) -> DataFrame:
    """Per graph the sorted on-bit positions of all vertex neighbourhoods up to ``radius``; at most ``bits`` of them."""
    states = neighborhood_hashes(vertices, edges, radius)
    marks = states[0].select("graph", fold(F.col("h"), bits).alias("bit"))
    for state in states[1:]:
        marks = marks.unionByName(state.select("graph", fold(F.col("h"), bits).alias("bit")))
    return marks.groupBy("graph").agg(F.array_sort(F.collect_set("bit")).alias("bits"))


def _key(state: DataFrame, sizes: DataFrame) -> DataFrame:
    """A graph's key from the multisets of its vertex hashes and of its components' sizes."""
    by_vertex = state.groupBy("graph").agg(F.count(F.lit(1)).alias("_n"), *_sums("h", "_s"))
    hashed = sizes.select("graph", F.md5(F.col("size").cast("string")).alias("h"))
    by_size = hashed.groupBy("graph").agg(F.count(F.lit(1)).alias("_c"), *_sums("h", "_z"))
    names = ["_n", *[f"_s{i}" for i in PIECES], "_c", *[f"_z{i}" for i in PIECES]]
    return by_vertex.join(by_size, "graph").select("graph", F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in names])).alias("key"))


def _colours(state: DataFrame, name: str) -> DataFrame:
    return state.groupBy("graph", "h").agg(F.count(F.lit(1))).groupBy("graph").agg(F.count(F.lit(1)).alias(name))


def graph_key(vertices: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Identity key per graph that ignores vertex names and row order: equal graphs share it.

    Hashes are refined until a graph's vertices fall into no more classes than the round before, each graph for itself, so
    that its key does not depend on the other graphs; ``rounds`` fixes the number instead. Component sizes are part of the
    key. Unequal graphs that refinement cannot tell apart, such as some regular ones, still share a key.
    """
    sizes = cut(component_sizes(components(vertices, edges)))
    if rounds is not None:
        return _key(neighborhood_hashes(vertices, edges, rounds)[-1], sizes)
    directed, now, keys = _directed(edges), cut(_start(vertices)), []
    while not keys or not now.isEmpty():
        later = cut(neighborhood_round(now, directed))
        classes = _colours(now, "before").join(_colours(later, "after"), "graph")
        settled = cut(classes.filter("before = after").select("graph"))
        keys.append(_key(join_by_key(later, settled, ["graph"], "left_semi"), sizes))
        now = cut(join_by_key(later, settled, ["graph"], "left_anti"))
    return reduce(DataFrame.unionByName, keys)


# --- structure ---------------------------------------------------------------------------------


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph, v, component``: the smallest vertex of the connected component.

    Each round gives the remaining vertices a fresh random order, points every one at its first neighbour (or itself),
    follows those pointers a few steps, merges what they reach, and keeps only edges between different places. A random
    order leaves at most about a third of the places, also on long paths, so few rounds are needed.
    """
    place = vertices.select("graph", "v", F.col("v").alias("at"))
    left = cut(edges.filter(F.col("src") != F.col("dst")).select(
        "graph", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    ).distinct())
    for turn in count():
        if left.isEmpty():
            smallest = place.groupBy("graph", "at").agg(F.min("v").alias("component"))
            return join_by_key(place, smallest, ["graph", "at"], "inner").select("graph", "v", "component")

        def first(c: str) -> Column:
            return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("v"))

        best = both_directions(left).groupBy("graph", F.col("a").alias("v")).agg(F.min(first("b")).alias("_b"))
        pointer = best.select("graph", "v", F.least("_b", first("v"))["v"].alias("to"))
        for _ in range(2):
            onward = pointer.select("graph", F.col("v").alias("to"), F.col("to").alias("_next"))
            pointer = join_by_key(pointer, onward, ["graph", "to"], "left").select("graph", "v", F.coalesce("_next", "to").alias("to"))
        pointer = cut(pointer)
        place = join_by_key(place, pointer.withColumnRenamed("v", "at"), ["graph", "at"], "left").select(
            "graph", "v", F.coalesce("to", "at").alias("at")
        )
        if turn % 4 == 3:
            place = cut(place)
        source = pointer.select("graph", F.col("v").alias("src"), F.col("to").alias("_s"))
        target = pointer.select("graph", F.col("v").alias("dst"), F.col("to").alias("_d"))
        moved = join_by_key(join_by_key(left, source, ["graph", "src"], "inner"), target, ["graph", "dst"], "inner").filter(F.col("_s") != F.col("_d"))
        left = cut(moved.select("graph", F.least("_s", "_d").alias("src"), F.greatest("_s", "_d").alias("dst")).distinct())
    raise AssertionError("unreachable")


def component_sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("graph", "component").agg(F.count(F.lit(1)).alias("size"))


def component_counts(placed: DataFrame) -> DataFrame:
    """Per graph: vertices, components, size of the largest component."""
    return component_sizes(placed).groupBy("graph").agg(
        F.sum("size").alias("vertices"), F.count(F.lit(1)).alias("components"), F.max("size").alias("largest")
    )


def largest_component(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices of the largest component of each graph; ties go to the component with the smallest vertex."""
    placed = cut(components(vertices, edges))
    best = component_sizes(placed).groupBy("graph").agg(
        F.min_by("component", F.struct(-F.col("size"), F.col("component"))).alias("component")
    )
    return placed.join(best, ["graph", "component"], "left_semi").select("graph", "v")


def _at_vertices(chains: DataFrame) -> DataFrame:
    """Per vertex: how many chain ends it has, whether one is a loop, and its first and last (other end, chain)."""
    ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u"), "e"), F.struct(F.col("b").alias("v"), F.col("a").alias("u"), "e"))
    return chains.select("graph", F.inline(ends)).groupBy("graph", "v").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("v") == F.col("u")).alias("loop"),
        F.min(F.struct("u", "e")).alias("low"), F.max(F.struct("u", "e")).alias("high"))


def core_graph(edges: DataFrame) -> DataFrame:
    """Edges left after removing vertices with at most one neighbour until none is left: rings and their linkers.

    Rake and compress: chains that end freely are dropped, and vertices between two chains, no two of them neighbours, are
    taken out by joining their chains to one. Long tails and long rings shrink by a constant share in every round, so
    rounds grow with the logarithm of their length. The edges of the chains that remain are the core.
    """
    held = cut(edges.filter(F.col("src") != F.col("dst")).select(
        "graph", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    ).distinct().withColumn("e", F.struct(F.lit(-1).alias("turn"), F.col("src").alias("x"), F.col("dst").alias("y"))))
    chains = held.select("graph", F.col("src").alias("a"), F.col("dst").alias("b"), "e")
    for turn in count():
        free = cut(_at_vertices(chains).filter("n = 1").select("graph", F.col("low.e").alias("e")).distinct())
        raked = not free.isEmpty()
        if raked:
            chains = cut(join_by_key(chains, free, ["graph", "e"], "left_anti").select("graph", "a", "b", "e"))
        order = F.struct(F.xxhash64(F.lit(turn), "v").alias("h"), F.col("v").alias("w"))
        between = cut(_at_vertices(chains).filter("n = 2 AND NOT loop").select("graph", "v", "low", "high", order.alias("o")))
        beside_ = between.select("graph", "v", F.explode(F.array("low.u", "high.u")).alias("u"))
        near = join_by_key(beside_, between.select("graph", F.col("v").alias("u"), F.col("o").alias("other")), ["graph", "u"], "inner")
        first = near.groupBy("graph", "v").agg(F.min("other").alias("other"))
        chosen = cut(between.join(first, ["graph", "v"], "left").filter("other IS NULL OR o < other"))
        if chosen.isEmpty():
            if not raked:
                return join_by_key(held, chains.select("graph", "e"), ["graph", "e"], "left_semi").select("graph", "src", "dst")
            continue
        named = F.struct(F.lit(turn).alias("turn"), F.col("v").alias("x"), F.col("v").alias("y"))
        joined = chosen.select("graph", F.explode(F.array("low.e", "high.e")).alias("e"), named.alias("to"))
        kept = join_by_key(chains, joined, ["graph", "e"], "left_anti").select("graph", "a", "b", "e")
        chains = cut(kept.unionByName(chosen.select("graph", F.col("low.u").alias("a"), F.col("high.u").alias("b"), named.alias("e"))))
        held = cut(join_by_key(held, joined, ["graph", "e"], "left").select("graph", "src", "dst", F.coalesce("to", "e").alias("e")))
    raise AssertionError("unreachable")


def core_keys(vertices: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Group key per graph: the identity key of its core, or the sentinel when it has none."""
    core = cut(core_graph(edges))
    ends = both_directions(core).select("graph", F.col("a").alias("v")).distinct()
    inside = vertices.join(ends, ["graph", "v"], "left_semi")
    ends = {"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")}
    kept = edges.withColumns(ends).join(core, ["graph", "src", "dst"], "left_semi")
    keys = graph_key(inside, kept, rounds)
    graphs = vertices.select("graph").distinct()
    return graphs.join(keys, "graph", "left").select("graph", fn.fill_group("key").alias("key"))


def graph_descriptors(
    vertices: DataFrame, edges: DataFrame, weights: DataFrame, plain: Sequence[str] = ("C", "H"), counted: str = "N",
    charge: str | None = None, aromatic: str | None = None,
) -> DataFrame:
    """Per graph: summed vertex weight, hetero vertices, non-aromatic ``counted`` vertices, charge, independent rings."""
    rows = vertices.join(weights.select("label", "weight"), "label", "left")
    ring_free = F.lit(True) if aromatic is None else ~F.coalesce(F.col(aromatic).cast("boolean"), F.lit(False))
    by_vertex = rows.groupBy("graph").agg(
        F.sum("weight").alias("weight"),
        F.count_if(~F.col("label").isin(list(plain))).alias("hetero"),
        F.count_if((F.col("label") == counted) & ring_free).alias("counted"),
        F.coalesce(F.sum(F.col(charge)) if charge else F.lit(0), F.lit(0)).cast("long").alias("charge"),
        F.count(F.lit(1)).alias("vertices"),
    )
    by_edge = edges.groupBy("graph").agg(F.count(F.lit(1)).alias("edges"))
    parts = component_counts(components(vertices, edges)).select("graph", "components")
    table = by_vertex.join(by_edge, "graph", "left").join(parts, "graph").fillna(0, ["edges"])
    return table.withColumn("rings", F.col("edges") - F.col("vertices") + F.col("components"))


# --- message passing ---------------------------------------------------------------------------


def message_passing(
    vertices: DataFrame, edges: DataFrame, state: Sequence[str], steps: int = 3, weight: str | None = None
) -> DataFrame:
    """Parameter-free rounds: every state column gains the mean over incoming neighbours of their state (plus the edge's
    ``weight``); a vertex without neighbours gains nothing."""
    directed = both_directions(cut(edges.select("graph", "src", "dst", *([weight] if weight else []))))
    now = vertices.select("graph", "v", *[F.col(c).cast("double").alias(c) for c in state])
    extra = F.col(weight).cast("double") if weight else F.lit(0.0)
    for i in range(steps):
        senders = now.select("graph", F.col("v").alias("a"), *state)
        means = join_by_key(directed, senders, ["graph", "a"], "inner").groupBy("graph", F.col("b").alias("v")).agg(
            *[F.avg(F.col(c) + extra).alias("_m_" + c) for c in state]
        )
        now = now.join(means, ["graph", "v"], "left").select(
            "graph", "v", *[(F.col(c) + F.coalesce("_m_" + c, F.lit(0.0))).alias(c) for c in state]
        )
        if i % 2 and i + 1 < steps:
            now = cut(now)
    return now


def graph_readout(states: DataFrame, state: Sequence[str], globals_: DataFrame | None = None) -> DataFrame:
    """Mean and max of every state column per graph, beside the graph's own columns."""
    pooled = states.groupBy("graph").agg(
        *[F.avg(c).alias("mean_" + c) for c in state], *[F.max(c).alias("max_" + c) for c in state]
    )
    return pooled if globals_ is None else pooled.join(globals_, "graph", "left")


# --- warnings ----------------------------------------------------------------------------------


def structure_warnings(
    graphs: DataFrame, vertices: DataFrame, edges: DataFrame, allowed: Sequence, many: int = 100
) -> DataFrame:
    """Warnings per graph: empty, disconnected, unusual labels (named once each), more than ``many`` vertices."""
    sizes = component_counts(components(vertices, edges))
    known = graphs.select("graph").distinct().join(sizes, "graph", "left")
    by_size = F.array_compact(F.array(
        F.when(F.col("vertices").isNull(), "no vertices"),
        F.when(F.col("components") > 1, "disconnected parts"),
        F.when(F.col("vertices") > many, f"more than {many} vertices"),
    ))
    first = known.select("graph", F.explode(by_size).alias("warning"))
    odd = vertices.filter(~F.coalesce(F.col("label").isin(list(allowed)), F.lit(False))).select(
        "graph", F.concat(F.lit("unusual label: "), fn.null_label("label")).alias("warning")
    ).distinct()
    return first.unionByName(odd)


def structure_summary(graphs: DataFrame, vertices: DataFrame, edges: DataFrame, many: int = 100) -> DataFrame:
    """Graphs, empty and disconnected ones, and min / median / max vertex count over non-empty ones."""
    known = graphs.select("graph").distinct().join(component_counts(components(vertices, edges)), "graph", "left")
    known = known.withColumn("_size", F.col("vertices").cast("double"))
    return aggregate(known, [], [
        F.count(F.lit(1)).alias("graphs"), F.count_if(F.col("vertices").isNull()).alias("empty"),
        F.count_if(F.coalesce(F.col("components") > 1, F.lit(False))).alias("disconnected"),
        F.min("vertices").alias("min_vertices"), F.max("vertices").alias("max_vertices"),
        F.count_if(F.coalesce(F.col("vertices") > many, F.lit(False))).alias("over_limit"),
    ], {"median_vertices": ("_size", 0.5)})
