"""What the joins on sets of word shingles share: from cells to verified links and components, without pairs of copies or of known kin.

An operator says how texts become sets with cells (keys of which linked sets share one at least), how a pair is judged before its
full sets are read, and how a block of sets of one cell is searched. Equal sets are one set, told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.batches import each_piece, lean, pieces, quoted
from mensura.llm.blocks import BLOCK, Block, block_of, block_pairs, narrowed, open_cells, searched, size_step
from mensura.llm.bpe import ramps
from mensura.llm.links import components, joined_components
from mensura.session import cut

FILTER_BITS = 24
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], shingle: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; fewer words than a shingle are one, none are the empty set."""
    from xxhash import xxh3_64_intdigest as digest

    words = [(t or b"").lower().split() for t in texts]  # of bytes: A-Z and the ASCII white space
    total = sum(map(len, words))
    hashes = np.fromiter((digest(w) for ws in words for w in ws), np.uint64, total)
    joined = np.zeros(max(0, total - shingle + 1), np.uint64)
    for j in range(shingle):
        joined = mixed(joined * _A + hashes[j : j + len(joined)])
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= shingle:
            out.append(np.unique(joined[at : at + n - shingle + 1]))
        else:
            out.append(np.array([digest(b" ".join(ws), seed=n)] if n else [], np.uint64))
        at += n
    return out


def most_different(total: int, percent: int) -> int:
    """In how many shingles two sets of together ``total`` can differ and still be linked."""
    return total * (100 - percent) // (100 + percent)


def may_link(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b that share so many shingles are linked."""
    return 100 * shared >= percent * (a + b - shared)


def identities(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; 0 for the empty set."""
    out = np.zeros((2, len(sets)), np.uint64)
    some = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if len(some):
        sizes = np.array([len(sets[i]) for i in some])
        hashes, begin = np.concatenate([sets[i] for i in some]), np.cumsum(sizes) - sizes
        for row, factor in zip(out, (_B, _C)):
            row[some] = mixed(np.add.reduceat(mixed(hashes * factor + _A), begin) + sizes.astype(np.uint64))
    return out[0].view(np.int64), out[1].view(np.int64)


def described(sets: list[np.ndarray], keys: np.ndarray, counts: np.ndarray) -> dict:
    """The columns n, c1, c2 and cells of a piece's sets."""
    one, two = identities(sets)
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return {
        "n": np.array([len(s) for s in sets], np.int64), "c1": one, "c2": two,
        "cells": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys, pa.int64())),
    }


def _bit(doc: Column) -> Column:
    return F.xxhash64(doc).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def full_sets(df: DataFrame, doc: str, text: str, wanted: DataFrame, shingle: int) -> DataFrame:
    """(c, n, hashes) of the wanted sets (c, head, c1, c2), read again from the texts of their first documents.

    A filter of fixed size over the ids keeps most other texts from being read again; what passes it wrongly is dropped by the join.
    """
    words = wanted.select(_bit(F.col("head")).alias("bit")).groupBy(F.floor(F.col("bit") / 32).alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 32 AS int)))").alias("v"))
    found = np.zeros((1 << FILTER_BITS) // 32, np.uint32)
    for r in words.toLocalIterator():  # at most 2 ** FILTER_BITS / 32 rows
        found[r.w] = r.v
    shared = df.sparkSession.sparkContext.broadcast(found)

    def work(batches):
        for batch, texts in pieces(batches):
            bits = np.asarray(batch.column("bit"))
            keep = np.flatnonzero((shared.value[bits >> 5] >> (bits & 31).astype(np.uint32)) & np.uint32(1))
            sets = shingle_sets([texts[i] for i in keep], shingle)
            one, two = identities(sets)
            made = [pa.array(one), pa.array(two), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(keep)), *made], ["head", "c1", "c2", "hashes"])

    rows = df.select(F.col(quoted(doc)).cast("long").alias("doc"), F.col(quoted(text)).cast("binary").alias("text"))
    rows = rows.withColumn("bit", _bit(F.col("doc")))
    made = rows.mapInArrow(lean(work), "head long, c1 long, c2 long, hashes binary").filter("length(hashes) > 0")
    met = made.withColumn("head", F.coalesce("head", F.lit(-1))).join(wanted.withColumn("head", F.coalesce("head", F.lit(-1))), ["c1", "c2", "head"])
    met = met.select("c", "hashes").dropDuplicates(["c"])  # rows that repeat an id and a text
    out = cut(met.select("c", F.floor(F.length("hashes") / 8).alias("n"), "hashes"))
    shared.destroy()
    return out


def pairs_that(pairs: DataFrame, table: DataFrame, value: str, kind: str, holds) -> DataFrame:
    """The pairs (a, b) for whose arrays and sizes ``holds`` is true; ``table`` has c, n and the value."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                x, y = ([np.frombuffer(v, kind) for v in part.column(side).to_pylist()] for side in ("x", "y"))
                keep = holds(x, y, np.asarray(part.column("nx")), np.asarray(part.column("ny")))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = table.select(F.col("c").alias("a"), F.col("n").alias("nx"), F.col(value).alias("x"))
    right = table.select(F.col("c").alias("b"), F.col("n").alias("ny"), F.col(value).alias("y"))
    # The smaller set of a pair may be in very many: it is joined last, when rows are large enough for Spark to split them.
    return pairs.join(left, "a").join(right, "b").select("a", "b", "nx", "ny", "x", "y").mapInArrow(lean(run), "a long, b long")


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets (c, n, hashes)."""
    def holds(x, y, nx, ny):
        shared = np.array([len(np.intersect1d(p, q, True)) for p, q in zip(x, y)], np.int64)
        return may_link(shared, nx, ny, percent)

    return pairs_that(pairs, full, "hashes", "<u8", holds)


def printed(full: DataFrame) -> DataFrame:
    """(c, n, prints: the last 16 bits of each hash, in their own order) of the full sets (c, n, hashes)."""
    def run(batches):
        for batch in batches:
            made = [np.sort(np.frombuffer(x, "<u2")[::4]).tobytes() for x in batch.column("hashes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("n"), pa.array(made, pa.binary())], ["c", "n", "prints"])

    return full.mapInArrow(lean(run), "c long, n long, prints binary")


def spanning(rows: pa.Table, candidates: Callable[[Block], Iterable[tuple[int, np.ndarray]]], percent: int, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs between the labels of a block that are linked by all but their full sets: as few as join all labels that its candidates join.

    ``candidates`` gives, for places of the left side, places of the right; they are judged by their prints, which never miss a link. Those
    whose labels are joined by then are not compared. With ``every`` no labels are joined, and all pairs are given.
    """
    block = Block(rows)
    marked = np.zeros(int(block.marks.max()) + 1, bool)
    a, b = [], []
    for i, near in candidates(block):
        near = near[block.label[near] != block.label[i]]
        if not len(near):
            continue
        own = block.marks[block.begin[i] : block.begin[i] + block.n[i]]
        marked[own] = True
        upto = np.cumsum(block.n[near])
        shared = np.add.reduceat(marked[block.marks[ramps(block.begin[near], block.n[near])]].astype(np.int64), upto - block.n[near])
        marked[own] = False
        for j in near[may_link(shared, block.n[i], block.n[near], percent)].tolist():
            if block.label[j] != block.label[i]:
                a.append(block.c[i])
                b.append(block.c[j])
                if not every:
                    block.label[block.label == block.label[j]] = block.label[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def with_hubs(held: DataFrame) -> DataFrame:
    """(cell, c, low) of the cells that several sets share, from (cell, c); ``low`` is the cell's set that meets the most others in its cells.

    The text that a family of near copies was made from has the cells that most of them have, so it is linked to more of
    them than any other, and one comparison a copy joins the family.
    """
    sizes = held.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = cut(held.join(sizes, "cell").select("cell", "c", "size"))
    met = members.groupBy("c").agg(F.sum("size").alias("met"))
    ranked = members.join(met, "c").select("cell", "c", "met")
    hub = ranked.groupBy("cell").agg(F.min(F.struct(-F.col("met"), F.col("c").alias("low"))).alias("hub")).select("cell", "hub.low")
    return cut(members.select("cell", "c").join(hub, "cell"))


def classes(
    df: DataFrame, doc: str, text: str, describe: Callable[[list], dict], sketched: Callable[[DataFrame, DataFrame], DataFrame], kind: str,
    holds: Callable, candidates: Callable[[Block], Iterable[tuple[int, np.ndarray]]], percent: int, shingle: int, block: int = BLOCK,
    columns: str = "", hubs: bool = False, carry: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(documents: doc, n, c1, c2; sets: c, c1, c2, head the smallest document, label of its component).

    ``describe`` gives n, c1, c2, cells and further ``columns`` of texts. ``sketched`` makes (c, n, sketch) from the sets and the full sets
    (c, n, hashes); ``holds`` judges pairs of sketches, numpy arrays of the ``kind``, as ``pairs_that`` wants it. ``candidates`` finds in a
    block all that may be linked, by prints and, with ``carry``, sketches. Only pairs that join labels leave its task, fewer than it has rows;
    in cells of which one turns out not to be linked, all pairs of labels that are still apart are then judged.
    In each cell the sets are first held against the one with the smallest number, or,
    with ``hubs``, against the one that shares its cells with the most others.
    """
    rows = each_piece(df, describe, "n long, c1 long, c2 long, cells array<long>" + columns, text, [doc])
    rows = cut(rows.withColumn("doc", F.col(f"row.{quoted(doc)}").cast("long")).drop("row"))
    rest = [c for c in rows.columns if c not in ("doc", "c1", "c2")]
    sets = rows.filter("n > 0").groupBy("c1", "c2").agg(F.min("doc").alias("head"), *[F.first(c).alias(c) for c in rest])
    sets = cut(sets.withColumn("c", F.monotonically_increasing_id()))  # fixed once it is written

    held = sets.select(F.explode("cells").alias("cell"), "c")
    if hubs:
        members = with_hubs(held)
    else:
        shared = held.groupBy("cell").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").drop("high")
        members = cut(held.join(shared, "cell").select("cell", "c", "low"))
    names = sets.select("c", "head", "c1", "c2")
    full = full_sets(df, doc, text, members.select("c").distinct().join(names, "c"), shingle)
    sketches = sketched(sets, full)

    tried = members.filter("c <> low").select(F.col("c").alias("a"), F.col("low").alias("b")).distinct()
    near = cut(verified(pairs_that(tried, sketches, "sketch", kind, holds), full, percent))
    labels = components(near)
    steps = full.select("c", size_step(F.col("n"), percent).alias("step"))
    named = members.select("cell", "c").join(labels, "c", "left").select("cell", "c", F.coalesce("label", "c").alias("label"))
    opened = cut(open_cells(cut(named)).join(steps, "c"))
    opened = narrowed(opened, full, percent, block)
    carried = printed(full).join(sketches.select("c", "sketch"), "c") if carry else printed(full)
    carried = cut(carried.join(opened.select("c").distinct(), "c", "left_semi"))

    def pairs(opened: DataFrame, every: bool) -> DataFrame:
        placed = block_pairs(opened, block_of(F.col("step"), percent, block)).join(carried, "c")
        return cut(searched(placed, lambda rows: spanning(rows, candidates, percent, every)))

    found = pairs(opened, False)
    near = cut(verified(found.select("a", "b").distinct(), full, percent))
    labels = joined_components(labels, near)
    failed = cut(found.join(near, ["a", "b"], "left_anti").select("cell").distinct())
    if not failed.isEmpty():  # a pair that is not linked may have stood in for one that is
        labels = cut(labels)
        rest = opened.drop("label").join(failed, "cell").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
        rest = pairs(cut(rest.select(*opened.columns)), True).select("a", "b").distinct()
        labels = joined_components(labels, cut(verified(rest, full, percent)))
    return rows.select("doc", "n", "c1", "c2"), cut(names.join(labels, "c", "left").select(*names.columns, F.coalesce("label", "c").alias("label")))


def by_document(documents: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id: the smallest id reachable by links) of every row, from ``classes``."""
    smallest = sets.groupBy("label").agg(F.min("head").alias("component_id"))
    named = cut(sets.join(smallest, "label").select("c1", "c2", "component_id"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))
    return documents.join(named, ["c1", "c2"], "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"))
