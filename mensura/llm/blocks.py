"""Which members of a cell are to be compared: pairs of bounded blocks of sets that are not known to be connected."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.batches import lean, pieces
from mensura.llm.bpe import ramps
from mensura.session import cut

BLOCK = 512
HELD_SHINGLES = 1 << 21  # of the sets of one block
RARITY_BITS, SIZE_CLASSES = 20, 4  # buckets that count shingles; classes of sizes between those of sets that can just be linked


class Block:
    """The rows of a task as numpy arrays; ``label`` follows the links that are found.

    A set's ``prints`` are 16 bits of each of its hashes. ``marks`` tells those of one set apart that are equal, so that two sets have at
    least as many marks in common as hashes.
    """

    def __init__(self, rows: pa.Table):
        self.c, self.label, self.side, self.n = (np.array(np.asarray(rows.column(x))) for x in ("c", "label", "side", "n"))
        self.prints = np.frombuffer(b"".join(rows.column("prints").to_pylist()), "<u2").astype(np.int64)
        self.sketches = rows.column("sketch").to_pylist() if "sketch" in rows.column_names else None
        self.begin = np.cumsum(self.n) - self.n
        self.left, self.right = np.flatnonzero(self.side <= 1), np.flatnonzero(self.side >= 1)  # 1: both sides
        at = np.arange(len(self.prints))
        new = np.concatenate([[True], self.prints[1:] != self.prints[:-1]])  # prints of a set ascend
        new[self.begin] = True
        self.marks = self.prints + ((at - np.maximum.accumulate(np.where(new, at, 0))) << 16)


def size_step(n: Column, percent: int) -> Column:
    """Steps of sizes a little wider than the ratio of linked sets can be, which are so at most one apart."""
    return F.floor(F.ln(n.cast("double")) / (math.log(100 / percent) * 1.000001)).cast("int")


def block_of(step: Column, percent: int, block: int = BLOCK) -> Column:
    """How many sets of a step make a block: at most ``block``, and fewer of sets so large that they hold ``HELD_SHINGLES``."""
    largest = F.exp((step + 1) * (math.log(100 / percent) * 1.000001))
    return F.least(F.lit(block), F.greatest(F.lit(1), F.floor(HELD_SHINGLES / largest))).cast("int")


def open_cells(members: DataFrame) -> DataFrame:
    """The members (cell, c, label, ...) of cells that hold more than one label, and how many (size); of cells with the same members, told apart
    by 128 bits, one.

    With a column ``part``, a cell of which one part is missing is left out.
    """
    whole = F.coalesce(F.min("part") < F.max("part"), F.lit(True)) if "part" in members.columns else F.lit(True)
    spread = members.groupBy("cell").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("c")).alias("one"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("two"),
        whole.alias("whole")).filter("low < high and whole")
    return members.join(spread.groupBy("size", "one", "two").agg(F.min("cell").alias("cell")).select("cell", "size"), "cell")


def rarity(sets: DataFrame) -> np.ndarray:
    """How many of the sets (hashes) hold a shingle, by ``RARITY_BITS`` bits of it: 2 ** RARITY_BITS numbers, however many sets there are."""
    def run(batches):
        held = np.zeros(1 << RARITY_BITS, np.int64)
        for _, hashes in pieces(batches):
            found = np.frombuffer(b"".join(hashes), "<u8") >> np.uint64(64 - RARITY_BITS)
            held += np.bincount(found.astype(np.int64), minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])

    rows = sets.select(F.col("hashes").alias("text")).mapInArrow(lean(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << RARITY_BITS, np.int64)
    out[np.asarray(rows.column("bucket"))] = np.asarray(rows.column("n"))
    return out


def first_shingles(hashes: list[np.ndarray], often: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """(place of the set, shingle, class, other class) of the rows of sets: two that may be linked have one in common, with classes exchanged.

    All shingles have one order, those of which there are fewer by ``often`` first. The first that two sets have in common is at most as far
    in one of them as the sizes of both allow: what follows it must be enough for a link. Sizes are dealt into classes. A shingle that no other
    set holds is left out.
    """
    shingles, places, owners = [], [], []
    for i, x in enumerate(hashes):
        count = often[(x >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
        first = np.argsort(count, kind="stable")[: len(x) - -(-percent * len(x) // 100) + 1]  # hashes ascend, so ties go by them
        some = np.flatnonzero(count[first] > 1)
        shingles.append(x[first[some]])
        places.append(some)
        owners.append(np.full(len(some), i))
    shingles, place, owner = (np.concatenate(x) for x in (shingles, places, owners))
    n = np.array([len(x) for x in hashes])[owner]

    def size_class(size: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(size, 1)) * (SIZE_CLASSES / math.log(100 / percent))).astype(np.int64)

    least, most = -(-percent * n // 100), np.minimum((100 + percent) * (n - place) // percent - n, 100 * n // percent)
    own, begin = size_class(n), size_class(least)
    times = np.where(most >= least, size_class(most) - begin + 1, 0)
    return np.repeat(owner, times), np.repeat(shingles, times), np.repeat(own, times), ramps(begin, times)


def narrowed(members: DataFrame, full: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(cell, c, label, step, part) from members (cell, c, label, step, size), with smaller cells in place of those of more than ``block`` sets.

    Linked sets of such cells share one by a shingle among the rarest of each, and by the classes of their sizes; of two classes, the sets of
    one ``part`` are to meet those of the other only. Copies that are too far from each other to be linked have so many shingles of their own that
    they hardly meet there, however many they are. ``full`` has (c, hashes).
    """
    large = members.filter(F.col("size") > block)
    members = members.filter(F.col("size") <= block).select("cell", "c", "label", "step", F.lit(None).cast("int").alias("part"))
    if large.isEmpty():
        return members
    wide = large.groupBy("c").agg(*[F.first(x).alias(x) for x in ("label", "step")])  # a set has one of each
    wide = cut(wide.join(full.select("c", "hashes"), "c"))
    shared = members.sparkSession.sparkContext.broadcast(rarity(wide))

    def run(batches):
        for piece, texts in pieces(batches):
            at, shingle, own, other = first_shingles([np.frombuffer(x, "<u8") for x in texts], shared.value, percent)
            rows = piece.select(["c", "label", "step"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(shingle.view(np.int64)), pa.array(own), pa.array(other)], ["c", "label", "step", "shingle", "own", "other"])

    rare = wide.withColumnRenamed("hashes", "text").mapInArrow(lean(run), "c long, label long, step int, shingle long, own long, other long")
    cell = F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other")).alias("cell")
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).alias("part")
    rare = open_cells(rare.select(cell, "c", "label", "step", side).repartition("cell"))  # dealt once for both uses
    out = cut(members.union(rare.select(*members.columns)))
    shared.destroy()
    return out


def block_pairs(members: DataFrame, block: int | Column = BLOCK) -> DataFrame:
    """(task, cell, c, label, side) from members (cell, c, label, step): a task's rows of side 0 or 1 meet those of side 1 or 2.

    Members of a cell are dealt into blocks by step and a hash of c. Blocks meet within a step and with the next one. A label with a
    block or more of rows in a step has blocks of its own, which do not meet each other; other labels share blocks. No cell is held
    whole, and no pairs within a label of many rows are formed; those of a cell's many labels are as many as it has blocks. ``block`` may
    depend on the step. With a column ``part``, rows of the same part of a cell do not meet either.
    """
    if "part" not in members.columns:
        members = members.withColumn("part", F.lit(None).cast("int"))
    counts = members.groupBy("cell", "step", "part", "label").agg(F.count(F.lit(1)).alias("rows"))
    own = F.when(F.col("rows") >= block, F.col("label"))
    nodes = counts.groupBy("cell", "step", "part", own.alias("own")).agg(F.ceil(F.sum("rows") / block).cast("int").alias("parts"))
    nodes = cut(nodes)
    slots = nodes.select("cell", "step", "part", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slot"))
    slots = slots.select("cell", F.struct("step", "part", "own", "slot").alias("node"))
    x, y = slots.select("cell", F.col("node").alias("x")), slots.select("cell", F.col("node").alias("y"))
    apart = F.col("y.step") - F.col("x.step")
    alike = [F.coalesce(F.col(f"x.{n}") == F.col(f"y.{n}"), F.lit(False)) for n in ("own", "part")]
    pairs = x.join(y, "cell").filter((F.col("x") <= F.col("y")) & (apart <= 1) & ~alike[0] & ~alike[1])
    pairs = cut(pairs.select("cell", "x", "y", F.xxhash64("cell", "x", "y").alias("task")))
    mine = counts.select("cell", "step", F.col("part").alias("its_part"), "label", own.alias("own"))
    keyed = members.join(mine, ["cell", "step", "label"]).filter(F.col("part").eqNullSafe(F.col("its_part"))).join(
        nodes.withColumnRenamed("own", "its").withColumnRenamed("part", "part_"), ["cell", "step"]).filter(
        F.col("own").eqNullSafe(F.col("its")) & F.col("part").eqNullSafe(F.col("part_")))
    slot = F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("slot")
    rows = cut(keyed.select("cell", "c", "label", F.struct("step", "part", "own", slot).alias("node")))
    first = rows.join(pairs.withColumnRenamed("x", "node"), ["cell", "node"]).select(
        "task", "cell", "c", "label", F.when(F.col("node") == F.col("y"), 1).otherwise(0).alias("side"))
    second = rows.join(pairs.filter("x <> y").withColumnRenamed("y", "node"), ["cell", "node"]).select("task", "cell", "c", "label", F.lit(2).alias("side"))
    return first.union(second)


def _runs(table: pa.Table, names: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal values."""
    change = np.zeros(max(0, table.num_rows - 1), bool)
    for n in names:
        v = np.asarray(table.column(n))
        change |= v[1:] != v[:-1]
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield table.slice(a, b - a)


def searched(placed: DataFrame, search: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Pairs (cell, a > b) that ``search`` finds in the rows of each task; ``placed`` has task, cell and what it needs."""
    dealt = placed.repartition("task").sortWithinPartitions("task", "cell")

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            runs = list(_runs(table, ["task", "cell"]))
            held = runs.pop().combine_chunks()  # its task may go on in the next batch
            for r in runs:
                yield found(r)
        if held is not None:
            yield found(held)

    def found(rows):
        a, b = search(rows)
        cell = pa.array(np.full(len(a), rows.column("cell")[0].as_py(), np.int64))
        return pa.RecordBatch.from_arrays([cell, pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], ["cell", "a", "b"])

    return dealt.mapInArrow(lean(run), "cell long, a long, b long")
