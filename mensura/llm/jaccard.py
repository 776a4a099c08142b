"""N-gram Jaccard join: texts whose sets of word shingles overlap almost wholly, by trees over vectors of group counts.

A text's shingles are hashed into groups; how many fall into each group makes it a point. Two texts share at most the sum of the
smaller coordinates, so points for which that sum is too small cannot be linked.

Over many texts the groups are dealt into bands. Sets of sizes a and b that are similar enough differ in at most
``d = (a + b) * (100 - p) / (100 + p)`` shingles; with more than d bands, some band has equal counts in both. So linked texts
meet in a cell (a band's point) of at least one band's tree, and cells are what Spark groups by. How many bands there are
depends on the set's size, by classes of sizes; a set near the end of its class also appears in the next.

Bands with one shingle or none say little: many texts meet there by chance. There are e bands more than d + 1, so linked texts agree
in e + 1 at least; a set with at most e such thin bands leaves them out and still meets its partners in another, and only
the rare set with more of them keeps them.

Within cells, first every set is verified against the cell's smallest, and links are contracted to components.
Cells that then still hold several components are searched for pairs of different components by trees of at most
``BLOCK`` points a side, by steps of size; nodes keep the largest coordinates below them, and survivors are compared by 16 bits
of each shingle; a task hands on only pairs that join components, fewer than it has sets, to be verified on the sets themselves. Pairs within a component are never formed, so a group of near copies costs about one comparison for each copy. What
this join has in common with others is in :mod:`mensura.llm.joining`.

Equal sets are one set throughout, told apart by 128 bits, and copies are never paired. Null and empty texts and texts without words have
the empty set and no links. Repeated rows are rows of one set. A null id counts as larger than any other. An empty table gives an
empty result. Only the id and the text are read, so no other column can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm import joining
from mensura.llm.batches import each_piece, lean, quoted
from mensura.llm.blocks import BLOCK, Block
from mensura.llm.joining import identities, mixed
from mensura.session import cut

SHINGLE = 3
PERCENT = 90
GROUPS = 256  # coordinates of a point
CELL_BITS = 48  # of a hash, for the coordinate within a band: with few, unrelated texts would often meet in a cell
THIN_SHARE = 0.023  # of the bands of a set that is smallest for its class, those with one shingle or none
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def shingle_sets(texts: list[bytes | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    return joining.shingle_sets(texts, shingle)


def may_link(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return joining.may_link(shared, a, b, percent)


def most_different(total: int, percent: int = PERCENT) -> int:
    return joining.most_different(total, percent)


# --- sizes and bands -----------------------------------------------------------------------------


def spare_bands(bands: int) -> int:
    """How many of the bands are allowed to be thin: about three deviations above what the thinnest sets of a class expect."""
    expected = bands * THIN_SHARE
    return math.ceil(expected + 3 * math.sqrt(expected))


@lru_cache
def size_classes(percent: int = PERCENT, upto: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest size, bands, spare bands) of each class; no bands where only equal sets can be linked."""
    first = [1]
    while first[-1] < upto:
        step = first[-1] * 3 // 2 + 1
        if len(first) == 1:
            step = next(n for n in range(1, 1000) if most_different(2 * n, percent) or most_different(2 * n - 1, percent))
        first.append(max(step, first[-1] + 1))
    tops = [n - 1 for n in first[1:]] + [upto]
    need = [d + 1 if (d := most_different(2 * top, percent)) else 0 for top in tops]
    spare = [spare_bands(n) if n else 0 for n in need]
    return np.array(first), np.array(need) + np.array(spare), np.array(spare)


def cells(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(cells of all sets in order, how many each set has)."""
    first, bands, spare = size_classes(percent)
    sizes = np.array([len(s) for s in sets], np.int64)
    hashes = np.concatenate([*sets, np.zeros(0, np.uint64)])
    # A cell is known by two sums over its shingles, each of a 24-bit weight of the coordinate: exact in floating point.
    weight = mixed((hashes >> np.uint64(64 - CELL_BITS)) * _A)
    weights = [((weight >> np.uint64(b)) & np.uint64(0xFFFFFF)).astype(np.float64) for b in (0, 24)]
    owner = np.repeat(np.arange(len(sets)), sizes)
    own = np.searchsorted(first, sizes, "right") - 1
    later = np.searchsorted(first, sizes * 100 // percent, "right") - 1
    found, owners = [], []
    for which, there in ((own, sizes > 0), (later, (sizes > 0) & (later > own))):
        k = np.where(there, bands[which], 0)
        begin = np.cumsum(k) - k
        mine = (k > 0)[owner]
        at = begin[owner[mine]] + (hashes[mine] % k[owner[mine]].astype(np.uint64)).astype(np.int64)
        total = int(k.sum())
        one, two = (np.bincount(at, w[mine], total).astype(np.uint64) for w in weights)
        whose = np.repeat(np.arange(len(sets)), k)
        nth = np.arange(total) - np.repeat(begin, k)
        label = which[whose].astype(np.uint64) * _C + nth.astype(np.uint64) * _D
        thin = np.bincount(at, minlength=total) <= 1
        few = np.bincount(whose[thin], minlength=len(sets)) <= spare[which]
        keep = ~(thin & few[whose])
        found.append(mixed(one * _A + two * _B + mixed(label))[keep])
        owners.append(whose[keep])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(found)[order].view(np.int64), np.bincount(np.concatenate(owners), minlength=len(sets))


def _described(texts: list[bytes | None], percent: int) -> dict:
    sets = shingle_sets(texts)
    return joining.described(sets, *cells(sets, percent))


# --- points and trees ------------------------------------------------------------------------------


def point(hashes: np.ndarray) -> np.ndarray:
    """Shingles in each group."""
    return np.bincount((hashes & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def may_link(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of sizes a and b that share so many shingles are linked."""
    return 100 * shared >= percent * (a + b - shared)


class CountTree:
    """A packed R-tree of points: nodes hold the largest coordinates, the smallest set and the components below them."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, fan: int = 16):
        self.order = np.lexsort((points[:, 0], sizes, labels)) if len(points) else np.zeros(0, np.int64)
        self.fan = fan
        self.levels = [(points[self.order], sizes[self.order], labels[self.order], labels[self.order])]
        while len(self.levels[-1][0]) > fan:
            p, s, low, high = self.levels[-1]
            begin = np.arange(0, len(p), fan)
            self.levels.append((np.maximum.reduceat(p, begin), np.minimum.reduceat(s, begin), np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin)))

    def search(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
        """(query, found) for all points of other components that the bound lets through."""
        top = len(self.levels[-1][0])
        q, node = (x.ravel() for x in np.indices((len(points), top)))
        for depth in range(len(self.levels) - 1, -1, -1):
            p, s, low, high = self.levels[depth]
            keep = np.zeros(len(q), bool)
            for i in range(0, len(q), 4096):
                a, b = q[i : i + 4096], node[i : i + 4096]
                bound = np.minimum(np.minimum(points[a], p[b]).sum(1), sizes[a])
                keep[i : i + 4096] = may_link(bound, sizes[a], s[b], percent) & ~((low[b] == high[b]) & (low[b] == labels[a]))
            q, node = q[keep], node[keep]
            if depth:
                width = len(self.levels[depth - 1][0])
                child = node[:, None] * self.fan + np.arange(self.fan)
                inside = child < width
                q, node = np.repeat(q, inside.sum(1)), child[inside]
        return q, self.order[node]


# --- the join --------------------------------------------------------------------------------------


def points_of(full: DataFrame) -> DataFrame:
    """(c, n, sketch: the point) of every set."""
    def run(batches):
        for batch in batches:
            made = [point(np.frombuffer(x, "<u8")).astype("<i4").tobytes() for x in batch.column("hashes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("n"), pa.array(made, pa.binary())], ["c", "n", "sketch"])

    return full.mapInArrow(lean(run), "c long, n long, sketch binary")


def _candidates(block: Block, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of the left side those of the right that its tree lets through."""
    cells = (np.repeat(np.arange(len(block.n)) * GROUPS, block.n) + (block.prints & (GROUPS - 1)))
    points = np.bincount(cells, minlength=len(block.n) * GROUPS).astype(np.int32).reshape(-1, GROUPS)
    left, right = block.left, block.right
    tree = CountTree(points[right], block.n[right], block.label[right])
    q, found = tree.search(points[left], block.n[left], block.label[left], percent)
    order = np.argsort(q, kind="stable")
    q, found = q[order], found[order]
    edges = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])).tolist() if len(q) else []
    for at, to in zip(edges, [*edges[1:], len(q)]):
        yield int(left[q[at]]), right[found[at:to]]


def classes(df: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = PERCENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents: doc, n shingles, c1 and c2 the set's identity; sets: c1, c2, head the smallest document, label of its component)."""
    def holds(x, y, nx, ny):
        bound = np.array([np.minimum(p, q).sum() for p, q in zip(x, y)], np.int64)
        return may_link(bound, nx, ny, percent)

    return joining.classes(
        df, doc, text, lambda texts: _described(texts, percent), lambda sets, full: cut(points_of(full)), "<i4", holds,
        lambda found: _candidates(found, percent), percent, SHINGLE, block)


def one_of_each(df: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row of each component, with the input's own columns: that of the smallest id, or one of those that repeat it.

    Rows without words stay. Rows are met again by id and set, so that rows which share an id but not a text are told apart.
    """
    _, sets = classes(df, doc, text, percent, block)
    first = F.min(F.struct(F.col("head").isNull().alias("none"), "head", "c1", "c2"))
    kept = cut(sets.groupBy("label").agg(first.alias("k")).select(
        "k.c1", "k.c2", F.coalesce("k.head", F.lit(-1)).alias("id"), F.col("k.none").alias("none")))
    empty = ~F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    worded = each_piece(df.filter(~empty), lambda texts: dict(zip(("c1", "c2"), identities(shingle_sets(texts)))), "c1 long, c2 long", text)
    own = F.col(f"row.{quoted(doc)}").cast("long")
    rows = worded.select("row", "c1", "c2", F.coalesce(own, F.lit(-1)).alias("id"), own.isNull().alias("none"))
    keys = ["c1", "c2", "id", "none"]
    return rows.join(kept, keys).dropDuplicates(keys).select("row.*").union(df.filter(empty))


def linked_documents(df: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id: the smallest id reachable by links) of every row."""
    return joining.by_document(*classes(df, doc, text, percent, block))
