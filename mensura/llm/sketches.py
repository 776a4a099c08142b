"""HyperMinHash near-duplicates: texts whose sets of word shingles overlap enough, found by compressed MinHash registers.

A set's shingles are dealt into ``REGISTERS`` buckets by their hash. A register keeps of its bucket's smallest hash only the count of
leading zeros and the next ``MANTISSA`` bits, two bytes in all; 0 stands for an empty bucket. Sets that share a cell have more of them, of
the same kind, to be judged by. Two registers are equal where the smallest
hashes are, and now and then by a collision, whose expected number follows from the sizes of the sets and is taken off the estimate.

Registers are cut into bands; sets with an equal band share a cell. Sets of sizes a and b that are linked differ in at most
``d = (a + b) * (100 - p) / (100 + p)`` shingles, each of which lies in one band. How many bands there are depends on the size, by classes; a
set near the end of its class also appears in the next. Up to about 150 shingles there are more than d bands, so linked sets surely
share one. Larger sets have ``MOST_BANDS`` bands of four registers: a pair at the very threshold shares none with a chance of about
1e-8 at 85 %, and less above it. A band with one filled register or none says little, and a set leaves its thin bands out unless they are
more than the class has to spare.

Candidates are judged by their registers first. One is dropped only if it surely is not linked (more registers differ than
shingles may), or if linked sets would agree in so few registers with a chance below ``MISSED``; what remains is verified on the
full sets. In every cell, sets are first held against the one that meets the most others in its cells; what that links becomes one component.
Cells that then still hold several are compared across components in blocks of at most ``block`` sets, by steps of size; larger cells are
first replaced by cells of rare shingles. A block's
candidates are compared by 16 bits of each shingle, unless links found there have joined them; only pairs that join components are handed on,
to be verified on the full sets.

Equal sets are one set throughout, told apart by 128 bits, and copies are never paired; null and empty texts and texts without words have the
empty set and no links. Repeated rows are rows of one set. A null id counts as larger than any other. An empty table
gives an empty result. Only ``doc`` and ``text`` are read, so no other column can clash.
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
from mensura.llm.batches import lean
from mensura.llm.blocks import BLOCK, Block
from mensura.llm.joining import mixed, most_different, shingle_sets
from mensura.session import cut

SHINGLE, PERCENT = 3, 85
REGISTERS, BUCKET_BITS, MANTISSA = 128, 7, 10
JUDGED_BITS = 9  # sets that share a cell have 2 ** JUDGED_BITS registers to be judged by
MOST_BANDS = 32
MISSED = 1e-10
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


# --- registers -------------------------------------------------------------------------------------------


def registers(sets: list[np.ndarray], bits: int = BUCKET_BITS) -> np.ndarray:
    """The 2 ** bits registers of every set of sorted hashes: 1 + leading zeros * 2 ** MANTISSA + mantissa of each bucket's smallest, 0 if empty."""
    out = np.zeros((len(sets), 1 << bits), np.uint16)
    sizes = np.array([len(s) for s in sets], np.int64)
    hashes = np.concatenate([*sets, np.zeros(0, np.uint64)])
    if not len(hashes):
        return out
    owner = np.repeat(np.arange(len(sets)), sizes)
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    place = (owner << bits) + bucket
    first = np.concatenate([[True], place[1:] != place[:-1]])  # hashes ascend, so a bucket's first is its smallest
    rest = (hashes[first] << np.uint64(bits)) >> np.uint64(11)  # 53 bits, exact in floating point
    half, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.where(rest > 0, 53 - exponent, 53)
    digits = np.where(rest > 0, np.floor((half - 0.5) * (2 << MANTISSA)), 0).astype(np.int64)
    out.reshape(-1)[place[first]] = 1 + (zeros << MANTISSA) + digits
    return out


def expected_collisions(a: np.ndarray, b: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """In how many registers sets of sizes a and b without common shingles agree.

    The smallest of r uniform hashes in a bucket has about the density r exp(-r x); where both lie between 2 ** -(i + 1) and 2 ** -i, a
    register tells places of width 2 ** -(i + 1 + MANTISSA) apart.
    """
    x, y = np.asarray(a, np.float64) / registers, np.asarray(b, np.float64) / registers
    low = 0.5 ** np.arange(1, 54)
    both = (x + y)[..., None]
    inside = np.exp(-both * low) - np.exp(-both * 2 * low)
    return registers * (x * y / np.maximum(x + y, 1e-300)) * (inside * low).sum(-1) / (1 << MANTISSA)


def agreement(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(registers that are equal and filled, registers that either fills)."""
    filled = (one | other) != 0
    return ((one == other) & filled).sum(-1), filled.sum(-1)


def estimated(equal: np.ndarray, filled: np.ndarray, a: np.ndarray, b: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The Jaccard similarity by the registers, less the collisions to be expected among those that differ."""
    share = equal / np.maximum(filled, 1)
    by_chance = expected_collisions(a, b, registers) / registers
    return np.clip((share - by_chance) / (1 - by_chance), 0, 1)


@lru_cache
def least_estimates(percent: int, registers: int = REGISTERS, missed: float = MISSED) -> np.ndarray:
    """For each number of filled registers, the estimate below which linked sets fall with a chance under ``missed`` (Chernoff's bound)."""
    p, out = percent / 100, np.zeros(registers + 1)
    for n in range(1, registers + 1):
        for k in range(n + 1):
            q = k / n
            far = (q * math.log(q / p) if k else 0) + ((1 - q) * math.log((1 - q) / (1 - p)) if k < n else 0)
            if q >= p or n * far < -math.log(missed):
                out[n] = (k - 1) / n  # one register of slack for the correction
                break
    return out


def may_be_linked(one: np.ndarray, other: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of sizes a and b with such registers are candidates."""
    equal, filled = agreement(one, other)
    a, b = np.broadcast_to(a, equal.shape), np.broadcast_to(b, equal.shape)
    least = least_estimates(percent, one.shape[-1])[filled]
    keep = filled - equal <= (a + b) * (100 - percent) // (100 + percent)  # a differing shingle spoils one register at most
    keep &= (equal >= least * filled) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    some = np.flatnonzero(keep)  # the correction only lowers the estimate
    keep[some] = estimated(equal[some], filled[some], a[some], b[some], one.shape[-1]) >= least[some]
    return keep


# --- bands -------------------------------------------------------------------------------------------------


def spare_bands(bands: int) -> int:
    """How many bands are allowed to be thin: about three deviations above what is expected with five shingles a band."""
    expected = 0.05 * bands
    return math.ceil(expected + 3 * math.sqrt(expected))


@lru_cache
def size_classes(percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest size, bands, spare bands) of each class; no bands where only equal sets can be linked."""
    first, bands, spare = [1], [0], [0]
    at = next(n for n in range(1, 1000) if most_different(2 * n, percent) or most_different(2 * n - 1, percent))
    while True:
        top = at * 5 // 4 + 1
        need = most_different(2 * top, percent) + 1
        first.append(at)
        spare.append(spare_bands(min(need, MOST_BANDS)))
        if need + spare[-1] >= MOST_BANDS:
            bands.append(MOST_BANDS)
            return np.array(first), np.array(bands), np.array(spare)
        bands.append(need + spare[-1])
        at = top + 1


def cells(regs: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(cells of all sets in order, how many each set has)."""
    first, bands, spare = size_classes(percent)
    own = np.searchsorted(first, sizes, "right") - 1
    later = np.searchsorted(first, sizes * 100 // percent, "right") - 1
    found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    spread = mixed(regs.astype(np.uint64) + np.arange(1, REGISTERS + 1, dtype=np.uint64) * _A)
    filled = regs != 0
    for c in np.unique(np.concatenate([own, later])).tolist():
        k = int(bands[c])
        rows = np.flatnonzero((sizes > 0) & ((own == c) | (later == c)))
        if not k or not len(rows):
            continue
        begin = np.arange(k) * REGISTERS // k
        label = mixed(np.arange(k, dtype=np.uint64) * _B + np.full(k, c, np.uint64) * _C)
        keys = mixed(np.add.reduceat(spread[rows], begin, axis=1) + label)
        thin = np.add.reduceat(filled[rows].astype(np.int64), begin, axis=1) <= 1
        none = np.add.reduceat(filled[rows].astype(np.int64), begin, axis=1) == 0
        keep = ~none & ~(thin & (thin.sum(1) <= spare[c])[:, None])
        found.append(keys[keep])
        owners.append(np.repeat(rows, k)[keep.ravel()])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order].view(np.int64), np.bincount(owner, minlength=len(regs))


# --- the operator --------------------------------------------------------------------------------------------


def _described(texts: list[bytes | None], shingle: int, percent: int) -> dict:
    sets = shingle_sets(texts, shingle)
    return joining.described(sets, *cells(registers(sets), np.array([len(s) for s in sets], np.int64), percent))


def judged_by(full: DataFrame) -> DataFrame:
    """(c, n, sketch: the registers by which pairs are judged) of the full sets (c, n, hashes)."""
    def run(batches):
        for batch in batches:
            regs = registers([np.frombuffer(x, "<u8") for x in batch.column("hashes").to_pylist()], JUDGED_BITS).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("n"), pa.array([r.tobytes() for r in regs], pa.binary())], ["c", "n", "sketch"])

    return full.mapInArrow(lean(run), "c long, n long, sketch binary")


def _candidates(block: Block, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of the left side those of other labels on the right that may be linked."""
    regs, n, right = np.frombuffer(b"".join(block.sketches), "<u2").reshape(-1, 1 << JUDGED_BITS), block.n, block.right
    for i in block.left.tolist():
        near = right[(block.label[right] != block.label[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
        if len(near):
            yield i, near[may_be_linked(regs[near], regs[i], n[near], n[i], percent)]


def classes(
    df: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(documents: doc, n, c1, c2; sets: c, c1, c2, head the smallest document, label of its component)."""
    return joining.classes(
        df, doc, text, lambda texts: _described(texts, shingle, percent), lambda sets, full: cut(judged_by(full)), "<u2",
        lambda x, y, nx, ny: may_be_linked(np.stack(x), np.stack(y), nx, ny, percent),
        lambda found: _candidates(found, percent), percent, shingle, block, hubs=True, carry=True)


def near_duplicates(
    df: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, n_shingles, component_id: the smallest id reachable by links, kept: whether it is the row's own) of every row."""
    found = joining.by_document(*classes(df, doc, text, percent, shingle, block))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
