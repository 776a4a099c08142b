"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

Components become integers, so every distance is exact. Codebooks are refined in rounds, and each part carries Drake and Hamerly's
adaptive bounds from one round to the next: its ``b`` closest other entries with lower bounds of their distances in ascending
order, and one outer bound for all entries beyond them. After the entries have moved, bounds fall by as much as theirs did. A part
whose own entry is surely closer than the first bound keeps it; of the others only the entries whose bounds do not decide are
measured, in integers, or all of them where the outer bound does not decide either. Bounds are rounded down and distances up,
so ties and near ties are always measured; a tie goes to the lower index. ``b`` shrinks to what the parts needed in the last round.

Vectors that are null, hold null or non-finite components, or whose length is not that of the kept vector with the smallest id, are
left out, as are lengths that ``parts`` does not divide (an empty vector among them). Null ids come last; vectors that share an
id are ordered by their integers, and repeated rows are rows of their own. An empty table gives an empty result. A finite
component of 2 ** 14 or more in magnitude raises, as its squared distances would not be exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.batches import lean, quoted
from mensura.session import cut
from mensura.skew import join_by_key

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MOST = 1 << 22  # of an integer component: a part's squared distances stay below 2 ** 53
ROWS = 4096  # vectors that are worked on at once
DECIDED = 0.99  # of the parts that were measured: the share that the next round's bounds would have decided


# --- bounds of the parts at one position ---------------------------------------------------------------


def _down(x: np.ndarray) -> np.ndarray:
    """Below x, in four bytes."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """All squared distances; whole numbers below 2 ** 53, and so exact."""
    x, book = x.astype(np.float64), book.astype(np.float64)
    return (x * x).sum(1)[:, None] + (book * book).sum(1) - 2 * (x @ book.T)


def _ordered(low: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Bounds in ascending order: each at most the ones after it."""
    both = np.concatenate([low, outer[:, None]], axis=1)
    return np.ascontiguousarray(np.minimum.accumulate(both[:, ::-1], axis=1)[:, ::-1])


def fresh(x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, its squared distance, the next ``b`` entries, their bounds and the outer one) by measuring all entries."""
    d = squared(x, book)
    order = np.argsort(d, axis=1, kind="stable")  # equal distances: the lower index first
    d = np.take_along_axis(d, order, 1)
    low = np.full((len(x), b + 1), np.inf, np.float32)
    known = d[:, 1 : b + 2]
    low[:, : known.shape[1]] = _down(np.sqrt(known))
    return order[:, 0], d[:, 0], order[:, 1 : b + 1].astype(np.uint8), low


def again(
    x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, near: np.ndarray, low: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same after the entries moved by at most ``moved``, and how many bounds each part needed (b + 1: all entries measured)."""
    b = near.shape[1]
    diff = (x - book[code]).astype(np.float64)
    own = (diff * diff).sum(1)
    reach = _up(np.sqrt(own))
    fallen = low.astype(np.float64)
    fallen[:, :b] -= moved[near]
    fallen[:, b] -= moved.max()
    low = _ordered(_down(fallen[:, :b]), _down(fallen[:, b]))
    code, near = code.copy(), near.copy()
    depth = (low <= reach[:, None]).sum(1)  # a bound above the reach rules out its entry and all after it

    rows = np.flatnonzero((depth > 0) & (depth <= b))
    if len(rows):
        z = depth[rows]
        most = int(z.max())
        inside = np.arange(most) < z[:, None]
        some = near[rows, :most]
        d = x[rows][:, None, :] - book[some]
        key = np.full((len(rows), most + 1), np.iinfo(np.int64).max)
        key[:, 0] = own[rows].astype(np.int64) * 256 + code[rows]
        key[:, 1:][inside] = ((d * d).sum(2) * 256 + some)[inside]
        key.sort(axis=1)
        code[rows], own[rows] = key[:, 0] % 256, key[:, 0] // 256
        near[rows, :most] = np.where(inside, key[:, 1:] % 256, some)
        exact = _down(np.sqrt((key[:, 1:] // 256).astype(np.float64)))
        low[rows, :most] = np.where(inside, exact, low[rows, :most])
        low[rows] = _ordered(low[rows, :b], low[rows, b])
    rows = np.flatnonzero(depth > b)
    if len(rows):
        code[rows], own[rows], near[rows], low[rows] = fresh(x[rows], book, b)
    return code, own, near, low, depth


# --- one pass over the table --------------------------------------------------------------------------


STATE = "id long, label {}, x binary, code binary, near binary, low binary, depth binary, error long"


def _matrix(column: pa.Array, kind, *shape: int) -> np.ndarray:
    if not shape[-1]:
        return np.zeros((len(column), *shape), kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


def _blobs(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows).reshape(len(rows), -1)
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.py_buffer(rows.tobytes())])


def _pass(state: DataFrame, label: str, books: np.ndarray, old: np.ndarray | None, b: int) -> DataFrame:
    """The state (id, label, x, code, near, low, depth, error) after an assignment to ``books``; ``old``: those before them."""
    parts, entries, width = books.shape
    keep = min(b, entries - 1)
    moved = None if old is None else _up(np.sqrt(((books - old) ** 2).sum(2).astype(np.float64)))
    shared = state.sparkSession.sparkContext.broadcast((books, moved))  # parts * entries vectors

    def run(batches):
        books, moved = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n = part.num_rows
                x = _matrix(part.column("x"), "<i4", parts, width).astype(np.int64)
                code, depth, error = np.empty((n, parts), np.uint8), np.full((n, parts), 255, np.uint8), np.zeros(n)
                near, low = np.empty((n, parts, keep), np.uint8), np.empty((n, parts, keep + 1), np.float32)
                if moved is not None:
                    was = _matrix(part.column("code"), np.uint8, parts)
                    size = len(part.column("near")[0].as_py()) // parts
                    nears, lows = _matrix(part.column("near"), np.uint8, parts, size), _matrix(part.column("low"), "<f4", parts, size + 1)
                for p in range(parts):
                    if moved is None:
                        code[:, p], own, near[:, p], low[:, p] = fresh(x[:, p], books[p], keep)
                    else:
                        code[:, p], own, all_near, all_low, depth[:, p] = again(x[:, p], books[p], moved[p], was[:, p].astype(np.int64), nears[:, p], lows[:, p])
                        near[:, p], low[:, p] = all_near[:, :keep], all_low[:, : keep + 1]  # the first bound that goes is the outer one now
                    error += own
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("label"), part.column("x"), _blobs(code), _blobs(near), _blobs(low), _blobs(depth),
                    pa.array(error.astype(np.int64))], ["id", "label", "x", "code", "near", "low", "depth", "error"])

    columns = ["id", "label", "x"] if old is None else ["id", "label", "x", "code", "near", "low"]
    return state.select(*columns).mapInArrow(lean(run), STATE.format(label))


def _sums(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the entries after each became the mean of its parts, counts of the parts by the bounds that they needed)."""
    parts, entries, width = books.shape

    def run(batches):
        total, count, depths = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), np.zeros(256, np.int64)
        for batch in batches:
            x, code = _matrix(batch.column("x"), "<i4", parts, width), _matrix(batch.column("code"), np.uint8, parts).astype(np.int64)
            depths += np.bincount(_matrix(batch.column("depth"), np.uint8, parts).ravel(), minlength=256)
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=entries)
                for j in range(width):
                    total[p, :, j] += np.bincount(code[:, p], x[:, p, j], entries).astype(np.int64)  # whole numbers below 2 ** 53
        at = np.argwhere(count)
        rows = [(int(p), int(e), int(count[p, e]), total[p, e].tolist()) for p, e in at] + [(-1, int(d), int(depths[d]), [0] * width) for d in np.flatnonzero(depths)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([],) * 4, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["part", "entry", "n", "total"])

    made = state.select("x", "code", "depth").mapInArrow(lean(run), "part int, entry int, n long, total array<long>")
    found = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[j]) for j in range(width)]).alias("total"))
    books, needed = books.copy(), np.zeros(256, np.int64)
    for r in found.collect():  # a row for each entry
        if r.part < 0:
            needed[r.entry] = r.n
        else:
            books[r.part, r.entry] = [t // r.n for t in r.total]
    return books, needed


def next_bounds(needed: np.ndarray, b: int, entries: int) -> int:
    """How many bounds to keep: as many as ``DECIDED`` of the measured parts needed, an eighth of the entries at least, never more than before."""
    measured = needed[1 : b + 1]
    if not measured.sum():
        enough = 0
    else:
        enough = 1 + int(np.searchsorted(np.cumsum(measured), DECIDED * measured.sum()))
    return max(min(b, max(entries // 8, enough)), 1)


# --- the operator ---------------------------------------------------------------------------------------


def kept_vectors(df: DataFrame, vec: str, vector: str, label: str, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(id, label, v: integer components) of the vectors that take part."""
    rows = df.select(F.col(quoted(vec)).cast("long").alias("id"), F.col(quoted(label)).alias("label"), F.col(quoted(vector)).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above all numbers
    rows = rows.filter(F.col("v").isNotNull() & finite & (F.size("v") > 0) & (F.size("v") % parts == 0))
    first = rows.agg(F.min_by(F.size("v"), F.struct(F.col("id").isNull(), "id", "v")).alias("n")).first().n
    far = F.exists("v", lambda x: F.abs(x) >= MOST / scale)
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("int"))
    checked = F.when(far, F.raise_error(F.lit(f"a component of {MOST // scale} or more in magnitude"))).otherwise(whole)
    return rows.filter(F.size("v") == F.lit(first)).select("id", "label", checked.alias("v"))


def codebooks_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def compress(
    df: DataFrame, vec: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE, bounds: int | None = None, watch: Callable[[int, np.ndarray], None] | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code: a byte for each part, error) of every kept vector, and the codebooks (parts, entries, width).

    A codebook starts as the parts of the ``entries`` (at most 256) vectors with the smallest ids. ``bounds`` is the first ``b``, a quarter of
    the entries unless given. ``watch`` is told each round's ``b`` and how many parts needed how many bounds.
    """
    if entries > 256:
        raise ValueError("a code is one byte")
    kept = kept_vectors(df, vec, vector, label, parts, scale)
    kind = kept.schema["label"].dataType.simpleString()
    heads = kept.orderBy(F.col("id").isNull(), "id", "v").limit(entries).select("v").collect()
    if not heads:
        empty = df.sparkSession.createDataFrame([], f"id long, label {kind}, code binary, error long")
        return empty, np.zeros((parts, 0, 0), np.int64)
    books = np.ascontiguousarray(np.array([r.v for r in heads], np.int64).reshape(len(heads), parts, -1).transpose(1, 0, 2))
    b = max(1, bounds or books.shape[1] // 4)

    def binary(batches):
        for batch in batches:
            v = batch.column("v")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), _blobs(np.asarray(v.flatten()).astype("<i4").reshape(len(v), -1))], ["id", "label", "x"])

    state, old = kept.mapInArrow(lean(binary), f"id long, label {kind}, x binary"), None
    for _ in range(rounds):
        state = cut(_pass(state, kind, books, old, b))
        old = books
        books, needed = _sums(state, books)
        if watch:
            watch(b, needed)
        if needed[:255].any():  # the first round measures all entries
            b = next_bounds(needed, b, books.shape[1])
    return cut(_pass(state, kind, books, old, b).select("id", "label", "code", "error")), books


def codes(df: DataFrame, vec: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """(vec_id, code: two hexadecimal digits for each part, error, label_error: errors of the label's vectors, codebooks_sha256)."""
    coded, books = compress(df, vec, vector, label, **options)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    whole = join_by_key(coded, sums, ["label"], null_safe=True)
    return whole.select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(hashlib.sha256(codebooks_text(books).encode()).hexdigest()).alias("codebooks_sha256"))
