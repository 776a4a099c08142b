"""Hot keys, exact quantiles and order over a whole table: one exact route each, whatever the size of the data.

No step counts rows to choose a route, lists keys on the driver, or gathers the values of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.session import cut


def join_by_key(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left", null_safe: bool = False) -> DataFrame:
    """Join rows to a table that is unique by ``keys`` without sending a hot key's rows to one task.

    The keys' hash is joined on as well, so both sides are dealt anew for this join, whatever they were dealt by before. That
    is what lets adaptive execution split the partitions of a hot key, or broadcast a side that it measured and found
    small. With ``null_safe`` null equals null.
    """
    keys = list(keys)
    for k in keys:
        kind = df.schema[k].dataType
        if table.schema[k].dataType.simpleString() != kind.simpleString():  # equal numbers of two types have two hashes
            table = table.withColumn(k, F.col(k).try_cast(kind))
    if null_safe:
        packed = F.struct(*keys).alias("_key")
        table = table.select(packed, *[c for c in table.columns if c not in keys])
        return join_by_key(df.select("*", packed), table, ["_key"], how).drop("_key")
    hashed = F.xxhash64(*keys)
    return df.withColumn("_hash", hashed).join(table.withColumn("_hash", hashed), [*keys, "_hash"], how).drop("_hash")


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row table (aggregates of a whole table) beside every row, as a subquery of the plan."""
    row = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumn("_beside", row).select(*df.columns, *[F.col("_beside")[c].alias(c) for c in one_row.columns])


# --- exact quantiles ---------------------------------------------------------------------------
#
# Counts of distinct values are put in one order of keys and values by ranges. A key that begins and ends within one range has its ranks
# there. Only the first and the last key of a range can go on in another: their rows are handed on with their range and what is before
# them in it; the weights by range, a few rows for each range, then give every such row its rank. No rows are joined to totals
# but these, and no list of a key's values is longer than ``HELD``.

HELD = 1 << 20  # distinct values of a key that a task holds; beyond that the key is handed on as well
Wanted = Sequence[tuple[int, float]]  # (number of a column, p) of each quantile


def _picked(values: np.ndarray, upto: np.ndarray, base: np.ndarray, total: np.ndarray, p: float) -> np.ndarray:
    """The interpolated quantile of each run of sorted values; ``upto`` counts rows to each value's end, ``base`` those before the run."""
    place = p * (total - 1)
    low, high = np.floor(place), np.ceil(place)
    x, y = (values[np.searchsorted(upto, base + rank.astype(np.int64), side="right")] for rank in (low, high))
    with np.errstate(invalid="ignore"):
        return np.where(x == y, x, x + (place - low) * (y - x))


def _of_runs(values: np.ndarray, n: np.ndarray, begin: np.ndarray, which: np.ndarray, wanted: Wanted, away: bool) -> np.ndarray:
    """A row for each run, with a number for each quantile wanted: NaN for those of other columns than the run's, ``which``.

    With ``away`` the median distance from the first quantile is one more.
    """
    upto, ends = np.cumsum(n), np.append(begin[1:], len(n))
    base = upto[begin] - n[begin]
    total = upto[ends - 1] - base
    out = [np.where(which == c, _picked(values, upto, base, total, p), np.nan) for c, p in wanted]
    if away:
        run = np.repeat(np.arange(len(begin)), ends - begin)
        with np.errstate(invalid="ignore"):
            apart = np.abs(values - out[0][run])
        order = np.lexsort((apart, run))
        out.append(_picked(apart[order], np.cumsum(n[order]), base, total, 0.5))
    return np.stack(out, axis=1)


def _counted(df: DataFrame, keys: Sequence[str], names: Sequence[str], weight: str | None = None) -> DataFrame:
    """(_k, _c, _v, _n): how often each key has each value of the columns named; a row counts ``weight`` times."""
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(names)])
    packed = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    rows = df.select(packed.alias("_k"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"), F.inline(cells)).filter(F.col("_v").isNotNull())
    return rows.groupBy("_k", "_c", "_v").agg(F.sum("_w").alias("_n"))


def _by_ranges(copies: DataFrame, wanted: Wanted, away: bool = False, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((_k, _c, q: what is wanted) of keys that lie in one range, rows (_k, _c, _v, _n, _rank, _total) of the others)."""
    most = HELD if most is None else most
    order = ["_k", "_c", "_v"]
    ranged = copies.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_run", F.xxhash64("_k", "_c"))
    names = ["_k", "_c", "q", "_r", "_b", "_v", "_n"]

    def run(batches):
        place, held, front, passing, done = TaskContext.get().partitionId(), [], None, True, 0

        def handed_on(rows: pa.Table, before: int) -> pa.Table:
            n = np.asarray(rows["_n"])
            here = pa.array(np.full(len(rows), place, np.int32))
            return pa.table([rows["_k"], rows["_c"], pa.nulls(len(rows), pa.list_(pa.float64())), here, pa.array(before + np.cumsum(n) - n), rows["_v"], rows["_n"]], names)

        def decided(rows: pa.Table, begin: np.ndarray) -> pa.Table:
            heads = rows.take(pa.array(begin))
            found = _of_runs(np.asarray(rows["_v"]), np.asarray(rows["_n"]), begin, np.asarray(heads["_c"]), wanted, away)
            q = pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
            blank = [pa.nulls(len(begin), kind) for kind in (pa.int32(), pa.int64(), pa.float64(), pa.int64())]
            return pa.table([heads["_k"], heads["_c"], q, *blank], names)

        def tables():
            nonlocal held, front, passing, done
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = pa.Table.from_batches([*held, batch]).combine_chunks()
                held, runs = [], np.asarray(rows["_run"])
                begin = np.concatenate([[0], np.flatnonzero(runs[1:] != runs[:-1]) + 1])
                passing = passing and front in (None, runs[0])
                if passing:  # the key at the front is the range's first, or has very many values
                    part = rows.slice(0, begin[1] if len(begin) > 1 else len(rows))
                    yield handed_on(part, done)
                    done, front = done + int(np.asarray(part["_n"]).sum()), runs[0]
                    if len(begin) == 1:
                        continue
                    passing, begin = False, begin[1:]
                if len(begin) > 1:
                    yield decided(rows.slice(begin[0], begin[-1] - begin[0]), begin[:-1] - begin[0])
                last = rows.slice(begin[-1])  # it may go on
                if len(last) > most:
                    yield handed_on(last, 0)
                    passing, front, done = True, runs[-1], int(np.asarray(last["_n"]).sum())
                else:
                    held = last.to_batches()
            if held:
                yield handed_on(pa.Table.from_batches(held), 0)

        for table in tables():
            yield from table.combine_chunks().to_batches(max_chunksize=50_000)

    key = copies.schema["_k"].dataType.simpleString()
    made = cut(ranged.mapInArrow(run, f"_k {key}, _c int, q array<double>, _r int, _b long, _v double, _n long"))
    edges = made.filter(F.col("q").isNull()).drop("q")
    earlier = Window.partitionBy("_k", "_c").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    sizes = edges.groupBy("_k", "_c", "_r").agg(F.sum("_n").alias("_size")).select(
        "_k", "_c", "_r", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"), F.sum("_size").over(Window.partitionBy("_k", "_c")).alias("_total"))
    placed = edges.join(F.broadcast(sizes), ["_k", "_c", "_r"])  # a few rows for each range
    return made.filter(F.col("q").isNotNull()).select("_k", "_c", "q"), placed.select(
        "_k", "_c", "_v", "_n", (F.col("_b") + F.col("_offset")).alias("_rank"), "_total")


def _ranked(placed: DataFrame, wanted: Wanted) -> DataFrame:
    """(_k, _c, q) of keys whose rows (_k, _c, _v, _n, _rank, _total) know their ranks."""
    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_rank") <= rank) & (rank < F.col("_rank") + F.col("_n")), F.col("_v")))

    parts, q = [], []
    for i, (c, p) in enumerate(wanted):
        place = F.lit(float(p)) * (F.col("_total") - 1)
        parts += [at(F.floor(place)).alias(f"_l{i}"), at(F.ceil(place)).alias(f"_h{i}"), F.max(place - F.floor(place)).alias(f"_s{i}")]
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        q.append(F.when(F.col("_c") != c, float("nan")).when(low == high, low).otherwise(low + F.col(f"_s{i}") * (high - low)))
    return placed.groupBy("_k", "_c").agg(*parts).select("_k", "_c", F.array(*q).alias("q"))


def select_quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]], weight: str | None = None) -> DataFrame:
    """Exact interpolated quantiles ``{alias: (column, p)}`` per key (none: the whole table), null values left out.

    With ``weight``, a column of whole numbers, a row stands for so many. A quantile between an infinite value and another follows the rules of floating-point numbers; NaN is the largest value. Keys
    without values are not in the result.
    """
    names = list(dict.fromkeys(c for c, _ in wanted.values()))
    numbered = [(names.index(c), float(p)) for c, p in wanted.values()]
    known, rest = _by_ranges(_counted(df, keys, names, weight), numbered)
    found = known.union(_ranked(rest, numbered))
    each = [F.col("q")[i] if len(names) == 1 else F.max(F.when(F.col("_c") == c, F.col("q")[i])) for i, (c, _) in enumerate(numbered)]
    each = [e.alias(a) for e, a in zip(each, wanted)]
    found = found.select("_k", *each) if len(names) == 1 else found.groupBy("_k").agg(*each)
    return found.select(*[F.col("_k")[k].alias(k) for k in keys], *wanted)


def select_spread(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, median, mad: the median distance from it) per key, exact; null values left out.

    A key that lies in one range has both at once. The distances of the others' values, two keys a range as a rule, are put in an
    order of their own.
    """
    middle = [(0, 0.5)]
    known, rest = _by_ranges(_counted(df, keys, [column]), middle, away=True)
    rest = cut(rest)
    medians = _ranked(rest, middle).select("_k", F.col("q")[0].alias("median"))
    away = F.abs(F.col("_v") - F.col("median")).alias("_v")
    apart = rest.join(F.broadcast(medians), "_k").select("_k", "_c", away, "_n").groupBy("_k", "_c", "_v").agg(F.sum("_n").alias("_n"))
    near, far = _by_ranges(apart, middle)
    spreads = near.union(_ranked(far, middle)).select("_k", F.col("q")[0].alias("mad"))
    both = known.select("_k", F.col("q")[0].alias("median"), F.col("q")[1].alias("mad")).union(medians.join(spreads, "_k"))
    return both.select(*[F.col("_k")[k].alias(k) for k in keys], "median", "mad")


def aggregate(
    df: DataFrame, keys: Sequence[str], aggs: Sequence[Column] = (), quantiles: dict[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """Group by ``keys`` (none = whole table) with ordinary aggregates and exact quantiles ``{alias: (column, p)}``."""
    base = df.groupBy(*keys).agg(*(list(aggs) or [F.count(F.lit(1)).alias("_unused")]))
    if quantiles:
        picked = select_quantiles(df, keys, quantiles)
        if keys:
            base = join_by_key(base, picked, keys, "left", null_safe=True)
        else:
            base = beside(base, picked)
    return base.drop("_unused")


# --- order over a whole table ------------------------------------------------------------------


def ordered_prefix(df: DataFrame, order: Sequence[Column], weight: str | None = None) -> DataFrame:
    """Add ``before`` (weight of all rows earlier in ``order``) and ``total`` without sorting in one task.

    Rows are range-partitioned, cut to the shared folder so the ranges stay fixed, and each range then adds its own
    running sum to the weight of the ranges before it. ``order`` must be unique, so equal rows cannot pile up. Adaptive
    execution chooses the number of ranges by merging neighbours.
    """
    amount = F.col(weight) if weight else F.lit(1)
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.sum(amount).alias("_size"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.select(
        "_range",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_size").over(everything).alias("total"),
    )
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inner", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
        .join(F.broadcast(sizes), "_range")
        .withColumn("before", F.col("_offset") + F.col("_inner"))
        .drop("_range", "_offset", "_inner")
    )
