"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows go from each partition to each cell (a part of a shard, of fixed size) is drawn from the distribution that a
uniform permutation of all rows would give. Rows are then permuted within their partition and cut by those counts, exchanged,
and permuted again within their cell. Shard sizes differ by one row at most and slots have no gaps.

Nothing of the matrix is gathered: a task derives its own row by halving the list of partitions again and again; every half's
share of the cells is drawn with a seed of its own, so all tasks draw the same. Only the partitions' row counts are broadcast.

Rows are told apart by partition and place, which are fixed in the shared folder first; repeated rows and null ids are rows like
any other. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.batches import lean, quoted
from mensura.session import cut

ROWS_PER_CELL = 16_384
MOST_CELLS = 8_192
FEWEST_CELLS = 4  # of a shard
_EXACT = 1_000_000_000  # numpy draws exactly below


def share(n: int, parts: int) -> np.ndarray:
    """Sizes of parts of n, at most one apart."""
    return n // parts + (np.arange(parts) < n % parts).astype(np.int64)


def _one(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """Of ``taken`` items drawn from good and bad ones, how many are good."""
    if good + bad < _EXACT:
        return int(rng.hypergeometric(good, bad, taken))
    # Beyond numpy's range the law itself, from the ratios of neighbouring chances; what lies outside has less than 1e-26.
    total = good + bad
    mean = taken * (good / total)
    reach = 12 * np.sqrt(mean * (bad / total) * ((total - taken) / max(1, total - 1))) + 60
    low, high = max(0, taken - bad, int(mean - reach)), min(good, taken, int(mean + reach) + 1)
    k = np.arange(low, high)
    steps = np.log((good - k) / (k + 1)) + np.log((taken - k) / (bad - taken + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(sums, rng.random() * sums[-1], "right")), high - low)


def drawn(rng: np.random.Generator, cells: np.ndarray, taken: int) -> np.ndarray:
    """How many of ``taken`` items, drawn from all cells, come from each."""
    rest, out = int(cells.sum()), np.zeros_like(cells)
    if rest < _EXACT:
        return rng.multivariate_hypergeometric(cells, taken, method="marginals") if taken else out
    for i, size in enumerate(cells.tolist()):
        out[i] = _one(rng, size, rest - size, taken)
        rest -= size
        taken -= int(out[i])
    return out


def matrix_row(before: np.ndarray, place: int, cells: np.ndarray, seed: int) -> np.ndarray:
    """Rows that partition ``place`` sends to each cell; ``before`` has the rows of all earlier partitions, and the total."""
    low, high, left = 0, len(before) - 1, cells.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        first = drawn(np.random.default_rng([seed, low, high]), left, int(before[middle] - before[low]))
        low, high, left = (low, middle, first) if place < middle else (middle, high, left - first)
    return left


def shuffled(df: DataFrame, shards: int, seed: int = 0, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``row`` (the input's columns), ``shard`` and ``slot`` (from 0 in its shard), in a uniformly random order."""
    rows = cut(df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), F.spark_partition_id().alias("src")))
    counts = {r.src: r.n for r in rows.groupBy("src").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
    order = sorted(counts)
    before = np.concatenate([[0], np.cumsum([counts[s] for s in order], dtype=np.int64)])
    total = int(before[-1])
    per_shard = max(FEWEST_CELLS, min(-(-total // (shards * rows_per_cell)), MOST_CELLS // shards or 1))
    sizes = share(total, shards)
    cells = np.concatenate([share(int(n), per_shard) for n in sizes])
    shared = df.sparkSession.sparkContext.broadcast((before, cells, {s: i for i, s in enumerate(order)}))
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("cell int, src int, place long").fields])

    def deal(batches):
        plans: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            sources = np.asarray(batch.column("src"))
            cell, place = np.empty(len(sources), np.int32), np.empty(len(sources), np.int64)
            for src in np.unique(sources).tolist():
                if src not in plans:
                    begins, wanted, index = shared.value
                    counts = matrix_row(begins, index[src], wanted, seed)
                    goes = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
                    plans[src] = (np.random.default_rng([seed, 1, src]).permutation(goes), 0)
                goes, at = plans[src]
                mine = np.flatnonzero(sources == src)
                cell[mine], place[mine] = goes[at : at + len(mine)], np.arange(at, at + len(mine))
                plans[src] = (goes, at + len(mine))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cell), batch.column("src"), pa.array(place)], ["row", "cell", "src", "place"])

    sent = rows.mapInArrow(lean(deal), schema)
    again = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed), "src", "place"), "src", "place")
    inside = F.col("cell") % per_shard
    shard = F.floor(F.col("cell") / per_shard).cast("int")

    def begin(of: Column) -> Column:
        """Slots of the cells before this one in its shard."""
        return (inside * F.floor(of / per_shard) + F.least(inside, of % per_shard)).cast("long")

    size = F.lit(total // shards) + F.when(shard < total % shards, 1).otherwise(0)
    slot = begin(size) + F.row_number().over(again).cast("long") - 1
    return sent.select("row", shard.alias("shard"), slot.alias("slot"))
