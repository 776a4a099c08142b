"""Train / validation / test splits and folds by whole groups, and a reproducible row split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura import fixed_values as fixed
from mensura.functions import columns as fn
from mensura.operators.stats import group_sizes
from mensura.skew import join_by_key, ordered_prefix


def _by_size(group: str) -> list[Column]:
    return [F.desc("size"), F.asc(group)]


def split_groups(df: DataFrame, group: str, frac: float = fixed.TRAIN_FRACTION) -> DataFrame:
    """The split of every group: largest groups first (ties by key) go to train until it holds ``floor(frac*n)`` rows.

    The group that crosses the target still goes to train whole. Only the group table is ordered, never the rows.
    """
    sizes = group_sizes(df, group)
    target = F.floor(F.lit(float(frac)) * F.col("total"))
    split = F.when(F.col("before") < target, "train").otherwise("test")
    return ordered_prefix(sizes, _by_size(group), "size").select(group, F.col("size").alias("group_size"), split.alias("split"))


def group_split(
    df: DataFrame, group: str, frac: float = fixed.TRAIN_FRACTION
) -> DataFrame:
    """Rows with their group (sentinel when missing), ``group_size`` and ``split``."""
    rows = df.withColumn(group, fn.fill_group(group))
    return join_by_key(rows, split_groups(rows, group, frac), [group], "left")


def seeded_group_holdout(
    df: DataFrame, group: str, frac: float = fixed.VALIDATION_FRACTION, seed: int = fixed.SEED, out: str = "split", kept: str = "train", held: str = "validation",
) -> DataFrame:
    """Hold out whole groups in a seeded order until they hold ``max(1, floor(n*frac))`` rows.

    The last group in that order is never held out. The order is that of ``md5(seed, group)``, so it does not depend on
    partitioning. A single group cannot be split and raises while running.
    """
    if not 0.0 < frac < 0.5:
        raise ValueError("the held-out fraction must lie between 0 and 0.5")
    rows = df.withColumn(group, fn.fill_group(group))
    sizes = group_sizes(rows, group).withColumn(
        "_shuffle", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")))
    )
    placed = ordered_prefix(sizes, [F.col("_shuffle"), F.col(group)], "size")
    target = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(float(frac))))
    last = F.col("before") + F.col("size") == F.col("total")
    split = (
        F.when(F.col("size") == F.col("total"), F.raise_error(F.lit("at least two groups are needed for a hold-out")))
        .when((F.col("before") < target) & ~last, held).otherwise(kept)
    )
    return join_by_key(rows, placed.select(group, split.cast("string").alias(out)), [group], "left")


def _phases(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, list[int]]]:
    """(size, rank, folds): from that rank on, groups of a size go round these folds, as if each in turn went to the lightest.

    ``sizes`` has (size, number of groups), the largest size first. Groups of one size join a fold at loads that are that size
    apart, so the folds take turns in the order of their loads modulo the size once they have been reached; how often each has had its
    turn follows without going through the groups.
    """
    loads, out = [0] * k, []
    for size, groups in sizes:
        base = min(loads)
        late = [(load - base) // size for load in loads]  # rounds that a fold sits out
        order = sorted(range(k), key=lambda f: ((loads[f] - base) % size, f))
        rank = 0
        for at, to in zip(steps := sorted(set(late)), [*steps[1:], None]):
            turn = [f for f in order if late[f] <= at]
            out.append((size, rank, turn))
            here = groups - rank if to is None else min(groups - rank, (to - at) * len(turn))
            for i, f in enumerate(turn):
                loads[f] += size * (here // len(turn) + (i < here % len(turn)))
            rank += here
            if rank == groups:
                break
    return out


def fold_groups(df: DataFrame, group: str, k: int = 3) -> DataFrame:
    """Fold of every group: groups by size, the largest first and ties by key, each go to the fold with the fewest rows so far, ties to the
    first fold.

    The driver goes through the distinct sizes, which are fewer than the square root of twice the rows, never through the groups.
    """
    table = group_sizes(df, group)
    histogram = table.groupBy("size").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.desc("size")).collect()
    phases = df.sparkSession.createDataFrame(
        _phases([(r["size"], r["groups"]) for r in histogram], k), "size long, rank long, folds array<int>")
    phases = phases.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("rank", "folds"))).alias("_phases"))  # at most k
    placed = ordered_prefix(table, _by_size(group))
    first = placed.groupBy("size").agg(F.min("before").alias("_first"))
    placed = join_by_key(join_by_key(placed, first, ["size"]), phases, ["size"]).withColumn("_rank", F.col("before") - F.col("_first"))
    mine = F.element_at(F.filter("_phases", lambda p: p["rank"] <= F.col("_rank")), -1)
    turn = F.pmod(F.col("_rank") - mine["rank"], F.size(mine["folds"])).cast("int")
    return placed.select(group, "size", F.get(mine["folds"], turn).alias("fold"))


def grouped_kfold(df: DataFrame, group: str, k: int = 3) -> DataFrame:
    """Rows with a ``fold`` from 0 to k-1; a group lies in one fold."""
    rows = df.withColumn(group, fn.fill_group(group))
    return join_by_key(rows, fold_groups(rows, group, k).select(group, "fold"), [group], "left")


def random_split(df: DataFrame, row_id: str, frac: float = 0.2, seed: int = fixed.SEED) -> DataFrame:
    """Row split by a hash of seed and id: the same rows whatever the partitioning."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))
    return df.withColumn("split", F.when(fn.chunk(h, 0) < F.lit(int(frac * 16**6)), "test").otherwise("train"))


def require_sides(df: DataFrame, split: str = "split", sides: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """Raise when a side of a split is empty, e.g. because one large group overshot the target."""
    found = {r[split] for r in df.filter(F.col(split).isin(list(sides))).select(split).distinct().collect()}
    empty = [s for s in sides if s not in found]
    if empty:
        raise ValueError("grouping did not produce rows for: " + ", ".join(empty))
    return df
