"""Replicates of one key: median, median absolute deviation, quality gate, one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura import fixed_values as fixed
from mensura.functions import columns as fn
from mensura.skew import join_by_key, select_spread


def replicate_profile(df: DataFrame, key: str, value: str, aggs: Sequence[Column] = ()) -> DataFrame:
    """Per key: ``median``, ``mad`` and any further aggregates. Rows without a key belong to no group.

    Both medians come from one order of all keys' distinct values, so a key may have any number of rows.
    """
    rows = df.filter(F.col(key).isNotNull()).withColumn("_v", fn.finite(value))
    grouped = rows.groupBy(key).agg(*(aggs or [F.count(F.lit(1)).alias("_unused")])).drop("_unused")
    return join_by_key(grouped, select_spread(rows, [key], "_v"), [key])


def with_replicate_mad(df: DataFrame, key: str, value: str) -> DataFrame:
    """Every row with its group's ``median``, its own ``deviation`` and the group's ``mad``; null for keyless rows."""
    joined = join_by_key(df, replicate_profile(df, key, value), [key], "left")
    return joined.withColumn("deviation", F.abs(F.col(value) - F.col("median")))


def replicate_filter(df: DataFrame, key: str, value: str, mad_max: float = fixed.MAD_MAX) -> DataFrame:
    """All rows of the keys that pass the gate, their value replaced by the group median."""
    profile = replicate_profile(df, key, value).filter(F.col("mad") <= mad_max)
    joined = join_by_key(df, profile.select(key, "median"), [key], "inner")
    return joined.withColumn(value, F.col("median")).select(*df.columns)


def replicate_consensus(
    df: DataFrame, key: str, value: str, order: str, mad_max: float = fixed.MAD_MAX
) -> DataFrame:
    """One row per key that passes the gate: the first row by ``order``, its value replaced by the group median."""
    first = F.min_by(F.struct(*[F.col(c) for c in df.columns if c != key]), order).alias("_first")
    profile = replicate_profile(df, key, value, [first]).filter(F.col("mad") <= mad_max)
    kept = [
        F.col(c) if c == key else F.col("median").alias(c) if c == value else F.col("_first")[c].alias(c)
        for c in df.columns
    ]
    return profile.select(*kept)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order. A mergeable minimum, so a hot key is reduced before the shuffle.

    Null counts as one key. ``order`` should be unique within a key.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(
        *[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns]
    )


def exact_dedup(df: DataFrame, columns: Sequence[str], order: Sequence[str] = ("source_index",)) -> DataFrame:
    """One row per distinct tuple of ``columns``, the first by ``order``; null equals null."""
    if set(columns) >= set(df.columns):
        return df.dropDuplicates(list(columns))
    return keep_first(df, columns, order)


def representative_row(df: DataFrame, by: str, prefer: Column, order: str = "source_index") -> DataFrame:
    """Per group the first preferred row, else the first row."""
    marked = df.withColumn("_other", ~F.coalesce(prefer, F.lit(False)))
    return keep_first(marked, [by], ["_other", order]).drop("_other")
