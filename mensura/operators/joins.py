"""Equi joins with the guards the curation and evaluation steps need, and set operations over identifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.skew import join_by_key

LOOKUP_ROWS = 100_000


def lookup_join(df: DataFrame, table: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join to a lookup table that has one row per key. Spark broadcasts it if its measured size allows."""
    return join_by_key(df, table.select(key, *columns), [key], "left")


def lookup_map(df: DataFrame, column: str, mapping: Mapping, out: str) -> DataFrame:
    """Left lookup in a map given by the caller; it travels inside the plan, so its length is checked."""
    if len(mapping) > LOOKUP_ROWS:
        raise ValueError("mapping too long for a plan; land it as a table and use lookup_join")
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(out, F.try_element_at(pairs, F.col(column)))


def attach_group_stats(
    df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]
) -> DataFrame:
    """Per-key aggregates put beside every row."""
    return join_by_key(df, df.groupBy(*keys).agg(*aggs), keys, "left")


def align_features(blocks: Sequence[DataFrame], row_id: str = "source_index") -> DataFrame:
    """Put feature blocks side by side by row id; ids must occur in every block."""
    return reduce(lambda a, b: a.join(b, row_id, "inner"), blocks)


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that fails while running if either side repeats a key.

    Each side is grouped by the key it is joined on, with its payload as a mergeable ``any_value`` struct, so the guard
    costs no shuffle beyond the join's own.
    """
    def unique(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        grouped = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest) if rest else F.lit(1)).alias("_row")
        )
        guard = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{side} side repeats a key"))).otherwise(F.col("_row"))
        grouped = grouped.withColumn("_row", guard)
        return grouped.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])

    return unique(left, "left").join(unique(right, "right"), list(keys), "left")


def select_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id is listed; repeats in the list change nothing."""
    return join_by_key(df, ids.select(key).distinct(), [key], "left_semi")


def exclusive_rows(df: DataFrame, keep_a: Column, keep_b: Column, out: str = "kept_by_a") -> DataFrame:
    """Rows kept by exactly one of two rules; a null condition keeps nothing."""
    a, b = F.coalesce(keep_a, F.lit(False)), F.coalesce(keep_b, F.lit(False))
    return df.filter(a != b).withColumn(out, a)


def split_overlap(df: DataFrame, split: str, key: str) -> DataFrame:
    """Keys found in more than one split, with the splits. One pass covers every pair; a set of splits stays small."""
    grouped = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return grouped.filter(F.size("splits") > 1).select(key, F.array_join("splits", "|").alias("splits"))


def split_overlap_counts(df: DataFrame, split: str, keys: Sequence[str]) -> DataFrame:
    """Number of shared values per key column."""
    counts = [
        split_overlap(df, split, k).agg(F.count(F.lit(1)).alias("shared"))
        .select(F.lit(k).alias("key_column"), "shared") for k in keys
    ]
    return reduce(DataFrame.unionByName, counts)


def same_id_set(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids found on one side only, with the side; empty when both id sets are the same."""
    marked = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    seen = marked.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    side = F.when(F.col("_a") == 1, "left only").otherwise("right only")
    return seen.filter(F.col("_a") != F.col("_b")).select(key, side.alias("side"))


# --- set operations ----------------------------------------------------------------------------


def union_runs(runs: Mapping[str, DataFrame], label: str = "model") -> DataFrame:
    """Stack tables under a label column; a column missing in one of them is null there."""
    marked = [df.withColumn(label, F.lit(name)) for name, df in runs.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), marked)


def shared_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).filter(F.col(column).isNotNull()).intersect(b.select(column))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def missing_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``a`` that ``b`` does not have."""
    return a.select(column).subtract(b.select(column))
