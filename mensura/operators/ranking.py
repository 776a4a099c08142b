"""Ordered helpers: early stopping, average ranks, leaderboards, candidate-versus-best comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions import columns as fn
from mensura.session import cut
from mensura.skew import join_by_key, ordered_prefix


def early_stopping(history: DataFrame, run: str, epoch: str, metric: str, patience: int) -> DataFrame:
    """Per run: best epoch and value, stop epoch, whether it stopped early.

    Training stops at the first epoch that completes ``patience`` epochs without strict improvement. A run's history
    has one row per epoch, so its window is as long as the training, not as the data.
    """
    by = Window.partitionBy(run).orderBy(epoch)
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    x = fn.finite(metric)
    rows = history.withColumn("_n", F.row_number().over(by))
    improved = x.isNotNull() & (F.min(x).over(past).isNull() | (x < F.min(x).over(past)))
    rows = rows.withColumn("_improved", improved)
    seen = by.rowsBetween(Window.unboundedPreceding, 0)
    latest = F.max(F.when(F.col("_improved"), F.col("_n"))).over(seen)
    rows = rows.withColumn("_stale", F.col("_n") - F.coalesce(latest, F.lit(0)))
    rows = rows.withColumn("_done", F.max(F.when(F.col("_stale") >= patience, 1).otherwise(0)).over(past))
    alive = rows.filter(F.coalesce(F.col("_done"), F.lit(0)) == 0)
    best = F.when(F.col("_improved"), F.col("_n"))
    return alive.groupBy(run).agg(
        F.max_by(F.when(F.col("_improved"), F.col(epoch)), best).alias("best_epoch"),
        F.max_by(F.when(F.col("_improved"), F.col(metric)), best).alias("best_value"),
        F.max(epoch).alias("stop_epoch"), (F.max("_stale") >= patience).alias("stopped_early"),
    )


def _rank_table(values: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Distinct values with their number ``_n`` and mean rank ``_rank`` within ``by`` groups, cut to the shared folder."""
    copies = values.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    placed = cut(ordered_prefix(copies, [F.col(c) for c in [*by, column]], "_n"))
    if by:
        starts = placed.groupBy(*by).agg(F.min("before").alias("_start"))
        placed = join_by_key(placed, starts, by, "left", null_safe=True)
    else:
        placed = placed.withColumn("_start", F.lit(0))
    return placed.select(*by, column, "_n", (F.col("before") - F.col("_start") + (F.col("_n") + 1) / 2).alias("_rank"))


def average_rank(
    df: DataFrame, column: str, by: Sequence[str] = (), out: str = "rank"
) -> DataFrame:
    """Rank from 1 in ascending order, ties sharing their mean rank, within ``by`` groups; null and NaN stay unranked.

    Distinct values are counted and ordered, then joined back, so neither a tie nor a group meets in one task.
    """
    keys = [*by, column]
    ranks = _rank_table(df.filter(~fn.is_missing(column)).select(*keys), list(by), column)
    return join_by_key(df, ranks.select(*keys, F.col("_rank").alias(out)), keys, "left", null_safe=True)


def average_ranks(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), suffix: str = "_rank"
) -> DataFrame:
    """:func:`average_rank` of several columns at once: all are counted and ordered in one pass."""
    by = list(by)
    cells = F.array(*[F.struct(F.lit(c).alias("_side"), F.col(c).cast("double").alias("_value")) for c in columns])
    values = df.select(*by, F.inline(cells)).filter(~fn.is_missing("_value"))
    ranks = _rank_table(values, [*by, "_side"], "_value")
    for c in columns:
        mine = ranks.filter(F.col("_side") == c).select(*by, "_value", F.col("_rank").alias(c + suffix))
        rows = df.withColumn("_value", F.col(c).cast("double"))
        df = join_by_key(rows, mine, [*by, "_value"], "left", null_safe=True).drop("_value")
    return df


def leaderboard(results: DataFrame, metric: str = "test_mae", ties: Sequence[str] = ("model", "features")) -> DataFrame:
    """Runs by ascending metric."""
    return results.orderBy(F.asc_nulls_last(metric), *[c for c in ties if c in results.columns])


def baseline_delta(
    results: DataFrame, candidate: str, metric: str = "test_mae", model: str = "model", tol: float = 1e-9
) -> DataFrame:
    """The candidate's metric against the best other run: difference and win / lose / tie (lower is better)."""
    mine = F.min(F.when(F.col(model) == candidate, F.col(metric)))
    others = F.when(F.col(model) != candidate, F.col(metric))
    table = results.agg(
        mine.alias("candidate_value"), F.min(others).alias("best_other_value"),
        F.min(F.when(others.isNotNull(), F.struct(others.alias("value"), F.col(model).alias("name")))).alias("_best"),
    )
    delta = F.col("candidate_value") - F.col("best_other_value")
    outcome = F.when(delta < -tol, "win").when(delta > tol, "lose").when(delta.isNotNull(), "tie")
    return table.select(
        F.lit(candidate).alias("candidate"), "candidate_value", F.col("_best.name").alias("best_other"), "best_other_value",
        delta.alias("difference"), outcome.alias("outcome"),
    )
