"""Feature reduction in one plan: variance, then correlation, then forest importance, learned on the train rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura import fixed_values as fixed
from mensura.operators import features as ft
from mensura.operators import models as md


def reduce_features(
    df: DataFrame, features: Sequence[str], label: str, *, split: str = "split", variance_min: float = fixed.VARIANCE_MIN,
    correlation_max: float = fixed.CORRELATION_MAX, trees: int = 100, seed: int = fixed.SEED,
) -> tuple[DataFrame, DataFrame]:
    """(the rows with the remaining features and all other columns; ``feature, place, dropped_by`` of every feature).

    Each step sees what the one before left, in the order of ``features``; train and test rows get the same columns.
    """
    train = df.filter(F.col(split) == "train")
    left, dropped = list(features), {}

    def keep(table: DataFrame, step: str) -> None:
        nonlocal left
        kept = ft.kept_features(table, left)
        dropped.update({c: step for c in left if c not in kept})
        left = kept

    keep(ft.variance_filter(df, left, variance_min, split), "variance")
    if left:
        keep(ft.correlation_filter(df, left, correlation_max, split), "correlation")
    if left:
        keep(md.importances(train, left, label, trees, seed), "importance")
    report = [(c, i, dropped.get(c)) for i, c in enumerate(features)]
    reduced = df.select(*[c for c in df.columns if c not in features or c in left])
    return reduced, df.sparkSession.createDataFrame(report, "feature string, place int, dropped_by string")
