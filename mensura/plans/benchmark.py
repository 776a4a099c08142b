"""Model benchmarks over one curated feature table: grouped split, grouped folds, sampled search, held-out metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura import fixed_values as fixed
from mensura.functions import columns as fn
from mensura.operators import evaluation as ev
from mensura.operators import features as ft
from mensura.operators import joins as jn
from mensura.operators import models as md
from mensura.operators import ranking as rk
from mensura.operators import splits as sp
from mensura.session import cut


def compare_models(
    train: DataFrame, test: DataFrame, variants: Mapping[str, Sequence[str]], label: str, group: str, *,
    row_id: str = "source_index", families: Sequence[str] = md.FAMILIES, trials: int = 8, folds: int = 3,
    spaces: Mapping[str, Mapping] | None = None, seed: int = fixed.SEED, parallelism: int | None = None,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(results by ascending error, predictions by run) of every family on every feature variant.

    The split tables are cut to the shared folder once and serve every run; the held-out rows are used only after the final fit.
    """
    train, test = cut(sp.grouped_kfold(train, group, folds)), cut(test)
    facts, runs = [], {}
    for family in families:
        for variant, columns in variants.items():
            space = (spaces or md.SPACES)[family]
            found = md.search(train, family, columns, label, "fold", trials, folds, space, parallelism, seed)
            best = found.orderBy("value", "number").first()
            _, scored = md.fit_predict_best(train, test, family, columns, label, found, row_id, seed)
            run = f"{family}_{variant}"
            runs[run] = cut(scored)
            facts.append((run, family, variant, len(columns), float(best["value"]), best["params"]))
    known = train.sparkSession.createDataFrame(
        facts, "run string, model string, features string, n_features int, cv_mae double, params string")
    scores = scored_runs(jn.union_runs(runs, "run"), ["run"])
    return rk.leaderboard(known.join(F.broadcast(scores), "run").drop("run")), runs


def scored_runs(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Held-out metrics under the names of the results table."""
    return ev.regression_metrics(predictions, by).drop("left_out").withColumnsRenamed({
        "mae": "test_mae", "rmse": "test_rmse", "r2": "test_r2", "pearson": "test_pearson", "spearman": "test_spearman",
        "rows": "n_test",
    })


def benchmark(
    df: DataFrame, variants: Mapping[str, Sequence[str]], label: str, group: str, *, row_id: str = "source_index",
    frac: float = fixed.TRAIN_FRACTION, **options,
) -> dict[str, DataFrame]:
    """Group split, model grid, leaderboard, stacked predictions, residual boxes, correlation between runs.

    ``df`` is computed once, and so is its split.
    """
    rows = cut(sp.group_split(cut(df), group, frac))
    sp.require_sides(rows)
    results, runs = compare_models(
        rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test"), variants, label, group,
        row_id=row_id, **options)
    stacked = jn.union_runs(runs)
    return {
        "results": results, "predictions": stacked, "residuals": ev.residual_box(stacked),
        "histogram": ev.residual_histogram(stacked), "correlation": ev.prediction_correlation(stacked, list(runs)),
    }


def matched_comparison(
    df: DataFrame, variants: Mapping[str, Sequence[str]], label: str, group: str, candidate: DataFrame,
    candidate_name: str = "candidate", *, row_id: str = "source_index", frac: float = fixed.TRAIN_FRACTION,
    validation: float = fixed.VALIDATION_FRACTION, seed: int = fixed.SEED, **options,
) -> dict[str, DataFrame]:
    """Compare a candidate's held-out predictions with tree models fitted on exactly its training rows.

    ``candidate`` holds ``source_index, actual, predicted``. Its ids must be those of the test split and its actual
    values must match, else this raises. Validation groups are kept out of the tree models' training.
    """
    rows = cut(sp.group_split(cut(df), group, frac))
    sp.require_sides(rows)
    inner = sp.seeded_group_holdout(rows.filter(F.col("split") == "train").drop("split"), group, validation, seed)
    rows = cut(inner.unionByName(rows.filter(F.col("split") == "test")))
    shared = jn.split_overlap(rows, "split", group)
    if not shared.isEmpty():
        raise ValueError("a group lies in more than one split")
    train, test = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test")
    ids = test.select(F.col(row_id).alias("source_index"))
    if not jn.same_id_set(ids, candidate.select("source_index"), "source_index").isEmpty():
        raise ValueError("the candidate's predictions do not cover exactly the test rows")
    truth = test.select(F.col(row_id).alias("source_index"), F.col(label).cast("double").alias("truth"))
    if not candidate.join(truth, "source_index").filter(~fn.is_close("truth", "actual")).isEmpty():
        raise ValueError("the candidate's actual values differ from the data")
    results, runs = compare_models(train, test, variants, label, group, row_id=row_id, seed=seed, **options)
    row = scored_runs(candidate).withColumns({
        "model": F.lit(candidate_name), "features": F.lit("own"), "n_features": F.lit(None).cast("int"),
        "cv_mae": F.lit(None).cast("double"), "params": F.lit(None).cast("string"),
    })
    table = results.unionByName(row)
    held_out = ev.wide_predictions({**runs, candidate_name: candidate.select(
        "source_index", "predicted").join(test.select(F.col(row_id).alias("source_index"), F.col(label).cast("double").alias("actual")), "source_index")})
    return {
        "results": rk.leaderboard(table), "held_out": held_out,
        "outcome": rk.baseline_delta(table, candidate_name), "rows": rows,
        "imputed": ft.imputed_counts(rows, list(dict.fromkeys(c for cs in variants.values() for c in cs))),
    }
