"""Queries for metrics, residuals, model comparison and held-out predictions."""

from pyspark.sql import functions as F

from mensura.operators import evaluation as ev
from mensura.operators import ranking as rk
from mensura.operators.curation import partition_rejects
from mensura.operators.joins import union_runs
from mensura.registry.core import query, rounded

MODELS = ["overall", "kind", "key"]
METRICS = ["mae", "rmse", "r2", "pearson", "spearman"]


def metric_sql(source: str) -> str:
    return f"""
ranked AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY actual) + (count(*) OVER (PARTITION BY model, actual) - 1) / 2.0 AS ra,
                     rank() OVER (PARTITION BY model ORDER BY predicted) + (count(*) OVER (PARTITION BY model, predicted) - 1) / 2.0 AS rp
           FROM {source} p WHERE coalesce(isfinite(predicted), false)),
metrics AS (SELECT model, count(*) AS rows, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse,
    1 - sum((actual - predicted) ** 2) / nullif(var_pop(actual) * count(*), 0) AS r2,
    CASE WHEN min(predicted) < max(predicted) THEN corr(actual, predicted) END AS pearson,
    CASE WHEN min(rp) < max(rp) THEN corr(ra, rp) END AS spearman,
    (SELECT count(*) FROM {source} o WHERE o.model = ranked.model AND NOT coalesce(isfinite(o.predicted), false)) AS left_out FROM ranked GROUP BY model)"""


METRIC_SQL = metric_sql("long_predictions")
METRIC_COLUMNS = ("rows, left_out, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) + 0.0 AS r2, round(pearson, 6) AS pearson, "
                  "round(spearman, 6) AS spearman")
ODD = """(SELECT source_index, model, actual, CASE WHEN source_index % 17 = 3 THEN NULL WHEN source_index % 19 = 5 THEN 'NaN'::DOUBLE
          WHEN source_index % 23 = 7 THEN 'Infinity'::DOUBLE ELSE predicted END AS predicted FROM long_predictions)"""


@query("residuals", "SELECT source_index, model, round(actual - predicted, 6) + 0.0 AS residual FROM long_predictions")
def _(t):
    return rounded(ev.residuals(t.long_predictions), "residual").select("source_index", "model", "residual")


@query("regression_metrics", f"WITH {metric_sql(ODD).strip()} SELECT model, {METRIC_COLUMNS} FROM metrics")
def _(t):
    """Some predictions are missing, NaN or infinite."""
    i = F.col("source_index")
    odd = F.when(i % 17 == 3, F.lit(None)).when(i % 19 == 5, float("nan")).when(i % 23 == 7, float("inf")).otherwise(F.col("predicted"))
    return rounded(ev.regression_metrics(t.long_predictions.withColumn("predicted", odd), ["model"]), *METRICS)


@query("regression_metrics_overall", f"WITH {METRIC_SQL.strip()} SELECT {METRIC_COLUMNS} FROM metrics WHERE model = 'key'")
def _(t):
    one = t.predictions.select("source_index", "actual", F.col("model_key").alias("predicted"))
    return rounded(ev.regression_metrics(one), *METRICS)


@query("leaderboard", f"WITH {METRIC_SQL.strip()} SELECT model, {METRIC_COLUMNS} FROM metrics ORDER BY mae")
def _(t):
    return rounded(rk.leaderboard(ev.regression_metrics(t.long_predictions, ["model"]), "mae"), *METRICS)


@query("baseline_delta", f"""WITH {METRIC_SQL.strip()},
c AS (SELECT (SELECT mae FROM metrics WHERE model = 'key') AS mine, (SELECT min(mae) FROM metrics WHERE model <> 'key') AS other,
             (SELECT model FROM metrics WHERE model <> 'key' ORDER BY mae, model LIMIT 1) AS best)
SELECT 'key' AS candidate, round(mine, 6) AS candidate_value, best AS best_other, round(other, 6) AS best_other_value,
       round(mine - other, 6) + 0.0 AS difference, CASE WHEN mine - other < -1e-9 THEN 'win' WHEN mine - other > 1e-9 THEN 'lose' ELSE 'tie' END AS outcome FROM c""")
def _(t):
    results = ev.regression_metrics(t.long_predictions, ["model"], spearman=False)
    return rounded(rk.baseline_delta(results, "key", "mae"), "candidate_value", "best_other_value", "difference")


BOX = """
SELECT model, count(*) AS count, round(min(x), 6) AS min, round(max(x), 6) AS max, round(quantile_cont(x, 0.25), 6) AS q1,
       round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3
FROM (SELECT model, actual - predicted AS x FROM long_predictions) e GROUP BY model"""


@query("residual_box", BOX)
def _(t):
    return rounded(ev.residual_box(ev.residuals(t.long_predictions)), "min", "max", "q1", "median", "q3")


@query("residual_box_heavy_keys", BOX)
def _(t):
    return rounded(ev.residual_box(ev.residuals(t.long_predictions)), "min", "max", "q1", "median", "q3")


@query("residual_histogram", """
WITH e AS (SELECT model, actual - predicted AS x, min(actual - predicted) OVER (PARTITION BY model) AS lo,
                  max(actual - predicted) OVER (PARTITION BY model) AS hi FROM long_predictions)
SELECT model, CAST(least(floor((x - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS rows FROM e GROUP BY 1, 2""")
def _(t):
    return ev.residual_histogram(ev.residuals(t.long_predictions))


@query("prediction_correlation", """
SELECT 'kind' AS model_a, 'key' AS model_b, round(corr(model_kind, model_key), 6) AS correlation FROM predictions
UNION ALL SELECT 'key', 'kind', round(corr(model_kind, model_key), 6) FROM predictions
UNION ALL SELECT 'kind', 'kind', 1.0 UNION ALL SELECT 'key', 'key', 1.0""")
def _(t):
    return rounded(ev.prediction_correlation(t.long_predictions, ["kind", "key"]), "correlation")


def _runs(t):
    return {
        m: t.predictions.select("source_index", "actual", F.col("model_" + m).alias("predicted")) for m in MODELS
    }


@query("wide_predictions", """
SELECT source_index, round(actual, 6) AS actual, model_overall AS overall, model_kind AS kind, model_key AS key FROM predictions""")
def _(t):
    return rounded(ev.wide_predictions(_runs(t)), "actual")


@query("pivot_predictions", "SELECT source_index, model_overall AS overall, model_kind AS kind, model_key AS key FROM predictions")
def _(t):
    return ev.pivot_predictions(union_runs(_runs(t)), MODELS)


_SIDE = "CASE o_orderstatus WHEN 'P' THEN 'test' WHEN 'O' THEN 'validation' ELSE 'train' END"


@query("run_metrics_row", f"""WITH {METRIC_SQL.strip()},
o AS (SELECT *, {_SIDE} AS side, o_totalprice >= 200000 AS gone FROM orders WHERE o_orderkey % 10 <> 0)
SELECT count(*) FILTER (side = 'train') AS n_train, count(*) FILTER (side = 'validation') AS n_validation, count(*) FILTER (side = 'test') AS n_test,
       count(*) FILTER (side = 'train' AND gone) AS n_imputed_train, count(*) FILTER (side = 'test' AND gone) AS n_imputed_test,
       count(DISTINCT o_custkey) FILTER (side = 'train') AS n_train_groups, count(DISTINCT o_custkey) FILTER (side = 'validation') AS n_validation_groups,
       count(DISTINCT o_custkey) FILTER (side = 'test') AS n_test_groups, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) AS n_rejected, 2 AS n_features,
       {', '.join(f"(SELECT {c} FROM metrics WHERE model = 'key') AS {c}" for c in ('rows', 'left_out'))},
       {', '.join(f"(SELECT round({c}, 6) + 0.0 FROM metrics WHERE model = 'key') AS {c}" for c in METRICS)} FROM o""")
def _(t):
    status = F.col("o_orderstatus")
    rows = t.orders.select(
        "o_custkey", "o_orderkey", F.when(F.col("o_totalprice") < 200000, F.col("o_totalprice")).alias("price"),
        F.when(status == "P", "test").when(status == "O", "validation").otherwise("train").alias("split"))
    usable, rejected = partition_rejects(rows, {"key ends in 0": F.col("o_orderkey") % 10 == 0}, "o_orderkey")
    one = t.predictions.select("source_index", "actual", F.col("model_key").alias("predicted"))
    return rounded(ev.run_metrics_row(usable, "split", "o_custkey", ["price", "o_orderkey"], one, rejected), *METRICS)
