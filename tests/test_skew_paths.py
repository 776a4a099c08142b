"""Exact quantiles, key joins and orders, whatever the number of rows a key has."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from mensura import skew
from mensura.operators import consensus as con
from mensura.operators import evaluation as ev
from mensura.operators import stats as st


def _sample(kind, n=4000):
    rng = np.random.default_rng(7)
    if kind == "ties":
        return rng.integers(-3, 4, n).astype(float)
    if kind == "wide":
        return rng.normal(size=n) * 10.0 ** rng.integers(-9, 9, n)
    if kind == "narrow":
        return 1000 + rng.normal(size=n) * 1e-6
    return np.full(n, 2.5)


@pytest.mark.parametrize("kind", ["ties", "wide", "narrow", "constant"])
def test_selected_quantiles_match_numpy(spark, kind):
    values = _sample(kind)
    keys = np.where(np.arange(len(values)) % 3 == 0, "hot", "warm")
    df = spark.createDataFrame([(str(k), float(v)) for k, v in zip(keys, values)], "k string, x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    wanted = {f"q{i}": ("x", p) for i, p in enumerate(probs)}
    for row in skew.select_quantiles(df, ["k"], wanted).collect():
        assert np.allclose([row[q] for q in wanted], np.quantile(values[keys == row["k"]], probs), rtol=1e-12, atol=0)


def test_one_key_with_a_third_of_the_rows(spark):
    df = spark.range(3000).select(
        F.col("id").alias("i"), F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 400).cast("string"))).alias("k"),
        (F.sin("id") * 3).alias("x"))
    found = {r["k"]: r for r in con.replicate_profile(df, "k", "x", [F.count(F.lit(1)).alias("n")]).collect()}
    values = {}
    for r in df.collect():
        values.setdefault(r["k"], []).append(r["x"])
    for k, v in values.items():
        middle = np.median(v)
        assert (found[k]["n"], found[k]["median"]) == (len(v), middle) and np.isclose(found[k]["mad"], np.median(np.abs(np.array(v) - middle)))
    assert con.with_replicate_mad(df, "k", "x").count() == 3000


@pytest.mark.parametrize("held", [4, 1 << 20])
def test_keys_that_span_ranges_carry_their_ranks(spark, monkeypatch, held):
    """Many ranges, keys of one value and of thousands, and keys with more values than a task holds."""
    monkeypatch.setattr(skew, "HELD", held)
    old = [(n, spark.conf.get(n)) for n in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")]
    for (n, _), v in zip(old, ("false", "7")):
        spark.conf.set(n, v)
    try:
        rng = np.random.default_rng(5)
        keys = np.where(np.arange(2000) % 3 == 0, 0, rng.integers(1, 300, 2000))
        values = np.round(rng.normal(size=2000), 2)
        df = spark.createDataFrame([(int(k), float(v), float(v) * 2) for k, v in zip(keys, values)], "k int, x double, y double")
        got = {r["k"]: r for r in skew.select_quantiles(df, ["k"], {"a": ("x", 0.5), "b": ("y", 0.9), "c": ("x", 0.0)}).collect()}
        spread = {r["k"]: r for r in skew.select_spread(df, ["k"], "x").collect()}
    finally:
        for n, v in old:
            spark.conf.set(n, v)
    assert set(got) == set(spread) == set(keys.tolist())
    for k in got:
        x = values[keys == k]
        middle = np.median(x)
        assert np.allclose([got[k]["a"], got[k]["b"], got[k]["c"]], [middle, np.quantile(2 * x, 0.9), x.min()], rtol=1e-12, atol=1e-12)
        assert np.allclose([spread[k]["median"], spread[k]["mad"]], [middle, np.median(np.abs(x - middle))], rtol=1e-12, atol=1e-12)


def test_null_is_a_key_like_any_other(spark):
    df = spark.createDataFrame([(None, 1.0)] * 50 + [("a", 2.0)] * 3, "k string, x double")
    table = st.number_stats(df, "x", ["k"])
    assert rows(table, "k", "count", "median") == [("a", 3, 2.0), (None, 50, 1.0)]


def test_quantiles_of_odd_numbers(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", inf), ("b", nan), ("b", 1.0), ("c", None), (None, -inf), (None, 5.0)], "k string, x double")
    got = {r["k"]: (r["n"], r["m"], r["h"]) for r in skew.aggregate(df, ["k"], [F.count(F.lit(1)).alias("n")], {"m": ("x", 0.5), "h": ("x", 1.0)}).collect()}
    assert got["a"] == (3, 2.0, inf) and got["c"] == (1, None, None) and got[None][2] == 5.0 and got["b"][0] == 2 and np.isnan(got["b"][2])
    whole = skew.aggregate(df.filter("k = 'a'"), [], [F.count(F.lit(1)).alias("n")], {"m": ("x", 0.5)}).first()
    assert (whole["n"], whole["m"]) == (3, 2.0)


def test_residual_views_leave_odd_residuals_out(spark):
    data = [("a", float(i)) for i in range(1, 5)] + [("a", float("nan")), ("a", float("inf")), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(data, "model string, residual double")
    box = {r["model"]: r for r in ev.residual_box(df).collect()}
    assert (box["a"]["count"], box["a"]["q1"], box["a"]["q3"], box["a"]["max"]) == (4, 1.75, 3.25, 4.0) and box[None]["median"] == 2.0
    bins = {(r["model"], r["bin"]): r["rows"] for r in ev.residual_histogram(df, bins=2).collect()}
    assert bins == {("a", 0): 2, ("a", 1): 2, (None, 0): 1, (None, 1): 1}


def test_join_keeps_every_row(spark):
    df = spark.createDataFrame([("h", i) for i in range(40)] + [("l", 1), (None, 2)], "k string, i int")
    table = spark.createDataFrame([("h", "x"), ("z", "y"), (None, "n")], "k string, v string")
    for how, n in (("left", 42), ("inner", 40), ("left_semi", 40), ("left_anti", 2)):
        assert skew.join_by_key(df, table, ["k"], how).count() == n
    assert rows(skew.join_by_key(df, table, ["k"], null_safe=True).filter("k IS NULL"), "i", "v") == [(2, "n")]
    longs = spark.createDataFrame([(1, "one")], "i long, v string")  # another type of number than df's
    assert rows(skew.join_by_key(df, longs, ["i"], "inner"), "k", "v") == [("h", "one"), ("l", "one")]


def test_a_hot_key_can_be_split(spark):
    """Both sides of a key join are dealt for the join itself, so adaptive execution may split a partition."""
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = skew.join_by_key(df, df.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("_hash") and sum("Exchange hashpartitioning" in line and "_hash" in line for line in plan.splitlines()) == 2


def test_prefix_follows_a_total_order(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("k"), (F.col("id") % 7 + 1).alias("w"))
    got = {r["k"]: (r["before"], r["total"]) for r in skew.ordered_prefix(df, [F.col("k")], "w").collect()}
    total, so_far = sum(r["w"] for r in df.collect()), 0
    for r in sorted(df.collect(), key=lambda r: r["k"]):
        assert got[r["k"]] == (so_far, total)
        so_far += r["w"]


def test_whole_table_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "x double")
    got = st.number_stats(empty, "x").first()
    assert got["count"] == 0 and got["median"] is None


def test_hash_ignores_partitioning(spark):
    df = spark.range(1000).select("id", F.sqrt("id").alias("x"))
    a = st.dataset_hash(df.repartition(7), ["id", "x"]).first()
    b = st.dataset_hash(df.orderBy(F.desc("id")), ["id", "x"]).first()
    c = st.dataset_hash(df.filter("id > 0"), ["id", "x"]).first()
    assert a == b and a["hash"] != c["hash"]


def test_hash_tells_rows_apart(spark):
    schema = "a string, b string"
    tables = [[("a|b", "c")], [("a", "b|c")], [(None, "c")], [("<null>", "c")], [("", "c")], [("1:a", "c")]]
    assert len({st.dataset_hash(spark.createDataFrame(t, schema), ["a", "b"]).first()["hash"] for t in tables}) == len(tables)
