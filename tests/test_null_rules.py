"""Small hand-made tables, one per rule on nulls, ties, rounding and deviations."""

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from mensura.functions import columns as fn
from mensura.operators import consensus as con
from mensura.operators import curation as cur
from mensura.operators import evaluation as ev
from mensura.operators import features as ft
from mensura.operators import joins as jn
from mensura.operators import ranking as rk
from mensura.operators import splits as sp
from mensura.operators import stats as st
from mensura.plans.curation import curate


def test_null_flag_is_kept(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 1)], "id int, flag int")
    assert rows(cur.filter_flag(df, "flag"), "id") == [(1,), (2,)]
    assert cur.filter_flag(df, "absent") is df


def test_null_validity_text_is_kept(spark):
    df = spark.createDataFrame([(1, None), (2, "bad"), (3, "other")], "id int, note string")
    assert rows(cur.filter_validity(df, {"note": ["bad"], "absent": ["bad"]}), "id") == [(1,), (3,)]


def test_keyless_rows_leave_the_consensus(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, None, 5.0), (3, "a", 5.0)], "i int, k string, x double")
    assert rows(con.replicate_consensus(df, "k", "x", "i"), "k", "x") == [("a", 5.0)]


def test_replicates(spark):
    data = [(1, "a", 5.0), (2, "a", 5.2), (3, "a", 7.9), (4, "b", 4.0), (5, "b", 9.0)]
    df = spark.createDataFrame(data, "i int, k string, x double")
    profile = {r["k"]: r for r in con.replicate_profile(df, "k", "x").collect()}
    assert profile["a"]["median"] == 5.2 and math.isclose(profile["a"]["mad"], 0.2)
    assert profile["b"]["median"] == 6.5 and profile["b"]["mad"] == 2.5
    assert rows(con.replicate_consensus(df, "k", "x", "i")) == [(1, "a", 5.2)]


def _record(i, relation, value, kind="pIC50"):
    return (i, "C", kind, relation, str(value), "nM", None)


RECORD = ("source_index int, canonical_smiles string, standard_type string, standard_relation string, "
          "standard_value string, standard_units string, potential_duplicate int")


def test_step_order_matters(spark):
    data = [_record(1, "=", 5.0), _record(2, "=", 5.1), _record(3, ">", 9.0), _record(4, ">", 9.1)]
    df = spark.createDataFrame(data, RECORD)
    assert rows(curate(df), "PIC50") == [(5.05,)]
    assert rows(curate(df, "audit"), "PIC50") == []
    with pytest.raises(ValueError):
        curate(df, "other")


def test_unknown_type_is_dropped_or_zero(spark):
    df = spark.createDataFrame([_record(1, "=", 5.0, "Ki")], RECORD)
    assert rows(curate(df), "PIC50") == []
    assert rows(curate(df, "audit"), "PIC50") == [(0.0,)]


def test_nan_is_missing_in_a_group(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", float("nan")), (3, "a", 5.4)], "i int, k string, x double")
    assert con.replicate_profile(df, "k", "x").first()["median"] == 5.2


def test_bad_numbers_become_null(spark):
    df = spark.createDataFrame([("n/a",), ("5d",), ("0x1p3",), (" 2.5 ",), ("1e3",), (None,)], "x string")
    assert [r[0] for r in df.select(fn.to_number("x")).collect()] == [None, None, None, 2.5, 1000.0, None]


def test_first_row_wins_after_repartition(spark):
    df = spark.createDataFrame([("a", 7, "late"), ("a", 3, "early")], "k string, i int, note string").repartition(5)
    assert rows(con.keep_first(df, ["k"], ["i"])) == [("a", 3, "early")]


def test_null_counts_in_dedup_but_not_in_unique(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "k string")
    table = st.duplicate_signatures({"p": df}, {"k": ["k"]}).first()
    assert (table["rows"], table["distinct_signatures"], table["excess_rows"]) == (4, 2, 2)
    assert st.key_counts(df, ["k"]).first()["unique_values"] == 1


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (2.5,), (3.5,)], "x double")
    assert [r[0] for r in df.select(fn.round_value("x", 0)).collect()] == [0.0, 2.0, 4.0]


def test_sample_and_population_deviation(spark):
    df = spark.createDataFrame([(1, 1.0, "train"), (2, 3.0, "train"), (3, 5.0, "test")], "i int, x double, split string")
    assert math.isclose(st.number_stats(df.filter("split = 'train'"), "x").first()["std"], math.sqrt(2))
    assert rows(ft.scale_train(df, ["x"]), "x") == [(-1.0,), (1.0,), (3.0,)]


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    table = st.target_stats(df, "x", {"all": F.lit(True)}, [0.25])
    assert {r["statistic"]: r["value"] for r in table.collect()}["quantile_25%"] == 1.75


def test_closeness(spark):
    df = spark.createDataFrame([(1.0, 1.000009), (1.0, 1.0001), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(fn.is_close("a", "b")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(fn.is_close("a", "b", equal_nan=True)).collect()] == [True, False, True]


def _groups(spark, sizes):
    return spark.createDataFrame([(g, i) for g, n in sizes for i in range(n)], "g string, i int")


def test_split_ties_and_targets(spark):
    table = {r["g"]: r["split"] for r in sp.split_groups(_groups(spark, [("b", 2), ("a", 2)]), "g", 0.5).collect()}
    assert table == {"a": "train", "b": "test"}
    split = sp.group_split(_groups(spark, [("p", 5), ("q", 3), ("r", 1), ("s", 1)]), "g")
    assert rows(split.groupBy("split").count()) == [("test", 2), ("train", 8)]
    over = sp.group_split(_groups(spark, [("p", 4), ("q", 4), ("r", 4)]), "g")
    assert rows(over.groupBy("split").count()) == [("train", 12)]
    with pytest.raises(ValueError):
        sp.require_sides(over)


def test_missing_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, i int")
    assert rows(sp.group_split(df, "g").select("g", "group_size").distinct()) == [("__NO_SCAFFOLD__", 2), ("a", 1)]


def test_holdout_needs_two_groups(spark):
    with pytest.raises(Exception, match="two groups"):
        sp.seeded_group_holdout(_groups(spark, [("a", 9)]), "g", 0.2).collect()
    with pytest.raises(ValueError):
        sp.seeded_group_holdout(_groups(spark, [("a", 9)]), "g", 0.5)


def test_folds_hold_whole_groups_and_are_balanced(spark):
    df = _groups(spark, [(f"g{i:02d}", 1 + i % 5) for i in range(40)])
    folds = sp.grouped_kfold(df, "g", 4)
    assert folds.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 5


def test_correlation_chain_drops_against_dropped_features(spark):
    base = [(float(i), float(i % 7)) for i in range(60)]
    data = [(a, a + 4 * b, a + 9 * b, 1.0, "train") for a, b in base]
    df = spark.createDataFrame(data, "f1 double, f2 double, f3 double, flat double, split string")
    table = {r["feature"]: r for r in ft.correlation_filter(df, ["f1", "f2", "f3", "flat"], 0.85).collect()}
    pairs = df.select(F.corr("f1", "f2"), F.corr("f2", "f3"), F.corr("f1", "f3")).first()
    assert pairs[0] > 0.85 and pairs[1] > 0.85 and pairs[2] < 0.85
    assert [table[f]["kept"] for f in ("f1", "f2", "f3", "flat")] == [True, False, False, True]


def test_early_stopping(spark):
    values = [5.0, 4.0, 4.0, 4.5, 3.9, 4.1, 4.2, 4.3, 1.0]
    df = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(values)], "run string, epoch int, m double")
    got = rk.early_stopping(df, "run", "epoch", "m", 3).first()
    assert (got["best_epoch"], got["best_value"], got["stop_epoch"], got["stopped_early"]) == (5, 3.9, 8, True)
    got = rk.early_stopping(df, "run", "epoch", "m", 5).first()
    assert (got["best_epoch"], got["stop_epoch"], got["stopped_early"]) == (9, 9, False)


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, None), (5, 30.0)], "i int, x double")
    assert rows(rk.average_rank(df, "x"), "i", "rank") == [(1, 1.0), (2, 2.5), (3, 2.5), (4, None), (5, 4.0)]


def test_unit_conversion(spark):
    data = [(1, 9.14, "10'5pM"), (2, 1.36, "10'6pM"), (3, 3.46, "10'3pM"), (4, 750.0, "nM")]
    df = spark.createDataFrame(data, "i int, v double, u string").withColumn("kind", F.lit("IC50"))
    out = cur.neg_log_transform(cur.normalize_units(df, "v", "u"), "kind", "v", "nano_value")
    assert rows(out, "i", "nano_value", "target") == [
        (1, 914.0, 6.03905), (2, 1360.0, 5.86646), (3, 3.46, 8.46092), (4, 750.0, 6.12494)]


def test_one_to_one_join_rejects_repeats(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    twice = spark.createDataFrame([(1, "p"), (1, "q")], "k int, y string")
    assert rows(jn.join_one_to_one(left, twice.limit(1), ["k"])) == [(1, "a", "p"), (2, "b", None)]
    with pytest.raises(Exception, match="repeats a key"):
        jn.join_one_to_one(left, twice, ["k"]).collect()


def test_salts(spark):
    df = spark.createDataFrame([("CCO.Cl",), ("Cl",), ("",), (None,), ("CCO",)], "s string")
    assert [r[0] for r in df.select(ft.strip_components("s")).collect()] == ["CCO", "", None, None, "CCO"]
    assert [r[0] for r in df.select(fn.notation_key(ft.strip_components("s")).isNull()).collect()] == [
        False, True, True, True, False]


def test_notation_counts(spark):
    texts = {
        "CC(=O)Oc1ccccc1C(=O)O": (13, 4, 0, 1, 0),          # aspirin
        "Cn1cnc2c1c(=O)n(C)c(=O)n2C": (14, 6, 0, 2, 0),     # caffeine
        "C[N+](C)(C)CCO": (7, 2, 1, 0, 1),                  # choline
        "[Na+].[Cl-]": (2, 2, 0, 0, 0),
        "ClCCBr": (4, 2, 0, 0, 0),
        "[Ca+2]": (1, 1, 0, 0, 2),
    }
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = df.select("s", F.struct(*[c.alias(n) for n, c in ft.notation_descriptors("s").items()]).alias("d")).collect()
    assert {r["s"]: tuple(r["d"]) for r in got} == texts


def test_gate_and_enforce(spark):
    one = spark.createDataFrame([(3,)], "n int")
    bad = st.findings([("x", "CRITICAL", one, "n", "{} are odd", "mend"), ("y", "WARNING", one.select((F.col("n") * 0).alias("n")), "n", "{} are odd", "mend")])
    assert rows(bad, "check", "severity") == [("x", "CRITICAL"), ("y", "PASS")]
    assert rows(bad, "message", "recommendation") == [("0 are odd", "No action required."), ("3 are odd", "mend")]
    with pytest.raises(AssertionError, match="x"):
        st.enforce(bad)


def test_rejects_need_enough_rows(spark):
    df = spark.createDataFrame([(i, None if i == 0 else "C", 1.0 if i > 1 else None) for i in range(5)], "source_index int, s string, x double")
    ok, bad = cur.partition_rejects(df, {"no text": F.col("s").isNull(), "no value": F.col("x").isNull()})
    assert rows(bad) == [(0, "no text"), (1, "no value")] and ok.count() == 3
    with pytest.raises(ValueError):
        cur.partition_rejects(df, {"no text": F.col("s").isNull()}, minimum=5)


def test_groups_of_any_type_may_be_null(spark):
    df = spark.createDataFrame([(i, None if i == 0 else i % 3) for i in range(9)], "i int, g int")
    assert rows(sp.group_split(df, "g").filter("i = 0"), "g") == [("__NO_SCAFFOLD__",)]
    assert sp.grouped_kfold(df, "g").count() == sp.seeded_group_holdout(df, "g").count() == 9


def test_metrics_keep_the_null_group(spark):
    df = spark.createDataFrame([(None, 1.0, 1.5), (None, 2.0, 2.5), ("a", 1.0, 1.0), ("a", 2.0, 3.0)], "model string, actual double, predicted double")
    got = {r["model"]: (r["rows"], r["mae"], r["spearman"]) for r in ev.regression_metrics(df, ["model"]).collect()}
    assert set(got) == {None, "a"} and got[None][:2] == (2, 0.5) and abs(got[None][2] - 1) < 1e-9


def test_correlation_of_columns_with_holes(spark):
    data = [(float(i), None if i == 3 else 2.0 * i, float(i % 2), 1.0, "train") for i in range(8)] + [(0.0, 99.0, 9.0, 1.0, "test")]
    df = spark.createDataFrame(data, "f0 double, f10 double, f2 double, f1 double, split string")
    names = ["f0", "f10", "f2", "f1"]
    table = ft.correlation_filter(df, names, 0.9)
    got = {r["feature"]: (r["highest"], r["kept"]) for r in table.collect()}
    assert got["f0"] == (None, True) and abs(got["f10"][0] - 1) < 1e-9 and not got["f10"][1] and got["f2"][1] and got["f1"] == (None, True)
    assert ft.kept_features(table, names) == ["f0", "f2", "f1"]


def test_sides_may_be_found_among_many(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(10)] + [("train",), ("test",)], "split string")
    assert sp.require_sides(df) is df


def test_numbers_that_are_none(spark):
    texts = ["1", " 2.5 ", "1e3", "5d", "3.F", "0x10", "+0X1p3", "inf", "NaN", "", None, "x", "-7", "\t8\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(fn.to_number("t").alias("x"))
    got = [r[0] for r in df.collect()]
    assert got[:3] == [1.0, 2.5, 1000.0] and got[3:7] == [None] * 4 and math.isinf(got[7]) and math.isnan(got[8]) and got[9:12] == [None] * 3 and got[12:] == [-7.0, 8.0]
