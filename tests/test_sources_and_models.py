"""Files, tables, streams and models end to end."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from __spark_entry__ import queries
from mensura.operators import evaluation as ev
from mensura.operators import models as md
from mensura.operators import splits as sp
from mensura.plans import benchmark as bench
from mensura.plans.audit import audit
from mensura.registry import Tables
from mensura.sources import records as rec
from mensura.sources import sinks
from mensura.streaming import landed

from conftest import DATA


def test_bad_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\n1,x\n2,y,extra\nq,z\n3,w\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    good, bad = rec.malformed_rows(spark, str(tmp_path / "r.csv"), schema)
    assert rows(good) == [(1, "x"), (3, "w")]
    assert rows(bad) == [("2,y,extra",), ("q,z",)]


def test_landed_ids_are_unique_and_fixed(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 5).alias("x")).repartition(6)
    landed_rows = rec.land_records(df, str(tmp_path / "t"))
    assert landed_rows.select("source_index").distinct().count() == 100
    with pytest.raises(Exception):
        rec.land_records(df, str(tmp_path / "t"))


def test_entity_lookup(spark):
    df = spark.createDataFrame([("T1", "Alpha (beta)"), ("T2", "alpha-2"), ("T3", None)], "id string, name string")
    assert rows(rec.search_entities(df, "name", " ALPHA "), "id") == [("T1",), ("T2",)]
    assert rec.select_entity(df, 0, "id", ["name"]).first()["name"] == "Alpha_beta"
    assert rec.select_entity(df, 2, "id", ["name"]).first()["name"] == "Unknown"
    for bad in (-1, 3):
        with pytest.raises(IndexError):
            rec.select_entity(df, bad, "id", ["name"])
    with pytest.raises(ValueError):
        rec.search_entities(df, "name", "  ")


def test_json_has_no_nan(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")])], "i int, x double, a array<double>")
    sinks.write_json(df, str(tmp_path / "j"))
    text = [f.read_text() for f in (tmp_path / "j").glob("*.json") if f.read_text()][0]
    assert json.loads(text) == {"i": 1, "x": None, "a": [1.0, None]}


def test_runs_do_not_overwrite(spark, tmp_path):
    df = spark.range(3)
    sinks.write_run(df, str(tmp_path), "r1", "t")
    with pytest.raises(Exception):
        sinks.write_run(df, str(tmp_path), "r1", "t")
    sinks.write_run(df, str(tmp_path), "r2", "t")
    assert rows(spark.read.parquet(str(tmp_path / "t")).groupBy("run_id").count()) == [("r1", 3), ("r2", 3)]


def test_stream_ingests_each_record_once(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType())])
    base = spark.range(10).select("id", F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"))
    base.write.parquet(source)
    stream = lambda: landed.landed_records(spark, source, schema)
    assert landed.ingest_available(stream(), out, marks, "id").count() == 10
    base.filter("id > 4").unionByName(spark.range(10, 12).select("id", F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"))).write.mode("append").parquet(source)
    assert sorted(r["id"] for r in landed.ingest_available(stream(), out, marks, "id").collect()) == list(range(12))
    spark.range(-3, 1).select("id", F.timestamp_seconds(F.col("id") + 1_600_000_000).alias("ts")).write.mode("append").parquet(source)  # years late
    assert sorted(r["id"] for r in landed.ingest_available(stream(), out, marks, "id").collect()) == list(range(-3, 12))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = T.StructType.fromDDL("id long, v long")
    stream = lambda: landed.landed_records(spark, source, schema)
    spark.createDataFrame([(1, 1), (None, 2), (None, 3)], schema).coalesce(1).write.parquet(source)
    assert landed.ingest_available(stream(), out, marks, "id").count() == 3
    for name in ("0", ".0.crc"):  # as if it broke off between the write and the commit
        (tmp_path / "marks" / "commits" / name).unlink()
    assert rows(landed.ingest_available(stream(), out, marks, "id")) == sorted([(1, 1), (None, 2), (None, 3)], key=repr)
    spark.createDataFrame([(1, 9), (2, 2), (2, 1), (None, 3)], schema).coalesce(1).write.mode("append").parquet(source)
    want = sorted([(1, 1), (2, 1), (None, 2), (None, 3), (None, 3)], key=repr)
    assert rows(landed.ingest_available(stream(), out, marks, "id")) == want
    assert landed.ingest_available(stream(), out, str(tmp_path / "other"), "id").count() == 5 + 3  # a new query knows the ids of the old one


def test_metrics_are_those_of_complete_pairs(spark):
    nan, inf = float("nan"), float("inf")
    data = [("a", float(i), 2.0 * i) for i in range(1, 6)] + [("a", 6.0, None)]
    data += [("b", 1.0, nan), ("b", 2.0, 2.5), ("b", 3.0, 3.5), ("b", 9.0, inf), ("b", None, 4.0), (None, None, 1.0)]
    found = {r["m"]: r for r in ev.regression_metrics(spark.createDataFrame(data, "m string, actual double, predicted double"), ["m"]).collect()}
    assert (found["a"]["rows"], found["a"]["left_out"], found["a"]["r2"]) == (5, 1, -4.5)
    assert found["a"]["pearson"] == pytest.approx(1) and found["a"]["spearman"] == pytest.approx(1)
    assert (found["b"]["rows"], found["b"]["left_out"], found["b"]["mae"], found["b"]["rmse"]) == (2, 3, 0.5, 0.5)
    assert (found[None]["rows"], found[None]["mae"], found[None]["spearman"]) == (0, None, None)


def test_csv_keeps_quotes_and_line_ends(spark, tmp_path):
    texts = ['line one\nline "two", x', '"', "", " spaces ", "a,b", None, "back\\slash", "\r\nend"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    sinks.write_csv(df, str(tmp_path / "c"))
    back = {r["i"]: r["t"] for r in rec.read_records_csv(spark, str(tmp_path / "c"), df.schema).collect()}
    assert [back[i] for i in (0, 1, 3, 4, 6)] == [texts[i] for i in (0, 1, 3, 4, 6)] and len(back) == len(texts)


def test_ids_follow_files_and_places(spark, tmp_path):
    for name, low, high in (("a", 0, 3), ("b", 3, 5000), ("c", 5000, 5010)):
        spark.range(low, high, 1, 1).write.parquet(str(tmp_path / "in" / f"part={name}"))
    source = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    assert rec.land_records(source, str(tmp_path / "out")).filter("source_index <> id").count() == 0


def _table(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("source_index"), (F.col("id") % 40).cast("string").alias("g"),
        F.when(F.col("id") % 11 != 0, F.sin("id")).alias("x"), F.cos(F.col("id") * 3).alias("z"),
        (F.coalesce(F.sin("id"), F.lit(0.0)) * 2 + F.cos(F.col("id") * 3)).alias("y"))


SPACES = {"forest": {"numTrees": ("int", 3, 4), "maxDepth": ("int", 3, 3)}}


def test_benchmark_and_matched_comparison(spark, tmp_path):
    df = _table(spark)
    options = {"families": ["forest"], "trials": 1, "folds": 2, "spaces": SPACES}
    out = bench.benchmark(df, {"both": ["x", "z"]}, "y", "g", **options)
    row = out["results"].first()
    assert row["n_test"] == 80 and row["test_r2"] > 0.3 and row["cv_mae"] > 0
    test = sp.group_split(df, "g").filter("split = 'test'")
    exact = test.select("source_index", F.col("y").alias("actual"), F.col("y").alias("predicted"))
    got = bench.matched_comparison(df, {"both": ["x", "z"]}, "y", "g", exact, "oracle", **options)
    assert got["outcome"].first()["outcome"] == "win"
    assert got["held_out"].count() == 80
    with pytest.raises(ValueError, match="test rows"):
        bench.matched_comparison(df, {"both": ["x", "z"]}, "y", "g", exact.limit(5), "oracle", **options)


def test_model_store_round_trip(spark, tmp_path):
    df = _table(spark)
    model = md.fit_forest(df, ["x", "z"], "y", {"numTrees": 3, "maxDepth": 3})
    md.save_model(model, str(tmp_path / "m"), {"columns": ["x", "z"]}, df)
    again, metadata = md.load_model(spark, str(tmp_path / "m"))
    assert metadata == {"columns": ["x", "z"]}
    assert rows(md.predict(model, df, ["x", "z"], "y")) == rows(md.predict(again, df, ["x", "z"], "y"))


def test_draw_is_seeded_and_in_range():
    a, b = md.draw(md.SPACES["boosted"], 5), md.draw(md.SPACES["boosted"], 5)
    assert a == b and all(2 <= s["maxDepth"] <= 10 and 0.01 <= s["stepSize"] <= 0.2 for s in a)


def test_metrics_without_variance(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "actual double, predicted double")
    row = ev.regression_metrics(df).first()
    assert (row["mae"], row["r2"], row["pearson"], row["spearman"]) == (1.5, None, None, None)


def test_p_values(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("actual"), (F.col("id") + F.sin("id")).alias("predicted"))
    row = ev.correlation_pvalue(df).first()
    assert row["pearson_p"] < 1e-6 and row["spearman_p"] < 1e-6


def test_audit_tables(spark):
    wanted = ["stage_counts", "leakage", "feature_sanity", "split_assignments", "dataset_hash", "findings"]
    tables = audit(Tables(spark, DATA).records, wanted, features=["IC50_nM"])
    assert tables["stage_counts"].count() == 9
    assert {r["severity"] for r in tables["findings"].collect()} <= {"PASS", "WARNING", "CRITICAL"}
    assert list(tables) == wanted


def test_a_batch_without_repeated_ids_is_not_written_as_json(spark, tmp_path, monkeypatch):
    source, out, calls = str(tmp_path / "in"), str(tmp_path / "out"), []
    to_json = landed.F.to_json
    monkeypatch.setattr(landed.F, "to_json", lambda c: (calls.append(1), to_json(c))[1])

    def batch(data):
        spark.createDataFrame(data, "id int, x string").coalesce(1).write.mode("append").parquet(source)
        return rows(landed.ingest_available(landed.landed_records(spark, source, T.StructType.fromDDL("id int, x string")), out, str(tmp_path / "marks"), "id"))

    assert batch([(1, "b"), (2, "a"), (None, "c"), (None, "c")]) == sorted([(1, "b"), (2, "a"), (None, "c"), (None, "c")], key=repr) and not calls
    assert batch([(2, "z"), (3, "b"), (3, "a"), (4, None)]) == sorted([(1, "b"), (2, "a"), (3, "a"), (4, None), (None, "c"), (None, "c")], key=repr) and calls


def test_the_benchmark_computes_its_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def looked_at(x):
        seen.add(1)
        return x

    df = spark.range(200).select(F.col("id").alias("source_index"), (F.col("id") % 40).cast("string").alias("g"), (F.col("id") % 7).cast("double").alias("x"),
                                 looked_at((F.col("id") % 11).cast("double")).alias("y"))
    options = {"families": ["forest"], "trials": 1, "folds": 2, "spaces": {"forest": {"numTrees": ("step", 2, 2, 1), "maxDepth": ("int", 2, 2)}}}
    bench.benchmark(df, {"x": ["x"]}, "y", "g", **options)
    assert seen.value == 200


def test_the_benchmark_query_searches_the_full_spaces(spark, tmp_path, monkeypatch):
    spark.range(60).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("name "), F.col("id") % 7).alias("p_name"), F.concat(F.lit("Brand#"), F.col("id") % 5).alias("p_brand"),
        (F.col("id") % 10).cast("int").alias("p_size"), (F.col("id") + 900.0).alias("p_retailprice")).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(180).select(
        (F.col("id") % 60).alias("l_partkey"), (F.col("id") % 50 + 1.0).alias("l_quantity"), (F.col("id") % 11 / 100).alias("l_discount"),
        (F.col("id") * 37 % 1000 + 1.0).alias("l_extendedprice")).write.parquet(str(tmp_path / "lineitem.parquet"))
    asked = []

    def search(df, family, columns, label, fold, n, folds, space, *rest):
        asked.append((family, len(columns), n, folds, space, df.select(fold).distinct().count()))
        params = {"forest": '{"numTrees": 2, "maxDepth": 2}', "boosted": '{"maxIter": 2, "maxDepth": 2}'}[family]
        return spark.createDataFrame([(0, 1.0, params)], "number int, value double, params string")

    monkeypatch.setattr(md, "search", search)
    assert rows(queries()["benchmark"](spark, str(tmp_path)), "model", "n_features", "sound") == [
        ("boosted", 21, True), ("boosted", 5, True), ("forest", 21, True), ("forest", 5, True)]
    assert asked == [(family, width, 8, 3, md.SPACES[family], 3) for family in md.FAMILIES for width in (5, 21)]


def test_a_forest_is_the_same_with_and_without_cached_node_ids(spark):
    df, params = _table(spark), {"numTrees": 4, "maxDepth": 6, "featureSubsetStrategy": "sqrt"}
    cached, plain = md.fit_forest(df, ["x", "z"], "y", params), md.fit_forest(df, ["x", "z"], "y", {**params, "cacheNodeIds": False})
    assert cached.stages[-1].getCacheNodeIds() and not plain.stages[-1].getCacheNodeIds()
    assert rows(md.predict(cached, df, ["x", "z"], "y")) == rows(md.predict(plain, df, ["x", "z"], "y"))
