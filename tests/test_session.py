"""Durable cut points leave no shuffle files and no settings behind."""

import time

from conftest import rows
from pyspark.sql import functions as F

from mensura.session import FILE_CLEANUP, cut


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in found if "/shuffle_" in f}


def test_a_cut_table_leaves_no_shuffle_files(spark):
    keyed = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    table = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(keyed.groupBy("k").agg(F.max("id").alias("top")), "k", "left")
    before, setting = shuffle_files(spark), spark.conf.get(FILE_CLEANUP, None)
    done = cut(table)  # both are held, so no garbage collection removes their files
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:  # they are removed in the background
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(FILE_CLEANUP, None) == setting
    wanted = sorted((k, len(range(k, 1000, 7)), range(k, 1000, 7)[-1]) for k in range(7))
    assert rows(done) == wanted and rows(done.groupBy("k").agg(F.max("n"))) == [w[:2] for w in wanted]
    assert rows(table) == wanted  # what was cut can still be read by itself


def test_a_cut_table_keeps_awkward_names_and_the_users_setting(spark):
    spark.conf.set(FILE_CLEANUP, "false")
    try:
        done = cut(spark.createDataFrame([(1, "x"), (1, "x")], ["a.b", "`"]).distinct())
        assert done.columns == ["a.b", "`"] and [tuple(r) for r in done.collect()] == [(1, "x")]
        assert spark.conf.get(FILE_CLEANUP, None) == "false"
    finally:
        spark.conf.unset(FILE_CLEANUP)
