"""Delimited text with quoted fields, cut at the true ends of its records wherever tasks begin."""

import random

import pytest
from conftest import rows
from pyspark.sql import types as T

from mensura.sources import quoted, sinks
from mensura.sources import records as rec

TEXTS = ['line one\nline "two", x', '"', " spaces ", "a,b", None, "back\\slash", "\r\nend", 'q"in, "side', "many\n\n\nempty lines\n", 'é🙂\n""\n', 'say "hi", ok']


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]

    def use(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "0")

    yield use
    for n, v in zip(names, old):
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", ["128m", "300b", "61b"])
def test_records_come_back_from_splits_of_any_size(spark, tmp_path, small_splits, size):
    rng = random.Random(1)
    data = [(i, TEXTS[i] if i < len(TEXTS) else rng.choice(TEXTS), i / 7) for i in range(80)]
    df = spark.createDataFrame(data, "i int, t string, x double")
    path = str(tmp_path / "c")
    sinks.write_csv(df.repartition(2), path)
    small_splits(size)
    if size != "128m":
        assert quoted.lines_of(spark, path).rdd.getNumPartitions() > 8
    assert sorted(map(tuple, rec.read_records_csv(spark, path, df.schema).collect())) == sorted(data)
    good, bad = rec.malformed_rows(spark, path, df.schema)
    assert sorted(map(tuple, good.collect())) == sorted(data) and bad.count() == 0


@pytest.mark.parametrize("size", ["128m", "7b"])
def test_good_and_bad_records_are_cut_alike(spark, tmp_path, small_splits, size):
    (tmp_path / "r.csv").write_text('a,b\n1,x\n2,y,extra\nq,z\n3,w\n\n4,"two\nlines, ""x"""\nz,"bad\nrecord"\n5,it"s\n6,"open\nto the\nend\n')
    small_splits(size)
    good, bad = rec.malformed_rows(spark, str(tmp_path / "r.csv"), T.StructType.fromDDL("a int, b string"))
    whole = rows(good)
    assert {(1, "x"), (3, "w"), (4, 'two\nlines, "x"'), (5, 'it"s')} <= set(whole)
    assert {("2,y,extra",), ("q,z",), ('z,"bad\nrecord"',)} <= set(rows(bad))
    assert len(whole) + bad.count() == 8  # the open record is one, in either


def test_types_are_inferred_from_all_records(spark, tmp_path):
    text = "n,big,d,day,ts,flag,name,none\r\n1,99999999999,1.5,2020-01-02,2020-01-02 03:04:05,true,x,\r\n,1,2,2020-02-02,2020-01-02 03:04:05,false,\"a\r\nb\",\r\n"
    (tmp_path / "t.csv").write_bytes(text.encode())
    got = rec.read_records_csv(spark, str(tmp_path / "t.csv"))
    assert [k for _, k in got.dtypes] == ["int", "bigint", "double", "date", "timestamp", "boolean", "string", "string"]
    assert rows(got, "n", "name") == [(1, "x"), (None, "a\r\nb")]
    assert rec.read_records_csv(spark, str(tmp_path / "t.csv"), "n int, big double").columns == ["n", "big"]


def test_state_of_a_line():
    lines = ["a,b", 'a,"b', 'a,"b"', '"a""', '""', 'x"y', '"a"b,c', '"a",""","', ""]
    assert [quoted.goes_on(x, False) for x in lines] == [False, True, False, True, False, False, False, False, False]
    assert [quoted.goes_on(x, True) for x in lines] == [True, False, False, False, True, False, False, False, True]


def test_header_only_and_empty_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert rec.read_records_csv(spark, str(tmp_path / "h.csv"), "a int, b string").count() == 0
    assert rec.read_records_csv(spark, str(tmp_path / "h.csv")).columns == ["a", "b"]
    assert rec.malformed_rows(spark, str(tmp_path / "h.csv"), T.StructType.fromDDL("a int"))[1].count() == 0


@pytest.mark.parametrize("size", ["128m", "5b"])
def test_types_are_inferred_without_cutting_the_records_twice(spark, tmp_path, small_splits, monkeypatch, size):
    (tmp_path / "a.csv").write_text('n,b\n1,x\n')
    (tmp_path / "b.csv").write_text('n,b\n2,"y\nz"\n')
    calls = []
    for name in ("first_states", "records_of"):
        whole = getattr(quoted, name)
        monkeypatch.setattr(quoted, name, lambda *a, _n=name, _f=whole, **k: (calls.append(_n), _f(*a, **k))[1])
    small_splits(size)
    got = rec.read_records_csv(spark, str(tmp_path))
    assert got.columns == ["n", "b"] and rows(got) == [(1, "x"), (2, "y\nz")]
    assert sorted(calls) == ["first_states", "records_of"]
    (tmp_path / "0.csv").write_text('"n ""of\n\nmany\nlines""",b\r\n2,y\n')
    states = quoted.first_states(quoted.lines_of(spark, str(tmp_path)))
    assert quoted.header_of(spark, str(tmp_path), states) == ['n "of\n\nmany\nlines"', "b"]
