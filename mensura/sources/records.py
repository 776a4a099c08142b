"""Reading and landing record files, tables and entity lookups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.functions import columns as fn
from mensura.skew import ordered_prefix
from mensura.sources import quoted

def read_records_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV; types are inferred when no schema is given. ``source_index`` is given once, by :func:`land_records`.

    Quotes inside quoted text are doubled, and a quoted text may hold line ends; a file of any size is read by many tasks. Fields that
    do not fit their type are null.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    states = quoted.first_states(quoted.lines_of(spark, path))
    records = quoted.records_of(spark, path, states=states)
    if schema is None:
        texts = T.StructType([T.StructField(c, T.StringType()) for c in quoted.header_of(spark, path, states)])
        schema = quoted.inferred(quoted.parsed(records, texts).drop(quoted.CORRUPT)) if len(texts) else texts
    return quoted.parsed(records, schema).drop(quoted.CORRUPT)


def malformed_rows(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the schema, raw text of the records that do not, as ``line``); nothing fails and nothing is lost.

    Records are cut as :func:`read_records_csv` does; a malformed one that spans lines is one row.
    """
    rows = quoted.parsed(quoted.records_of(spark, path), schema)
    bad = F.col(quoted.CORRUPT)
    return rows.filter(bad.isNull()).drop(quoted.CORRUPT), rows.filter(bad.isNotNull()).select(bad.alias("line"))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an input with fewer splits than cores to all cores; larger inputs stay as they are.

    Meant for work that is heavy per row, such as long texts in a few unsplittable files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def land_records(df: DataFrame, path: str, row_id: str = "source_index", mode: str = "errorifexists") -> DataFrame:
    """Write records once with a row id, and read them back; the id is fixed from then on.

    Ids count from 0 without gaps. Records read from files are numbered by file name and place in the file, however the files
    were cut into tasks; other records by partition and place.
    """
    here = F.monotonically_increasing_id()
    try:
        placed = df.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", here.alias("here")).alias("_place"))
    except AnalysisException:  # not read from files
        placed = df.withColumn("_place", F.struct(here.alias("here")))
    ordered_prefix(placed, [F.col("_place")]).withColumnRenamed("before", row_id).drop("_place", "total").write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def select_records(
    df: DataFrame, entity: str, entity_id, kind: str, kinds: Sequence[str], value: str
) -> DataFrame:
    """Records of one entity with a value, of the wanted types; the filter reaches the file scan."""
    return df.filter((F.col(entity) == F.lit(entity_id)) & F.col(value).isNotNull() & F.col(kind).isin(list(kinds)))


def register_table(df: DataFrame, name: str, saved: bool = False) -> None:
    """Create or replace a table: a session view, or a saved catalog table."""
    if saved:
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)


def materialize_if_absent(spark: SparkSession, names: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The first existing table of the candidates; if there is none, build and save the first name."""
    for name in names:
        if spark.catalog.tableExists(name):
            return spark.table(name)
    build().write.mode("errorifexists").saveAsTable(names[0])
    return spark.table(names[0])


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows in a stated order."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def search_entities(df: DataFrame, name: str, term: str, k: int | None = 10, order_by: Sequence[str] = ()) -> DataFrame:
    """Entities whose name contains the term, ignoring case; the first ``k`` in name order, or all."""
    if not term or not term.strip():
        raise ValueError("the search term must not be empty")
    found = df.filter(F.contains(F.lower(F.col(name)), F.lit(term.strip().lower()))).orderBy(name, *order_by)
    return found if k is None else found.limit(k)


def select_entity(
    df: DataFrame, k: int, key: str, names: Sequence[str], order_by: Sequence[str] = ()
) -> DataFrame:
    """The k-th match (from 0) with its key as text and its names made safe for file and table names."""
    if not isinstance(k, int) or isinstance(k, bool):
        raise TypeError("k must be an integer")
    if k < 0:
        raise IndexError(f"{k} is out of bounds")
    order = [F.col(c) for c in (order_by or [key])]
    placed = ordered_prefix(df.select(*dict.fromkeys([key, *names, *(order_by or [])])), order)
    row = placed.filter(F.col("before") == k).select(F.col(key).cast("string").alias(key), *[
        fn.sanitize_name(F.coalesce(F.col(c), F.lit("Unknown"))).alias(c) for c in names
    ])
    if row.isEmpty():
        raise IndexError(f"{k} is out of bounds")
    return row
