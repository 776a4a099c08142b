"""Incremental ingest of landed record files with Structured Streaming."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.session import cut
from mensura.skew import join_by_key


def landed_records(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
                   files_per_trigger: int = 1000) -> DataFrame:
    """A stream over record files as they land."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def _ids_folders(spark: SparkSession, ledger: str, buckets: list[int]) -> list[str]:
    """The folders of those buckets that hold ids."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{ledger}/bucket=*")
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    found = {f.getPath().getName(): f.getPath().toString() for f in there}  # at most one for each bucket
    return [found[n] for n in (f"bucket={b}" for b in buckets) if n in found]


def ingest_available(stream: DataFrame, path: str, checkpoint: str, row_id: str | None = None, buckets: int = 32) -> DataFrame:
    """Process everything landed so far into Parquet, and return the table.

    Each batch has a folder of its own, named by the query and the batch's number and written by overwriting: a batch that is run again
    after a failure, wherever it broke off, replaces what it wrote before. With ``row_id`` a record whose id another batch
    has landed, or that comes again in its batch, is left out, however old or new it is. Ids lie in a ledger, by hash buckets; a batch
    reads only those ids of the buckets it touches that are between its smallest and its largest, never the records. Of records of
    one batch that share an id, the first by their content stays. Records without an id are all kept.
    """
    spark, schema = stream.sparkSession, stream.schema
    ledger = f"{path.rstrip('/')}/_ids"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=none")

    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or hashlib.sha1(checkpoint.encode()).hexdigest()
        name = f"{query}-{number}"
        fresh = batch
        if row_id is not None:
            whole = F.struct(*[F.col(c) for c in schema.names])
            some = batch.filter(F.col(row_id).isNotNull())
            repeated = cut(some.groupBy(row_id).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select(row_id))
            named = some
            if not repeated.isEmpty():
                first = some.join(repeated, row_id, "left_semi").groupBy(row_id).agg(F.min_by(whole, F.to_json(whole)).alias("_row")).select("_row.*")
                named = some.join(repeated, row_id, "left_anti").select(*schema.names).unionByName(first)
            named = cut(named.withColumn("bucket", F.pmod(F.xxhash64(row_id), F.lit(buckets)).cast("int")))
            touched = named.groupBy("bucket").agg(F.min(row_id).alias("low"), F.max(row_id).alias("high")).collect()  # a row for each bucket
            folders = _ids_folders(spark, ledger, [r.bucket for r in touched])
            if folders:
                known = spark.read.option("basePath", ledger).schema(T.StructType([
                    schema[row_id], T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.StringType())])).parquet(*folders)
                known = known.filter((F.col("batch") != name) & F.col(row_id).between(min(r.low for r in touched), max(r.high for r in touched)))
                named = cut(join_by_key(named, known.select(row_id), [row_id], "left_anti"))
            named.select(row_id, "bucket", F.lit(name).alias("batch")).repartition("bucket").sortWithinPartitions("bucket", row_id).write.partitionBy("bucket", "batch").mode(
                "overwrite").option("partitionOverwriteMode", "dynamic").parquet(ledger)
            fresh = named.select(*schema.names).unionByName(batch.filter(F.col(row_id).isNull()))
        fresh.write.mode("overwrite").parquet(f"{path}/batch={name}")

    query = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def touched_keys(batch: DataFrame, key: str) -> DataFrame:
    """Distinct keys of a batch: medians are not incremental, so a stream recomputes only the keys a batch touches."""
    return batch.filter(F.col(key).isNotNull()).select(key).distinct()
