"""Session settings and durable cut points."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # since Spark 4.1; earlier ones ignore it


def build_session(app: str = "mensura", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC time and adaptive execution; other settings stay the cluster's own."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder every executor can reach; a local folder only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="mensura-checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that later steps neither recompute nor lose it.

    Nothing reads the shuffle files of the writing again, so they go with it, and not when the driver happens to collect its garbage.
    """
    shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(FILE_CLEANUP, None)
    conf.set(FILE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # the setting holds for a DataFrame that is made under it
    finally:
        if before is None:
            conf.unset(FILE_CLEANUP)
        else:
            conf.set(FILE_CLEANUP, before)
