"""Writing results: Parquet, CSV, JSON without NaN, one folder per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.functions import columns as fn


def export_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV that :func:`read_records_csv` reads back: quotes in a text are doubled; line ends and outer spaces are kept."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def json_safe(df: DataFrame) -> DataFrame:
    """Null in place of NaN and infinite numbers, nested arrays and structs included."""
    def clean(c, kind):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return fn.json_number(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.StructType):
            whole = F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
            return F.when(c.isNotNull(), whole)
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: clean(v, kind.valueType))
        return c

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row; null fields are written as null."""
    json_safe(df).write.mode(mode).option("ignoreNullFields", False).json(path)


def run_scoped_path(root: str, run_id: str) -> str:
    return f"{root.rstrip('/')}/run_id={run_id}"


def write_run(df: DataFrame, root: str, run_id: str, table: str) -> str:
    """Write one table of one run to a new folder; writing the same run twice fails."""
    path = f"{root.rstrip('/')}/{table}/run_id={run_id}"
    df.write.mode("errorifexists").parquet(path)
    return path
