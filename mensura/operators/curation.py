"""Row-wise curation: column pruning, validity, units, transforms, censoring, ranges, rejects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura import fixed_values as fixed
from mensura.functions import columns as fn


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns that hold no value. The columns of the result depend on the data, so one aggregate runs at once."""
    held = df.agg(*[F.bool_or(F.col(f"`{c}`").isNotNull()).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for c, some in zip(df.columns, held) if not some])


def drop_if_present(df: DataFrame, names: Sequence[str] = tuple(fixed.PRUNED_COLUMNS)) -> DataFrame:
    return df.drop(*names)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise KeyError("missing required columns: " + ", ".join(missing))
    return df


def with_optional(df: DataFrame, name: str, dtype: str = "string") -> DataFrame:
    """The column, or an all-null column of that name."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(dtype))


def is_valid(columns: Sequence[str], rules: Mapping[str, Sequence[str]]) -> Column:
    """Whether no flag text of the row is in its list of bad texts; rows without a text, and missing columns, are valid."""
    bad = [F.col(name).isin(list(texts)) for name, texts in rules.items() if name in columns]
    return reduce(Column.__and__, [~F.coalesce(b, F.lit(False)) for b in bad], F.lit(True))


def is_flagged(columns: Sequence[str], flag: str, bad: int = 1) -> Column:
    """Whether the row's flag is set; a null flag, or none at all, is not."""
    return F.col(flag).eqNullSafe(F.lit(bad)) if flag in columns else F.lit(False)


def filter_validity(df: DataFrame, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """Drop rows whose flag text is in any list of bad texts; rows without a text stay. A missing column drops nothing."""
    return df.filter(is_valid(df.columns, rules))


def filter_flag(df: DataFrame, flag: str, bad: int = 1) -> DataFrame:
    """Drop flagged rows; a null flag is kept. Without the column nothing is flagged."""
    return df.filter(~is_flagged(df.columns, flag, bad)) if flag in df.columns else df


def filter_allowed(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(list(allowed)))


def normalize_units(
    df: DataFrame, value: str, unit: str, factors: Mapping[str, float] = fixed.UNIT_FACTORS,
    out: str = "nano_value", normal: str = fixed.NORMAL_UNIT,
) -> DataFrame:
    """Add ``out`` = value x factor of its unit, keep the unit as ``original_<unit>``, write the normal unit."""
    factor = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
    return (
        df.withColumn("original_" + unit, F.col(unit))
        .withColumn(out, fn.to_number(value) * F.try_element_at(factor, F.col(unit)))
        .withColumn(unit, F.lit(normal))
    )


def neg_log_transform(
    df: DataFrame, kind: str, raw: str, scaled: str, out: str = "target", default: float | None = None,
    digits: int = fixed.TARGET_DIGITS,
) -> DataFrame:
    return df.withColumn(out, fn.round_value(fn.neg_log(kind, fn.to_number(raw), scaled, default), digits))


def drop_nonfinite(df: DataFrame, column: str) -> DataFrame:
    return df.filter(fn.is_finite(column))


def filter_censored(df: DataFrame, relation: str, keep: str = fixed.EXACT_RELATION) -> DataFrame:
    return df.filter(F.col(relation) == keep)


def filter_range(
    df: DataFrame, column: str, above: float | None = 0.0, up_to: float | None = fixed.RANGE_MAX
) -> DataFrame:
    """``above < x <= up_to``; a bound of None is open. NaN is outside."""
    x = F.col(column)
    if above is not None:
        df = df.filter(x > above)
    return df.filter(x <= up_to) if up_to is not None else df.filter(~F.isnan(x))


def with_reason(df: DataFrame, rules: Mapping[str, Column], out: str = "reason") -> DataFrame:
    """Name of the first rule a row breaks, else null. A rule is the condition that rejects."""
    reason = reduce(lambda so_far, r: F.coalesce(so_far, r), [
        F.when(broken, F.lit(name)) for name, broken in rules.items()
    ])
    return df.withColumn(out, reason)


def partition_rejects(
    df: DataFrame, rules: Mapping[str, Column], row_id: str = "source_index", minimum: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected ids with reason). ``minimum`` checks at once that enough rows are usable."""
    judged = with_reason(df, rules)
    ok = judged.filter(F.col("reason").isNull()).drop("reason")
    if minimum is not None and ok.limit(minimum).count() < minimum:
        raise ValueError(f"fewer than {minimum} usable records")
    return ok, judged.filter(F.col("reason").isNotNull()).select(row_id, "reason")
