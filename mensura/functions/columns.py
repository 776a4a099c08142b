"""Column expressions: parsing, transforms, null rules, categories. All run inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mensura import fixed_values as fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Tolerant parse: text that is no number becomes null. Java-only spellings (``5d``, ``0x1p3``) are no numbers."""
    def parsed(text: Column) -> Column:
        head = F.lower(F.substring(F.ltrim(text, F.lit("+-")), 1, 2))
        suffix = F.lower(F.substring(text, -1, 1)).isin("d", "f") & F.substring(text, -2, 1).between(".", "9")
        return F.when((head != "0x") & ~suffix, text.try_cast("double"))

    return let(F.trim(_col(c).cast("string"), F.lit(" \t\n\r\f\x0b")), parsed)


def finite(c: Column | str) -> Column:
    """The value where it is finite, else null, so that aggregates skip it."""
    c = _col(c)
    return F.when(is_finite(c), c)


def is_finite(c: Column | str) -> Column:
    c = _col(c)
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def is_nonfinite(c: Column | str) -> Column:
    """Present but infinite. NaN counts as missing, as it does in the data this follows."""
    return F.coalesce(F.abs(_col(c)) == float("inf"), F.lit(False))


def is_missing(c: Column | str) -> Column:
    c = _col(c)
    return c.isNull() | F.coalesce(F.isnan(c), F.lit(False))


def neg_log(kind: Column | str, raw: Column | str, scaled: Column | str, default: float | None = None) -> Column:
    """Negative log10 of a nano-scale value, by record type; ``default`` where no type rule applies.

    A linear value must be positive. A log value whose raw number is missing stays null even with a default.
    """
    kind, raw, scaled = _col(kind), _col(raw), _col(scaled)
    return (
        F.when((kind == fixed.TYPE_LINEAR) & (scaled > 0), -F.log10(scaled * F.lit(1e-9)))
        .when(kind == fixed.TYPE_LOG, -raw)
        .when(kind == fixed.TYPE_NEG_LOG, raw)
        .when(kind == fixed.TYPE_LOG_NANO, F.lit(9.0) - raw)
        .otherwise(F.lit(default).cast("double"))
    )


def round_value(c: Column | str, digits: int = fixed.TARGET_DIGITS) -> Column:
    """Half-to-even rounding."""
    return F.bround(_col(c), digits)


def sanitize_name(c: Column | str) -> Column:
    """Runs of non-word characters become one underscore; none at the ends. Word characters are Unicode's."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"(?U)\W+", "_"), "^_+|_+$", "")


def null_label(c: Column | str, label: str = fixed.NULL_LABEL) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(label))


def fill_group(c: Column | str, sentinel: str = fixed.NO_GROUP) -> Column:
    """The group as text, or the sentinel."""
    return F.coalesce(_col(c).cast("string"), F.lit(sentinel))


def one_hot(c: Column | str, choices: Iterable, prefix: str) -> list[Column]:
    """One 0/1 column per choice; a value outside the choices, or null, gives zeros."""
    c = _col(c)
    return [
        F.coalesce((c == F.lit(choice)).cast("double"), F.lit(0.0)).alias(f"{prefix}_{choice}".lower())
        for choice in choices
    ]


def clip_shift(c: Column | str, low: int, high: int, shift: int = 0) -> Column:
    """Clamp into a category range, then shift to a non-negative code."""
    return F.greatest(F.least(_col(c), F.lit(high)), F.lit(low)) + F.lit(shift)


def is_close(a: Column | str, b: Column | str, equal_nan: bool = False, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """``|a-b| <= atol + rtol*|b|``; nulls are close to nothing, or to each other when asked."""
    a, b = _col(a), _col(b)
    near = F.coalesce((a == b) | (F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)), F.lit(False))
    gone_a, gone_b = is_missing(a), is_missing(b)
    near = near & ~gone_a & ~gone_b
    return near | (gone_a & gone_b) if equal_nan else near


def json_number(c: Column | str) -> Column:
    """Null instead of NaN or infinity, so that the value can be written as JSON."""
    return finite(c)


def notation_key(c: Column | str) -> Column:
    """Identity key of a notation text: equal texts share it; null and empty text have none."""
    c = _col(c)
    return F.when(F.trim(c) != "", F.upper(F.md5(c)))


def chunk(c: Column, index: int, digits: int = 6) -> Column:
    """The ``index``-th group of hex digits of a hash, as a number. Six digits keep sums of 5e11 terms in a long."""
    return F.conv(F.substring(c, 1 + index * digits, digits), 16, 10).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, wherever the optimizer copies the expression to."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def median_of(values: Column) -> Column:
    """Median of a sorted, non-empty array."""
    n = F.size(values)
    low = F.get(values, F.floor((n - 1) / 2).cast("int"))
    high = F.get(values, F.floor(n / 2).cast("int"))
    return (low + high) / 2
