"""Text features, notation descriptors, train-only imputation and scaling, feature selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura import fixed_values as fixed
from mensura.functions import columns as fn
from mensura.operators.stats import aggregate, long_features
from mensura.skew import beside

# --- text --------------------------------------------------------------------------------------


def token_fingerprint(
    df: DataFrame, text: str, n: int = 2, bits: int = fixed.BITS, out: str = "bits"
) -> DataFrame:
    """Add the on-bit positions of a text: its distinct runs of ``n`` words, hashed and folded. Short text has none.

    Runs are built by pairing the word list with its own shifted copies, so a long text costs linear time.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    runs = words
    for shift in range(1, n):
        shifted = F.slice(words, shift + 1, 1_000_000_000)
        runs = F.zip_with(runs, shifted, lambda head, word: F.concat(head, F.lit(" "), word))
    whole = F.array_distinct(F.array_compact(runs))
    folded = F.transform(whole, lambda run: (
        F.conv(F.substring(F.md5(run), 1, 8), 16, 10).cast("long") % bits
    ).cast("int"))
    marked = F.coalesce(F.array_sort(F.array_distinct(folded)), F.array().cast("array<int>"))
    return df.withColumn(out, marked)


# Patterns of the line notation.
BRACKET = r"\[[^\[\]]*\]"
PLAIN_ATOM = "Br|Cl|[BCNOPSFIbcnops]"
ELEMENT = r"^\[[0-9]*([A-Z][a-z]?|[a-z][a-z]?|\*)"


def notation_descriptors(text: str) -> dict[str, Column]:
    """Counts read off a line notation: heavy atoms, heteroatoms, aliphatic nitrogens, ring closures, formal charge.

    Atoms in brackets are listed and read one by one; all others are counted by pattern in one pass each.
    """
    def times(pattern: str) -> Column:
        return F.regexp_count(bare, F.lit(pattern))

    bare = F.regexp_replace(F.col(text), BRACKET, " ")
    inside = F.regexp_extract_all(F.col(text), F.lit(BRACKET), F.lit(0))
    symbols = F.filter(
        F.transform(inside, lambda a: F.regexp_extract(a, ELEMENT, 1)), lambda s: ~s.isin("H", "D", "T", "")
    )
    heavy = times(PLAIN_ATOM) + F.size(symbols)
    carbons = times("[Cc]") - times("Cl") + F.size(F.filter(symbols, lambda s: s.isin("C", "c")))
    signs = F.transform(inside, lambda a: F.regexp_extract(a, r"([+-]+[0-9]*)\]$", 1))

    def charge(sign: Column) -> Column:
        amount = F.regexp_extract(sign, "([0-9]+)", 1)
        size = F.when(amount != "", amount.try_cast("int")).otherwise(F.length(sign))
        return F.when(sign == "", 0).when(sign.startswith("-"), -size).otherwise(size)

    return {
        "heavy_atoms": heavy,
        "heteroatoms": heavy - carbons,
        "aliphatic_nitrogens": times("N") + F.size(F.filter(symbols, lambda s: s == "N")),
        "ring_closures": F.floor(times("%[0-9][0-9]|[0-9]") / 2).cast("int"),
        "formal_charge": F.aggregate(
            F.transform(signs, charge), F.lit(0), lambda total, c: total + F.coalesce(c, F.lit(0))
        ),
    }


def strip_components(text: Column | str, salts: Sequence[str] = tuple(fixed.SALT_FRAGMENTS)) -> Column:
    """Remove listed fragments from dot-separated text; empty when nothing is left, null when there was no text."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.filter(F.split(text, "[.]"), lambda p: ~p.isin(list(salts)))
    return F.when(F.trim(text) != "", F.array_join(parts, "."))


# --- train-only statistics ---------------------------------------------------------------------


def _train(split: str, c: Column, train: str = "train") -> Column:
    return F.when(F.col(split) == train, c)


def check_missing_allowed(df: DataFrame, columns: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Raise when a column outside ``allowed`` has a missing value, or any column an infinite one."""
    strict = [c for c in columns if c not in allowed]
    counts = df.agg(
        F.array(*[F.count_if(fn.is_missing(c)) for c in strict]).alias("missing"),
        F.array(*[F.count_if(fn.is_nonfinite(c)) for c in columns]).alias("nonfinite"),
    ).first()
    bad = [c for c, n in zip(strict, counts["missing"]) if n] + [c for c, n in zip(columns, counts["nonfinite"]) if n]
    if bad:
        raise ValueError("unsupported missing or infinite values in: " + ", ".join(bad))
    return df


def impute_train_mean(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """Fill missing numbers with the mean of the train rows; a column without train values gets 0."""
    means = df.agg(*[F.coalesce(F.avg(_train(split, fn.finite(c))), F.lit(0.0)).alias("_mean_" + c) for c in columns])
    filled = beside(df, means)
    return filled.withColumns({c: F.coalesce(fn.finite(c), F.col("_mean_" + c)) for c in columns}).drop(*means.columns)


def imputed_counts(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """Missing values per column and split, as ``split, feature, imputed``."""
    counts = df.groupBy(split).agg(*[F.count_if(~fn.is_finite(c)).alias(c) for c in columns])
    return counts.unpivot(split, list(columns), "feature", "imputed")


def _scales(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    aggs = []
    for c in columns:
        x = _train(split, F.col(c).cast("double"))
        deviation = F.coalesce(F.stddev_pop(x), F.lit(1.0))
        aggs.append(F.coalesce(F.avg(x), F.lit(0.0)).alias("_mean_" + c))
        aggs.append(F.when(deviation < 1e-8, 1.0).otherwise(deviation).alias("_scale_" + c))
    return df.agg(*aggs)


def scale_train(df: DataFrame, columns: Sequence[str], split: str = "split", impute: bool = True) -> DataFrame:
    """(x - mean) / population std, both from the (imputed) train rows; a std below 1e-8 counts as 1."""
    rows = impute_train_mean(df, columns, split) if impute else df
    scales = _scales(rows, columns, split)
    scaled = beside(rows, scales)
    return scaled.withColumns(
        {c: (F.col(c) - F.col("_mean_" + c)) / F.col("_scale_" + c) for c in columns}
    ).drop(*scales.columns)


def unscale(df: DataFrame, column: str, fitted_on: DataFrame, target: str, split: str = "split") -> DataFrame:
    """Bring a scaled prediction back to the target's own scale."""
    scales = _scales(fitted_on, [target], split)
    back = F.col(column) * F.col("_scale_" + target) + F.col("_mean_" + target)
    return beside(df, scales).withColumn(column, back).drop(*scales.columns)


# --- selection ---------------------------------------------------------------------------------


def variance_filter(
    df: DataFrame, columns: Sequence[str], threshold: float = fixed.VARIANCE_MIN, split: str = "split"
) -> DataFrame:
    """Per feature: population variance over train rows and whether it is above the threshold."""
    train = df.filter(F.col(split) == "train").withColumn("_id", F.lit(0))
    table = aggregate(long_features(train, "_id", columns), ["feature"], [F.var_pop(fn.finite("x")).alias("variance")])
    return table.select("feature", "variance", F.coalesce(F.col("variance") > threshold, F.lit(False)).alias("kept"))


def bit_variance_filter(
    df: DataFrame, bits: str, threshold: float = fixed.VARIANCE_MIN, split: str = "split"
) -> DataFrame:
    """The same for on-bit lists: a bit's variance is p(1-p); bits never set in train have none."""
    train = df.filter(F.col(split) == "train")
    on = train.select(F.explode(bits).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("_on"))
    p = F.col("_on") / F.col("_rows")
    table = beside(on, train.agg(F.count(F.lit(1)).alias("_rows")))
    return table.select("bit", (p * (1 - p)).alias("variance"), (p * (1 - p) > threshold).alias("kept"))


TILE = 128  # columns of a block


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One array of the columns' finite values a row, in as many parts as tasks run at once: what a task hands on does not depend on its rows."""
    rows = df.select(F.array(*[fn.finite(F.col(c).cast("double")) for c in columns]).alias("v"))
    return rows.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def column_means(vectors: DataFrame, width: int) -> np.ndarray:
    """The mean of each place of the vectors over its values, 0 where there is none; a number for each column comes to the driver."""
    def run(batches):
        n, total = np.zeros(width), np.zeros(width)
        for batch in batches:
            values = _matrix(batch, width)
            held = np.isfinite(values)
            n += held.sum(0)
            total += np.where(held, values, 0.0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(n), pa.array(total)], ["i", "n", "total"])

    found = vectors.mapInArrow(run, "i long, n double, total double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = np.zeros(width)
    for r in found.collect():
        out[r["i"]] = r["total"] / r["n"] if r["n"] else 0.0
    return out


def _tiles(width: int, means: np.ndarray, tile: int):
    """Per task, for every two blocks of columns: the sums over the rows in which both columns of a pair have a value, as one matrix.

    The sums are of distances from the mean: sums of squares of large numbers would lose the small differences.
    """
    blocks = [slice(i, min(i + tile, width)) for i in range(0, width, tile)]
    pairs = [(a, b) for b in range(len(blocks)) for a in range(b + 1)]

    def run(batches):
        sums = {p: np.zeros((6, blocks[p[0]].stop - blocks[p[0]].start, blocks[p[1]].stop - blocks[p[1]].start)) for p in pairs}
        for batch in batches:
            values = _matrix(batch, width) - means
            held = np.isfinite(values).astype(float)
            x = np.where(held > 0, values, 0.0)
            square = x * x
            for (a, b), s in sums.items():
                one, two = blocks[a], blocks[b]
                s += [held[:, one].T @ held[:, two], x[:, one].T @ held[:, two], held[:, one].T @ x[:, two],
                      square[:, one].T @ held[:, two], held[:, one].T @ square[:, two], x[:, one].T @ x[:, two]]
        for (a, b), s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([s.tobytes()], pa.binary())], ["a", "b", "sums"])

    return run, blocks


def correlation_filter(
    df: DataFrame, columns: Sequence[str], threshold: float = fixed.CORRELATION_MAX, split: str = "split", tile: int = TILE,
) -> DataFrame:
    """Per feature: its largest absolute correlation with an earlier feature over train rows, and whether it is kept.

    An earlier feature counts even if it is dropped itself. A pair is judged by the rows in which both have a finite
    value; where either does not vary there the correlation is undefined and never drops. Tasks add up matrices of blocks of
    columns; those of one pair of blocks meet in one task, which adds them and hands on one number for each column.
    """
    columns = list(columns)
    width = len(columns)
    vectors = _vectors(df.filter(F.col(split) == "train"), columns)
    run, blocks = _tiles(width, column_means(vectors, width), tile)
    tiles = vectors.mapInArrow(run, "a int, b int, sums binary").repartition("a", "b").sortWithinPartitions("a", "b")

    def judge(batches):
        at, total = None, None
        for batch in batches:
            for a, b, sums in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (a, b):
                    if at:
                        yield judged(at, total)
                    at, total = (a, b), 0.0
                total = total + np.frombuffer(sums)
        if at:
            yield judged(at, total)

    def judged(at, total):
        one, two = (blocks[k] for k in at)
        n, x, y, xx, yy, xy = total.reshape(6, one.stop - one.start, -1)
        with np.errstate(all="ignore"):
            left, right = xx - x * x / n, yy - y * y / n
            size = np.minimum(np.abs(xy - x * y / n) / np.sqrt(left * right), 1.0)
            varies = (n > 1) & (left > 1e-14 * xx) & (right > 1e-14 * yy)
        if at[0] == at[1]:
            varies &= np.triu(np.ones(varies.shape, bool), 1)
        size = np.where(varies, size, -1.0).max(0)
        some = np.flatnonzero(size >= 0)
        return pa.RecordBatch.from_arrays([pa.array((some + two.start).astype(np.int32)), pa.array(size[some])], ["j", "highest"])

    highest = tiles.mapInArrow(judge, "j int, highest double").groupBy("j").agg(F.max("highest").alias("highest"))
    every = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "j int, feature string")
    return every.join(highest, "j", "left").select("feature", "highest", F.coalesce(F.col("highest") <= threshold, F.lit(True)).alias("kept"))


def kept_features(table: DataFrame, columns: Sequence[str]) -> list[str]:
    """Names kept by a selection table, in the order of the columns; as many as there are columns at most."""
    kept = {r["feature"] for r in table.filter("kept").select("feature").collect()}
    return [c for c in columns if c in kept]


def attach_selected(
    df: DataFrame, selected: DataFrame, group: str, row_id: str = "source_index"
) -> DataFrame:
    """Selected feature columns joined to all original columns by row id, with the group sentinel filled in."""
    return df.withColumn(group, fn.fill_group(group)).join(selected, row_id, "inner")


# --- column sets -------------------------------------------------------------------------------


def model_columns(
    columns: Sequence[str], variant: str, prefix: str = fixed.BIT_PREFIX,
    descriptors: Sequence[str] = tuple(fixed.DESCRIPTORS),
) -> list[str]:
    """Feature columns of a variant: ``bits``, ``descriptors`` or ``combined``; anything else is never a feature."""
    bits = [c for c in columns if c.startswith(prefix)]
    numbers = [c for c in columns if c in set(descriptors)]
    try:
        return {"bits": bits, "descriptors": numbers, "combined": bits + numbers}[variant]
    except KeyError:
        raise ValueError(f"unknown feature variant: {variant}") from None


def feature_variants(
    df: DataFrame, prefix: str = fixed.BIT_PREFIX, descriptors: Sequence[str] = tuple(fixed.DESCRIPTORS),
    widths: dict[str, int] | None = None, forbidden: Sequence[str] = tuple(fixed.IDENTIFIERS),
    nullable: Sequence[str] = tuple(fixed.NULLABLE_DESCRIPTORS),
) -> dict[str, list[str]]:
    """Columns of all three variants, checked for width, forbidden names and unsupported missing values."""
    variants = {v: model_columns(df.columns, v, prefix, descriptors) for v in ("bits", "descriptors", "combined")}
    for name, columns in variants.items():
        if widths and len(columns) != widths[name]:
            raise ValueError(f"{name}: expected {widths[name]} features, found {len(columns)}")
        leaked = set(columns) & set(forbidden)
        if leaked:
            raise ValueError(f"{name}: forbidden columns {sorted(leaked)}")
    check_missing_allowed(df, variants["combined"], nullable)
    return variants


def bit_columns(df: DataFrame, bits: str, width: int = fixed.BITS, prefix: str = fixed.BIT_PREFIX) -> DataFrame:
    """Widen an on-bit list into 0/1 columns, for callers that need plain columns."""
    flags = [F.array_contains(bits, i).cast("int").alias(f"{prefix}{i}") for i in range(width)]
    return df.select(*[c for c in df.columns if c != bits], *flags)
