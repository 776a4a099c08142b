"""Descriptive and audit aggregates. Counts combine before the shuffle; medians and quantiles are exact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura import fixed_values as fixed
from mensura.functions import columns as fn
from mensura.operators.consensus import representative_row, replicate_profile
from mensura.operators.joins import exclusive_rows
from mensura.session import cut
from mensura.skew import aggregate, beside, join_by_key, select_quantiles


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _share(part: Column, whole: Column) -> Column:
    """Percent of a whole; 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(100.0) * part / whole)


def _number_aggs(column: str, prefix: str = "") -> list[Column]:
    x = fn.finite(column)
    return [
        F.count(x).alias(prefix + "count"),
        _count(fn.is_missing(column)).alias(prefix + "missing"),
        _count(fn.is_nonfinite(column)).alias(prefix + "nonfinite"),
        F.min(x).alias(prefix + "min"),
        F.max(x).alias(prefix + "max"),
        F.avg(x).alias(prefix + "mean"),
        F.stddev_samp(x).alias(prefix + "std"),
    ]


def number_stats(
    df: DataFrame, column: str, by: Sequence[str] = ()
) -> DataFrame:
    """Count of finite values, missing, nonfinite, min, max, mean, sample std, exact median."""
    rows = df.select(*by, F.col(column).cast("double").alias(column))
    rows = rows.withColumn("_x", fn.finite(column))
    return aggregate(rows, by, _number_aggs(column), {"median": ("_x", 0.5)})


def target_stats(
    df: DataFrame, column: str, scopes: Mapping[str, Column], quantiles: Sequence[float] = tuple(fixed.QUANTILES),
) -> DataFrame:
    """Long table ``scope, statistic, value`` of number statistics and quantiles.

    A scope is a row condition. A row is copied once for each scope it is in, so one grouping covers all scopes.
    """
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in scopes.items()]))
    rows = df.select(F.explode(hits).alias("scope"), F.col(column).cast("double").alias("_y"))
    rows = rows.withColumn("_x", fn.finite("_y"))
    aggs = [F.count(F.lit(1)).alias("rows"), *_number_aggs("_y")[1:]]
    names = {f"quantile_{round(q * 100)}%": q for q in quantiles}
    wanted = {"median": ("_x", 0.5), **{n: ("_x", q) for n, q in names.items()}}
    wide = aggregate(rows, ["scope"], aggs, wanted)
    order = ["rows", "missing", "nonfinite", "min", "max", "mean", "median", "std", *names]
    cells = F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).cast("double").alias("value")) for n in order])
    return wide.select("scope", F.inline(cells))


def key_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Number of distinct non-null values per column, one row per column, from one pass."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    found = df.agg(*[count(F.col(c)).alias(str(i)) for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(str(i)).alias("unique_values")) for i, c in enumerate(columns)])
    return found.select(F.inline(cells))


def stage_lineage(
    ledger: DataFrame, stages: Mapping[str, Sequence[str]], keys: Sequence[str], numbers: Sequence[str], missing: Sequence[str] = (),
    reached: str = "_reached", replaced: Mapping[str, tuple[str, int]] | None = None,
) -> DataFrame:
    """Per stage: rows before, after, removed, percent removed, unique keys, missing counts, number statistics.

    ``ledger`` has every record once, with the number of the last stage it is in; ``stages`` names the columns of each stage in order.
    A column that a stage does not have gives nulls. ``replaced`` says which column takes another's place from which stage on. What a
    stage holds is what reaches it or goes further, so records are counted once, by the last stage, and summed from the end.
    """
    spark, replaced = ledger.sparkSession, dict(replaced or {})
    n = len(stages)
    names = spark.createDataFrame([(i, s) for i, s in enumerate(stages, 1)], "stage_order int, stage string")
    has = {c: [i for i, columns in enumerate(stages.values(), 1) if c in columns] for c in [*keys, *numbers, *missing]}
    # Measures: a number, or what replaces it, with the stages in which it holds.
    spans = []
    for c in numbers:
        low, high = min(has[c], default=1), max(has[c], default=0)
        other, since = replaced.get(c, (c, n + 1))
        spans += [(c, c, low, min(high, since - 1))] + ([(c, other, since, high)] if since <= high else [])
    rows = ledger.select(
        F.col(reached).cast("int").alias("_r"), *[F.col(c).cast("string").alias("_k_" + c) for c in keys],
        *[fn.to_number(column).alias(f"_x{i}") for i, (_, column, _, _) in enumerate(spans)],
        *[F.coalesce(fn.is_missing(fn.to_number(c)) if c in numbers else F.col(c).isNull(), F.lit(False)).alias("_m_" + c) for c in missing],
    )
    aggs = [F.count(F.lit(1)).alias("rows"), *[F.count_if("_m_" + c).alias("_m_" + c) for c in missing]]
    for i in range(len(spans)):
        x = fn.finite(f"_x{i}")
        parts = {"count": F.count(x), "missing": _count(fn.is_missing(f"_x{i}")), "nonfinite": _count(fn.is_nonfinite(f"_x{i}")),
                 "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "var": F.var_pop(x)}
        aggs += [a.alias(f"_{k}{i}") for k, a in parts.items()]
    by_end = rows.groupBy("_r").agg(*aggs)  # a row for each stage

    each = by_end.join(F.broadcast(names), F.col("_r") >= F.col("stage_order"), "right")
    means = [(F.sum(F.col(f"_count{i}") * F.col(f"_mean{i}")).over(Window.partitionBy("stage_order")) /
              F.sum(f"_count{i}").over(Window.partitionBy("stage_order"))).alias(f"_whole{i}") for i in range(len(spans))]
    each = each.select("*", *means)
    sums = [F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_after"), *[F.coalesce(F.sum("_m_" + c), F.lit(0)).alias("missing_" + c) for c in missing]]
    for i in range(len(spans)):
        count, mean = F.col(f"_count{i}"), F.col(f"_mean{i}")
        apart = F.sum(count * (F.col(f"_var{i}") + (mean - F.col(f"_whole{i}")) * (mean - F.col(f"_whole{i}"))))
        sums += [F.coalesce(F.sum(f"_{k}{i}"), F.lit(0)).alias(f"{k}{i}") for k in ("count", "missing", "nonfinite")]
        sums += [F.min(f"_min{i}").alias(f"min{i}"), F.max(f"_max{i}").alias(f"max{i}"), F.max(f"_whole{i}").alias(f"mean{i}"),
                 F.when(F.sum(count) > 1, F.sqrt(F.greatest(apart, F.lit(0.0)) / (F.sum(count) - 1))).alias(f"std{i}")]
    table = each.groupBy("stage_order", "stage").agg(*sums)

    cells = F.array(*[F.struct(F.lit(i).alias("_i"), fn.finite(f"_x{i}").alias("_x")) for i in range(len(spans))])
    values = rows.select("_r", F.inline(cells)).filter(F.col("_x").isNotNull()).groupBy("_r", "_i", "_x").agg(F.count(F.lit(1)).alias("_n"))
    low, high = (F.element_at(F.array(*[F.lit(s[k]) for s in spans]), F.col("_i") + 1) for k in (2, 3))
    upto = F.least(high, F.col("_r"))
    values = values.withColumn("stage_order", F.explode(F.when(low <= upto, F.sequence(low, upto)).otherwise(F.array().cast("array<int>"))))
    medians = select_quantiles(values, ["stage_order", "_i"], {"median": ("_x", 0.5)}, weight="_n")
    medians = medians.groupBy("stage_order").agg(*[F.max(F.when(F.col("_i") == i, F.col("median"))).alias(f"median{i}") for i in range(len(spans))])
    table = table.join(F.broadcast(medians), "stage_order", "left")  # a row for each stage

    which = F.array(*[F.struct(F.lit(c).alias("_i"), F.col("_k_" + c).alias("_k")) for c in keys])
    ends = rows.select("_r", F.inline(which)).filter(F.col("_k").isNotNull()).groupBy("_i", "_k").agg(F.max("_r").alias("_r"))
    ends = ends.groupBy("_r").agg(*[F.count_if(F.col("_i") == c).alias("unique_" + c) for c in keys])
    unique = names.join(ends, F.col("_r") >= F.col("stage_order")).groupBy("stage_order").agg(*[F.sum("unique_" + c).alias("unique_" + c) for c in keys])
    table = table.join(F.broadcast(unique), "stage_order", "left")

    at = F.col("stage_order")
    before = F.coalesce(F.lag("rows_after").over(Window.orderBy("stage_order")), F.col("rows_after"))  # one row per stage
    table = table.withColumn("before_rows", before)
    table = table.withColumn("rows_removed", F.greatest(F.lit(0), F.col("before_rows") - F.col("rows_after")))

    def measured(c: str, part: str) -> Column:
        mine = [(i, s) for i, s in enumerate(spans) if s[0] == c]
        return reduce(lambda so_far, x: so_far.when(at.between(x[1][2], x[1][3]), F.col(f"{part}{x[0]}")), mine, F).alias(f"{c}_{part}")

    return table.select(
        "stage_order", "stage", "before_rows", "rows_after", "rows_removed",
        _share(F.col("rows_removed"), F.col("before_rows")).alias("percent_removed"),
        *[F.coalesce(F.when(at.isin(has[c]), F.col("unique_" + c)), F.lit(0)).alias("unique_" + c) for c in keys],
        *[F.when(at.isin(has[c]), F.col("missing_" + c)).alias("missing_" + c) for c in missing],
        *[measured(c, part) for c in numbers for part in ("count", "missing", "nonfinite", "min", "max", "mean", "median", "std")],
    )


def unit_distribution(
    scopes: Mapping[str, DataFrame], unit: str, value: str, supported: Sequence[str]
) -> DataFrame:
    """Per scope and unit (null unit kept): records, percent, min, max, median, whether supported."""
    parts = [
        df.select(F.lit(name).alias("scope"), fn.null_label(unit).alias("unit"), fn.to_number(value).alias("_v"),
                  F.coalesce(F.col(unit).isin(list(supported)), F.lit(False)).alias("supported"))
        for name, df in scopes.items()
    ]
    rows = reduce(DataFrame.unionByName, parts)
    grouped = aggregate(
        rows, ["scope", "unit", "supported"],
        [F.count(F.lit(1)).alias("records"), F.min("_v").alias("value_min"), F.max("_v").alias("value_max")],
        {"value_median": ("_v", 0.5)},
    )
    total = F.sum("records").over(Window.partitionBy("scope"))  # one row per unit
    return grouped.withColumn("percent", _share(F.col("records"), total))


def relation_distribution(df: DataFrame, relation: str, keep: str = fixed.EXACT_RELATION) -> DataFrame:
    """Per relation (null kept): records, percent, whether retained, and the total rejected on every row."""
    grouped = df.groupBy(fn.null_label(relation).alias("relation")).agg(
        F.count(F.lit(1)).alias("records"),
        F.max(F.coalesce(F.col(relation) == keep, F.lit(False))).alias("retained"),
    )
    everything = Window.partitionBy()  # one row per relation
    return grouped.select(
        "relation", "records", _share(F.col("records"), F.sum("records").over(everything)).alias("percent"), "retained",
        F.sum(F.when(F.col("retained"), 0).otherwise(F.col("records"))).over(everything).alias("rejected_total"),
    )


# --- replicates --------------------------------------------------------------------------------


def replicate_stats(
    df: DataFrame, key: str, value: str, label: str, order: str = "source_index", mad_max: float = fixed.MAD_MAX,
) -> DataFrame:
    """Per key: rows, median, mean, sample std, min, max, MAD, range, first non-null label, MAD above the gate."""
    x = fn.finite(value)
    first = F.min_by(F.when(F.col(label).isNotNull(), F.col(label)),
                     F.when(F.col(label).isNotNull(), F.col(order)))
    profile = replicate_profile(df, key, value, [
        F.count(F.lit(1)).alias("measurements"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"), first.alias("label"),
    ])
    return profile.withColumn("range", F.col("max") - F.col("min")).withColumn(
        "mad_over", F.coalesce(F.col("mad") > mad_max, F.lit(False))
    )


def replicate_count_distribution(stats: DataFrame) -> DataFrame:
    return stats.groupBy("measurements").agg(F.count(F.lit(1)).alias("groups"))


def high_variability(stats: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The k keys with the widest range, ties by key."""
    return stats.orderBy(F.desc_nulls_last("range"), key).limit(k).select(
        key, "label", "measurements", "min", "max", "median", "mad", "range"
    )


def mad_summary(stats: DataFrame, rows: DataFrame) -> DataFrame:
    """Groups over the gate, their share of groups and of measurements, and how MAD and range are distributed."""
    over = F.col("mad_over")
    aggs = [
        F.count(F.lit(1)).alias("groups"), _count(over).alias("groups_over"),
        F.coalesce(F.sum(F.when(over, F.col("measurements"))), F.lit(0)).alias("measurements_over"),
        F.coalesce(F.max("measurements"), F.lit(0)).alias("largest_group"),
        *[a for c in ("mad", "range") for a in _number_aggs(c, c + "_")],
    ]
    summary = aggregate(stats, [], aggs, {"mad_median": ("mad", 0.5), "range_median": ("range", 0.5)})
    summary = summary.withColumn("_rows", rows.agg(F.count(F.lit(1))).scalar())
    return summary.withColumn("percent_groups_over", _share(F.col("groups_over"), F.col("groups"))).withColumn(
        "percent_measurements_over", _share(F.col("measurements_over"), F.col("_rows"))
    ).drop("_rows")


def duplicate_signatures(
    phases: Mapping[str, DataFrame], signatures: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Rows, distinct signatures and excess per phase and column set; null equals null.

    Each row becomes one digest of 128 bits per column set, so that one grouping counts all sets of all phases.
    """
    columns = list(dict.fromkeys(c for cs in signatures.values() for c in cs))
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(p).alias("phase"), *columns) for p, df in phases.items()])
    keys = F.array(*[
        F.struct(F.lit(name).alias("signature"), F.unhex(F.md5(F.to_json(F.struct(*cs)))).alias("_key")) for name, cs in signatures.items()
    ])
    copies = rows.select("phase", F.inline(keys)).groupBy("phase", "signature", "_key").agg(F.count(F.lit(1)).alias("_n"))
    return copies.groupBy("phase", "signature").agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("distinct_signatures"),
        (F.sum("_n") - F.count(F.lit(1))).alias("excess_rows"),
    )


def identity_mappings(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that break a one-to-one mapping: ``a`` with several ``b`` and ``b`` with several ``a``.

    Works on distinct pairs, so a key with many rows counts once per partner; partners are listed, never collected.
    """
    pairs = df.select(a, b).filter(F.col(a).isNotNull()).distinct()
    parts = []
    for one, many in ((a, b), (b, a)):
        sizes = pairs.filter(F.col(many).isNotNull()).groupBy(one).agg(F.count(F.lit(1)).alias("_n"))
        several = sizes.filter(F.col("_n") > 1).select(one).filter(F.col(one).isNotNull())
        listed = join_by_key(pairs.filter(F.col(many).isNotNull()), several, [one], "left_semi")
        parts.append(listed.select(F.lit(f"{one}_to_many_{many}").alias("direction"), a, b))
    return parts[0].unionByName(parts[1])


def identity_mapping_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct values of both columns and how many of each map to several of the other."""
    pairs = df.select(a, b).distinct()
    parts = []
    for one, many in ((a, b), (b, a)):
        sizes = pairs.filter(F.col(one).isNotNull()).groupBy(one).agg(F.count(F.col(many)).alias("_n"))
        parts.append(sizes.agg(
            F.count(F.lit(1)).alias("unique_values"), _count(F.col("_n") > 1).alias("with_several")
        ).select(F.lit(one).alias("column"), "unique_values", "with_several"))
    return parts[0].unionByName(parts[1])


# --- comparing two filters ---------------------------------------------------------------------


def compare_filters_by(df: DataFrame, keep_a: Column, keep_b: Column, by: str) -> DataFrame:
    """Per group (null kept): candidates, retained by A, by B, by one only, removed by one only."""
    a, b = F.coalesce(keep_a, F.lit(False)), F.coalesce(keep_b, F.lit(False))
    return df.groupBy(fn.null_label(by).alias(by)).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(a).alias("retained_a"), F.count_if(b).alias("retained_b"),
        F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"),
        F.count_if(~a & b).alias("removed_only_a"), F.count_if(~b & a).alias("removed_only_b"),
    )


def compare_filters(
    df: DataFrame, rules: Mapping[str, Column], key: str, value: str
) -> DataFrame:
    """Per rule: rows and unique keys retained and the statistics of the retained values.

    A row is copied once for each rule that keeps it, so one grouping covers all rules.
    """
    hits = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    kept = cut(df.select(hits.alias("_hits"), F.col(key).alias("_key"), F.col(value).cast("double").alias("_y")).select(F.explode("_hits").alias("filter"), "_key", "_y"))
    kept = kept.withColumn("_x", fn.finite("_y"))
    aggs = [F.count(F.lit(1)).alias("retained"), *[a for a in _number_aggs("_y")[3:]]]
    table = aggregate(kept, ["filter"], aggs, {"median": ("_x", 0.5)})
    unique = kept.filter(F.col("_key").isNotNull()).groupBy("filter", "_key").agg(F.count(F.lit(1))).groupBy("filter").agg(F.count(F.lit(1)).alias("unique_keys"))
    names = df.sparkSession.createDataFrame([(n,) for n in rules], "filter string")
    whole = names.join(table, "filter", "left").join(unique, "filter", "left").fillna(0, ["retained", "unique_keys"])  # a row for each rule
    return whole.select("retained", "unique_keys", "min", "max", "mean", "median", "std", "filter")


def compare_filters_summary(df: DataFrame, keep_a: Column, keep_b: Column, key: str) -> DataFrame:
    """Candidates, rows classified differently, their percent, and the unique keys they touch."""
    different = exclusive_rows(df, keep_a, keep_b)
    rows = df.agg(F.count(F.lit(1)).alias("candidates"))
    other = different.agg(F.count(F.lit(1)).alias("different"), F.count_distinct(key).alias("unique_keys_affected"))
    return beside(rows, other).withColumn(
        "percent_different", _share(F.col("different"), F.col("candidates"))
    )


def threshold_boundary_counts(
    df: DataFrame, column: str, threshold: float, percents: Sequence[int] = tuple(fixed.TOP_PERCENTS)
) -> DataFrame:
    """Rows within some percent of a cut-off, one column per percent."""
    away = F.abs(F.col(column) - threshold)
    return df.agg(*[_count(away <= threshold * p / 100).alias(f"within_{p}_percent") for p in percents])


def value_sanity(df: DataFrame, column: str, low: float = 0.0, high: float = 20.0) -> DataFrame:
    x = F.col(column)
    return df.agg(
        _count(x == 0).alias("zero"), _count(x < 0).alias("negative"),
        _count(((x < low) | (x > high)) & ~F.isnan(x)).alias("extreme"),
        _count(fn.is_missing(column)).alias("missing"), _count(fn.is_nonfinite(column)).alias("nonfinite"),
    )


# --- groups ------------------------------------------------------------------------------------


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def group_size_summary(df: DataFrame, group: str, split: str) -> DataFrame:
    """Per split and overall: groups, rows, fraction of rows, row-weighted mean/median size, largest; plus the group view.

    Row-weighted figures give every row its group's size, as a per-row size column would. They are computed from the
    group table: a group of size s stands for s rows.
    """
    table = df.groupBy(split, group).agg(F.count(F.lit(1)).alias("_rows"))
    sizes = table.groupBy(group).agg(F.sum("_rows").alias("size"))
    placed = join_by_key(table, sizes, [group], "left")
    by_size = placed.groupBy(split, "size").agg(
        F.count(F.lit(1)).alias("_groups"), F.sum("_rows").alias("_rows")
    )  # at most sqrt(2 * rows) distinct sizes
    per_split = by_size.groupBy(split).agg(
        F.sum("_groups").alias("groups"), F.sum("_rows").alias("rows"), F.max("size").alias("largest"),
        (F.sum(F.col("size") * F.col("_rows")) / F.sum("_rows")).alias("mean_size"),
        F.expr("percentile(size, 0.5, _rows)").alias("median_size"),
    )
    overall = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("_groups")).agg(
        F.sum("_groups").alias("groups"), F.sum(F.col("size") * F.col("_groups")).alias("rows"),
        F.max("size").alias("largest"),
        (F.sum(F.col("size") * F.col("_groups")) / F.sum("_groups")).alias("mean_size"),
        F.expr("percentile(size, 0.5, _groups)").alias("median_size"),
    ).select(F.lit("all groups").alias(split), "groups", "rows", "largest", "mean_size", "median_size")
    total = F.max("rows").over(Window.partitionBy())  # one row per split plus the overall row, which holds all rows
    return per_split.unionByName(overall).withColumn("fraction", F.col("rows") / total)


def top_share(df: DataFrame, group: str, percents: Sequence[int] = tuple(fixed.TOP_PERCENTS)) -> DataFrame:
    """Fraction of rows in the largest 1/5/10 % of groups; at least one group counts as top."""
    by_size = group_sizes(df, group).groupBy("size").agg(F.count(F.lit(1)).alias("_groups"))
    larger = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)  # one row per distinct size
    everything = Window.partitionBy()
    ranked = by_size.select(
        "size", "_groups", F.coalesce(F.sum("_groups").over(larger), F.lit(0)).alias("_before"),
        F.sum("_groups").over(everything).alias("_all"),
    )
    parts = []
    for p in percents:
        top = F.greatest(F.lit(1), F.ceil(F.col("_all") * p / 100))
        taken = F.greatest(F.lit(0), F.least(F.col("_groups"), top - F.col("_before")))
        parts.append((F.sum(taken * F.col("size")) / F.sum(F.col("size") * F.col("_groups"))).alias(f"top_{p}_percent"))
    return ranked.agg(*parts)


# --- features ----------------------------------------------------------------------------------


def long_features(df: DataFrame, row_id: str, features: Sequence[str]) -> DataFrame:
    """``row_id, feature, x``: one row per feature value."""
    wide = df.select(row_id, *[F.col(c).cast("double").alias(c) for c in features])
    return wide.unpivot(row_id, list(features), "feature", "x")


def feature_sanity(long: DataFrame) -> DataFrame:
    """Per feature of a long table: number statistics, population variance, zero/near-zero variance, huge magnitude."""
    rows = long.select("feature", "x").withColumn("_x", fn.finite("x"))
    aggs = [*_number_aggs("x"), F.var_pop("_x").alias("variance"), F.max(F.abs("_x")).alias("_size")]
    table = aggregate(rows, ["feature"], aggs, {"median": ("_x", 0.5)})
    return table.select(
        "feature", "count", "missing", "nonfinite", "min", "max", "mean", "median", "std", "variance",
        (F.col("variance") == 0).alias("zero_variance"),
        F.coalesce(F.col("variance") < 1e-8, F.lit(False)).alias("near_zero_variance"),
        F.coalesce(F.col("_size") >= 1e6, F.lit(False)).alias("huge_magnitude"),
    )


def bit_sanity(df: DataFrame, bits: str, width: int = fixed.BITS) -> DataFrame:
    """Feature sanity of 0/1 bit columns held as on-bit lists, from one count per bit; bits never set included."""
    rows = df.agg(F.count(F.lit(1)).alias("_n"))
    on = df.select(F.explode(bits).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("on"))
    every = df.sparkSession.range(width).select(F.col("id").cast("int").alias("bit"))
    p = F.col("on") / F.col("_n")
    table = beside(every.join(on, "bit", "left").fillna(0, ["on"]), rows)
    return table.select(
        "bit", "on", p.alias("mean"),
        F.when(F.col("on") * 2 > F.col("_n"), 1.0).when(F.col("on") * 2 == F.col("_n"), 0.5).otherwise(0.0).alias("median"),
        (p * (1 - p)).alias("variance"),
        F.when(F.col("_n") > 1, F.sqrt(p * (1 - p) * F.col("_n") / (F.col("_n") - 1))).alias("std"),
        ((F.col("on") == 0) | (F.col("on") == F.col("_n"))).alias("zero_variance"),
    )


def fingerprint_stats(df: DataFrame, bits: str) -> DataFrame:
    """Fingerprints, unique, excess copies, all-zero, mean/min/max active bits."""
    copies = df.groupBy(F.md5(F.array_join(bits, ",")).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.size(bits)).alias("_on")
    )
    return copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("fingerprints"), F.count(F.lit(1)).alias("unique_fingerprints"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_excess"),
        F.coalesce(F.sum(F.when(F.col("_on") == 0, F.col("_n"))), F.lit(0)).alias("all_zero"),
        (F.sum(F.col("_n") * F.col("_on")) / F.sum("_n")).alias("mean_active"),
        F.min("_on").alias("min_active"), F.max("_on").alias("max_active"),
    )


def describe_columns(long: DataFrame) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max per feature of a long table."""
    rows = long.select("feature", fn.finite("x").alias("x"))
    return aggregate(rows, ["feature"], [
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    ], {"p25": ("x", 0.25), "p50": ("x", 0.5), "p75": ("x", 0.75)})


def leakage_audit(
    df: DataFrame, features: Sequence[str], target: str, identifiers: Sequence[str] = tuple(fixed.IDENTIFIERS),
    tokens: Sequence[str] = tuple(fixed.TARGET_TOKENS),
) -> DataFrame:
    """Per feature: is it an identifier, is its name like the target's, do its values equal the target's."""
    y = F.col(target).cast("double")
    checks = []
    for c in features:
        x = F.col(c).try_cast("double")
        both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
        checks.append(F.coalesce(F.bool_and(F.when(both, x == y)), F.lit(False)))
    equal = df.agg(F.array(*checks).alias("_equal"))
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(c in identifiers).alias("is_identifier"),
                 F.lit(any(t in c.lower() for t in tokens)).alias("target_like_name"),
                 F.col("_equal")[i].alias("equals_target"))
        for i, c in enumerate(features)
    ])
    return equal.select(F.inline(rows))


# --- hashes and findings -----------------------------------------------------------------------


def dataset_hash(df: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """Row count and a content hash that ignores row order and partitioning: summed pieces of every row's hash."""
    def field(c: Column) -> Column:
        """With its length before it, so that no two rows have one text; null is a length of its own."""
        return F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("null:"))

    texts = [field((F.col(c) if isinstance(c, str) else c).cast("string")) for c in columns]
    hashed = df.select(F.md5(F.concat(*texts)).alias("_h"))
    pieces = [F.coalesce(F.sum(fn.chunk(F.col("_h"), i).cast("decimal(20,0)")), F.lit(0)) for i in range(4)]
    sums = hashed.agg(F.count(F.lit(1)).alias("rows"), *[p.cast("string").alias(f"_s{i}") for i, p in enumerate(pieces)])
    return sums.select("rows", F.md5(F.concat_ws("-", F.col("rows").cast("string"), *[f"_s{i}" for i in range(4)])).alias("hash"))


def unit_conversion_check(
    df: DataFrame, unit: str, raw: str, scaled: str, target: str, factors: Mapping[str, float] = fixed.UNIT_FACTORS,
    order: str = "source_index",
) -> DataFrame:
    """Per supported unit: its first positive record, recomputed, and whether stored and recomputed numbers agree."""
    known = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
    rows = df.filter(F.col(unit).isin(list(factors))).select(
        F.col(unit).alias("unit"), F.col(order).alias("source_index"), fn.to_number(raw).alias("raw"),
        F.col(scaled).alias("scaled"), F.col(target).alias("target"),
    )
    first = representative_row(rows, "unit", F.col("raw") > 0)
    expected = F.col("raw") * F.element_at(known, F.col("unit"))
    again = fn.round_value(F.when(expected > 0, -F.log10(expected * F.lit(1e-9))))
    return first.withColumn("factor", F.element_at(known, F.col("unit"))).withColumn("expected", expected).withColumn(
        "recomputed", again
    ).withColumn("scaled_matches", fn.is_close("scaled", "expected", equal_nan=True)).withColumn(
        "target_matches", fn.is_close("target", "recomputed")
    )


def unit_prefix_check(units: DataFrame, unit: str, factors: Mapping[str, float] = fixed.UNIT_FACTORS) -> DataFrame:
    """Per unit in use: the factor applied and the factor its ``10'<n>pM`` prefix implies (nano is 1)."""
    known = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
    power = F.regexp_extract(unit, r"^10'(\d+)pM$", 1).try_cast("double")
    implied = F.when(F.col(unit) == fixed.NORMAL_UNIT, F.lit(1.0)).otherwise(F.pow(F.lit(10.0), power) / 1000)
    return units.filter(F.col(unit).isin(list(factors))).select(
        F.col(unit).alias("unit"), F.element_at(known, F.col(unit)).alias("factor"), implied.alias("implied_factor")
    ).withColumn("matches", fn.is_close("factor", "implied_factor"))


def findings(checks: Sequence[tuple[str, str, DataFrame, str, str, str]]) -> DataFrame:
    """One row per check: ``(name, severity when it fires, one-row table, count column, message, recommendation)``.

    Zero affected rows pass and need no recommendation. The message gets the count in place of ``{}``.
    """
    parts = []
    for name, severity, df, column, message, advice in checks:
        n = F.coalesce(F.col(column).cast("long"), F.lit(0))
        parts.append(df.select(
            F.when(n > 0, F.lit(severity)).otherwise(F.lit("PASS")).alias("severity"), F.lit(name).alias("check"), n.alias("affected"),
            F.replace(F.lit(message), F.lit("{}"), n.cast("string")).alias("message"),
            F.when(n > 0, F.lit(advice)).otherwise(F.lit("No action required.")).alias("recommendation"),
        ))
    return reduce(DataFrame.unionByName, parts)


def gate(table: DataFrame) -> DataFrame:
    """Number of findings per severity class and whether the run passes (no CRITICAL)."""
    critical = F.count_if(F.col("severity") == "CRITICAL")
    return table.agg(
        F.count(F.lit(1)).alias("checks"), critical.alias("critical"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"), (critical == 0).alias("passed"),
    )


def enforce(table: DataFrame) -> DataFrame:
    """Raise when a finding is CRITICAL, else return the findings."""
    failed = [r["check"] for r in table.filter(F.col("severity") == "CRITICAL").select("check").collect()]  # one row per check
    if failed:
        raise AssertionError("critical findings: " + ", ".join(failed))
    return table


