"""Record curation from raw activity records to one trusted value per key, in both documented step orders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura import fixed_values as fixed
from mensura.functions import columns as fn
from mensura.operators import consensus as con
from mensura.operators import curation as cur
from mensura.operators import features as feat
from mensura.session import cut
from mensura.skew import join_by_key


@dataclass(frozen=True)
class Names:
    """Column names of the records; the defaults are those of public activity exports."""

    row_id: str = "source_index"
    structure: str = "canonical_smiles"
    cleaned: str = "cleaned_smiles"
    key: str = "InChIkey"
    kind: str = "standard_type"
    relation: str = "standard_relation"
    value: str = "standard_value"
    unit: str = "standard_units"
    flag: str = "potential_duplicate"
    comment: str = "data_validity_comment"
    description: str = "data_validity_description"
    scaled: str = "IC50_nM"
    target: str = "PIC50"


def with_identity(df: DataFrame, names: Names = Names()) -> DataFrame:
    """Replace the structure text by its cleaned form and add its identity key."""
    cur.require_columns(df, [names.structure])
    cleaned = df.withColumn(names.cleaned, feat.strip_components(names.structure)).drop(names.structure)
    return cleaned.withColumn(names.key, fn.notation_key(names.cleaned))


def valid_records(df: DataFrame, names: Names = Names()) -> DataFrame:
    return cur.filter_validity(df, {
        names.comment: fixed.VALIDITY_COMMENTS, names.description: fixed.VALIDITY_DESCRIPTIONS,
    })


def convert(df: DataFrame, names: Names = Names(), default: float | None = None) -> DataFrame:
    """Supported units only, value scaled to nano, negative log target by record type."""
    cur.require_columns(df, [names.unit, names.value, names.kind])
    rows = cur.filter_allowed(df, names.unit, list(fixed.UNIT_FACTORS))
    rows = cur.normalize_units(rows, names.value, names.unit, out=names.scaled)
    return cur.neg_log_transform(rows, names.kind, names.value, names.scaled, names.target, default)


def production_stages(
    df: DataFrame, names: Names = Names(), mad_max: float = fixed.MAD_MAX
) -> list[tuple[str, DataFrame]]:
    """Filters first, then consensus: one row per key."""
    stages = [("raw", df)]

    def then(name: str, step: DataFrame) -> DataFrame:
        stages.append((name, step))
        return step

    rows = cur.drop_if_present(cur.drop_all_null_columns(df))
    rows = then("valid", valid_records(rows, names).drop(names.comment, names.description))
    rows = then("identified", with_identity(rows, names))
    rows = then("unflagged", cur.filter_flag(rows, names.flag))
    rows = then("converted", cur.drop_nonfinite(convert(rows, names), names.target))
    rows = then("exact", cur.filter_censored(rows, names.relation))
    rows = then("in range", cur.filter_range(rows, names.scaled))
    rows = con.replicate_consensus(rows, names.key, names.target, names.row_id, mad_max)
    then("consensus", cur.drop_if_present(rows, fixed.PRUNED_AFTER_CONSENSUS))
    return stages


def record_stages(df: DataFrame, names: Names = Names()) -> list[tuple[str, DataFrame]]:
    """The row-wise stages of the audit order, before any grouping."""
    valid = valid_records(cur.drop_all_null_columns(df), names)
    identified = with_identity(valid, names)
    unflagged = cur.filter_flag(identified, names.flag)
    converted = convert(unflagged, names, default=0.0).withColumn(names.value, fn.to_number(names.value))
    return [("raw", df), ("valid", valid), ("identified", identified), ("unflagged", unflagged), ("converted", converted)]


STAGES = ("raw", "valid", "identified", "unflagged", "converted", "consistent", "deduplicated", "exact", "in range")


@dataclass(frozen=True)
class Ledger:
    """Every raw record once, with ``_reached``: the number, from 1, of the last stage of ``STAGES`` that it is in.

    ``columns`` has each stage's own columns. ``_median`` takes the target's place from ``consistent`` on.
    """

    rows: DataFrame
    columns: dict[str, list[str]]
    names: Names

    def stage(self, name: str) -> DataFrame:
        """The rows and columns of a stage."""
        number, target = STAGES.index(name) + 1, self.names.target
        held = set(self.rows.columns)
        late = number > STAGES.index("converted") + 1
        return self.rows.filter(F.col("_reached") >= number).select(*[
            F.col("_median").alias(c) if late and c == target else F.col(f"`{c}`") if c in held else F.lit(None).cast("string").alias(c)
            for c in self.columns[name]])


def audit_ledger(df: DataFrame, names: Names = Names(), mad_max: float = fixed.MAD_MAX) -> Ledger:
    """Consensus first, then exact duplicates, relation, and the range of the raw value: how far every record gets.

    The records are read twice, to find empty columns and to judge each record by itself, and then kept in the shared folder; the
    grouping stages work on those records that reach them. ``names.row_id`` tells records apart.
    """
    held = cur.drop_all_null_columns(df)
    cur.require_columns(held, [names.structure, names.unit, names.value, names.kind])
    rules = {names.comment: fixed.VALIDITY_COMMENTS, names.description: fixed.VALIDITY_DESCRIPTIONS}
    identified = held.withColumn(names.cleaned, feat.strip_components(names.structure)).withColumn(names.key, fn.notation_key(names.cleaned))
    rows = cur.normalize_units(identified, names.value, names.unit, out=names.scaled).withColumn(names.unit, F.col("original_" + names.unit))
    rows = cur.neg_log_transform(rows, names.kind, names.value, names.scaled, names.target, 0.0)
    allowed = F.coalesce(F.col(names.unit).isin(list(fixed.UNIT_FACTORS)), F.lit(False))
    base = cut(rows.withColumn(
        "_reached", F.when(~cur.is_valid(held.columns, rules), 1).when(cur.is_flagged(held.columns, names.flag), 3).when(~allowed, 4).otherwise(5)))
    converted = base.filter("_reached = 5")

    passing = con.replicate_profile(converted, names.key, names.target).filter(F.col("mad") <= mad_max).select(names.key, F.col("median").alias("_median"))
    consistent = cut(join_by_key(converted, passing, [names.key], "inner"))
    alike = [names.key, names.cleaned, "_median"]
    first = consistent.groupBy(*alike).agg(F.min(names.row_id).alias("_first"))
    marked = join_by_key(consistent, first, alike, "left", null_safe=True)
    kept = F.col("_first") == F.col(names.row_id)
    exact = F.coalesce(F.col(names.relation) == fixed.EXACT_RELATION, F.lit(False))
    within = F.coalesce(fn.to_number(names.value) <= fixed.RANGE_MAX, F.lit(False))
    marked = marked.withColumn("_reached", F.when(~kept, 6).when(~exact, 7).when(~within, 8).otherwise(9)).drop("_first")
    others = join_by_key(converted, passing.select(names.key), [names.key], "left_anti").unionByName(base.filter("_reached < 5"))
    rows = cut(others.withColumn("_median", F.lit(None).cast("double")).unionByName(marked))

    unscaled = [*[c for c in held.columns if c != names.structure], names.cleaned, names.key]
    scaled = [*unscaled, "original_" + names.unit, names.scaled, names.target]
    columns = {"raw": df.columns, "valid": held.columns, "identified": unscaled, "unflagged": unscaled} | {n: scaled for n in STAGES[4:]}
    return Ledger(rows, columns, names)


def audit_stages(df: DataFrame, names: Names = Names(), mad_max: float = fixed.MAD_MAX) -> list[tuple[str, DataFrame]]:
    """The stages of the audit order, each a part of one ledger."""
    ledger = audit_ledger(df, names, mad_max)
    return [(name, ledger.stage(name)) for name in STAGES]


def curate(
    df: DataFrame, order: str = "production", names: Names = Names(), mad_max: float = fixed.MAD_MAX,
) -> DataFrame:
    """Curated table. The two orders give different rows by design: see the README."""
    builders = {"production": production_stages, "audit": audit_stages}
    if order not in builders:
        raise ValueError("order must be 'production' or 'audit'")
    return builders[order](df, names, mad_max)[-1][1]
