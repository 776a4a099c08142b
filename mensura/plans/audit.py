"""The data audit: every table that describes a curation run, from one set of stages."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura import fixed_values as fixed
from mensura.functions import columns as fn
from mensura.operators import joins as jn
from mensura.operators import splits as sp
from mensura.operators import stats as st
from mensura.plans.curation import STAGES, Names, audit_ledger
from mensura.session import cut


def audit(
    df: DataFrame, wanted: Sequence[str] | None = None, names: Names = Names(), group: str | None = None,
    features: list[str] | None = None, mad_max: float = fixed.MAD_MAX, strict: bool = False,
) -> dict[str, DataFrame]:
    """The wanted audit tables by name (all by default).

    ``group`` is the split group column (default: the identity key); ``features`` are checked for sanity and leakage
    where given. All tables are made of one ledger of the records, which is built once. Tables that several others are made of are
    cut to the shared folder. With ``strict`` a
    CRITICAL finding fails the run.
    """
    ledger = audit_ledger(df, names, mad_max)
    by_name = {name: ledger.stage(name) for name in STAGES}
    raw, converted, exact = by_name["raw"], by_name["converted"], by_name["exact"]
    key, target, cleaned = names.key, names.target, names.cleaned
    group = group or key
    raw_value, scaled = fn.to_number(names.value) <= fixed.RANGE_MAX, F.col(names.scaled) <= fixed.RANGE_MAX
    final = cache(lambda: cut(by_name["in range"]))
    replicates = cache(lambda: cut(st.replicate_stats(
        converted, key, target, cleaned, names.row_id, mad_max)))
    assigned = cache(lambda: cut(sp.group_split(final(), group)))
    long = cache(lambda: st.long_features(final(), names.row_id, features))
    signatures = {
        cleaned: [cleaned], key: [key], target: [target], f"{cleaned} + {target}": [cleaned, target],
        f"{key} + {target}": [key, target],
    }
    scopes = {"final": F.lit(True), "train": F.col("split") == "train", "test": F.col("split") == "test"}
    assignment = list(dict.fromkeys([names.row_id, key, cleaned, target, group, "group_size", "split"]))
    tables = {
        "stage_counts": lambda: st.stage_lineage(
            ledger.rows, ledger.columns, [key, cleaned], [names.value, names.scaled, target],
            [names.structure, cleaned, key, names.unit, names.value, names.scaled, target], replaced={target: ("_median", 6)}),
        "unit_distribution": lambda: st.unit_distribution(
            {"raw": raw, "unflagged": by_name["unflagged"]}, names.unit, names.value, list(fixed.UNIT_FACTORS)),
        "unit_conversion": lambda: st.unit_conversion_check(
            converted, "original_" + names.unit, names.value, names.scaled, target, order=names.row_id),
        "unit_prefix": lambda: st.unit_prefix_check(raw.select(names.unit).distinct(), names.unit),
        "replicates": replicates,
        "replicate_counts": lambda: st.replicate_count_distribution(replicates()),
        "high_variability": lambda: st.high_variability(replicates(), key),
        "mad_summary": lambda: st.mad_summary(replicates(), converted),
        "duplicate_signatures": lambda: st.duplicate_signatures(
            {"converted": converted, "deduplicated": by_name["deduplicated"], "final": final()}, signatures),
        "identity_mappings": lambda: st.identity_mappings(by_name["identified"], key, cleaned),
        "identity_mapping_counts": lambda: st.identity_mapping_counts(by_name["identified"], key, cleaned),
        "filter_differences": lambda: jn.exclusive_rows(exact, raw_value, scaled),
        "filter_differences_by_unit": lambda: st.compare_filters_by(exact, raw_value, scaled, "original_" + names.unit),
        "filter_comparison": lambda: st.compare_filters(
            exact, {"raw value": raw_value, "scaled value": scaled}, key, target),
        "filter_summary": lambda: st.compare_filters_summary(exact, raw_value, scaled, key),
        "relation_distribution": lambda: st.relation_distribution(raw, names.relation),
        "raw_value_sanity": lambda: st.value_sanity(raw.select(fn.to_number(names.value).alias("v")), "v"),
        "target_sanity": lambda: st.value_sanity(final(), target),
        "boundary_counts": lambda: st.threshold_boundary_counts(final(), names.scaled, fixed.RANGE_MAX),
        "split_assignments": lambda: assigned().select(*assignment),
        "group_sizes": lambda: st.group_size_summary(assigned(), group, "split"),
        "top_groups": lambda: st.top_share(assigned(), group),
        "split_overlap": lambda: jn.split_overlap_counts(assigned(), "split", list(dict.fromkeys([group, key, cleaned]))),
        "target_distribution": lambda: st.target_stats(assigned(), target, scopes),
        "dataset_hash": lambda: st.dataset_hash(final(), [key, cleaned, F.format_string("%.10g", F.col(target))]),
    }
    if features:
        tables["feature_sanity"] = lambda: st.feature_sanity(long())
        tables["feature_summary"] = lambda: st.describe_columns(long())
        tables["leakage"] = lambda: st.leakage_audit(final(), features, target)
    tables = {name: cache(build) for name, build in tables.items()}
    tables["findings"] = lambda: audit_findings({n: b for n, b in tables.items() if n != "findings"}, final(), target, group)
    if strict:
        st.enforce(tables["findings"]())
    return {name: tables[name]() for name in (wanted or tables)}


def audit_findings(tables: dict[str, Callable[[], DataFrame]], final: DataFrame, target: str, group: str) -> DataFrame:
    """Findings over the audit tables; CRITICAL ones fail a strict run."""
    is_group = F.col("key_column") == group
    overlap = tables["split_overlap"]()
    checks = [
        ("standard relation filter recorded", "PASS", tables["relation_distribution"]().agg(F.max("rejected_total").alias("n")), "n",
         "{} records have a relation other than equality.", "Keep the relation filter before modelling."),
        ("raw value and scaled value thresholds differ", "WARNING", tables["filter_summary"](), "different",
         "{} records are judged differently by the raw and the scaled value.", "Filter by the value in one unit."),
        ("finite model target", "CRITICAL", final.agg(F.count_if(~fn.is_finite(target)).alias("n")), "n",
         "{} targets are missing or infinite.", "Remove or repair these records before a split."),
        ("group overlap between splits", "CRITICAL", overlap.filter(is_group).agg(F.sum("shared").alias("n")), "n",
         "{} groups lie in more than one split.", "Split by whole groups."),
        ("record overlap between splits", "CRITICAL", overlap.filter(~is_group).agg(F.sum("shared").alias("n")), "n",
         "{} record keys lie in more than one split.", "Remove duplicates before the split."),
        ("unit conversion formula", "WARNING", tables["unit_prefix"]().agg(F.count_if(~F.col("matches")).alias("n")), "n",
         "{} units have a factor that their prefix does not imply.", "Check the unit table."),
    ]
    if "leakage" in tables:
        leaks = tables["leakage"]().agg(
            F.count_if("is_identifier").alias("identifiers"),
            F.count_if(F.col("target_like_name") | F.col("equals_target")).alias("targets"))
        checks += [
            ("identifier leakage", "CRITICAL", leaks, "identifiers", "{} features are identifiers.", "Leave identifiers out of the features."),
            ("target leakage", "WARNING", leaks, "targets", "{} features are named like the target or equal it.", "Review these features."),
        ]
    return st.findings(checks)
