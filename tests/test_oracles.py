"""A cross-section of the registered queries against their SQL on the smallest tables; tools/check.py runs them all."""

import duckdb
import pytest
from conftest import DATA

from __spark_entry__ import entry, oracle_sql, queries
from mensura.registry.core import BASE

NAMES = [
    "drop_all_null_columns", "filter_validity", "normalize_units", "neg_log_transform_default_zero", "partition_rejects",
    "replicate_consensus", "replicate_consensus_heavy_keys", "curate_production", "keep_first",
    "attach_group_stats_heavy_keys", "join_one_to_one", "split_overlap", "same_id_set", "missing_values",
    "group_split_heavy_keys", "seeded_group_holdout", "grouped_kfold", "random_split", "group_size_summary",
    "top_share", "early_stopping", "average_rank_by_group", "number_stats_heavy_keys", 
    "relation_distribution", "replicate_stats", "mad_summary", "duplicate_signatures", "identity_mappings", 
    "dataset_hash", "unit_conversion_check", "token_fingerprint", "notation_descriptors", "impute_train_mean",
    "correlation_filter", "feature_sanity", "bit_sanity", "neighborhood_fingerprint", "components", 
    "regression_metrics", "prediction_correlation", "wide_predictions", "stream_landed_records",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = db.execute(oracle_sql()[name])
    head = [d[0] for d in cursor.description]
    assert sorted(head) == columns
    at = [head.index(c) for c in columns]
    theirs = sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == theirs


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_has_a_name_and_sql():
    names, texts = set(queries()), set(oracle_sql())
    assert texts <= names
    assert {n for n in names - texts if not n.startswith("op") and n != "pipeline"} == set()
