"""From an entity search to a registered table of its records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from mensura.sources import records as rec
from mensura.sources import sinks


def ingest(
    entities: DataFrame, activity: DataFrame, term: str, position: int, *, entity_key: str, entity_name: str,
    record_entity: str, kind: str, kinds: Sequence[str], value: str, folder: str,
) -> tuple[DataFrame, str]:
    """Search, pick one match, keep its records, land them with row ids, export and register them.

    Returns the landed records and the table name they are registered under.
    """
    matches = rec.search_entities(entities, entity_name, term, None, [entity_key])
    chosen = rec.select_entity(matches, position, entity_key, [entity_name], [entity_name, entity_key]).first()
    name = chosen[entity_name]
    rows = rec.select_records(activity, record_entity, chosen[entity_key], kind, kinds, value)
    landed = rec.land_records(rows, f"{folder.rstrip('/')}/{name}.parquet", mode="overwrite")
    if landed.isEmpty():
        raise ValueError(f"no records found for {name}")
    sinks.write_csv(landed, f"{folder.rstrip('/')}/{name}.csv")
    rec.register_table(landed, name)
    return landed, name
