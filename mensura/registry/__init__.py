"""The query registry: every operator on the driver tables, with an independent SQL text where one exists."""

from mensura.registry.core import REGISTRY, Tables, oracle_texts
from mensura.registry import (  # noqa: F401  (importing registers the queries)
    curation,
    evaluation,
    features,
    graphs,
    modelling,
    relations,
    splits,
    statistics,
    tables,
)

__all__ = ["REGISTRY", "Tables", "oracle_texts"]
