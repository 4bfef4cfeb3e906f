"""All registered queries and their SQL twins."""

from __future__ import annotations

from galleryspark.plans import (
    component_queries,
    curation_queries,
    evaluation_queries,
    experiment_queries,
    inventory_queries,
    raster_queries,
    storage_queries,
    vector_queries,
)

_MODULES = [
    vector_queries,
    evaluation_queries,
    inventory_queries,
    curation_queries,
    component_queries,
    raster_queries,
    experiment_queries,
    storage_queries,
]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: text for module in _MODULES for name, text in module.ORACLE.items()}
