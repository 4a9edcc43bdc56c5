"""Query catalog: importing this module registers every entry (order = catalog order)."""

from . import (  # noqa: F401
    catalog_aggregates,
    catalog_evaluation,
    catalog_features,
    catalog_io,
    catalog_joins,
    catalog_models,
    catalog_resampling,
    catalog_streaming,
)
from .registry import ORACLE, QUERIES  # noqa: F401
