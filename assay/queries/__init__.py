"""The registered queries, each with the SQL it has to agree with."""

from assay.queries.registry import REGISTRY
from assay.queries import columns, files, joins, logs, tables  # noqa: F401  (they fill the registry)

__all__ = ["REGISTRY"]
