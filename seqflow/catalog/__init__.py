"""Named queries over the driver's tables, each with its SQL counterpart."""

from seqflow.catalog.registry import oracle_sql, queries  # noqa: F401
