"""Token-ledger analytics as plain Spark DataFrame plans."""

from chaintally.sources.catalog import Sources

__all__ = ["Sources"]
