"""All queries of the library by name, with their SQL where SQL can express them."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register f(spark, sf_dir) -> DataFrame under a name."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def load() -> None:
    """Import every module that registers queries."""
    from ledgerloom.functions import values  # noqa: F401
    from ledgerloom.operators import captions, claims, entry_points, incremental, ingest, intake, linkage, maintained, mapping, metrics, provenance, recon, records, rules, settle, tabular, textops, uploads, windows  # noqa: F401
    from ledgerloom.sources import csvscan, files  # noqa: F401
    from ledgerloom.streaming import changes  # noqa: F401
