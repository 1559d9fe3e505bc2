"""Names, callables and SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deskwise.sources.tables import Tables, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = (), more: dict[str, str] | None = None):
    """Registers ``f(tables)``. ``sql`` selects from the views it ``needs`` and from ``more`` named expressions; one that reads
    itself has ``recursive`` before its name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            text = ctes(needs)
            parts = [text] if text != "with " else []
            parts += [("" if i or parts else "with ") + f"{k.removeprefix('recursive ')} as ({v})" for i, (k, v) in enumerate((more or {}).items())]
            told = ",\n".join(parts) + "\n" + sql
            ORACLES[name] = told.replace("with ", "with recursive ", 1) if any(k.startswith("recursive ") for k in more or {}) else told
        return f

    return register
