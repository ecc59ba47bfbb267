"""Where the catalogue's queries register."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers fn(tables, spark) under its name, with its DuckDB SQL if there is one."""

    def add(fn):
        from ..sources.tables import ParquetSource

        def run(spark, sf_dir):
            return fn(ParquetSource(spark, sf_dir), spark)

        key = name or fn.__name__
        run.__name__, run.__doc__ = key, fn.__doc__
        QUERIES[key] = run
        if sql:
            ORACLE[key] = sql.strip()
        return fn

    return add
