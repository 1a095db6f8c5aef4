"""All queries over the driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from parley.shipping import ship

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}
#: The operator ids that each query covers.
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, sql: str | None = None, covers: str = ""):

    def add(f: Callable[[SparkSession, str], DataFrame]):
        @wraps(f)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        _QUERIES[name] = shipped
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return add


def _load_all() -> None:
    import importlib
    import pkgutil

    from parley.plans import catalogue

    for module in pkgutil.iter_modules(catalogue.__path__):
        importlib.import_module(f"parley.plans.catalogue.{module.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)
