"""SQL text with bound parameters over a data folder: Spark parses, plans and runs it."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from parley.sources.tables import load


def bound(value):
    """A parameter as Spark binds it: objects and arrays become JSON text, other values stay."""
    return json.dumps(value, separators=(",", ":")) if isinstance(value, (dict, list, tuple)) else value


class Catalog:
    """Views over the tables of one folder; with read_only (the default) only queries are accepted."""

    def __init__(self, spark: SparkSession, sf_dir: str, tables: Sequence[str], read_only: bool = True):
        self.spark, self.read_only = spark, read_only
        self.frames = {t: load(spark, sf_dir, t) for t in tables}

    def attach(self, name: str, frame: DataFrame) -> None:
        """A table of another source under a name of its own."""
        self.frames[name] = frame

    def execute(self, sql: str, params: Sequence = ()) -> DataFrame:
        """The rows of one statement with positional parameters."""
        if self.read_only and not sql.lstrip(" (\n").lower().startswith(("select", "with", "values")):
            raise ValueError("this catalog is read-only")
        for name, frame in self.frames.items():
            frame.createOrReplaceTempView(name)
        return self.spark.sql(sql, args=[bound(p) for p in params] or None)

    def execute_proxy(self, sql: str, params: Sequence, method: str) -> list:
        """all: rows as lists; get: the first row as a list, empty without one; values: as all; run: no rows.

        The caller asks for the rows in the driver, so `all` is for statements that limit themselves.
        """
        df = self.execute(sql, params)
        if method == "run":
            df.write.format("noop").mode("overwrite").save()
            return []
        if method == "get":
            row = df.head()
            return list(row) if row else []
        if method in ("all", "values"):
            return [list(r) for r in df.collect()]
        raise ValueError(f"no method {method}")
