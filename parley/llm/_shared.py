"""Shared-folder tables and row keys for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.graph import checkpointed, components, shared_folder

__all__ = ["Scratch", "checkpointed", "components", "give_back", "row_key", "shared_folder", "unused"]


class Scratch:
    """Parquet tables in the shared folder that are deleted together when the work that needs them is done or has failed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.delete()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def delete(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory of this process to the system where the C library can; training leaves large arrays behind in a driver that lives on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: A second key beside doc_id: rows that share an id but not a text stay apart, rows that share both are alike anyway.
def row_key(id_col: str = "doc_id", text_col: str = "text") -> list:
    """Two columns, k_id and k_text, never null, by which results can be joined back to their rows."""
    return [
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("k_id"),
        F.xxhash64(F.col(text_col)).alias("k_text"),
    ]


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
