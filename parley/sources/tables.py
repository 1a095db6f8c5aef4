"""Reading the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder; Spark reads the columns and row groups that the plan needs."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """The columns that both have, in the order of the first: what an import from another database carries over."""
    other = set(b.columns)
    return [c for c in a.columns if c in other]


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, dealt over all of them before work that is dear by row; other tables as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df
