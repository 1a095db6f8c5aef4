"""Running a stream to the end of what is there, as a query that returns its result table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from parley.operators.graph import shared_folder


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A stream of the files of one table of a data folder, where a table is a file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}*.parquet")


def run_to_end(stream: DataFrame, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """All rows that a stream gives for what is available now; each micro-batch replaces or adds to a table in the shared folder.

    In update mode, of the rows of one key those of the last micro-batch count:
    state of windows that the watermark has passed is dropped, and their last
    row stays in the table.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    whole = mode == "complete"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out" if whole else f"{path}/out/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True)
    writer.start().awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/out")
    values = F.struct(*[c for c in stream.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("v")).select(*keys, "v.*").select(*stream.columns)
