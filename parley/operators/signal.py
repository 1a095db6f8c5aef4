"""Signal statistics over ordered rows: levels, hangover, smoothing, peaks, lag by cross-correlation, speech sessions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def dbfs(rms: Column) -> Column:
    """A level in decibels below full scale."""
    return 20 * F.log10(F.greatest(rms, F.lit(1e-9)))


def level_windows(df: DataFrame, keys: Sequence[str], index: str, value: str, size: int) -> DataFrame:
    """(keys, win, rms, peak, nonzero, n): tumbling windows of `size` rows by an index from 0; sums are combined before the shuffle."""
    x = F.col(value)
    out = df.groupBy(*keys, F.floor(F.col(index) / size).cast("long").alias("win")).agg(F.sqrt(F.avg(x * x)).alias("rms"), F.max(F.abs(x)).alias("peak"), F.avg((x != 0).cast("double")).alias("nonzero"), F.count("*").alias("n"))
    return out


def hangover(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, frames: int = 6) -> DataFrame:
    """Adds held: the flag, or the flag of one of the `frames` rows before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-frames, 0)
    return df.withColumn("held", F.max(flag.cast("int")).over(w))


def smoothed(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, keep: float = 0.8) -> DataFrame:
    """(keys, n, last): exponential smoothing of each key's values in order, from its first value; a fold over the key's ordered values."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    fold = F.aggregate(F.slice("_r", 2, F.greatest(F.size("_r") - 1, F.lit(0))), F.col("_r")[0]["_v"], lambda a, r: a * keep + r["_v"] * (1 - keep))
    return df.groupBy(*keys).agg(rows.alias("_r")).select(*keys, F.size("_r").cast("long").alias("n"), fold.alias("last"))


def peaks(df: DataFrame, keys: Sequence[str], index: str, value: str, most: int) -> DataFrame:
    """(keys, bucket, peak): `most` maxima of absolute values at most of each key, over an index that counts from 0.

    Values are taken together in blocks of a power of two, the least with which
    there are fewer than twice `most` full ones; buckets are then stretches of
    blocks that share a block at their edges where they do not fall on one. A
    key of no more blocks than `most` gives its blocks. Values that are no
    numbers count as 0. Lengths are a grouped maximum beside the data, so
    nothing is counted while planning; blocks are combined before the shuffle.
    """
    length = df.groupBy(*keys).agg((F.max(index) + 1).cast("long").alias("_n"))
    size = F.expr(f"shiftleft(1L, array_min(filter(sequence(0, 62), k -> shiftright(_n, k) < {2 * most})))")
    magnitude = F.when(F.isnan(F.col(value).cast("double")) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(F.abs(F.col(value).cast("double")), F.lit(0.0)))
    j = df.join(length.withColumn("_size", size), list(keys)) if keys else df.crossJoin(F.broadcast(length.withColumn("_size", size)))
    blocks = j.groupBy(*keys, "_n", "_size", F.floor(F.col(index) / F.col("_size")).cast("long").alias("_block")).agg(F.max(magnitude).alias("_peak"))
    count = F.ceil(F.col("_n") / F.col("_size"))
    step = F.greatest(count / F.lit(float(most)), F.lit(1.0))
    # Bucket i takes the blocks from floor(i * step) to ceil((i + 1) * step) - 1.
    first, last = F.floor(F.col("_block") / step), F.ceil((F.col("_block") + 1) / step) - 1
    wide = F.sequence(F.greatest(first - 1, F.lit(0)), F.least(last + 1, F.least(count, F.lit(most)) - 1))
    inside = F.filter(wide, lambda i: (F.floor(i * step) <= F.col("_block")) & (F.ceil((i + 1) * step) > F.col("_block")))
    return blocks.select(*keys, F.explode(inside).alias("bucket"), "_peak").withColumn("bucket", F.col("bucket").cast("long")).groupBy(*keys, "bucket").agg(F.max("_peak").alias("peak"))


def lag_of(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, float, float]:
    """(lag of b behind a, peak ratio, distinctiveness) by phase-weighted cross-correlation within `most` samples."""
    n = 1 << int(len(a) + len(b) - 1).bit_length()
    cross = np.fft.rfft(b, n) * np.conj(np.fft.rfft(a, n))
    r = np.fft.irfft(cross / np.maximum(np.abs(cross), 1e-12), n)
    r = np.concatenate([r[-most:], r[: most + 1]])
    k = int(np.abs(r).argmax())
    top, rest = abs(r[k]), np.abs(np.delete(r, range(max(0, k - 2), min(len(r), k + 3))))
    return k - most, float(top / max(np.abs(r).mean(), 1e-12)), float(top / max(rest.max() if len(rest) else 0, 1e-12))


def lags(df: DataFrame, keys: Sequence[str], order: str, a: str, b: str, most: int = 200) -> DataFrame:
    """(keys, lag, ratio, distinct): the lag between two channels of each key, whose samples are one recording of bounded length."""
    kinds = df.select(*keys).schema
    schema = StructType(kinds.fields).add("lag", "long").add("ratio", "double").add("distinct", "double")

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return pd.DataFrame([(*key, *lag_of(rows[a].to_numpy(float), rows[b].to_numpy(float), most))], columns=schema.names)

    return df.select(*keys, order, a, b).groupBy(*keys).applyInPandas(one, schema)


def speech_sessions(df: DataFrame, keys: Sequence[str], time: str, probability: str, on: float = 0.5, off: float = 0.35, redemption: int = 600, least: int = 90) -> DataFrame:
    """(keys, session, start, end): speech by hysteresis.

    A frame of `on` or more starts or carries speech, one under `off` does not,
    one between keeps what was. Silence up to `redemption` is part of a session;
    sessions shorter than `least` are dropped.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    level = F.when(F.col(probability) >= on, 1).when(F.col(probability) < off, 0)
    rows = df.select(*keys, time, level.alias("_l")).withColumn("_s", F.coalesce(F.last("_l", ignorenulls=True).over(w), F.lit(0))).where("_s = 1")
    gap = F.col(time) - F.lag(time).over(w)
    rows = rows.withColumn("session", F.sum(F.when(gap.isNull() | (gap > redemption), 1).otherwise(0)).over(w))
    return rows.groupBy(*keys, "session").agg(F.min(time).alias("start"), F.max(time).alias("end")).where(F.col("end") - F.col("start") >= least)
