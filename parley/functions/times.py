"""Time functions over literals and columns; `now` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_ms(text: Column | str) -> Column:
    """hh:mm:ss or mm:ss as milliseconds, 0 for anything else."""
    parts = F.split(text, ":")
    n = [F.element_at(parts, i).try_cast("long") for i in (-1, -2)] + [F.try_element_at(parts, F.lit(-3)).try_cast("long")]
    ok = F.col(text).rlike(r"^\d+(:\d+){1,2}$") if isinstance(text, str) else text.rlike(r"^\d+(:\d+){1,2}$")
    return F.when(ok, ((F.coalesce(n[2], F.lit(0)) * 60 + n[1]) * 60 + n[0]) * 1000).otherwise(0).cast("long")


def timecode(ms: Column | str) -> Column:
    """Milliseconds as hh:mm:ss."""
    s = F.floor(F.col(ms) / 1000 if isinstance(ms, str) else ms / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def julian_day(ts: Column | str) -> Column:
    """A timestamp as a Julian day number; null stays null."""
    return F.unix_millis(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) / 86400000.0 + 2440587.5


def bucket(ts: Column, now: str) -> tuple[Column, Column]:
    """(label, sort key) of a time relative to a literal now: days, then weeks up to 27 days, then months; later times mirror."""
    days = F.datediff(F.lit(now).cast("date"), ts.cast("date"))
    weeks = F.floor(F.abs(days) / 7 + 0.5).cast("int")
    months = F.abs((F.year(F.lit(now).cast("date")) - F.year(ts)) * 12 + F.month(F.lit(now).cast("date")) - F.month(ts))
    months = F.greatest(months, F.lit(1))

    def named(n: Column, unit: str) -> Column:
        ago = F.when(n == 1, F.lit(f"1 {unit}")).otherwise(F.concat(n.cast("string"), F.lit(f" {unit}s")))
        return F.when(days > 0, F.concat(ago, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), ago))

    label = (
        F.when(days == 0, "Today").when(days == 1, "Yesterday").when(days == -1, "Tomorrow")
        .when(F.abs(days) <= 6, named(F.abs(days), "day")).when(F.abs(days) <= 27, named(weeks, "week")).otherwise(named(months, "month"))
    )
    return label, days


#: Days that each retention policy keeps.
RETENTION_DAYS = {"1_day": 1, "7_days": 7, "30_days": 30, "90_days": 90}


def expired(policy: Column, created: Column, now: str) -> Column:
    """Whether retention is over: never for 'forever' and for unknown times, always for 'none'."""
    out = F.when(policy == "none", True).when(policy == "forever", False)
    for name, days in RETENTION_DAYS.items():
        out = out.when(policy == name, F.lit(now).cast("timestamp_ntz") >= created.cast("timestamp_ntz") + F.expr(f"INTERVAL {days} DAYS"))
    return F.coalesce(out, F.lit(False))
