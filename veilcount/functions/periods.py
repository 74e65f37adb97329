"""Period labels, epochs, day numbers and size buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcount.constants import DAY_US, EPOCH_DAYS, SIZE_BUCKETS


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp, whatever the session's time zone; times without a zone are UTC."""
    c = F.col(column)
    if dict(df.dtypes)[column] != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.expr(f"extract(SECOND FROM `{column}`)") * 1_000_000).cast("long")
    return days * DAY_US + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + second


def day_of(us: Column) -> Column:
    """The UTC date of a time in microseconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / F.lit(DAY_US)).cast("int"))


def week_label(us: Column) -> Column:
    """``2026-W30``, by the ISO week's own year."""
    day = day_of(us)
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def month_label(us: Column) -> Column:
    day = day_of(us)
    return F.format_string("%04d-%02d", F.year(day), F.month(day))


def period_label(us: Column, granularity: str) -> Column:
    if granularity not in ("week", "month"):
        raise ValueError("granularity is week or month")
    return week_label(us) if granularity == "week" else month_label(us)


def current_period(granularity: str = "week", now: Column | None = None) -> Column:
    """The period of a clock, or of the present time."""
    return period_label(F.unix_micros(F.current_timestamp()) if now is None else now, granularity)


def epoch_of(us: Column, days: int = EPOCH_DAYS) -> Column:
    if days <= 0:
        raise ValueError("an epoch has at least a day")
    return F.floor(us / F.lit(days * DAY_US)).cast("long")


def size_bucket(n: Column) -> Column:
    """Upper bounds are inclusive."""
    out = F.lit(SIZE_BUCKETS[-1][1])
    for most, name in reversed(SIZE_BUCKETS[:-1]):
        out = F.when(n <= most, name).otherwise(out)
    return out
