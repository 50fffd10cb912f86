"""Time columns. Instants are ``timestamp_ntz`` in UTC, arithmetic is on epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch(ts) -> Column:
    return F.unix_seconds(as_col(ts).cast("timestamp"))


def micros(ts) -> Column:
    return F.unix_micros(as_col(ts).cast("timestamp"))


def from_epoch(seconds) -> Column:
    return F.timestamp_seconds(as_col(seconds)).cast("timestamp_ntz")


def bin_epoch(ts, seconds: int) -> Column:
    e = epoch(ts)
    return e - F.pmod(e, F.lit(seconds).cast("long"))


def time_bin(ts, seconds: int) -> Column:
    """Floor to the epoch-anchored interval."""
    return from_epoch(bin_epoch(ts, seconds))


def grid_step(ts, seconds: int) -> Column:
    """Epoch-anchored step number."""
    e = epoch(ts)
    return ((e - F.pmod(e, F.lit(seconds).cast("long"))) / seconds).cast("long")


def shift(ts, seconds) -> Column:
    return from_epoch(epoch(ts) + (F.lit(seconds) if isinstance(seconds, int) else as_col(seconds)))


def to_local(ts, tz: str) -> Column:
    """Wall clock of a zone, across DST changes."""
    return F.from_utc_timestamp(as_col(ts).cast("timestamp"), tz).cast("timestamp_ntz")


def local_day(ts, tz: str | None = None, offset_hours: float = 0.0) -> Column:
    c = as_col(ts)
    if tz:
        c = to_local(c, tz)
    if offset_hours:
        c = shift(c, int(offset_hours * 3600))
    return F.to_date(c)


def lead_bucket(lead_minutes, width: int) -> Column:
    """Truncates toward zero, so leads of -29..29 share bucket 0."""
    return (F.expr(f"`{lead_minutes}` div {int(width)}") * F.lit(int(width))).cast("long")
