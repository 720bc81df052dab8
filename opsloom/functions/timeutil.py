"""Time arithmetic on TIMESTAMP_NTZ values.

Sessions run in UTC: ``timestampdiff`` goes through TIMESTAMP. Microsecond counts stay
under 2**53, so divisions of them are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz(text: str) -> Column:
    """A TIMESTAMP_NTZ literal."""
    return F.lit(text).cast("timestamp_ntz")


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 as a long."""
    return F.timestamp_diff("MICROSECOND", ntz("1970-01-01 00:00:00"), column(ts).cast("timestamp_ntz"))


def from_micros(us: str | Column) -> Column:
    return F.timestamp_add("MICROSECOND", column(us), ntz("1970-01-01 00:00:00"))


# Seconds per unit name.
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def floor_time(ts: str | Column, unit: str | float) -> Column:
    """Start of the clock-aligned slot (H8); ``unit`` is a name or a number of seconds.

    ``window`` floors the stored long directly, several times faster than date functions.
    It drops rows without a time, hence the stand-in for null. One operator can hold only
    one slot width.
    """
    seconds = UNIT_SECONDS.get(unit, unit)
    moment = column(ts).cast("timestamp_ntz")
    slot = F.window(F.coalesce(moment, ntz("1970-01-01 00:00:00")), f"{int(seconds * 1_000_000)} microseconds")
    return F.when(moment.isNotNull(), slot.getField("start"))


def time_chunk(ts: str | Column, seconds: float) -> Column:
    """Start of the ``seconds``-wide chunk that holds ``ts``; grows with time."""
    return floor_time(ts, seconds)
