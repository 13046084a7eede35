"""GPS time: weeks and seconds since 1980-01-06, ahead of UTC by the leap seconds inserted since."""

from __future__ import annotations

import bisect
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = dt.datetime(1980, 1, 6)
WEEK_S = 604800

# The days (UTC) from which GPS time is one more second ahead; from IERS Bulletin C.
LEAP_DAYS = "1981-07-01 1982-07-01 1983-07-01 1985-07-01 1988-01-01 1990-01-01 1991-01-01 1992-07-01 1993-07-01 1994-07-01 1996-01-01 1997-07-01 1999-01-01 2006-01-01 2009-01-01 2012-07-01 2015-07-01 2017-01-01".split()
_LEAPS = [dt.datetime.fromisoformat(d) for d in LEAP_DAYS]


@dataclass(frozen=True, order=True)
class GpsTime:
    week: int
    seconds: float

    @classmethod
    def of(cls, when: GpsTime | dt.datetime) -> GpsTime:
        """From a datetime (naive: UTC); a GpsTime stays as it is."""
        if isinstance(when, cls):
            return when
        utc = when.astimezone(dt.timezone.utc).replace(tzinfo=None) if when.tzinfo else when
        since = utc - EPOCH + dt.timedelta(seconds=bisect.bisect_right(_LEAPS, utc))
        us = (since.days * 86400 + since.seconds) * 1_000_000 + since.microseconds
        return cls(us // (WEEK_S * 1_000_000), us % (WEEK_S * 1_000_000) / 1e6)

    @property
    def milliseconds(self) -> float:
        return self.seconds * 1000


def leap_seconds(ts: Column) -> Column:
    """Seconds that GPS time is ahead at a UTC timestamp without zone."""
    out = F.lit(0)
    for n, day in enumerate(LEAP_DAYS, 1):
        out = F.when(ts >= F.lit(day).cast("timestamp_ntz"), n).otherwise(out)
    return out


def gps_microseconds(ts: Column) -> Column:
    epoch = F.lit("1980-01-06 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts) + leap_seconds(ts).cast("long") * 1_000_000


def gps_week(ts: Column) -> Column:
    return F.floor(gps_microseconds(ts) / (WEEK_S * 1_000_000)).cast("long")


def gps_milliseconds(ts: Column) -> Column:
    return (gps_microseconds(ts) % (WEEK_S * 1_000_000)) / 1000.0
