"""Bar time rules. Times are epoch milliseconds; the session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000
FIXED = {"1m": 1, "3m": 3, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240, "6h": 360, "8h": 480, "12h": 720}
CALENDAR = {"1d": "DAY", "3d": "DAY", "1w": "WEEK", "1M": "MONTH"}
ZONE = "Asia/Taipei"


def ms_of(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp without zone, taken as UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def _local(ms: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ms), zone)


def _utc_ms(local: Column, zone: str) -> Column:
    return F.unix_millis(F.to_utc_timestamp(local.cast("timestamp"), zone))


def _local_open(ms: Column, interval: str, zone: str) -> Column:
    local = _local(ms, zone)
    if interval == "3d":
        days = F.datediff(local, F.lit("1970-01-01").cast("date"))
        return F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(days / 3) * 3).cast("int"))
    return F.date_trunc(CALENDAR[interval], local)


def bar_open_ms(ms: Column, interval: str, zone: str = ZONE) -> Column:
    """Opening time of the bar that holds ``ms``: fixed intervals count from the epoch, calendar ones in the zone."""
    if interval in FIXED:
        width = FIXED[interval] * MINUTE
        return (F.floor(ms / width) * width).cast("long")
    return _utc_ms(_local_open(ms, interval, zone), zone)


def bar_close_ms(open_ms: Column, interval: str, zone: str = ZONE) -> Column:
    """Last millisecond of the bar: the next opening less one."""
    if interval in FIXED:
        return open_ms + F.lit(FIXED[interval] * MINUTE - 1)
    local = _local(open_ms, zone)
    if interval == "1M":
        following = F.add_months(local, 1)
    else:
        following = F.date_add(local, {"1d": 1, "3d": 3, "1w": 7}[interval])
    return _utc_ms(following, zone) - 1


def to_ms(value: Column, threshold: float = 1e12) -> Column:
    """Milliseconds from seconds or milliseconds: values above the threshold are milliseconds already."""
    return F.when(value > threshold, value.cast("long")).otherwise((value * 1000).cast("long"))


def local_bar_times(open_ms: Column, interval: str, zone: str = ZONE) -> list[Column]:
    """Header columns of a bar."""
    close = bar_close_ms(open_ms, interval, zone)
    return [
        F.lit(interval).alias("bar_interval"), open_ms.alias("bar_open_ms"), close.alias("bar_close_ms"),
        _local(open_ms, zone).alias("bar_open_local"), _local(close, zone).alias("bar_close_local"),
    ]


def day_cycle(ms: Column, zone: str = "UTC") -> list[Column]:
    """Sine and cosine of the time of day and of the day of the week (Monday is 0)."""
    local = _local(ms, zone)
    day = (F.hour(local) + F.minute(local) / 60.0) * (2 * 3.141592653589793 / 24)
    week = F.weekday(local) * (2 * 3.141592653589793 / 7)
    return [F.sin(day).alias("tod_sin"), F.cos(day).alias("tod_cos"), F.sin(week).alias("dow_sin"), F.cos(week).alias("dow_cos")]
