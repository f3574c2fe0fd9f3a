"""Trading calendar as column expressions: no look-ahead, no UDF.

Weekdays are trading days; holidays are the dates without a bar, met by the as-of join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE, OPEN, CLOSE, AUCTION = "Asia/Kolkata", "09:15:00", "15:30:00", "09:00:00"


def local_time(published_at: Column, zone: str = ZONE, utc_ntz: bool = False) -> Column:
    """Wall-clock time in the exchange's zone; ``utc_ntz`` for TIMESTAMP_NTZ columns that hold UTC."""
    if utc_ntz:
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), published_at)
    return F.from_utc_timestamp(F.to_utc_timestamp(published_at, F.current_timezone()), zone)


def is_trading_day(day: Column) -> Column:
    return F.weekday(day) < 5


def next_trading_day(day: Column) -> Column:
    """First weekday strictly after ``day``."""
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))


def clock(local: Column) -> Column:
    """Microseconds since midnight."""
    return F.hour(local).cast("long") * 3_600_000_000 + F.minute(local).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), local) * 1_000_000).cast("long")


def _micros(time: str) -> int:
    h, m, s = map(int, time.split(":"))
    return (h * 3600 + m * 60 + s) * 1_000_000


def timing(local: Column) -> Column:
    """``pre_open`` before the open, ``intraday`` up to and with the close, else ``post_close``; weekends ``post_close``."""
    c = clock(local)
    return (
        F.when(~is_trading_day(F.to_date(local)), "post_close")
        .when(c < _micros(OPEN), "pre_open")
        .when(c <= _micros(CLOSE), "intraday")
        .otherwise("post_close")
    )


def session_date(local: Column) -> Column:
    """The first session that opens after ``local``: the same day before the open, else the next trading day."""
    day = F.to_date(local)
    return F.when(timing(local) == "pre_open", day).otherwise(next_trading_day(day))


def leak_free(local: Column, session: Column) -> Column:
    """Whether the session opens strictly after the event."""
    day = F.to_date(local)
    return (session > day) | ((session == day) & (clock(local) < _micros(OPEN)))


def align(events: DataFrame, published_at: str = "published_at", utc_ntz: bool = False) -> DataFrame:
    """``events`` with local_time, timing and session_date: one projection."""
    out = events.withColumn("local_time", local_time(F.col(published_at), utc_ntz=utc_ntz))
    return out.withColumns({"timing": timing(F.col("local_time")), "session_date": session_date(F.col("local_time"))})


def checked(aligned: DataFrame) -> DataFrame:
    """The same rows; the query fails if one of them leaks."""
    ok = leak_free(F.col("local_time"), F.col("session_date"))
    return aligned.filter(F.assert_true(ok, F.lit("session opens before the event")).isNull())
