"""Local time. The session's zone is UTC; every function takes the owner's zone, a name or a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.schemas import HOUR_MS

#: Names as labels show them.
WEEKDAYS = ["понедельник", "вторник", "среда", "четверг", "пятница", "суббота", "воскресенье"]
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]


def _zone(zone: str | Column) -> Column:
    return F.lit(zone) if isinstance(zone, str) else zone


def local_time(ms: Column, zone: str | Column) -> Column:
    """The owner's wall clock as a timestamp."""
    return F.from_utc_timestamp(F.timestamp_millis(ms), _zone(zone))


def local_day(ms: Column, zone: str | Column) -> Column:
    return F.date_format(local_time(ms, zone), "yyyy-MM-dd")


def hour_start(ms: Column, zone: str | Column) -> Column:
    """Start of the local clock hour. The offset is the one at that instant, so the two equal hours of an autumn night stay apart."""
    offset = F.unix_millis(local_time(ms, zone)) - ms
    return F.floor((ms + offset) / HOUR_MS).cast("long") * HOUR_MS - offset


def day_start(day: Column, zone: str | Column) -> Column:
    """Instant of local midnight."""
    return F.unix_millis(F.to_utc_timestamp(F.to_timestamp(day), _zone(zone)))


def day_end(day: Column, zone: str | Column) -> Column:
    """Instant of the next local midnight; a day isn't always 24 hours long."""
    return F.unix_millis(F.to_utc_timestamp(F.to_timestamp(F.date_add(F.to_date(day), 1)), _zone(zone)))


def hhmm(ms: Column, zone: str | Column) -> Column:
    return F.date_format(local_time(ms, zone), "HH:mm")


def day_label(day: Column) -> Column:
    """29 September 2026 as "вторник, 29 сентября 2026"."""
    date = F.to_date(day)
    weekday = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(date) + 1)
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(date))
    return F.concat(weekday, F.lit(", "), F.dayofmonth(date).cast("string"), F.lit(" "), month, F.lit(" "), F.year(date).cast("string"))


def format_duration(ms: Column) -> Column:
    """"1 ч 05 мин", "3 мин 12 с" or "45 с"."""
    seconds = F.floor(ms / 1000)
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (
        F.when(h > 0, F.concat(h.cast("string"), F.lit(" ч "), two(m), F.lit(" мин")))
        .when(m > 0, F.concat(m.cast("string"), F.lit(" мин "), two(s), F.lit(" с")))
        .otherwise(F.concat(s.cast("string"), F.lit(" с")))
    )
