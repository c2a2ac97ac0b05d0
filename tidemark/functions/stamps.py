"""Stamps as Spark columns: when a value holds (``as_of``) and when it was learned (``known``).

Every expression is independent of the session's time zone. Text that is no stamp becomes null; it
never fails a job, and whoever cuts by a stamp must tell a null that was given from one that was not
(``unreadable``). Accepted are ISO dates and date-times: calendar and week dates, with hyphens or in the basic
form, any character between date and time, times with colons or in the basic form, fractions with ``.``
or ``,``, and ``Z`` or numeric offsets, which may have seconds and a fraction.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCHANGE_ZONE = "America/New_York"

_DATE = r"\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d)?|\d{4}W\d{2}\d?"
_TIME = r"\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}(?:\d{2}(?:[.,]\d+)?)?"
_STAMP = rf"^({_DATE})(?:[^0-9]({_TIME})(Z|[+-](?:{_TIME}))?)?$"


#: The usual forms, which Spark reads as they are once a zone stands at their end; and those that have one.
_USUAL = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?)?$"
_ZONED = r"(?:Z|[+-]\d{2}:\d{2})$"
#: Characters of a bare date, the only usual form of that length.
_BARE = 10


def _instant(stamp: Column, zone: str) -> Column:
    """The usual forms take two tests and one cast; only others are taken apart."""
    return F.when(stamp.rlike(_USUAL), _usual(stamp, zone)).otherwise(_taken_apart(stamp, zone))


def _usual(stamp: Column, zone: str) -> Column:
    midnight = F.when(F.length(stamp) == _BARE, F.lit(" 00:00:00")).otherwise(F.lit(""))
    return F.when(stamp.rlike(_ZONED), stamp).otherwise(F.concat(stamp, midnight, F.lit(f" {zone}"))).try_cast("timestamp")


def usual_as_of(stamp: Column) -> Column:
    """``as_of_instant`` of stamps in the usual form, null for all others, readable or not."""
    return F.when(stamp.rlike(_USUAL), _usual(stamp, EXCHANGE_ZONE))


def _calendar_day(date: Column) -> Column:
    """The day of a calendar or week date; null if there is no such day."""

    def of_week(p: Column) -> Column:
        day = F.date_add(F.date_sub(p["fourth"], F.weekday(p["fourth"])), 7 * (p["week"] - 1) + p["weekday"] - 1)
        return F.when(p["week"].between(1, 53) & p["weekday"].between(1, 7) & (F.weekofyear(day) == p["week"]), day)

    def of(digits: Column) -> Column:
        plain = F.concat_ws("-", digits.substr(1, 4), digits.substr(5, 2), digits.substr(7, 2)).try_cast("date")
        weekday = F.when(F.length(digits) > 6, digits.substr(7, 1)).otherwise("1").try_cast("int")
        fourth = F.concat(digits.substr(1, 4), F.lit("-01-04")).try_cast("date")  # always of the year's first week
        week = F.struct(fourth.alias("fourth"), digits.substr(5, 2).try_cast("int").alias("week"), weekday.alias("weekday"))
        return F.when(F.contains(date, F.lit("W")), let(week, of_week)).otherwise(plain)

    return let(F.regexp_replace(date, "[-W]", ""), of)


def _clock(time: Column) -> Column:
    """Microseconds of a time or an offset without its sign; null for minutes or seconds beyond 59."""

    def of(p: Column) -> Column:
        fraction = F.rpad(F.substring(p["fraction"], 1, 6), 6, "0").try_cast("bigint")
        return F.when((p["m"] < 60) & (p["s"] < 60), ((p["h"] * 60 + p["m"]) * 60 + p["s"]) * 1_000_000 + fraction)

    def two(digits: Column, i: int) -> Column:
        return F.coalesce(F.nullif(digits.substr(i, 2), F.lit("")), F.lit("0")).try_cast("bigint")

    def parts(digits: Column) -> Column:
        fraction = F.regexp_extract(digits, r"[.,](\d+)$", 1)
        return F.struct(two(digits, 1).alias("h"), two(digits, 3).alias("m"), two(digits, 5).alias("s"), fraction.alias("fraction"))

    return let(let(F.regexp_replace(time, ":", ""), parts), of)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, however often ``of`` names it."""
    return F.transform(F.array(value), of)[0]


def _taken_apart(stamp: Column, zone: str) -> Column:
    """The forms that few stamps have; kept out of generated code, which they would make too long."""
    day = 86_400_000_000

    def read(p: Column) -> Column:
        local = F.timestamp_add("MICROSECOND", p["clock"], p["day"].cast("timestamp_ntz"))
        at = F.timestamp_add("MICROSECOND", -F.coalesce(p["away"], F.lit(0)), local)
        text = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(p["offset"] == "", f" {zone}").otherwise("Z"))
        fits = (p["clock"] < day) & ((p["offset"].isin("", "Z")) | (F.abs(p["away"]) < day))
        return F.when(fits, text.try_cast("timestamp"))

    def measure(p: Column) -> Column:
        sign = F.when(p["offset"].startswith("-"), -1).otherwise(1)
        clock = F.when(p["time"] == "", F.lit(0).cast("bigint")).otherwise(_clock(p["time"]))
        away = F.when(~p["offset"].isin("", "Z"), sign * _clock(F.substring(p["offset"], 2, 40)))
        return F.struct(_calendar_day(p["date"]).alias("day"), clock.alias("clock"), away.alias("away"), p["offset"].alias("offset"))

    date, time, offset = (F.regexp_extract(stamp, _STAMP, i) for i in (1, 2, 3))
    parts = F.struct(date.alias("date"), time.alias("time"), offset.alias("offset"))
    return F.when(stamp.rlike(_STAMP), let(let(parts, measure), read))


def as_of_instant(stamp: Column) -> Column:
    """The instant of an as-of stamp: its offset, else exchange time; a bare date is the day's start there."""
    return _instant(stamp, EXCHANGE_ZONE)


def known_instant(stamp: Column) -> Column:
    """The instant of a fetch or known-at stamp: its offset, else UTC; cut to the second."""
    return F.date_trunc("second", _instant(stamp, "UTC"))


def exchange_time(instant: Column) -> Column:
    """The exchange's wall clock at an instant, as a timestamp without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(EXCHANGE_ZONE), _utc_clock(instant))


def _utc_clock(instant: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def session_day(instant: Column) -> Column:
    """The exchange date of an instant."""
    return exchange_time(instant).cast("date")


def as_of_text(instant: Column) -> Column:
    """Fixed-width UTC text with microseconds: text order is the order of instants."""
    return F.concat(F.date_format(_utc_clock(instant), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def day_start(day: Column) -> Column:
    """The instant at which an exchange day begins."""
    return as_of_instant(F.date_format(day, "yyyy-MM-dd"))


def finite(x: Column) -> Column:
    """A finite double, or null for NaN, the infinities, and text that is no number."""
    x = x.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def given(text: Column) -> Column:
    """Empty text counts as not given."""
    return F.nullif(text, F.lit(""))


def unreadable(text: Column, instant: Column) -> Column:
    """Whether a stamp was given that cannot be read. Such a cut-off must never count as none."""
    return given(text).isNotNull() & instant.isNull()


# ---- one stamp, on the driver ----
def moment(text: str, zone: str = EXCHANGE_ZONE) -> dt.datetime:
    """The instant of one stamp; ValueError if it cannot be read. The columns' forms are the standard library's."""
    read = dt.datetime.fromisoformat(text)
    return (read if read.tzinfo else read.replace(tzinfo=ZoneInfo(zone))).astimezone(dt.UTC)


def session_of(text: str) -> dt.date:
    """The exchange date of one stamp."""
    return moment(text).astimezone(ZoneInfo(EXCHANGE_ZONE)).date()


def must_read(**stamps: str | None) -> None:
    """ValueError if one of the stamps, by name, is given (neither None nor empty) and cannot be read."""
    for name, text in stamps.items():
        try:
            if text:
                moment(text)
        except (ValueError, OverflowError):
            raise ValueError(f"{name} is not a stamp: {text!r}") from None
