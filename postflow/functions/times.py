"""Post timestamps such as `Thu Sep 12 07:15:00 +0000 2013`."""

import datetime as dt

from pyspark.sql import Column, functions as F

# The form of a post timestamp, its names, and the zone names of RFC 822.
POST_TIME = (
    r"^[A-Za-z]+ [A-Za-z]+ \d+ \d+:\d+:\d+ (?:[+-]\d{4}|[A-Za-z]+) \d{4}(?!\d)"
)
WEEKDAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
ZONES = {
    "GMT": "+0000", "UTC": "+0000",
    "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600",
    "PST": "-0800", "PDT": "-0700",
}


def parse_post_time(text: Column) -> Column:
    """The instant, or null where the text does not hold a valid one.

    Values are checked strictly (day 32, hour 25 and a wrong weekday give null) and the form
    loosely (one-digit fields, long names, text after the year). Works under ANSI mode and
    the default parser policy, in any session zone.
    """
    parts = F.split(text, " ")
    weekday, month, day, time, zone, year = (F.get(parts, F.lit(i)) for i in range(6))
    names = F.create_map(*[F.lit(v) for pair in ZONES.items() for v in pair])
    offset = F.when(zone.rlike("^[+-]"), zone).otherwise(F.try_element_at(names, F.upper(zone)))
    instant = F.try_to_timestamp(
        F.concat_ws(" ", F.substring(month, 1, 3), day, time, F.substring(year, 1, 4), offset),
        F.lit("MMM d H:m:s yyyy Z"),
    )
    months = [m[:3] for m in MONTHS] + MONTHS
    return F.when(
        text.rlike(POST_TIME)
        & F.lower(month).isin(months)
        & _is_weekday(F.lower(weekday), _date(year, month, day)),
        instant,
    )


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date of a year, a month's name and a day, without a date pattern; null if there is none."""
    first_letters = F.lit("".join(m[:3] for m in MONTHS))
    number = F.ceil(F.instr(first_letters, F.lower(F.substring(month, 1, 3))) / 3)
    return F.concat_ws("-", F.substring(year, 1, 4), number, day.try_cast("int")).try_cast("date")


def _is_weekday(word: Column, day: Column) -> Column:
    """True where `word` is the short or the long name of the date's weekday."""
    number = F.dayofweek(day) - 1
    short, long = (F.array(*[F.lit(d[:n]) for d in WEEKDAYS]) for n in (3, None))
    return (word == F.get(short, number)) | (word == F.get(long, number))


def utc_date(instant: Column) -> Column:
    """The calendar day in UTC, whatever the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86400).cast("int"))


def instant(value) -> dt.datetime:
    """A datetime in UTC from a datetime (naive ones are UTC) or an ISO string."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if value.tzinfo is None:
        return value.replace(tzinfo=dt.timezone.utc)
    return value.astimezone(dt.timezone.utc)


def instant_literal(value) -> Column:
    """`value` as a constant that Spark folds and pushes into the scan."""
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return F.timestamp_micros(F.lit((instant(value) - epoch) // dt.timedelta(microseconds=1)))
