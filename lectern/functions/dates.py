"""Dates: bounds and ranges as users write them, and ISO text in columns.

Bounds are read on the driver against a clock that is passed in; what reaches the data
is a comparison of ISO text with ISO text, which the scan can use.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days in a relative unit.
UNIT_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}
_RELATIVE = re.compile(r"([0-9]+)([dwmy])")


def is_relative(text: str) -> bool:
    """Whether the text is a number of days, weeks, months or years."""
    return bool(_RELATIVE.fullmatch(text.strip()))


def _day(year: int, month: int, day: int, text: str) -> date:
    try:
        return date(year, month, day)
    except ValueError:
        raise ValueError(f"{text!r} is no date") from None


def _next_month(day: date) -> date:
    return date(day.year + day.month // 12, day.month % 12 + 1, 1)


def parse_bound(text: str, upper: bool, now: datetime) -> str:
    """The ISO day that a bound stands for; an upper bound is the first day after its
    period.  Relative bounds count back from now and are the same either way."""
    text = text.strip()
    if m := _RELATIVE.fullmatch(text):
        return (now.date() - timedelta(days=int(m[1]) * UNIT_DAYS[m[2]])).isoformat()
    if m := re.fullmatch(r"([0-9]{4})-([0-9]{2})-([0-9]{2})", text):
        first = _day(int(m[1]), int(m[2]), int(m[3]), text)
        after = first + timedelta(days=1)
    elif m := re.fullmatch(r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", text):
        first = _day(int(m[3]), int(m[2]), int(m[1]), text)
        after = first + timedelta(days=1)
    elif m := re.fullmatch(r"([0-9]{1,2})/([0-9]{4})", text):
        first = _day(int(m[2]), int(m[1]), 1, text)
        after = _next_month(first)
    elif m := re.fullmatch(r"[0-9]{4}", text):
        first = _day(int(text), 1, 1, text)
        after = date(first.year + 1, 1, 1)
    else:
        raise ValueError(f"{text!r} is no date")
    return (after if upper else first).isoformat()


def parse_range(text: str, now: datetime) -> tuple[str | None, str | None]:
    """(first day, first day after) of ``lo..hi``, ``lo..``, ``..hi`` or one period; a
    relative period is open at the end.  Empty and backward ranges are errors."""
    low, dots, high = (x.strip() for x in text.partition(".."))
    if not dots:
        if not low:
            raise ValueError("the range is empty")
        return parse_bound(low, False, now), None if is_relative(low) else parse_bound(low, True, now)
    if not low and not high:
        raise ValueError("the range is empty")
    first = parse_bound(low, False, now) if low else None
    after = parse_bound(high, True, now) if high else None
    if first and after and first >= after:
        raise ValueError(f"{text!r} ends before it starts")
    return first, after


def date_window(within: str | None, since: str | None, now: datetime) -> tuple[str | None, str | None]:
    """The window of the two options: ``within`` wins; ``since`` is open at the end,
    unless it is a range itself."""
    if within:
        return parse_range(within, now)
    if since:
        return parse_range(since, now) if ".." in since else (parse_bound(since, False, now), None)
    return None, None


# -- columns ---------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_iso(text: Column | str) -> Column:
    """The instant of ISO text: a day of 10 characters, a time from 19; else null."""
    c = _c(text)
    time = F.when(F.length(c) >= 19, F.substring(c, 1, 19)).when(F.length(c) >= 10, F.substring(c, 1, 10))
    return time.try_cast("timestamp_ntz")


def format_iso(instant: Column | str) -> Column:
    return F.date_format(_c(instant), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_day(day: Column | str) -> Column:
    return F.unix_date(_c(day).cast("date"))


def day_of_epoch(number: Column | str) -> Column:
    return F.date_from_unix_date(_c(number))


def human_age(seconds: Column | str) -> Column:
    """How long ago, in words."""
    s = _c(seconds).cast("long")
    return (
        F.when(s < 90, F.lit("just now"))
        .when(s < 5400, F.concat(F.floor(s / 60).cast("string"), F.lit(" minutes ago")))
        .when(s < 172800, F.concat(F.floor(s / 3600).cast("string"), F.lit(" hours ago")))
        .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit(" days ago")))
    )


def display_date(text: Column | str) -> Column:
    """ISO text as ``DD/MM/YYYY``; anything else unchanged."""
    c = _c(text)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.regexp_replace(F.substring(c, 1, 10), r"^(\d{4})-(\d{2})-(\d{2})$", "$3/$2/$1")).otherwise(c)
