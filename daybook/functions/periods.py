"""Period keys and bounds as columns, and the driver's helpers for periods that a user names."""

from __future__ import annotations

import calendar
import re
from datetime import date, timedelta

from pyspark.sql import Column, functions as F

#: Fixed value: days that a free range may span.
RANGE_MAX_DAYS = 92


def day_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def week_key(day: Column) -> Column:
    """ISO year and week, as 2024-W03."""
    return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def year_key(day: Column) -> Column:
    return F.date_format(day, "yyyy")


KEYS = {"week": week_key, "month": month_key, "year": year_key}


def month_day(day: Column) -> Column:
    return F.date_format(day, "MM-dd")


def months_between(start: Column, end: Column) -> Column:
    """Whole months from start to end."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - (F.dayofmonth(end) < F.dayofmonth(start)).cast("int")


def months_before(day: date, months: int) -> date:
    """The same day so many months earlier, or that month's last."""
    years, month = divmod(day.month - months - 1, 12)
    after = date(day.year + years + month // 11, (month + 1) % 12 + 1, 1)  # the first of the month after it
    last = after - timedelta(1)
    return last - timedelta(max(0, last.day - day.day))


def bounds(kind: str, key: str) -> tuple[date, date]:
    """First and last day of a period."""
    if kind == "week":
        first = date.fromisocalendar(int(key[:4]), int(key[6:]), 1)
        return first, first + timedelta(6)
    if kind == "month":
        year, month = int(key[:4]), int(key[5:7])
        return date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1])
    if kind == "year":
        return date(int(key), 1, 1), date(int(key), 12, 31)
    first, last = key.split("..")
    return date.fromisoformat(first), date.fromisoformat(last)


def parse(text: str, ranges: bool = True) -> tuple[str, str]:
    """(kind, key) of 2024, 2024-3, 2024-w3 or first..last; ValueError for anything else."""
    text = text.strip()
    if m := re.fullmatch(r"(\d{4})", text):
        return "year", m[1]
    if m := re.fullmatch(r"(\d{4})-[wW](\d{1,2})", text):
        first = date.fromisocalendar(int(m[1]), int(m[2]), 1)
        return "week", "{}-W{:02d}".format(*first.isocalendar()[:2])
    if (m := re.fullmatch(r"(\d{4})-(\d{1,2})", text)) and 1 <= int(m[2]) <= 12:
        return "month", f"{m[1]}-{int(m[2]):02d}"
    if ranges and (m := re.fullmatch(r"(\d{4}-\d\d-\d\d)\.\.(\d{4}-\d\d-\d\d)", text)):
        first, last = map(date.fromisoformat, m.groups())
        if 0 <= (last - first).days < RANGE_MAX_DAYS:
            return "range", f"{first}..{last}"
        raise ValueError(f"a range begins before it ends, and has {RANGE_MAX_DAYS} days at most")
    raise ValueError(f"not a period: {text}")


def previous(kind: str, first: date) -> str:
    """Key of the period before the one that begins at `first`."""
    if kind == "year":
        return f"{first.year - 1:04d}"
    if kind == "month":
        before = first - timedelta(1)
        return f"{before.year:04d}-{before.month:02d}"
    year, week, _ = (first - timedelta(7)).isocalendar()
    return f"{year:04d}-W{week:02d}"


def title(kind: str, key: str) -> str:
    """A period in words."""
    first, last = bounds(kind, key)
    if kind == "year":
        return key
    if kind == "week":
        return f"Week {int(key[6:])} of {key[:4]}"
    if kind == "month":
        return f"{calendar.month_name[first.month]} {first.year}"
    left = f"{first.day}" + ("" if first.month == last.month and first.year == last.year else f" {calendar.month_name[first.month]}")
    left += "" if first.year == last.year else f" {first.year}"
    return f"{left} to {last.day} {calendar.month_name[last.month]} {last.year}"


_MONTHS = {name.lower(): k for k in range(1, 13) for name in (calendar.month_name[k], calendar.month_abbr[k])}
#: Words that make a day the end of a range.
RANGE_WORDS = frozenset("since after before until till through between from during over throughout".split())


def _number(word: str) -> int | None:
    """A day of a month, with or without its ordinal ending."""
    digits = word.rstrip("stndrh")
    return int(digits) if digits.isdecimal() and len(digits) < 3 and word[len(digits) :] in ("", "st", "nd", "rd", "th") else None


def _named_days(words: list[str]):
    """(month, day, year or none) of the days that stand in words, month first before day first."""
    at = lambda k: words[k] if 0 <= k < len(words) else ""
    year = lambda k: int(at(k)) if at(k).isdecimal() and len(at(k)) == 4 else None
    months = [(k, _MONTHS[w]) for k, w in enumerate(words) if w in _MONTHS]
    for k, month in months:
        if (day := _number(at(k + 1))) is not None:
            yield month, day, year(k + 2)
    for k, month in months:
        if (day := _number(at(k - 2 if at(k - 1) == "of" else k - 1))) is not None:
            yield month, day, year(k + 1)


def explicit_day(question: str, today: date) -> date | None:
    """The one day that a question names; none beside words of a range. Without a year: its most recent past."""
    words = [w.strip("-_") for w in re.findall(r"[\w-]+", question.lower())]
    if not RANGE_WORDS.isdisjoint(part for w in words for part in w.split("-")):
        return None
    for word, back in (("yesterday", 1), ("today", 0)):
        if word in words:
            return today - timedelta(back)
    try:
        for word in words:
            if len(word) == 10 and word[4] == word[7] == "-":
                return date.fromisoformat(word)
        month, day, year = next(_named_days(words), (None, 0, None))
        if month is None:
            return None
        if year is None:
            year = today.year - ((month, day) > (today.month, today.day))
        return date(year, month, day)
    except ValueError:
        return None
