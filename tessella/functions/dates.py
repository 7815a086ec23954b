"""Partial dates, capture times and typed dates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

QUARTER_HOUR_NS, MOST_SHIFT_NS = 15 * 60 * 10**9, 14 * 3600 * 10**9


def estimate_key(year: Column, month: Column, day: Column) -> Column:
    """Sort key of a partial date: unknown parts are 00."""
    return F.format_string("%04d-%02d-%02dT00:00:00", year, F.coalesce(month, F.lit(0)), F.coalesce(day, F.lit(0)))


def valid_estimate(year: Column, month: Column, day: Column, today: Column | None = None) -> Column:
    """From 1800 to today; a day only with a month; a date that exists."""
    today = F.current_date() if today is None else today
    least = F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1))
    real = F.when(day.isNull(), F.lit(True)).otherwise(F.expr("true") & (day >= 1) & (day <= F.dayofmonth(F.last_day(least))))
    fine = (year >= 1800) & (year <= F.year(today)) & (month.isNull() | month.between(1, 12)) & (day.isNull() | month.isNotNull())
    first = F.when(month.isNull(), F.make_date(year, F.lit(1), F.lit(1))).otherwise(F.date_add(least, F.coalesce(day, F.lit(1)) - 1))
    return F.coalesce(F.when(fine, real & (first <= today)).otherwise(False), F.lit(False))


def precision(month: Column, day: Column) -> Column:
    return F.when(month.isNull(), "year").when(day.isNull(), "month").otherwise("day")


def is_tz_shift(diff_ns: Column) -> Column:
    """A whole number of quarter hours, not 0, 14 hours at most."""
    return (diff_ns != 0) & (diff_ns % QUARTER_HOUR_NS == 0) & (F.abs(diff_ns) <= MOST_SHIFT_NS)


def local_text(ns: Column) -> Column:
    """Nanoseconds since 1970 as local wall-clock text, rounded down."""
    return F.date_format(F.timestamp_seconds(F.floor(ns / F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss")


def earlier_of(created_ns: Column, mtime_ns: Column) -> Column:
    """The time of creation if there is one that is not after the time of change (or there is no such time)."""
    return F.when((created_ns > 0) & ((created_ns <= mtime_ns) | (mtime_ns <= 0)), created_ns).otherwise(mtime_ns)


def capture_seconds(taken: Column) -> Column:
    """Seconds of wall-clock text as if it were UTC; null where it is no full date."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(taken, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def offset_seconds(offset: Column) -> Column:
    """+hh:mm as seconds."""
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    return sign * (F.substring(offset, 2, 2).cast("int") * 3600 + F.substring(offset, 5, 2).cast("int") * 60)


def same_moment(a_taken: Column, a_off: Column, a_mtime: Column, b_taken: Column, b_off: Column, b_mtime: Column) -> Column:
    """Whether a still and a clip were taken together. Both offsets known: instants within 10 s. One unknown: within 10 s of
    a whole number of quarter hours, up to 14 h. A side without a date: times of change within 10 s."""
    a, b = capture_seconds(a_taken), capture_seconds(b_taken)
    diff = F.abs(a - b)
    known = F.abs((a - offset_seconds(a_off)) - (b - offset_seconds(b_off))) <= 10
    off = F.pmod(diff, F.lit(900))
    loose = (diff <= 14 * 3600 + 10) & (F.least(off, 900 - off) <= 10)
    changed = F.abs(a_mtime - b_mtime) <= 10 * 10**9
    return F.when(a.isNull() | b.isNull(), changed).when(a_off.isNotNull() & b_off.isNotNull(), known).otherwise(loose)


@dataclass(frozen=True)
class Term:
    """A date that a search names: unknown parts match anything."""

    year: int | None = None
    month: int | None = None
    day: int | None = None
    year_prefix: str | None = None

    def matches(self, year: Column, month: Column, day: Column) -> Column:
        """The item's date lies wholly inside the term: a part that the term names must be known and equal."""
        parts = [(self.year, year), (self.month, month), (self.day, day)]
        out = F.lit(True)
        for want, have in parts:
            if want is not None:
                out = out & F.coalesce(have == want, F.lit(False))
        if self.year_prefix is not None:
            out = out & F.coalesce(F.format_string("%04d", year).startswith(self.year_prefix), F.lit(False))
        return out


#: Beginnings of month names in English and German.
MONTHS = {"jan": 1, "jän": 1, "feb": 2, "mar": 3, "mär": 3, "mae": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12}


def parse_param(text: str) -> Term | None:
    """YYYY, YYYY-MM, YYYY-MM-DD or --MM."""
    if m := re.fullmatch(r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?", text):
        year, month, day = (int(x) if x else None for x in m.groups())
        return Term(year, month, day) if (month is None or 1 <= month <= 12) and (day is None or 1 <= day <= 31) else None
    if m := re.fullmatch(r"--(\d{2})", text):
        return Term(month=int(m[1])) if 1 <= int(m[1]) <= 12 else None
    return None


def parse_typed(text: str) -> list[Term]:
    """What a person may mean: years, month names by three letters or more, numeric dates, the beginning of a year."""
    words = re.findall(r"\d+(?:[./-]\d+)*|[^\W\d_]+", text.lower())
    year = month = day = prefix = None
    for w in words:
        if m := re.fullmatch(r"(\d{4})[-./](\d{1,2})(?:[-./](\d{1,2}))?", w):
            year, month, day = int(m[1]), int(m[2]), int(m[3]) if m[3] else None
        elif m := re.fullmatch(r"(?:(\d{1,2})[./-])?(\d{1,2})[./-](\d{4})", w):
            day, month, year = int(m[1]) if m[1] else None, int(m[2]), int(m[3])
        elif re.fullmatch(r"\d{4}", w):
            year = int(w)
        elif re.fullmatch(r"\d{3}", w):
            prefix = w
        elif re.fullmatch(r"\d{1,2}", w):
            day = int(w)
        elif len(w) >= 3 and w[:3] in MONTHS:
            month = MONTHS[w[:3]]
        else:
            return []
    if (month is not None and not 1 <= month <= 12) or (day is not None and (month is None or not 1 <= day <= 31)):
        return []
    if prefix is not None and year is not None:
        return []
    return [Term(year, month, day, prefix)] if (year, month, day, prefix) != (None,) * 4 else []
