"""Dates in free text, as Arrow functions.

A date is a struct (year, month, day) whose year may be missing. Fixed rules: digits in three groups are a date when one
group has four digits; of the two others the one above 12 is the day; where neither is, a slash puts the day first and
a hyphen the month first, and other separators leave it open. A month name fixes the order. Eight digits are read as
YYYYMMDD or DDMMYYYY, six as YYYYMM or MMYYYY with day 1. Impossible dates give null.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DATE = "year int, month int, day int"
MONTHS = {name.lower(): k for k in range(1, 13) for name in (calendar.month_name[k], calendar.month_abbr[k])}
_NAME = "|".join(sorted(MONTHS, key=len, reverse=True))
_SEP = r"\s*[,\-/.\s]\s*"

DIGITS = re.compile(rf"\b(\d{{4}}|\d{{1,2}})({_SEP})(\d{{4}}|\d{{1,2}})(?:\2|{_SEP})(\d{{4}}|\d{{1,2}})\b")
NAMED = re.compile(
    rf"\b(?:(?P<d1>\d{{1,2}}){_SEP}(?P<m1>{_NAME})\.?{_SEP}(?P<y1>\d{{4}})|(?P<m2>{_NAME})\.?{_SEP}(?P<d2>\d{{1,2}}){_SEP}(?P<y2>\d{{4}})"
    rf"|(?P<y3>\d{{4}}){_SEP}(?P<m3>{_NAME})\.?{_SEP}(?P<d3>\d{{1,2}})|(?P<m4>{_NAME})\.?{_SEP}(?P<y4>\d{{4}}){_SEP}(?P<d4>\d{{1,2}})"
    rf"|(?P<y5>\d{{4}}){_SEP}(?P<d5>\d{{1,2}}){_SEP}(?P<m5>{_NAME})|(?P<d6>\d{{1,2}}){_SEP}(?P<y6>\d{{4}}){_SEP}(?P<m6>{_NAME}))\b",
    re.I,
)
JOINED = re.compile(rf"\b(?:(?P<d1>\d{{1,2}})(?P<m1>{_NAME})(?P<y1>\d{{4}})|(?P<y2>\d{{4}})(?P<m2>{_NAME})(?P<d2>\d{{1,2}})|(?P<n>\d{{8}}|\d{{6}}))\b", re.I)
YEARLESS_NAMED = re.compile(rf"\b(?:(?P<d1>\d{{1,2}}){_SEP}(?P<m1>{_NAME})|(?P<m2>{_NAME})\.?{_SEP}(?P<d2>\d{{1,2}}))\b", re.I)
YEARLESS_DIGITS = re.compile(rf"\b(\d{{1,2}}){_SEP}(\d{{1,2}})\b")
YEAR = re.compile(r"\b(?:19|20)\d{2}\b")


@dataclass(frozen=True)
class Found:
    """Parts of a date as read, whether their order is known, and the span they were read from."""

    year: int | None
    first: int
    second: int | None
    ordered: bool
    start: int
    end: int
    text: str


def possible(year: int | None, month: int, day: int) -> bool:
    return 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year or 2000, month)[1]


def _named(m: re.Match) -> tuple[int, int, int | None]:
    g = {k[0]: v for k, v in m.groupdict().items() if v and k != "n"}
    return MONTHS[g["m"].lower()], int(g["d"]), int(g["y"]) if "y" in g else None


def find(text: str | None) -> Found | None:
    """The first date-like group: digits with separators, else with a month's name, else without separators."""
    text = text or ""
    for m in DIGITS.finditer(text):
        parts = [m[1], m[3], m[4]]
        if [len(p) for p in parts].count(4) == 1:
            k = next(i for i, p in enumerate(parts) if len(p) == 4)
            rest = [int(p) for i, p in enumerate(parts) if i != k]
            return Found(int(parts[k]), rest[0], rest[1], False, m.start(), m.end(), m[0])
    if m := NAMED.search(text):
        month, day, year = _named(m)
        return Found(year, month, day, True, m.start(), m.end(), m[0])
    for m in JOINED.finditer(text):
        if not m["n"]:
            month, day, year = _named(m)
            return Found(year, month, day, True, m.start(), m.end(), m[0])
        n = m["n"]
        if 1900 < int(n[:4]) < 2100:
            year, rest = int(n[:4]), n[4:]
            months, days = int(rest[:2]), int(rest[2:] or 1)
        elif 1900 < int(n[-4:]) < 2100:
            year, rest = int(n[-4:]), n[:-4]
            months, days = int(rest[-2:]), int(rest[:-2] or 1)
        else:
            continue
        return Found(year, months, days, True, m.start(), m.end(), n)
    return None


def settle(found: Found | None) -> tuple[int | None, int, int] | None:
    """The date that a find means, null where its order is open or it is impossible."""
    if found is None:
        return None
    if found.ordered:
        month, day = found.first, found.second if found.second is not None else 1
    else:
        a, b = found.first, found.second
        if a > 12:
            day, month = a, b
        elif b > 12:
            day, month = b, a
        elif "/" in found.text:
            day, month = a, b
        elif "-" in found.text:
            day, month = b, a
        else:
            return None
    return (found.year, month, day) if possible(found.year, month, day) else None


def parse(text: str | None) -> tuple[int | None, int, int] | None:
    return settle(find(text))


def parse_yearless(text: str | None) -> tuple[None, int, int] | None:
    """Month and day without a year; digits only where one of them is above 12."""
    if m := YEARLESS_NAMED.search(text or ""):
        month, day, _ = _named(m)
        return (None, month, day) if possible(None, month, day) else None
    if m := YEARLESS_DIGITS.search(text or ""):
        a, b = int(m[1]), int(m[2])
        if (a > 12) != (b > 12):
            day, month = (a, b) if a > 12 else (b, a)
            return (None, month, day) if possible(None, month, day) else None
    return None


def iso(date: tuple[int | None, int, int] | None) -> str | None:
    if date is None:
        return None
    year, month, day = date
    return f"{month:02d}-{day:02d}" if year is None else f"{year:04d}-{month:02d}-{day:02d}"


@F.pandas_udf(StringType())
def first_date(texts: pd.Series) -> pd.Series:
    """ISO form of the first date of each text."""
    return pd.Series([iso(parse(t)) for t in texts], dtype=object)


@F.pandas_udf(StringType())
def first_yearless_date(texts: pd.Series) -> pd.Series:
    return pd.Series([iso(parse_yearless(t)) for t in texts], dtype=object)
