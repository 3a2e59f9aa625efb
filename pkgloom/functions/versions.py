"""Match versions with tags, feed titles and changelog lines.

A version's pattern is data: its parts, joined by any separator, not followed by another digit. Patterns are built per
row and matched by the JVM (``rlike`` with a column); only the choice among partial matches runs as an Arrow function.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pkgloom.functions import dates

# Endings of unfinished releases.
SUFFIX = r"(?:rc|α(?:lpha)?|β(?:eta)?|alpha|beta)"
SUFFIX_WORD = rf"\b\d*{SUFFIX}(?:_?\d+)?\b"


def significant(version: Column, separators: str = r".\-_") -> Column:
    """Parts of a version without the trailing ones that are all zeros, but at least two of them."""
    parts = F.regexp_extract_all(version, F.lit(rf"[^\s{separators}]+"), F.lit(0))
    last = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.when(~F.try_element_at(parts, k.cast("int")).rlike("^0+$"), k)))
    keep = F.when(last.isNull(), F.size(parts)).otherwise(last)
    return F.slice(parts, F.lit(1), F.greatest(F.when(keep > 1, keep).otherwise(F.lit(2)), F.lit(1)))


def _escaped(part: Column) -> Column:
    return F.regexp_replace(part, r"([^\p{L}\p{Nd}])", r"\\$1")


def general_pattern(version: Column, separators: str = r".\-_", spaced: bool = True) -> Column:
    sep = rf"\s?[{separators}]\s?" if spaced else f"[{separators}]"
    return F.concat(F.lit(r"(?iU)(?:^|\s)v?"), F.array_join(F.transform(significant(version, separators), _escaped), sep), F.lit(r"(?![^\D0])"))


def exact_pattern(version: Column, suffix: Column, separators: str = r".\-_", spaced: bool = True) -> Column:
    sep = rf"\s?[{separators}]\s?" if spaced else f"[{separators}]"
    zeros = F.lit(rf"(?:{sep}0+)*")
    ending = F.when(suffix.isNotNull(), F.concat(F.lit(r"(?:[\W_\s]+)?"), _escaped(suffix), F.lit(r"\b"))).otherwise(
        F.lit(rf"(?=$|[\W_\s]+(?!\d|{SUFFIX_WORD}))")
    )
    return F.concat(general_pattern(version, separators, spaced), zeros, ending)


def tail(text: Column, pattern: Column) -> Column:
    """What follows the match up to the first blank."""
    m = F.regexp_substr(text, pattern)
    return F.when(m.isNotNull(), F.regexp_extract(F.substring(text, F.instr(text, m) + F.length(m), F.length(text)), r"^\S*", 0))


def tail_class(tail_: Column) -> Column:
    """0 stable with digits, 1 stable, 2 unfinished."""
    unfinished = tail_.rlike(rf"[ab]|{SUFFIX}")
    return F.when(unfinished, 2).when(tail_.rlike(r"[.\-_]\d"), 0).otherwise(1)


def tail_value(tail_: Column) -> Column:
    """The numbers of a tail as an array, which orders like the version."""
    return F.transform(F.regexp_extract_all(F.regexp_extract(tail_, r"(?<=[.\-_])\d+(?:[.\-_]\d+)*", 0), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("decimal(38,0)"))


def _head_parts(text: Column) -> Column:
    parts = F.slice(F.regexp_extract_all(F.regexp_replace(F.lower(text), "^v", ""), F.lit(r"[^\s.\-_]+"), F.lit(0)), 1, 2)
    return F.transform(parts, lambda p, i: F.regexp_replace(F.regexp_extract(p, r"^(\d*)", 1), "0+$", ""))


def head_key(version: Column) -> Column:
    """The leading numbers of the first two parts of a version (of the only part), without trailing zeros. A tag that
    matches the version at its beginning has this key among its ``head_keys``, so it can be the key of the join."""
    return F.array_join(_head_parts(version), ".")


def head_keys(tag: Column) -> Column:
    parts = _head_parts(tag)
    return F.array_distinct(F.array(F.array_join(parts, "."), F.array_join(F.slice(parts, 1, 1), ".")))


def best_matches(rows: DataFrame, keys: list[str], text: str, version: str, suffix: str, order: list[str]) -> DataFrame:
    """Per key the row that matches the version best: exact matches first, then partial ones with the least numeric
    tail, then stable, then unfinished ones; ties by ``order``. Rows without a match are left out."""
    general, exact = general_pattern(F.col(version)), exact_pattern(F.col(version), F.col(suffix))
    hits = (
        rows.where(F.col(version) != "")
        .withColumn("general_", general)
        .where(F.expr(f"regexp({text}, general_)"))
        .withColumn("exact_", exact)
        .withColumn("is_exact", F.expr(f"regexp({text}, exact_)"))
        .withColumn("tail", tail(F.col(text), F.col("general_")))
        .drop("general_", "exact_")
    )
    rank = F.row_number().over(
        Window.partitionBy(*keys).orderBy(
            F.desc("is_exact"), F.when(F.col("is_exact"), 0).otherwise(tail_class(F.col("tail"))), tail_value(F.col("tail")), *[F.col(o) for o in order]
        )
    )
    return hits.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def best_date_tags(rows: DataFrame, keys: list[str], text: str, date: str, suffix: str, order: list[str]) -> DataFrame:
    """Per key the tag whose date fits a version that is a date (``date``, ISO): same date and suffix, same date, same
    suffix, same month; ties by ``order``. Only tags that name year and month are read."""
    year, month = F.year(F.to_date(date)), F.month(F.to_date(date))
    near = rows.where(F.contains(F.col(text), year.cast("string")) & F.contains(F.col(text), month.cast("string")))
    found = near.withColumn("found", F.to_date(dates.first_date(text)))
    ranked = found.withColumn("fit", date_tag_rank(year, month, F.day(F.to_date(date)), F.col("found"), F.col(text), F.col(suffix))).where("fit is not null")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("fit", *order))
    return ranked.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def changelog_release(text: str | None, version: str | None, suffix: str | None) -> str | None:
    """ISO date of a version in a changelog: on its line, else a yearless date with the first possible later year."""
    if not text or not version:
        return None
    parts = [p for p in re.split(r"[\s.\-_]+", version) if p]
    while len(parts) > 2 and set(parts[-1]) == {"0"}:
        parts.pop()
    general = re.compile(r"(?:^|\s)v?" + r"[.\-_]".join(map(re.escape, parts)) + r"(?![^\D0])", re.I)
    ending = rf"(?:[\W_]+)?{re.escape(suffix)}\b" if suffix else rf"(?=$|[\W_]+(?!\d|{SUFFIX_WORD}))"
    exact = re.compile(general.pattern + r"(?:[.\-_]0+)*" + ending, re.I)
    lines = text.splitlines()
    best: tuple | None = None
    for k, line in enumerate(lines):
        m = general.search(line)
        if m is None:
            continue
        if e := exact.search(line):
            best = (-1, (), k, e)
            break
        rest = re.match(r"\S*", line[m.end() :])[0]
        kind = 2 if re.search(rf"[ab]|{SUFFIX}", rest) else 0 if re.search(r"[.\-_]\d", rest) else 1
        entry = (kind, tuple(map(int, re.findall(r"\d+", rest))) if kind == 0 else (), k, m)
        if best is None or entry[:3] < best[:3]:
            best = entry
    if best is None:
        return None
    k, m = best[2], best[3]
    area = lines[k][: m.start()] + lines[k][m.end() :]
    found = dates.find(area)
    if found is not None:
        return dates.iso(dates.settle(found))
    open_ = dates.parse_yearless(area)
    if open_ is not None:
        for line in lines[k + 1 :]:
            if (y := dates.YEAR.search(line)) and dates.possible(int(y[0]), open_[1], open_[2]):
                return dates.iso((int(y[0]), open_[1], open_[2]))
    return None


@F.pandas_udf(StringType())
def changelog_date(texts: pd.Series, versions: pd.Series, suffixes: pd.Series) -> pd.Series:
    return pd.Series([changelog_release(*row) for row in zip(texts, versions, suffixes, strict=True)], dtype=object)


def date_tag_rank(year: Column, month: Column, day: Column, found: Column, tail_: Column, suffix: Column) -> Column:
    """0 same date and suffix, 1 same date, 2 same suffix, 3 same month; null where the month differs."""
    near = (F.year(found) == year) & (F.month(found) == month)
    full = F.day(found) == day
    fits = F.when(suffix.isNull(), ~tail_.rlike(SUFFIX)).otherwise(F.contains(tail_, suffix))
    return F.when(near, F.when(full & fits, 0).when(full, 1).when(fits, 2).otherwise(3))
