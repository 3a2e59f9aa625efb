"""Normalisation of fingerprints (software, publisher, version), as Catalyst expressions.

Each step refers to the step before exactly once, or binds it with ``let``; otherwise Catalyst would copy the whole
chain at every reference and the plan would grow exponentially.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of a repository build, endings of unfinished releases.
REPOSITORY = r"\W*(?:git|svn|\bfc\d|\bel\d|debian|ubuntu)"
UNFINISHED = r"(?:rc|alpha|beta|α(?:lpha)?|β(?:eta)?)(?:_?\d+)?"
BLANKS = r"[\s   -     　]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANKS}|{BLANKS}$", "")


def software_name(software: Column) -> Column:
    """Without what follows the last colon (an architecture), and without one more such part."""
    cut = F.regexp_replace(strip(F.coalesce(software, F.lit(""))), r"(?s):[^:]*$", "")
    return strip(F.regexp_replace(cut, r"(?s)(?<!:):[^:]+$", ""))


def version_uncut(version: Column) -> Column:
    """The version without release, build, epoch and repository parts."""
    text = strip(F.coalesce(version, F.lit("")))
    head = let(
        text,
        lambda v: F.when(
            F.length(strip(F.regexp_extract(v, r"(?s)^(.*)-[^-]*$", 1))) > 1, F.regexp_extract(v, r"(?s)^(.*)-[^-]*$", 1)
        ).otherwise(F.regexp_extract(v, r"(?s)([^-]*)$", 1)),
    )
    # a version without a hyphen has no head, and its tail is the whole
    out = F.ltrim(head, F.lit("+ ~"))
    out = F.regexp_replace(out, r"(?s)~[^~]*$", "")
    out = F.regexp_replace(out, r"(?s)\+[^+]*$", "")
    out = F.rtrim(out, F.lit(": "))
    out = F.regexp_replace(out, r"(?s)^[^:]*:", "")

    def without_repository(v: Column) -> Column:
        return let(
            F.regexp_substr(v, F.lit(f"(?U){REPOSITORY}")),
            lambda m: F.when(m.isNull(), v)
            .when(F.instr(v, m) > 1, F.substring(v, F.lit(1), F.instr(v, m) - 1))
            .otherwise(F.substring(v, F.instr(v, m) + F.length(m), F.length(v))),
        )

    return strip(let(out, without_repository))


def version_suffix(uncut: Column) -> Column:
    """rc1, beta2 and the like; null where there is none."""
    return F.nullif(F.regexp_extract(uncut, rf"(?U)\b\d*({UNFINISHED})\b", 1), F.lit(""))


def without_suffix(uncut: Column, suffix: Column) -> Column:
    return F.when(suffix.isNull(), uncut).otherwise(F.substring(uncut, F.lit(1), F.instr(uncut, suffix) - 1))


# Fixed value: a date at the place of a version.
DATE = r"((?:19|20)\d{2})\.?(\d{1,2})\.?(\d{1,2})?"


def version_date(uncut: Column) -> Column:
    """ISO date named by a version: a missing day is the month's last; null where there is none or it is impossible."""
    year, month, day = (F.regexp_extract(uncut, DATE, k) for k in (1, 2, 3))

    def built(m: Column) -> Column:
        first = F.when(m.between(1, 12), F.make_date(year.cast("int"), m, F.lit(1)))
        last = F.last_day(first)
        return F.when(day == "", last).when(
            day.cast("int").between(1, F.day(last)), F.date_add(first, day.cast("int") - 1)
        )

    return F.when(month != "", F.date_format(let(F.nullif(month, F.lit("")).cast("int"), built), "yyyy-MM-dd"))


def truncated(version: Column) -> Column:
    """Without trailing separators, and without the last of more than two parts."""
    cut = F.regexp_replace(version, r"(?U)[\W_]+$", "")
    return F.regexp_replace(cut, r"(?U)^([^\W_]+(?:[\W_]+[^\W_]+)+)[\W_]+[^\W_]+$", "$1")


def normalized(df: DataFrame) -> DataFrame:
    """software, publisher, version of ``df`` normalised, with version_uncut, version_suffix, version_date and
    version_is_date. Null counts as empty; an empty version has empty derived fields."""
    base = df.select(
        software_name(F.col("software")).alias("software"),
        strip(F.coalesce("publisher", F.lit(""))).alias("publisher"),
        version_uncut(F.col("version")).alias("version_uncut"),
    )
    parts = base.withColumn("version_suffix", version_suffix(F.col("version_uncut"))).withColumn(
        "version_date", version_date(F.col("version_uncut"))
    )
    short = without_suffix(F.col("version_uncut"), F.col("version_suffix"))
    parts = parts.withColumn("short_", short)
    is_date = F.col("version_date").isNotNull() & (F.regexp_extract("version_uncut", DATE, 0) == F.col("short_"))
    return parts.select(
        "software",
        "publisher",
        F.when(is_date, F.col("short_")).otherwise(truncated(F.col("short_"))).alias("version"),
        "version_uncut",
        "version_suffix",
        "version_date",
        is_date.alias("version_is_date"),
    )


def fingerprints(df: DataFrame) -> DataFrame:
    """Distinct normalised fingerprints; the derived fields are those of the smallest uncut version, so that the choice
    among equal keys does not depend on order."""
    key = ["software", "publisher", "version"]
    rest = ["version_uncut", "version_suffix", "version_date", "version_is_date"]
    one = normalized(df).groupBy(*key).agg(F.min(F.struct(*rest)).alias("r"))
    return one.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
