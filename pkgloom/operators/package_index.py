"""Rebuild the package index from a dump of packages and links.

``packages``: projectname_seed, family, repo, srcname, binname, visiblename, trackname, comment, version strings,
binnames and licenses arrays, flags (bits), links (JSON array of [type, id, ...]). ``links``: id, url, refcount.

All aggregates of a (project, family) pair share one shuffle; the three link roles are one conditional aggregation
instead of self-joins, and the best address of each role one max_by instead of a lateral join. Rows whose project or
family is null never join in the relational original and are left out of the joined index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["projectname_seed", "family"]
#: Packages with one of these flag bits are ignored where others exist.
IGNORED = 1 << 2 | 1 << 3 | 1 << 4 | 1 << 5
ROLES = [(0, "homepage"), (4, "project_url"), (5, "package_url")]


def sorted_set(column: Column) -> Column:
    """Distinct values in order; null where there is none."""
    return F.nullif(F.array_sort(F.array_distinct(F.collect_set(column))), F.array().cast("array<string>"))


def all_names(packages: DataFrame) -> DataFrame:
    """Distinct (project, family, name) of the five name columns, in one pass."""
    names = F.concat(
        F.array("srcname", "binname", "visiblename", "trackname"), F.coalesce("binnames", F.array().cast("array<string>"))
    )
    return packages.select(*KEY, F.explode(names).alias("name")).where("name is not null").distinct()


def attributes(packages: DataFrame) -> DataFrame:
    """Per project and family: other_names, description, licenses, versions (null kept last), smallest repo."""
    names = F.concat(
        F.array("srcname", "binname", "visiblename", "trackname"), F.coalesce("binnames", F.array().cast("array<string>"))
    )
    none = F.array().cast("array<string>")
    grouped = packages.groupBy(*KEY).agg(
        F.array_distinct(F.flatten(F.collect_set(names))).alias("names_"),
        F.collect_set("comment").alias("comments_"),
        F.array_distinct(F.flatten(F.collect_set("licenses"))).alias("licenses_"),
        F.collect_set("version").alias("versions_"),
        F.max(F.col("version").isNull()).alias("unversioned_"),
        F.min("repo").alias("repo"),
    )

    def tidy(name: str) -> Column:
        return F.array_sort(F.filter(name, lambda x: x.isNotNull()))

    return grouped.select(
        *KEY,
        F.nullif(tidy("names_"), none).alias("other_names"),
        "repo",
        F.nullif(F.array_join(tidy("comments_"), ", "), F.lit("")).alias("description"),
        F.nullif(tidy("licenses_"), none).alias("licenses"),
        F.concat(tidy("versions_"), F.when(F.col("unversioned_"), F.array(F.lit(None).cast("string"))).otherwise(none)).alias("versions"),
    )


def link_rows(packages: DataFrame) -> DataFrame:
    """(project, family, link_type, link_id, kept) of every link of every package."""
    parsed = F.from_json("links", "array<array<int>>")
    return packages.select(*KEY, ((F.col("flags").bitwiseAND(IGNORED)) == 0).alias("kept"), F.explode(parsed).alias("l")).select(
        *KEY, F.get("l", F.lit(0)).alias("link_type"), F.get("l", F.lit(1)).alias("link_id"), "kept"
    )


def link_groups(packages: DataFrame) -> DataFrame:
    """(project, family, link_type, ids): ids of packages that are not ignored, else of all, sorted."""
    none = F.array().cast("array<int>")
    return (
        link_rows(packages)
        .groupBy(*KEY, "link_type")
        .agg(F.expr("collect_set(link_id) filter (where kept)").alias("kept_"), F.collect_set("link_id").alias("all_"))
        .select(*KEY, "link_type", F.array_sort(F.coalesce(F.nullif("kept_", none), F.col("all_"))).alias("ids"))
    )


def link_roles(packages: DataFrame) -> DataFrame:
    """One row per project and family with the ids of each role (null for none)."""
    grouped = link_groups(packages).groupBy(*KEY).agg(
        *[F.max(F.when(F.col("link_type") == k, F.col("ids"))).alias(f"{name}_ids") for k, name in ROLES]
    )
    return packages.select(*KEY).distinct().join(grouped, KEY, "left")


def chosen_urls(packages: DataFrame, links: DataFrame) -> DataFrame:
    """The most referenced address of each role per project and family that has one; ties go to the smallest link id."""
    ids = link_groups(packages).where(F.col("link_type").isin([k for k, _ in ROLES])).select(*KEY, "link_type", F.explode("ids").alias("id"))
    found = ids.join(links.select("id", "url", "refcount"), "id")
    rank = F.struct(F.coalesce("refcount", F.lit(2**31 - 1)), -F.col("id"))
    return found.groupBy(*KEY).agg(
        *[F.max_by(F.when(F.col("link_type") == k, F.col("url")), F.when(F.col("link_type") == k, rank)).alias(name) for k, name in ROLES]
    )


def best_urls(packages: DataFrame, links: DataFrame) -> DataFrame:
    """The chosen addresses of every project and family, null for none."""
    return packages.select(*KEY).distinct().join(chosen_urls(packages, links), KEY, "left")


def build_package_index(packages: DataFrame, links: DataFrame) -> DataFrame:
    """The package index. Names and versions of a pair run in lockstep, the shorter list padded with nulls."""
    keyed = attributes(packages).where("projectname_seed is not null and family is not null")
    joined = keyed.join(chosen_urls(packages, links), KEY, "left")
    names = F.concat(F.array("projectname_seed"), F.coalesce("other_names", F.array().cast("array<string>")))
    zipped = F.arrays_zip(names.alias("package"), F.coalesce("versions", F.array().cast("array<string>")).alias("version"))
    return joined.withColumn("z", F.explode(zipped)).select(
        F.col("z.package").alias("package"), "projectname_seed", "family", "repo", "description", "licenses",
        F.col("z.version").alias("version"), *[name for _, name in ROLES],
    )
