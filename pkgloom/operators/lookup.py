"""Look fingerprints up in the package index and rank the candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgloom.functions.names import family, like_pattern, lookup_name, supported_host


def filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) != ""


def listed(column: str) -> Column:
    return F.coalesce(F.size(column), F.lit(0)) > 0


def tier(with_descriptions: bool = True) -> Column:
    """Rank of a candidate, 1 best: supported address with description and licenses, supported address, address with
    both, address, project address, package address, any."""
    host = filled("homepage") & supported_host(F.col("homepage"))
    told = filled("description") & listed("licenses")
    if not with_descriptions:  # supported address, address, any
        return F.when(host, 1).when(filled("homepage"), 4).otherwise(7)
    return (
        F.when(host & told, 1).when(host, 2).when(filled("homepage") & told, 3).when(filled("homepage"), 4)
        .when(filled("project_url"), 5).when(filled("package_url"), 6).otherwise(7)
    )


def best_of(candidates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order. The window keeps one row a key before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return candidates.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def with_any_url(index: DataFrame) -> DataFrame:
    return index.where("coalesce(homepage, project_url, package_url) is not null")


def universal_lookup(fingerprints: DataFrame, index: DataFrame) -> DataFrame:
    """For every fingerprint the best index row of its name in any family; ``index`` needs an id for ties."""
    keyed = fingerprints.withColumn("package", lookup_name(F.col("software")))
    hits = keyed.join(with_any_url(index), "package").withColumn("tier", tier())
    return best_of(hits, fingerprints.columns, [F.col("tier"), F.col("id")])


def pattern_keys(version: Column) -> Column:
    """Every LIKE pattern of the form M__.m% that a version matches, and the version itself: one key per dot, so that
    the LIKE join is an equality join."""
    dots = F.filter(
        F.sequence(F.lit(2), F.greatest(F.length(version), F.lit(2))),
        lambda k: (F.substring(version, k, F.lit(1)) == ".") & F.substring(version, k + 1, F.lit(1)).rlike(r"^\d$"),
    )
    keys = F.transform(
        dots,
        lambda k: F.concat(F.substring(version, 1, 1), F.repeat(F.lit("_"), k - 2), F.lit("."), F.substring(version, k + 1, F.lit(1)), F.lit("%")),
    )
    return F.array_distinct(F.concat(keys, F.array(version)))


def family_lookup(fingerprints: DataFrame, index: DataFrame) -> DataFrame:
    """For every fingerprint of a known distribution the best row of its name within the family. Where that has no
    supported address, a row of the same project with a version of similar size may take its place.

    Rows of one project are reduced to the best per pattern key before they meet fingerprints, so a project that holds
    much of the index is not multiplied by its fingerprints."""
    keyed = fingerprints.withColumn("package", lookup_name(F.col("software"))).withColumn("family", family(F.col("publisher")))
    keys = fingerprints.columns
    hits = keyed.where("family is not null").join(index, ["package", "family"])
    own = best_of(hits.withColumn("tier", tier(False)), keys, [F.col("tier"), F.col("id")])
    settled = own.where("tier = 1").withColumn("tier", F.lit(0))
    open_ = own.where("tier > 1")
    columns = ["projectname_seed", "description", "licenses", "homepage", "project_url", "package_url", "id", "index_version"]
    patterns = hits.where(filled("index_version")).select(*keys, like_pattern(F.col("index_version")).alias("pattern")).distinct()
    asked = open_.select(*keys, "projectname_seed").join(patterns, keys)
    others = with_any_url(index).where("index_version is not null").select(*columns).withColumn("tier", tier())
    order = [F.col("tier"), F.desc_nulls_last("index_version"), F.col("id")]
    by_key = best_of(others.withColumn("pattern", F.explode(pattern_keys(F.col("index_version")))), ["projectname_seed", "pattern"], order)
    similar = asked.join(by_key, ["projectname_seed", "pattern"]).select(*keys, *columns, "tier")
    # a version that is no number stands for itself, and may hold wildcards
    wild = asked.where(r"pattern rlike '[%_]' and not pattern rlike '^\\d_*[.]\\d%$'")
    o = others.select(*[F.col(c).alias(f"o_{c}") for c in [*columns, "tier"]])
    wilder = wild.join(o, (F.col("projectname_seed") == F.col("o_projectname_seed")) & F.expr("o_index_version like pattern")).select(
        *keys, *[F.col(f"o_{c}").alias(c) for c in [*columns, "tier"]]
    )
    ranked = (
        similar.unionByName(wilder).withColumn("own", F.lit(0))
        .unionByName(open_.select(*keys, *columns).withColumn("tier", F.greatest(tier(), F.lit(4))).withColumn("own", F.lit(1)))
    )
    best = best_of(ranked, keys, [F.col("tier"), F.desc("own"), F.desc_nulls_last("index_version"), F.col("id")])
    return settled.select(*keys, *columns, "tier").unionByName(best.select(*keys, *columns, "tier"))


def not_yet_stored(fingerprints: DataFrame, stored: DataFrame, strict: bool = False) -> DataFrame:
    """Fingerprints without a stored result. Empty key parts are stored as null; ``strict`` keeps the historical rule
    that a null part never matches, so that such fingerprints are always new."""
    key = ["software", "publisher", "version"]
    known = stored.select(*[F.nullif(F.col(f"fp_{k}"), F.lit("")).alias(f"k_{k}") for k in key]).distinct()
    condition = F.lit(True)
    for k in key:
        mine = F.nullif(F.col(k), F.lit(""))
        condition = condition & ((mine == F.col(f"k_{k}")) if strict else mine.eqNullSafe(F.col(f"k_{k}")))
    return fingerprints.join(known, condition, "left_anti")


def two_hops(asked: DataFrame, ways: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(package, source, homepage) of every distinct non-null package asked for: its source and that one's homepage, both from the
    first of the ``ways`` that has one. A way is (package, source) and (source, homepage); of several sources the
    first in spelling counts, of several homepages the last. Each side is reduced to a row a key before it is joined."""
    found = asked.select("package").where("package is not null").distinct()
    for k, (sources, homes) in enumerate(ways):
        one = sources.where("package is not null and source is not null").groupBy("package").agg(F.min("source").alias(f"s{k}"))
        home = homes.where("source is not null and homepage is not null").groupBy(F.col("source").alias(f"s{k}")).agg(F.max("homepage").alias(f"h{k}"))
        found = found.join(one, "package", "left").join(home, f"s{k}", "left")
    places = range(len(ways))
    return found.select("package", F.coalesce(*[f"s{k}" for k in places]).alias("source"), F.coalesce(*[f"h{k}" for k in places]).alias("homepage"))
