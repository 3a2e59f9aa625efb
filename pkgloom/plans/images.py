"""The driver's tables in the shapes that the relational operators take, in Spark and as DuckDB views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgloom.engine import table

#: The package dump as an image of the star schema: (column, Spark expression, DuckDB expression).
PACKAGE_COLUMNS = [
    ("projectname_seed", "p_type", "p_type"),
    ("family", "p_brand", "p_brand"),
    ("repo", "l_returnflag", "l_returnflag"),
    ("srcname", "p_name", "p_name"),
    ("binname", "lower(p_name)", "lower(p_name)"),
    ("visiblename", "case when p_partkey % 7 = 0 then null else concat(p_name, ' ', p_size) end", "case when p_partkey % 7 = 0 then null else concat(p_name, ' ', p_size) end"),
    ("trackname", "replace(p_name, ' ', '-')", "replace(p_name, ' ', '-')"),
    ("binnames", "case when p_partkey % 5 = 0 then null else split(p_name, ' ') end", "case when p_partkey % 5 = 0 then null else string_split(p_name, ' ') end"),
    ("comment", "case when l_linenumber = 7 then null else concat(l_returnflag, l_linestatus) end", "case when l_linenumber = 7 then null else concat(l_returnflag, l_linestatus) end"),
    ("licenses", "case when l_linenumber = 6 then null else array(l_linestatus, l_returnflag) end", "case when l_linenumber = 6 then null else [l_linestatus, l_returnflag] end"),
    ("version", "case when p_size % 11 = 0 then null else concat(p_size, '.', l_linenumber) end", "case when p_size % 11 = 0 then null else concat(p_size, '.', l_linenumber) end"),
    ("flags", "cast(l_quantity as int)", "cast(l_quantity as int)"),
    ("links", "case when l_linenumber = 5 then null else concat('[[', l_linenumber % 6, ',', l_suppkey, '],[4,', l_suppkey % 97, ']]') end", "case when l_linenumber = 5 then null else concat('[[', l_linenumber % 6, ',', l_suppkey, '],[4,', l_suppkey % 97, ']]') end"),
]


def packages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(*[F.expr(e).alias(name) for name, e, _ in PACKAGE_COLUMNS])


def links(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").selectExpr(
        "cast(s_suppkey as int) as id", "concat('https://example.org/', s_name) as url", "cast(floor(s_acctbal) as int) as refcount"
    )


PACKAGES_SQL = (
    "packages as (select "
    + ", ".join(f"{e} as {name}" for name, _, e in PACKAGE_COLUMNS)
    + " from lineitem join part on l_partkey = p_partkey)"
)
LINKS_SQL = (
    "links as (select cast(s_suppkey as int) as id, concat('https://example.org/', s_name) as url, "
    "cast(floor(s_acctbal) as int) as refcount from supplier)"
)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The stored package index with its version under the name that the lookups take."""
    return table(spark, folder, "packages_info").withColumnRenamed("version", "index_version").drop("observed_at", "loaded_at", "repo")


def key(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct raw fingerprints, stripped."""
    from pkgloom.functions.normalize import strip

    raw = table(spark, folder, "fingerprints_raw")
    return raw.select(*[strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("software", "publisher", "version")]).distinct()


def package_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """A fingerprint per package name and family of the index, published by a distribution of that family."""
    named = F.expr(f"{PUBLISHED}")
    return table(spark, folder, "packages_info").select(F.col("package").alias("software"), named.alias("publisher"), F.lit("").alias("version")).distinct()


PUBLISHED = "case family when 'debuntu' then 'Debian' when 'fedora' then 'Fedora Project' when 'opensuse' then 'openSUSE' when 'alpine' then 'Alpine Linux' when 'arch' then 'Arch Linux' when 'centos' then 'CentOS' else 'Other' end"
#: A publisher of every distribution that is told apart, by the id of an index row.
DISTRIBUTED = """case id % 13 when 0 then 'Debian QA' when 1 then 'Ubuntu Developers' when 2 then 'Fedora Project' when 3 then 'Red Hat, Inc.' when 4 then 'openSUSE'
 when 5 then 'SUSE LLC' when 6 then 'Alpine Linux' when 7 then 'Amazon Linux' when 8 then 'Rocky Enterprise' when 9 then 'AlmaLinux OS' when 10 then 'CentOS' when 11 then 'Arch Linux' else family end"""
PACKAGE_FP_SQL = f"fp as (select distinct package as software, {PUBLISHED} as publisher, '' as version from packages_info)"
