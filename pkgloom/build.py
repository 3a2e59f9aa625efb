"""Build the reference tables in a folder: package index, index files, dictionary entries, licenses.

A table whose folder has Spark's success mark is taken as built. The package index is written with a stable id and
clustered by package, so that lookups by name prune row groups; the other tables are upserted into what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgloom.engine import cut
from pkgloom.operators import alpine, package_index, upserts


def exists(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``id``: its place in the given order, counted per range partition and shifted by the sizes of those
    before, without a window over the whole table."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id()).withColumn("mono_", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("part_").agg(F.count(F.lit(1)).alias("n"), F.min("mono_").alias("low")).orderBy("part_").collect()
    shift, at = {}, 0
    for r in sizes:
        shift[r.part_] = at - r.low
        at += r.n
    if not shift:
        return ranged.withColumn("id", F.lit(0).cast("bigint")).drop("part_", "mono_")
    moved = F.create_map(*[F.lit(x) for pair in shift.items() for x in pair])
    return ranged.withColumn("id", F.col("mono_") + moved[F.col("part_")] + 1).drop("part_", "mono_")


def build_index(spark: SparkSession, target: str, packages: DataFrame, links: DataFrame) -> DataFrame:
    path = f"{target}/packages_info.parquet"
    if not exists(spark, path):
        index = numbered(package_index.build_package_index(packages, links), "package", "projectname_seed", "family", "version")
        index.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def refresh(spark: SparkSession, target: str, name: str, merge) -> DataFrame:
    """Replace a table by ``merge`` of its old content (null where there is none). The new content is written beside the
    old one and takes its place when it is complete; the old one is set aside until then, and comes back by itself if the
    change stopped between."""
    path = f"{target}/{name}.parquet"
    jvm = spark._jvm.org.apache.hadoop.fs
    now, new, aside = jvm.Path(path), jvm.Path(f"{path}.new"), jvm.Path(f"{path}.old")
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(now) and fs.exists(aside):
        fs.rename(aside, now)
    old = spark.read.parquet(path) if exists(spark, path) else None
    merge(old).write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(aside, True)
    if old is not None:
        fs.rename(now, aside)
    fs.rename(new, now)
    fs.delete(aside, True)
    return spark.read.parquet(path)


def build_alpine(spark: SparkSession, target: str, records: DataFrame) -> DataFrame:
    columns = ["srcname", "homepage", "description", "licenses"]
    new = alpine.described_sources(alpine.merged_index(records))
    return refresh(spark, target, "alpine_packages", lambda old: new if old is None else upserts.keep_old_if_empty(old, new, "package", columns))


def build_cpe(spark: SparkSession, target: str, entries: DataFrame) -> DataFrame:
    """``entries``: publisher, product, version, pos (dictionary order)."""
    key = ["publisher", "product", "version"]

    def merge(old: DataFrame | None) -> DataFrame:
        base = spark.createDataFrame([], "id bigint, publisher string, product string, version string") if old is None else old
        start = base.agg(F.max("id")).first()[0] or 0
        fresh = numbered(upserts.insert_ignore(base, entries, key, "pos"), "pos")
        return base.select("id", *key).unionByName(fresh.select((F.col("id") + start).alias("id"), *key))

    return refresh(spark, target, "cpe_entities", merge)


def build_licenses(spark: SparkSession, target: str, rows: DataFrame) -> DataFrame:
    """``rows``: identifier, name, osi_approved, seq."""

    def merge(old: DataFrame | None) -> DataFrame:
        both = rows if old is None else rows.unionByName(old.withColumn("seq", F.lit(-1)))
        return upserts.last_wins(both, ["identifier"], "seq").select("identifier", "name", "osi_approved")

    return refresh(spark, target, "licenses", merge)
