"""Queries of the packed-field operator over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgloom.engine import small, table
from pkgloom.operators.multivalue import explode_values, split_values

#: The canonical license list is a fixed dimension; a larger one is refused rather than broadcast.
MAX_LICENSES = 5_000


def license_words(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    rows = small(table(spark, folder, "licenses").select("identifier", "name"), MAX_LICENSES, "licenses")
    return [r.identifier for r in rows if r.identifier], [r.name for r in rows if r.name]


def alpine_license_values(spark: SparkSession, folder: str) -> DataFrame:
    """package and the array values_ of the licenses of alpine_packages."""
    words, names = license_words(spark, folder)
    alpine = table(spark, folder, "alpine_packages").select("package", "licenses")
    return split_values(alpine, "licenses", "terms", words, names)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    packages = table(spark, folder, "packages_info").select(F.col("id").cast("string").alias("record_key"), "description")
    prose = explode_values(split_values(packages, "description"), ["record_key"])
    terms = explode_values(alpine_license_values(spark, folder).withColumnRenamed("package", "record_key"), ["record_key"])
    return (
        prose.withColumn("table_name", F.lit("packages_info"))
        .unionByName(terms.withColumn("table_name", F.lit("alpine_packages")))
        .select("table_name", "record_key", "pos", "value")
    )
