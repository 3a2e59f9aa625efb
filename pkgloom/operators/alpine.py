"""Merge package index files and describe source packages by their binaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgloom.functions.names import source_name
from pkgloom.operators.upserts import first_wins


def merged_index(records: DataFrame) -> DataFrame:
    """One record per package: that of the first file. ``records``: file_rank, pos, package, version, srcname,
    homepage, description, licenses; within a file the last record of a package counts."""
    return first_wins(records.withColumn("back_", -F.col("pos")), ["package"], ["file_rank", "back_"]).drop("back_")


def described_sources(merged: DataFrame) -> DataFrame:
    """The merged records with cleaned source names; the description of a package with a source name is the list
    'package - description' of all packages of that source, files in reverse order, records in order."""
    cleaned = merged.withColumn("srcname", source_name(F.col("srcname"), F.col("version")))
    line = F.concat("package", F.lit(" - "), F.coalesce("description", F.lit("")))
    told = (
        cleaned.where("srcname <> ''")
        .groupBy("srcname")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("file_rank")).alias("r"), "pos", "package", line.alias("t")))).alias("ts"))
        .select("srcname", F.array_join(F.transform("ts", lambda x: x["t"]), ", ").alias("told"))
    )
    return cleaned.join(told, "srcname", "left").select(
        "package", "srcname", "homepage", F.coalesce("told", "description").alias("description"), "licenses"
    )
