"""Readers for the external formats, each a DataFrame of the schema that the operators take."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

APK = "package string, version string, description string, homepage string, licenses string, srcname string"


def _apk_record(block: str) -> dict[str, str]:
    names = {"P": "package", "V": "version", "T": "description", "U": "homepage", "L": "licenses", "o": "srcname"}
    out = dict.fromkeys(names.values(), "")
    for line in block.splitlines():
        key, sep, value = line.partition(":")
        if sep and key.strip() in names:
            out[names[key.strip()]] = value.strip()
    return out


def apk_text(spark: SparkSession, path: str, file_rank: int = 0) -> DataFrame:
    """Records of a package index text, separated by blank lines, read as splittable text."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where("trim(value) <> ''")
    pairs = F.transform(F.split(F.trim("value"), r"\n"), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, F.lit(":")) + 1, F.length(x))).alias("v")))
    keyed = blocks.withColumn("p", F.filter(pairs, lambda x: x["k"] != x["v"]))

    def value(key: str) -> F.Column:
        hits = F.filter("p", lambda x: x["k"] == key)
        return F.coalesce(F.try_element_at(hits, F.lit(-1))["v"], F.lit(""))

    return keyed.select(
        F.lit(file_rank).alias("file_rank"), F.monotonically_increasing_id().alias("pos"), value("P").alias("package"), value("V").alias("version"),
        value("T").alias("description"), value("U").alias("homepage"), value("L").alias("licenses"), value("o").alias("srcname"),
    ).where("package <> ''")


def apk_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of package index archives (tar, compressed or not), one task per archive."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    text = tar.extractfile("APKINDEX").read().decode("utf-8", "replace")
                rows = [_apk_record(b) for b in text.split("\n\n") if b.strip()]
                rows = [r for r in rows if r["package"]]
                yield pd.DataFrame(rows).assign(file=name, pos=range(len(rows))) if rows else pd.DataFrame(columns=["file", "pos"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, f"{APK}, file string, pos bigint")


CPE = r"^cpe:2\.3:a:([^:]+):([^:]+):([^:]+)"


def cpe_xml(spark: SparkSession, path: str) -> DataFrame:
    """(publisher, product, version) of the application entries of a dictionary in XML."""
    items = spark.read.format("xml").option("rowTag", "cpe-23:cpe23-item").option("rootTag", "cpe-list").load(path)
    return items.select(*[F.regexp_extract("_name", CPE, k).alias(n) for k, n in ((1, "publisher"), (2, "product"), (3, "version"))]).where("publisher <> ''")


def spdx_json(spark: SparkSession, path: str) -> DataFrame:
    """(identifier, name, osi_approved): two rows per license, one under its name and one under its identifier."""
    schema = "licenses array<struct<licenseId:string,name:string,isOsiApproved:boolean>>"
    one = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("licenses").alias("l"))
    rows = F.array(
        F.struct(F.col("l.name").alias("identifier"), F.col("l.name").alias("name"), F.col("l.isOsiApproved").alias("osi_approved")),
        F.struct(F.col("l.licenseId").alias("identifier"), F.col("l.name").alias("name"), F.col("l.isOsiApproved").alias("osi_approved")),
    )
    return one.select(F.inline(rows))


ITEMS = "array<struct<title:string,pubDate:string>>"


def rss_items(feeds: DataFrame, body: str = "body") -> DataFrame:
    """One row per feed item that has a title: pos, title, published (null where the item has no date of its own)."""
    feed = F.from_xml(F.col(body), f"channel struct<item:{ITEMS}>, item {ITEMS}")
    none = F.from_json(F.lit("[]"), ITEMS)
    items = F.filter(F.concat(F.coalesce(feed["channel"]["item"], none), F.coalesce(feed["item"], none)), lambda i: i["title"].isNotNull())
    kept = [c for c in feeds.columns if c != body]
    return feeds.select(*kept, F.posexplode(items).alias("pos", "i")).select(*kept, "pos", F.col("i.title").alias("title"), F.col("i.pubDate").alias("published"))


def payloads(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Bodies of asked addresses from a table of answers (url, status, body); answers other than 2xx count as none."""
    good = answers.where("status between 200 and 299").select("url", "body")
    return asked.join(good, "url", "left")


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of an external database; partitioning options make the read parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
