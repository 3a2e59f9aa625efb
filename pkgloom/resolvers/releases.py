"""Release dates of versions, out of tags, feeds and changelogs. Every way gives (keys, version, version_suffix, ..., release_date) for
the versions that it knows; ``first_known`` takes the first way that knows a date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgloom.engine import join_skewed
from pkgloom.functions import dates
from pkgloom.functions import versions as V
from pkgloom.operators.lookup import best_of
from pkgloom.sources.readers import rss_items


def by_tag(asked: DataFrame, tags: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` (keys, version, version_suffix) with the best tag (name, date, page, pos) of its project and the tag's day. Exact
    matches come first, of equal ones the first on the earliest page. Tags meet versions by their leading numbers only."""
    named = tags.select(*keys, "name", "date", "page", "pos").withColumn("head_", F.explode(V.head_keys(F.col("name"))))
    pairs = asked.where("version <> ''").withColumn("head_", V.head_key(F.col("version"))).join(named, [*keys, "head_"]).drop("head_")
    best = V.best_matches(pairs, [*keys, "version", "version_suffix"], "name", "version", "version_suffix", ["page", "pos", "name"])
    return best.withColumn("release_date", F.substring(F.coalesce("date", F.lit("")), 1, 10)).drop("date", "tail")


def by_feed(asked: DataFrame, feeds: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` with the publishing day of the item of its project's feed (keys, body) that names the version best; '' where that
    item has no date."""
    items = rss_items(feeds.select(*keys, "body"))
    best = V.best_matches(asked.join(items, keys), [*keys, "version", "version_suffix"], "title", "version", "version_suffix", ["pos"])
    return best.withColumn("release_date", F.coalesce(dates.first_date("published"), F.lit(""))).drop("published", "tail")


def by_changelog(asked: DataFrame, changelogs: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` with the day that its project's changelog (keys, text) gives the version."""
    told = changelogs.select(*keys, "text").where("text is not null")
    sized = told.join(asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("held_")), keys)
    rows = join_skewed(asked, sized, keys, "held_")
    return rows.withColumn("release_date", F.coalesce(V.changelog_date("text", "version", "version_suffix"), F.lit(""))).drop("text", "held_").where("release_date <> ''")


def first_known(asked: DataFrame, keys: list[str], *ways: DataFrame) -> DataFrame:
    """(keys, version, version_suffix, release_date) of the first way that gives a day; versions without any have ''."""
    known = [*keys, "version", "version_suffix"]
    united = asked.select(*known, F.lit("").alias("release_date"), F.lit(len(ways)).alias("way_"))
    for k, way in enumerate(ways):
        united = united.unionByName(way.select(*known, "release_date", F.lit(k).alias("way_")).where("release_date <> ''"))
    return best_of(united, known, [F.col("way_"), F.col("release_date")]).drop("way_")
