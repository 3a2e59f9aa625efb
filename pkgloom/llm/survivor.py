"""One surviving record per group of duplicates, field by field.

The rows are stacked to one line per field and value, pre-aggregated per distinct value (latest time, smallest id) before
any shuffle by group, freed of values that say nothing, and ranked by recency, completeness and id in a window that
keeps the first. A value that is the beginning of another, or a proper subset of another, is no candidate; beginnings
are found by one range-sorted pass over the distinct values, so that no group is gathered in one task.

Defined results: a null time ranks last; equal times are settled by the longer value, then by the smaller id; a field
without a usable value gives no row; groups of one row give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgloom.engine import cut, key_spelling

# Strings that stand for "nothing known".
STAND_INS = [
    "-", "--", "?", "??", "n/a", "na", "none", "null", "nil", "tbd", "todo", "unknown", "unspecified", "undefined",
    "not available", "no description", "no description available", "(no description available)", "(none)", "(unknown)",
    "http://", "https://", "homepage", "description", "license", "...", "xxx", "fixme",
]

END = "\u0001"


def stands_in(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\s ]+", " "))).isin(STAND_INS) | (
        F.trim(F.regexp_replace(text, r"[\s ]+", " ")) == ""
    )


def _flag_beginnings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a partition sorted by group, field and value: whether the next value starts with this one. The last row is
    left open (null), and the first is marked, so that partition borders can be settled."""
    held: pd.DataFrame | None = None
    first = True
    for batch in batches:
        if not len(batch):
            continue
        whole = batch if held is None else pd.concat([held, batch], ignore_index=True)
        g, f, v = whole["key"].tolist(), whole["field_name"].tolist(), whole["value"].tolist()
        flags = [
            g[i] == g[i + 1] and f[i] == f[i + 1] and len(v[i + 1]) > len(v[i]) and v[i + 1].startswith(v[i])
            for i in range(len(v) - 1)
        ]
        out = whole.iloc[:-1].assign(begins=flags, edge=[first and i == 0 for i in range(len(flags))])
        if len(out):
            first = False
            yield out
        held = whole.iloc[-1:].reset_index(drop=True)
    if held is not None:
        yield held.assign(begins=pd.array([None], dtype="boolean"), edge=[first])


def drop_beginnings(values: DataFrame) -> DataFrame:
    """``values`` (key, field_name, value and more, distinct by these three) without those that another value of the
    same key and field begins with. In sorted order, whatever starts with a value follows it directly."""
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "field_name", "value"]
    schema = ", ".join(f"`{c}` {t}" for c, t in values.dtypes) + ", begins boolean, edge boolean"
    ranged = values.repartitionByRange(n, *order).sortWithinPartitions(*order)
    flagged = cut(ranged.mapInPandas(_flag_beginnings, schema))
    # at most two rows per partition lie at a border
    border = flagged.where("edge or begins is null").select(*order, "begins").orderBy(*order).collect()
    doomed = [
        (a.key, a.field_name, a.value)
        for a, b in zip(border, border[1:], strict=False)
        if a.begins is None and (a.key, a.field_name) == (b.key, b.field_name) and len(b.value) > len(a.value) and b.value.startswith(a.value)
    ]
    kept = flagged.where("not coalesce(begins, false)").drop("begins", "edge")
    if doomed:
        kept = kept.join(F.broadcast(values.sparkSession.createDataFrame(doomed, values.select(*order).schema)), order, "left_anti")
    return kept


def drop_subsets(values: DataFrame) -> DataFrame:
    """``values`` (key, value, items) without those whose set of items is a proper subset of another's of the key.

    A set is compared only with the sets that hold its rarest item within the key."""
    sets = values.withColumn("set_", F.array_distinct(F.filter("items", lambda x: x.isNotNull())))
    pairs = sets.select("key", "value", "set_", F.explode("set_").alias("item"))
    rarity = pairs.groupBy("key", "item").agg(F.count(F.lit(1)).alias("n_item"))
    anchored = (
        pairs.join(rarity, ["key", "item"])
        .groupBy("key", "value")
        .agg(F.min(F.struct("n_item", "item")).alias("a"), F.first("set_").alias("set_"))
        .select("key", "value", "set_", F.col("a.item").alias("item"))
    )
    larger = pairs.select(F.col("key").alias("k2"), F.col("item").alias("i2"), F.col("set_").alias("s2"))
    within = anchored.join(
        larger,
        (F.col("key") == F.col("k2"))
        & (F.col("item") == F.col("i2"))
        & (F.size("s2") > F.size("set_"))
        & (F.size(F.array_except("set_", "s2")) == 0),
        "left_semi",
    ).select("key", "value")
    return values.join(within, ["key", "value"], "left_anti")


def best_values(df: DataFrame, group: str, texts: list[str], lists: list[str], time: str, key: str = "id") -> DataFrame:
    """(first_id, field_name, best_id) per group of at least two rows and field. ``group`` is taken by its key spelling;
    rows without a group or a key are left out."""
    known_ids = df.where(F.col(group).isNotNull() & F.col(key).isNotNull())
    rows = known_ids.select(
        key_spelling(F.col(group)).alias("key"), F.col(key).alias("row_id"), F.col(time).alias("at"),
        *[F.col(f).alias(f"v{k}") for k, f in enumerate([*texts, *lists])],
    )
    groups = rows.groupBy("key").agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    coded = [
        F.struct(F.lit(f).alias("field_name"), F.col(f"v{k}").alias("value"), F.lit(None).cast("array<string>").alias("items"))
        for k, f in enumerate(texts)
    ] + [
        F.struct(
            F.lit(f).alias("field_name"),
            F.array_join(F.transform(f"v{k}", lambda x: F.concat(F.coalesce(x, F.lit("\u0002")), F.lit(END))), "").alias("value"),
            F.col(f"v{k}").alias("items"),
        )
        for k, f in enumerate(lists, len(texts))
    ]
    stacked = rows.select("key", "row_id", "at", F.inline(F.array(*coded))).where(F.col("value").isNotNull())
    values = cut(
        stacked.groupBy("key", "field_name", "value").agg(
            F.max("at").alias("at"), F.min("row_id").alias("best_id"), F.first("items").alias("items")
        )
    )
    whole = drop_beginnings(values)
    known = F.when(F.col("items").isNull(), ~stands_in(F.col("value"))).otherwise(
        F.exists(F.col("items"), lambda x: x.isNotNull() & ~stands_in(x))
    )
    usable = cut(whole.where(known))
    singles = usable.where(F.col("items").isNull())
    several = usable.where(F.col("items").isNotNull())
    if lists:
        kept = [drop_subsets(several.where(F.col("field_name") == f)) for f in lists]
        for k in kept:
            singles = singles.unionByName(k)
    rank = Window.partitionBy("key", "field_name").orderBy(
        F.desc_nulls_last("at"), F.length("value").desc(), F.col("best_id")
    )
    best = singles.withColumn("rank_", F.row_number().over(rank)).where("rank_ = 1")
    return best.join(groups, "key").select("first_id", "field_name", "best_id")


def surviving_records(df: DataFrame, group: str, texts: list[str], lists: list[str], time: str, key: str = "id") -> DataFrame:
    """One built record per group: ``first_id`` and the best value of each field (null where none is usable)."""
    best = best_values(df, group, texts, lists, time, key)
    out = None
    for f in [*texts, *lists]:
        part = best.where(F.col("field_name") == f).join(df.select(F.col(key).alias("best_id"), f), "best_id").select("first_id", f)
        out = part if out is None else out.join(part, "first_id", "full")
    return out
