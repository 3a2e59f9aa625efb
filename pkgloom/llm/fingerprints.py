"""Collapse records that differ only in case, blanks, punctuation or the order of their fields.

Distinct raw forms are hashed (see ``rolling``), the hashes of a record's fields sorted so that field order does not
matter, and equal hashes grouped with partial aggregation. Every form is then compared with the representative of its
group by two skipping pointers; a form that fails (a hash collision) is grouped by its exact canonical spelling
instead, so no result rests on a hash.

Defined results: null, empty and punctuation-only fields are all the empty spelling, and records whose fields are all
empty are copies of each other; exact repeats are copies; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgloom.engine import cut, join_skewed, key_spelling, unused
from pkgloom.llm.rolling import same_spelling, text_hashes


def _hashed(fields: list[str]):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            columns = [text_hashes(batch[f].fillna("").tolist()) for f in fields]
            pairs = np.stack([np.stack(c, axis=1) for c in columns], axis=1)  # row, field, hash
            order = np.lexsort((pairs[:, :, 1], pairs[:, :, 0]), axis=1)
            pairs = np.take_along_axis(pairs, order[:, :, None], axis=1)
            with np.errstate(over="ignore"):
                mixed = [np.zeros(len(batch), dtype=np.uint64) for _ in range(2)]
                for k in range(len(fields)):
                    for h in range(2):
                        mixed[h] = (mixed[h] ^ pairs[:, k, h]) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(k + 1)
                        mixed[h] ^= mixed[h] >> np.uint64(31)
            yield batch.assign(hash_a=mixed[0].view(np.int64), hash_b=mixed[1].view(np.int64))

    return work


def _verified(fields: list[str]):
    def same(a: tuple, b: tuple) -> bool:
        return a == b or any(all(same_spelling(x, y) for x, y in zip(a, p, strict=True)) for p in permutations(b))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mine = batch[fields].itertuples(index=False, name=None)
            other = batch[[f"of_{f}" for f in fields]].itertuples(index=False, name=None)
            yield batch.assign(same=[same(a, b) for a, b in zip(mine, other, strict=True)])

    return work


def copy_groups(df: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """One row per distinct raw form of ``fields`` (nulls as '', named f0, f1, ...): the form, ``first_id`` (the smallest
    ``key`` of its group), ``form_copies`` and ``copies`` (rows of the form and of the group). Rows without a key are
    left out, since they cannot be named."""
    f = [f"f{k}" for k in range(len(fields))]
    raw = _raw(df, fields, key)
    forms = raw.groupBy(*f).agg(F.min("row_id").alias("form_id"), F.count(F.lit(1)).alias("form_copies"))
    kind = dict(raw.dtypes)["row_id"]
    columns = ", ".join(f"{c} string" for c in f)
    hashed = cut(
        forms.mapInPandas(_hashed(f), f"{columns}, form_id {kind}, form_copies bigint, hash_a bigint, hash_b bigint")
    )
    members = F.struct(F.col("form_id"), *[F.col(c) for c in f])
    groups = cut(
        hashed.groupBy("hash_a", "hash_b")
        .agg(F.min(members).alias("m"), F.count(F.lit(1)).alias("forms"))
        .select("hash_a", "hash_b", "forms", *[F.col(f"m.{c}").alias(f"of_{c}") for c in f])
    )
    paired = join_skewed(hashed, groups, ["hash_a", "hash_b"], "forms")
    schema = ", ".join(f"`{n}` {t}" for n, t in paired.dtypes) + ", same boolean"
    checked = cut(paired.mapInPandas(_verified(f), schema))
    spelled = F.array_join(F.array_sort(F.array(*[key_spelling(F.col(c)) for c in f])), "\u0001")
    checked = checked.withColumn("exact", F.when(F.col("same"), F.lit("")).otherwise(spelled))
    totals = cut(
        checked.groupBy("hash_a", "hash_b", "exact").agg(
            F.min("form_id").alias("first_id"), F.sum("form_copies").alias("copies"), F.count(F.lit(1)).alias("n_forms")
        )
    )
    out = join_skewed(
        checked.select("hash_a", "hash_b", "exact", "form_copies", *f), totals, ["hash_a", "hash_b", "exact"], "n_forms"
    )
    return out.select(*f, "first_id", "form_copies", "copies")


def _raw(df: DataFrame, fields: list[str], key: str) -> DataFrame:
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"f{k}") for k, c in enumerate(fields)]
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("row_id"), *named)


def copy_links(df: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(first_id, copy_id): every row of a group of copies other than the one with the smallest ``key``."""
    forms = cut(copy_groups(df, fields, key).where("copies > 1"))
    raw = _raw(df, fields, key)
    joined = join_skewed(raw, forms, [f"f{k}" for k in range(len(fields))], "form_copies")
    return joined.where("row_id <> first_id").select("first_id", F.col("row_id").alias("copy_id"))


def collapse(df: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """One record per group of copies: the row with the smallest ``key``, all its columns, and ``copies``, which
    replaces a column of that name."""
    (first,) = unused(df, "first_id_")
    firsts = copy_groups(df, fields, key).groupBy("first_id").agg(F.max("copies").alias("copies"))
    firsts = firsts.withColumnRenamed("first_id", first)
    return df.drop("copies").join(firsts, F.col(key) == F.col(first)).drop(first)
