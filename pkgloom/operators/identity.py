"""Dictionary identities (CPE) and licenses of recognised software."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgloom.engine import cut, join_skewed, small
from pkgloom.operators.lookup import best_of

#: A list of licenses with more rows is refused rather than held by every worker.
MAX_LICENSES = 5_000
#: Distance within which the nearest license is the one meant, and the length of the stand-in's vectors.
LICENSE_DISTANCE, DIMENSIONS = 0.2, 256
#: Query vectors that are sent to the workers at a time.
QUERY_BLOCK = 4_096


def cpe_candidates(software: DataFrame, cpe: DataFrame) -> DataFrame:
    """(id, cpe_id, publisher, product, version) for every dictionary entry whose product is one of the software's
    names in lower case with underscores. ``software``: id, names, publishers, version."""
    names = F.array_distinct(F.transform("names", lambda n: F.replace(F.lower(n), F.lit(" "), F.lit("_"))))
    asked = software.select("id", "publishers", "version", F.explode(names).alias("product")).where("product <> ''")
    entries = cpe.select(F.col("id").alias("cpe_id"), F.col("publisher").alias("cpe_publisher"), "product", F.col("version").alias("cpe_version"))
    return asked.join(entries, "product")


def version_parts(version: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(version, F.lit("")), F.lit(r"(?U)[^\W_]+"), F.lit(0))


def cpe_identity(software: DataFrame, cpe: DataFrame) -> DataFrame:
    """(id, cpe_id, cpe_string): the first entry in dictionary order whose publisher is among the software's or whose
    version continues the software's."""
    known = F.array_contains(F.transform("publishers", F.lower), F.replace("cpe_publisher", F.lit("_"), F.lit(" ")))
    mine, theirs = version_parts(F.col("version")), version_parts(F.col("cpe_version"))
    continues = (F.size(mine) > 0) & (F.size(theirs) >= F.size(mine)) & (F.slice(theirs, F.lit(1), F.greatest(F.size(mine), F.lit(1))) == mine)
    hits = cpe_candidates(software, cpe).where(F.coalesce(known, F.lit(False)) | continues)
    return best_of(hits, ["id"], [F.col("cpe_id")]).select(
        "id", "cpe_id", F.concat(F.lit("cpe:2.3:a:"), "cpe_publisher", F.lit(":"), "product", F.lit(":")).alias("cpe_string")
    )


def exact_licenses(values: DataFrame, licenses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched with the license's name, unmatched) of ``values`` (…, identifier)."""
    known = licenses.select("identifier", "name")
    return values.join(known, "identifier"), values.join(known.select("identifier"), "identifier", "left_anti")


def nearest(queries: DataFrame, base: DataFrame, threshold: float | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, near_id, distance): the base vector at the least Euclidean distance to each query, ties to the smaller
    id, within ``threshold`` (inclusive) where given. Both have id and vector; vectors are of one length.

    The query set meets every base vector, in blocks of QUERY_BLOCK queries that are sent to the workers: each task
    keeps its best per query, and only those bests are shuffled. The driver holds one block at a time; of several, each is
    settled before the next is read."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    numbered = queries.select("id", "vector").where("vector is not null").withColumn("block_", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    found = None
    for k in range(blocks):
        rows = numbered.where(F.col("block_") == k).select("id", "vector").collect()
        one = base.where("vector is not null").select("id", "vector").mapInPandas(
            _nearest_in([r.id for r in rows], [r.vector for r in rows], exclude_self), "query_id bigint, near_id bigint, d2 double"
        )
        one = one.groupBy("query_id").agg(F.min(F.struct("d2", "near_id")).alias("m"))
        one = cut(one) if blocks > 1 else one
        found = one if found is None else found.unionByName(one)
    best = found
    out = best.select("query_id", F.col("m.near_id").alias("near_id"), F.sqrt("m.d2").alias("distance"))
    return out if threshold is None else out.where(F.col("distance") <= threshold)


def _nearest_in(ids: list[int], vectors: list[list[float]], exclude_self: bool):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = np.array(vectors, dtype=np.float64)
        own = np.array(ids, dtype=np.int64)
        least = np.full(len(own), np.inf)
        near = np.full(len(own), -1, dtype=np.int64)
        for batch in batches:
            if not len(own):
                continue
            b = np.array(batch["vector"].tolist(), dtype=np.float64)
            name = batch["id"].to_numpy(dtype=np.int64)
            order = np.argsort(name, kind="stable")
            b, name = b[order], name[order]
            for at in range(0, len(b), 256):
                part, names = b[at : at + 256], name[at : at + 256]
                d = ((q[:, None, :] - part[None, :, :]) ** 2).sum(axis=2)
                if exclude_self:
                    d[own[:, None] == names[None, :]] = np.inf
                j = d.argmin(axis=1)
                here = d[np.arange(len(own)), j]
                better = (here < least) | ((here == least) & (names[j] < near))
                least[better], near[better] = here[better], names[j][better]
        some = near >= 0
        yield pd.DataFrame({"query_id": own[some], "near_id": near[some], "d2": least[some]})

    return work


def ngram_vectors(texts: pd.Series) -> pd.Series:
    """A stand-in for an embedding model: hashed counts of the three-letter parts of a text in lower case, of length 1."""
    out = np.zeros((len(texts), DIMENSIONS))
    for row, text in enumerate(texts):
        padded = f"  {(text or '').lower()}  "
        for k in range(len(padded) - 2):
            out[row, zlib.crc32(padded[k : k + 3].encode("utf-8", "surrogatepass")) % DIMENSIONS] += 1
    return pd.Series(list(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)), index=texts.index)


def nearest_entries(values: DataFrame, entries: list[str], embed: Callable[[pd.Series], pd.Series] = ngram_vectors, threshold: float = LICENSE_DISTANCE) -> DataFrame:
    """(identifier, entry, distance) for the distinct ``identifier`` of ``values`` whose nearest entry lies within ``threshold`` of
    Euclidean distance, ties to the first in spelling. ``entries`` is a bounded list that every worker holds; values
    are embedded where they are, in batches, and nothing but distinct identifiers is shuffled."""
    listed = sorted(set(entries))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.stack(embed(pd.Series(listed, dtype=object)).to_list()) if listed else np.zeros((0, 1))
        for batch in batches:
            said = batch.column("identifier").to_pylist()
            if not said or not len(base):
                continue
            asked = np.stack(embed(pd.Series(said, dtype=object)).to_list())
            d2 = (asked**2).sum(axis=1)[:, None] + (base**2).sum(axis=1)[None, :] - 2 * asked @ base.T
            near = d2.round(12).argmin(axis=1)
            distance = np.sqrt(np.maximum(d2[np.arange(len(near)), near], 0))
            found = np.flatnonzero(distance <= threshold)
            columns = [pa.array([said[k] for k in found], type=pa.string()), pa.array([listed[near[k]] for k in found], type=pa.string()), pa.array(distance[found])]
            yield pa.RecordBatch.from_arrays(columns, names=["identifier", "entry", "distance"])

    distinct = values.select("identifier").where("identifier is not null").distinct()
    return distinct.mapInArrow(work, "identifier string, entry string, distance double")


def resolve_licenses(values: DataFrame, licenses: DataFrame, keys: list[str], embed: Callable[[pd.Series], pd.Series] = ngram_vectors, threshold: float = LICENSE_DISTANCE) -> tuple[DataFrame, DataFrame]:
    """((*keys, names), (identifier)) for ``values`` (*keys, at, identifier): per key the names of the listed identifiers in
    their order, then those of the nearest entries, then the identifiers that have no counterpart, as they are; and these
    latter, distinct, to be stored as licenses of their own name. An identifier is resolved once, however often it stands."""
    dimension = small(licenses.select("identifier", "name"), MAX_LICENSES, "licenses")
    listed = cut(values.select("identifier").where("identifier is not null").groupBy("identifier").agg(F.count(F.lit(1)).alias("held_")))
    exact = listed.join(F.broadcast(licenses.select("identifier", "name")), "identifier").select("identifier", "name", F.lit(0).alias("rank_"))
    open_ = listed.join(F.broadcast(licenses.select("identifier")), "identifier", "left_anti")
    near = nearest_entries(open_, [r.identifier for r in dimension if r.identifier], embed, threshold)
    named = licenses.select(F.col("identifier").alias("entry"), "name")
    near = near.join(F.broadcast(named), "entry").select("identifier", "name", F.lit(1).alias("rank_"))
    known = cut(exact.unionByName(near))
    kept = open_.join(known.select("identifier"), "identifier", "left_anti").select("identifier")
    table = known.unionByName(kept.select("identifier", F.col("identifier").alias("name"), F.lit(2).alias("rank_"))).join(listed, "identifier")
    told = join_skewed(values.where("identifier is not null"), cut(table), ["identifier"], "held_")
    names = told.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank_", "at", "name"))).alias("l_"))
    return names.select(*keys, F.transform("l_", lambda x: x["name"]).alias("names")), kept
