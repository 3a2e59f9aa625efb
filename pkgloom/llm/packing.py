"""Combine texts into containers of a fixed number of tokens.

Hierarchical residual packing: every partition packs its items best-fit, largest first, and emits the containers that
are nearly full; the others become items themselves, move on together with those of neighbouring partitions, and are
packed again, until a round no longer brings them down. No round gathers more open containers in a task than
TASK_ITEMS, so the tree has as many levels as the data need and one task never holds all.

Defined results: a text longer than the capacity is split into full containers and a rest, any other text is never
split; null and empty texts have size 0 and still get a container and place, at most as many of them to a container as its
capacity; equal texts are packed each; a table
without rows gives none. The result depends on the partitioning, but every run is a valid packing.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgloom.engine import cut

#: A container with at most this share of its capacity unused is emitted.
FULL_SHARE = 0.005
#: Items (open containers) that one task packs at a time.
TASK_ITEMS = 40_000
#: A further round must bring the open containers down by this share.
PROGRESS = 0.01

def default_vocabulary() -> str:
    """Path of the public rank file of the installed tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text."""
    encode = _encoding(path).encode_ordinary
    return [len(encode(t)) for t in texts]


def token_sizes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every text."""
    path = path or default_vocabulary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = pa.array(count_tokens(texts, path), type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts], names=["doc_id", "tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, "doc_id bigint, tokens bigint")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the items of each container: largest first, each into the container it leaves least room in."""
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    bins: list[list[int]] = []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r is set when some container has room r
    for k in order:
        size = sizes[k]
        fits = mask >> size
        if fits and size <= capacity:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
            bins[b].append(k)
            left = room - size
        else:
            b, left = len(bins), capacity - size
            bins.append([k])
        rooms[left].append(b)
        mask |= 1 << left
    return bins


MEMBERS = "array<struct<doc_id:bigint,piece:int,first_token:bigint,tokens:bigint>>"


def _pack(capacity: int, level: int, least: int):
    """Packs open containers (size, members); ``full`` marks what no later round could improve."""
    slack = max(int(capacity * FULL_SHARE), least - 1)

    def flush(sizes: list[int], members: list, part: int, serial: int):
        rows = []
        some, none = [k for k, s in enumerate(sizes) if s], [k for k, s in enumerate(sizes) if not s]
        groups = [[some[k] for k in g] for g in best_fit([sizes[k] for k in some], capacity)]
        # texts without tokens need no room: they are dealt out over the containers, what is left gets its own
        groups += [[] for _ in range(max(1 if none and not groups else 0, -(-len(none) // capacity) - len(groups)))]
        for i, k in enumerate(none):
            groups[i % len(groups)].append(k)
        for group in groups:
            size = sum(sizes[k] for k in group)
            joined = [m for k in group for m in members[k]]
            rows.append((f"{level}-{part}-{serial}", size, joined, capacity - size <= slack or not size))
            serial += 1
        return pd.DataFrame(rows, columns=["container", "size", "members", "full"]), serial

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, serial, sizes, members = TaskContext.get().partitionId(), 0, [], []
        for batch in batches:
            sizes += [int(s) for s in batch["size"]]
            members += [list(m) for m in batch["members"]]
            if len(sizes) >= TASK_ITEMS:
                frame, serial = flush(sizes, members, part, serial)
                yield frame
                sizes, members = [], []
        if sizes:
            frame, serial = flush(sizes, members, part, serial)
            yield frame

    return work


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """(container, place, doc_id, piece, first_token, tokens): where every text went. ``sizes``: (doc_id, tokens)."""
    whole = F.floor(F.col("tokens") / capacity).cast("int")
    sizes = sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    pieces = sizes.withColumn(
        "piece",
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / capacity).cast("int") - 1))),
    ).select(
        "doc_id",
        F.when(F.col("tokens") > capacity, F.col("piece") + 1).otherwise(F.lit(0)).alias("piece"),
        (F.col("piece").cast("long") * capacity).alias("first_token"),
        F.when(F.col("piece") < whole, F.lit(capacity).cast("long")).otherwise(F.col("tokens") - F.col("piece") * capacity).alias("tokens"),
    )
    schema = f"container string, size bigint, members {MEMBERS}, full boolean"
    items = pieces.select(F.col("tokens").alias("size"), F.array(F.struct("doc_id", "piece", "first_token", "tokens")).alias("members"))
    smallest = sizes.where("tokens > 0").agg(F.min(F.least(F.col("tokens"), F.pmod(F.col("tokens") - 1, F.lit(capacity)) + 1))).first()[0] or 1
    level, done, before = 0, None, None
    while True:
        packed = cut(items.mapInPandas(_pack(capacity, level, int(smallest)), schema))
        full = packed.where("full").select("container", "members")
        done = full if done is None else done.unionByName(full)
        rest = packed.where("not full").select("container", "size", "members")
        open_ = rest.count()
        parts = max(1, -(-open_ // TASK_ITEMS))
        stalled = before is not None and open_ > before * (1 - PROGRESS)
        last = level > 0 and parts == 1 and rest.rdd.getNumPartitions() == 1
        if open_ <= 1 or stalled or last:
            done = done.unionByName(rest.select("container", "members"))
            break
        # neighbours meet: a quarter of the partitions, at least what keeps a task within TASK_ITEMS
        fewer = max(parts, rest.rdd.getNumPartitions() // 4, 1)
        before = open_ if level else None
        items = rest.select("size", "members").repartition(fewer)
        level += 1
    return done.select("container", F.posexplode("members").alias("place", "m")).select("container", "place", "m.*")


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers, and the share of capacity used."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("used").alias("tokens"),
        F.ceil(F.sum("used") / capacity).cast("long").alias("least_containers"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("fill_share"),
    )
