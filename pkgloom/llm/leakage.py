"""Find evaluation passages inside a corpus with an FM-index per shard of the corpus.

A shard is up to SHARD characters of texts as word numbers of the evaluation vocabulary. Words that no item holds end a
stretch, and a stretch of fewer than four words cannot hold a phrase; all others are indexed: suffix array, Burrows-Wheeler
transform, a wavelet matrix for ranks, sampled suffix positions. All four-word phrases of the items are searched
backwards at once, located through the samples, chained along equal offsets, and every chain is drawn out on both sides over
equal words and single changed ones that two equal words follow, as far as they go. Runs of eight words or more are merged into removal
spans per text and item.

Notices are phrases that three or more items share, or that stand in at least NOTICE_SHARE of all texts; they count
for nothing. Statistics run over all texts and all items, each distinct one (by its words) counted once.

Defined results: null and empty texts and items match nothing; items shorter than eight words cannot leak; equal texts
and equal items are each reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgloom.engine import cut, join_skewed

GRAM = 4
RUN = 8
#: The part of an item's words that must stand in runs.
LEAST_SHARE = 1 / 3
#: A phrase in this share of all distinct texts, and in at least NOTICE_LEAST of them, is a notice; so is one of three
#: distinct items.
NOTICE_SHARE, NOTICE_LEAST, NOTICE_ITEMS = 0.02, 15, 3
#: Items go to the workers in blocks of so many, each block against all texts.
BLOCK = 20_000
#: Every so many suffix positions are kept; also the first word of each stretch.
SAMPLE = 8
#: Characters of texts that one index holds.
SHARD = 4_000_000

MARKUP = re.compile(r"<[^<>\n\x00]{1,120}>|&#?\w{1,8};")
WORDS = re.compile(r"[^\W_]+|\x00")


def words_of(text: str) -> list[str]:
    text = text.lower().replace("\x00", " ")
    if "<" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    return WORDS.findall(text)


def digest(words: list[str]) -> int:
    """The same number for the same words, on every machine."""
    return int.from_bytes(blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class FMIndex:
    """Full-text index of a sequence of numbers below ``size``; 0 separates stretches and is never searched."""

    def __init__(self, seq: np.ndarray, size: int) -> None:
        n = len(seq)
        self.n = n
        zero = seq == 0
        zeros = int(zero.sum())
        rank = np.where(zero, np.cumsum(zero) - 1, seq.astype(np.int64) + zeros)
        width = 1
        while True:  # prefix doubling; every separator is a symbol of its own, so it ends within the longest stretch
            after = np.full(n, -1, dtype=np.int64)
            after[: n - width] = rank[width:]
            key = rank * (n + size + 2) + (after + 1)
            suffixes = np.argsort(key, kind="stable")
            ordered = key[suffixes]
            fresh = np.empty(n, dtype=np.int64)
            steps = np.zeros(n, dtype=np.int64)
            steps[1:] = np.cumsum(ordered[1:] != ordered[:-1])
            fresh[suffixes] = steps
            rank = fresh
            if steps[-1] == n - 1 or width >= n:
                break
            width *= 2
        self.bwt = np.where(suffixes > 0, seq[suffixes - 1], 0).astype(np.int64)
        counts = np.bincount(seq, minlength=size)
        self.first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        starts = np.zeros(n, dtype=bool)
        starts[0] = True
        starts[1:] = zero[:-1]
        self.sampled = (suffixes % SAMPLE == 0) | starts[suffixes] | zero[suffixes]
        self.at_sample = np.cumsum(self.sampled) - 1
        self.positions = suffixes[self.sampled]
        self.bits = max(1, int(size - 1).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []
        now = self.bwt
        for bit in range(self.bits - 1, -1, -1):
            ones = (now >> bit) & 1
            total = np.concatenate([[0], np.cumsum(ones)])
            self.levels.append((total, n - int(total[-1])))
            now = np.concatenate([now[ones == 0], now[ones == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        low, high = np.zeros_like(at), at.copy()
        for level, bit in zip(self.levels, range(self.bits - 1, -1, -1), strict=True):
            total, zeros = level
            one = (symbols >> bit) & 1 == 1
            ones_low, ones_high = total[low], total[high]
            low = np.where(one, zeros + ones_low, low - ones_low)
            high = np.where(one, zeros + ones_high, high - ones_high)
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each row of ``patterns``, found from the last symbol backwards."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            low[live] = self.first[c] + self.rank(c, low[live])
            high[live] = self.first[c] + self.rank(c, high[live])
            live = live[high[live] > low[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back through the transform to the nearest sample."""
        rows, walked = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            c = self.bwt[rows[open_]]
            rows[open_] = self.first[c] + self.rank(c, rows[open_])
            walked[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        return self.positions[self.at_sample[rows]] + walked


class ItemSet:
    """The evaluation items (id, text, places of shared phrases) as word numbers, their distinct four-word phrases and where these stand."""

    def __init__(self, items: list[tuple[int, str, list[int]]]) -> None:
        self.ids = [i for i, _, _ in items]
        texts = [words_of(t or "") for _, t, _ in items]
        vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for t in texts for w in t}))}
        self.size = len(vocabulary) + 1
        self.vocabulary = vocabulary
        self.numbers = [np.array([vocabulary[w] for w in t], dtype=np.int64) for t in texts]
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.shared = [np.zeros(len(t), dtype=bool) for t in texts]
        for k, (_, _, starts) in enumerate(items):
            for p in starts or []:
                self.shared[k][p : p + RUN] = True
        rows, where = [], []
        for k, ids in enumerate(self.numbers):
            for p in range(len(ids) - GRAM + 1):
                if not self.shared[k][p : p + GRAM].all():
                    rows.append(ids[p : p + GRAM])
                    where.append((k, p))
        grams = np.array(rows, dtype=np.int64).reshape(-1, GRAM)
        self.patterns, inverse = np.unique(grams, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        order = np.argsort(inverse, kind="stable")
        self.where = np.array(where, dtype=np.int64).reshape(-1, 2)[order]
        self.offsets = np.searchsorted(inverse[order], np.arange(len(self.patterns) + 1))
        # all items in a row, ends and shared words as -2, which no text holds: a run is not drawn out across them
        padded = [np.full(2, -2)]
        for ids, shared in zip(self.numbers, self.shared, strict=True):
            padded += [np.where(shared, -2, ids), np.full(2, -2)]
        self.flat = np.concatenate(padded)
        self.start = np.concatenate([[0], np.cumsum(self.lengths + 2)])[:-1] + 2


def _known_stretches(ids: np.ndarray) -> np.ndarray:
    """Places of the words in stretches of four or more words of the evaluation vocabulary."""
    edge = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= GRAM
    start, size = start[long], (end - start)[long]
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())


def _drawn_out(text: np.ndarray, at: np.ndarray, flat: np.ndarray, word: np.ndarray, step: int) -> np.ndarray:
    """How far runs go on from the words at ``at`` of the text and ``word`` of the items, which are equal, in steps of +1 or
    -1: over equal words, and over a single changed one that two equal ones follow."""
    far = np.zeros(len(at), dtype=np.int64)
    live = np.arange(len(at))
    while len(live):
        t, w = at[live] + step * (far[live] + 1), word[live] + step * (far[live] + 1)
        equal = text[t] == flat[w]
        bridged = ~equal & (text[t] != -1) & (flat[w] != -2)
        t2, w2 = np.where(bridged, t + step, t), np.where(bridged, w + step, w)
        bridged &= (text[t2] == flat[w2]) & (text[t2 + step] == flat[w2 + step])
        far[live] += np.where(equal, 1, np.where(bridged, 2, 0))
        live = live[equal | bridged]
    return far


def _runs(ids: np.ndarray, items: ItemSet) -> np.ndarray:
    """Rows (place in ids, item, first word, end word) of the runs of one shard; ids has -1 between texts."""
    keep = _known_stretches(ids)
    none = np.zeros((0, 4), dtype=np.int64)
    if not len(keep):
        return none
    jump = np.concatenate([[0], (np.diff(keep) > 1).astype(np.int64)])
    place = np.arange(len(keep)) + np.cumsum(jump)  # one separator between stretches
    seq = np.zeros(place[-1] + 2, dtype=np.int64)
    seq[place] = ids[keep]
    original = np.zeros(len(seq), dtype=np.int64)
    original[place] = keep
    index = FMIndex(seq, items.size)
    low, high = index.search(items.patterns)
    found = np.flatnonzero(high > low)
    if not len(found):
        return none
    many = high[found] - low[found]
    rows = np.repeat(low[found], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = original[index.locate(rows)]
    pattern = np.repeat(found, many)
    times = items.offsets[pattern + 1] - items.offsets[pattern]
    at = np.repeat(at, times)
    entry = np.repeat(items.offsets[pattern], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    item, word = items.where[entry, 0], items.where[entry, 1]
    shift = at - word
    order = np.lexsort((word, shift, item))
    item, word, shift = item[order], word[order], shift[order]
    cutoff = np.ones(len(item), dtype=bool)
    cutoff[1:] = (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (np.diff(word) > GRAM + 1)
    begin = np.flatnonzero(cutoff)
    last = np.concatenate([begin[1:], [len(item)]]) - 1
    item, shift, first, end = item[begin], shift[begin], word[begin], word[last] + GRAM
    text = np.concatenate([np.full(2, -1), ids, np.full(2, -1)])
    back = _drawn_out(text, first + shift + 2, items.flat, first + items.start[item], -1)
    on = _drawn_out(text, end - 1 + shift + 2, items.flat, end - 1 + items.start[item], 1)
    first, end = first - back, end + on
    long = end - first >= RUN
    return np.unique(np.stack([first + shift, item, first, end], axis=1)[long], axis=0)


def _phrases(text: pd.Series) -> pd.DataFrame:
    """Digests of all words of an item, and of each eight words in a row."""
    out = []
    for t in text:
        w = words_of(t or "")
        out.append((digest(w), [digest(w[p : p + RUN]) for p in range(len(w) - RUN + 1)]))
    return pd.DataFrame(out, columns=["spelled", "phrases"])


def shared_phrases(items: DataFrame) -> DataFrame:
    """(item_id, text, shared): every item with the places of its phrases that three or more distinct items hold."""
    phrases = F.pandas_udf(_phrases, "struct<spelled bigint, phrases array<bigint>>")
    keyed = cut(items.select("item_id", "text", phrases("text").alias("k")).select("item_id", "text", "k.*"))
    one = keyed.dropDuplicates(["spelled"]).select("spelled", F.posexplode("phrases").alias("p", "phrase"))
    owners = one.groupBy("phrase", "spelled").agg(F.count(F.lit(1)).alias("n")).groupBy("phrase").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("n"))
    noted = cut(owners.where(F.col("owners") >= NOTICE_ITEMS).select("phrase", "n"))
    places = join_skewed(one, noted, ["phrase"], "n").groupBy("spelled").agg(F.collect_list("p").alias("shared"))
    return cut(keyed.drop("phrases").join(places, "spelled", "left").select("item_id", "text", "shared"))


#: The prepared items of this worker process.
_PREPARED: dict[str, ItemSet] = {}


def find_runs(docs: DataFrame, items: list[tuple[int, str, list[int]]]) -> DataFrame:
    """(doc_id, spelled, item, starts, ends, places): per text and item number the item's word ranges found and the word of
    the text where each begins; spelled is the digest of the text's words. The digest of every text also comes once
    per batch in a row without item."""

    names = ["doc_id", "spelled", "item", "starts", "ends", "places"]
    carried = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK items
    mark = uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pkgloom.llm.leakage import _PREPARED as prepared  # the worker's own, not a copy that came with this function

        if mark not in prepared:
            prepared.clear()
            prepared[mark] = ItemSet(carried.value)
        known = prepared[mark]
        lookup = known.vocabulary | {"\x00": -1}
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            parts, held, size = [], [], 0
            for t in texts:
                held.append(t.replace("\x00", " "))
                size += len(t)
                if size > SHARD:
                    parts.append("\x00".join([*held, ""]))
                    held, size = [], 0
            if held:
                parts.append("\x00".join([*held, ""]))
            numbers, spelled, found, at = [], [], [], 0
            for text in parts:
                text = text.lower()
                if "<" in text or "&" in text:
                    text = MARKUP.sub(" ", text)
                words = WORDS.findall(text)
                ids = np.fromiter((lookup.get(w, 0) for w in words), dtype=np.int64, count=len(words))
                start = 0
                for end in np.flatnonzero(ids == -1):
                    spelled.append(digest(words[start:end]))
                    start = end + 1
                found.append(_runs(ids, known) + np.array([at, 0, 0, 0]))
                numbers.append(ids == -1)
                at += len(ids)
            every = list(set(spelled))
            if every:
                none, lists = pa.nulls(len(every), pa.int64()), pa.nulls(len(every), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([none, pa.array(every, type=pa.int64()), none, lists, lists, lists], names=names)
            found = np.concatenate([*found, np.zeros((0, 4), dtype=np.int64)])
            if not len(found):
                continue
            ends = np.flatnonzero(np.concatenate(numbers))
            doc = np.searchsorted(ends, found[:, 0])
            start = np.concatenate([[0], ends + 1])[doc]
            frame = pd.DataFrame(
                {"doc": doc, "item": found[:, 1], "starts": found[:, 2], "ends": found[:, 3], "places": found[:, 0] - start}
            )
            grouped = frame.groupby(["doc", "item"], sort=True).agg(list).reset_index()
            lists = [pa.array(grouped[c].tolist(), type=pa.list_(pa.int64())) for c in ("starts", "ends", "places")]
            named = batch.column("doc_id").take(pa.array(grouped["doc"].to_numpy()))
            own = pa.array([spelled[d] for d in grouped["doc"]], type=pa.int64())
            yield pa.RecordBatch.from_arrays([named, own, pa.array(grouped["item"].to_numpy(), type=pa.int64()), *lists], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        work, "doc_id bigint, spelled bigint, item bigint, starts array<bigint>, ends array<bigint>, places array<bigint>"
    )


def _notices(runs: DataFrame, texts: int, known: ItemSet) -> dict[int, np.ndarray]:
    """Per item number a mask of the words that are notices; ``texts`` is the number of distinct texts. A distinct text
    counts once for each word. Only the words that are notices reach the driver."""
    need = max(NOTICE_LEAST, NOTICE_SHARE * texts)
    one = runs.dropDuplicates(["item", "spelled"]).groupBy("item", "starts", "ends").agg(F.count(F.lit(1)).alias("n"))
    spread = F.array_distinct(F.flatten(F.zip_with("starts", "ends", lambda a, z: F.sequence(a, z - 1))))
    words = one.select("item", F.explode(spread).alias("word"), "n")
    often = words.groupBy("item", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= need).select("item", "word").collect()
    masks = {k: m.copy() for k, m in enumerate(known.shared)}
    for row in often:
        masks[row.item][row.word] = True
    return masks


def leaks(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, item_id, share) of every leak, (doc_id, first_word, last_word) of the merged removal spans)."""
    spark = docs.sparkSession
    texts = None
    items = shared_phrases(items)
    total = items.count()
    blocks = max(1, -(-total // BLOCK))
    found = spans = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        listed = [(r.item_id, r.text, r.shared) for r in part.orderBy("item_id").collect()]
        known = ItemSet(listed)
        if not len(known.patterns):
            continue
        rows = cut(find_runs(docs, listed))
        texts = rows.select("spelled").distinct().count() if texts is None else texts
        runs = rows.where("item is not null").drop("spelled")
        masks = _notices(rows.where("item is not null"), texts, known)
        ids, lengths = [None if i is None else str(i) for i in known.ids], known.lengths

        def share(batches: Iterator[pd.DataFrame], masks=masks, ids=ids, lengths=lengths) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for doc, item, starts, ends, places in batch.itertuples(index=False):
                    got = np.zeros(lengths[item], dtype=bool)
                    for a, z in zip(starts, ends, strict=True):
                        got[a:z] = True
                    got &= ~masks[item]
                    part = got.sum() / max(1, lengths[item])
                    if part >= LEAST_SHARE:
                        out.append((doc, ids[item], float(part), [[int(p), int(p + z - a)] for p, a, z in zip(places, starts, ends, strict=True)]))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "share", "spans"])

        # ids travel as text, which stays exact where some are null
        texted = runs.withColumn("doc_id", F.col("doc_id").cast("string"))
        judged = cut(texted.mapInPandas(share, "doc_id string, item_id string, share double, spans array<array<bigint>>"))
        judged = judged.withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("item_id", F.col("item_id").cast("bigint"))
        one = judged.select("doc_id", "item_id", F.round("share", 6).alias("share"))
        flat = judged.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s")[0].alias("a"), F.col("s")[1].alias("z"))
        found = one if found is None else found.unionByName(one)
        spans = flat if spans is None else spans.unionByName(flat)
    if found is None:
        found = spark.createDataFrame([], "doc_id bigint, item_id bigint, share double")
        spans = spark.createDataFrame([], "doc_id bigint, a bigint, z bigint")
    order = "partition by doc_id order by a, z"
    merged = (
        spans.withColumn("reach", F.expr(f"max(z) over ({order} rows between unbounded preceding and 1 preceding)"))
        .withColumn("island", F.expr(f"sum(case when reach is null or a > reach then 1 else 0 end) over ({order} rows unbounded preceding)"))
        .groupBy("doc_id", "island")
        .agg(F.min("a").alias("first_word"), (F.max("z") - 1).alias("last_word"))
        .select("doc_id", "first_word", "last_word")
    )
    return found, merged
