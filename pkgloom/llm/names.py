"""Link the spellings of one person or organisation.

Names are parsed into core words (the distinctive ones), initials and generic words. The core words of all names are
matched as words: MinHash signatures of their padded q-grams are cut into bands, as many for each word length as the
collision curve asks for at the least resemblance of two words that the verification accepts; candidates are verified
by edit distance, and star clustering turns words into word families: the most frequent spelling is a centre, every other one
belongs to a centre it is itself close to. Every name belongs to the family of its surname-like word, which position, initials
and lone use over the whole corpus tell from given names. Within a family the other words of the names are compared by
Monge-Elkan similarity and again clustered as stars.

Every step is a join or an aggregation over distinct words or given parts; no family, bucket or star is gathered in one
task, and buckets that many words share are spread by their size.

Defined results: null, empty and value-like strings (versions, numbers) are linked to nothing; names that hold nothing but
generic words are one where these words are the same apart from articles and legal forms; equal spellings are one name;
ties are settled by spelling.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgloom.engine import cut, join_skewed, release

# Generic words of organisation names with their abbreviations; the default of a parameter.
GENERIC_GROUPS = """
foundation fndn fdn found fnd
corporation corp
company co comp
limited ltd
incorporated inc
group grp
association assoc assn asso
institute inst insti instit
project proj prj projects
university uni univ
collective coll collect
software sw soft softw
technologies technology technol tech techs
systems system sys syst
networks network nets netw net
labs lab laboratories
data
computing comput
research res rsch
open
source
opensource oss os
linux
enterprise ent enterpr
distribution distr dist distrib
core
team
maintainers maintainer
developers developer dev devs
packages package
lists list
legacy
llc
gmbh
bv
ag
sa
plc
studios studio
solutions
services
community
society
org
"""
ARTICLES = {"the", "of", "and", "for", "a", "an"}
LEGAL = {"corporation", "company", "limited", "incorporated", "llc", "gmbh", "bv", "ag", "sa", "plc"}
# Endings of account names, letters within version numbers.
ENDINGS = ("soft", "hq", "dev", "devs", "labs", "lab", "inc", "org", "team", "project", "software", "tech", "oss", "io")
MARKERS = "rc|alpha|beta|a|b|c|p|r|v|pre|post|dev|git|svn|fc|el|bpo|build|ubuntu|deb|nmu|ppa|dfsg|lp|mga|snapshot|final"

GENERIC = {w: line.split()[0] for line in GENERIC_GROUPS.split("\n") for w in line.split()} | {w: "" for w in ARTICLES}
NUMBER = re.compile(rf"(?:{MARKERS})?\d+(?:(?:{MARKERS})?\d*)*|alpha|beta|rc")

Q = 2
ROWS = 3
#: Two words that verification accepts must meet in some band at least so probably, at the worst place of their edits.
RECALL = 0.95
#: A word is given-name-like when the core words beside it start with at least so many different letters.
HUB_LETTERS = 7
#: Words of at most so many letters are read as given names where a longer word stands beside them.
SHORT = 5
#: Weights of one power of this do not rank the nodes of a star.
WEIGHT_CLASS = 4
#: Members of a bucket that meet in one task; larger buckets are spread.
BUCKET = 256


def edits(length: int) -> int:
    """Edits that verification allows between words, the shorter of which has so many letters."""
    return 0 if length < 4 else 1 if length < 9 else 2


def least_resemblance(length: int) -> float:
    """Jaccard resemblance of the q-grams of two words of this length at the allowed edits, each of them a transposition
    amid the word, which changes the most q-grams."""
    whole = length + Q - 1
    broken = min(edits(length) * (Q + 1), whole - 1)
    return (whole - broken) / (whole + broken)


def bands_for(resemblance: float, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands needed on the collision curve 1 - (1 - s^rows)^bands."""
    return 1 if resemblance >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - resemblance**rows))


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def split_name(name: str) -> list[str]:
    """The words of a name; none for a version or number in the place of a name."""
    words = plain(name).split()
    numbers = [w for w in words if NUMBER.fullmatch(w)]
    if len(numbers) == len(words) or words[0].isdigit() and len(numbers) * 2 > len(words):
        return []
    if len(words) >= 4 and 2 <= len(words[-1]) <= 8 and words[-2] in words[:-3]:
        return words[:-3]  # local part, host and domain of an address
    return words


def parse(name: str, generic: dict[str, str] = GENERIC) -> tuple[list[str], list[str], bool]:
    """Core words, initials, and whether generic words were present. Core is empty for what is no name and for names of
    nothing but generic words."""
    words = split_name(name)
    if not words:
        return [], [], False
    lettered = [w for w in words if not any(c.isdigit() for c in w)]
    initials = [w for w in lettered if len(w) == 1]
    core = [w for w in lettered if len(w) > 1 and w not in generic]
    if not core:  # letters and digits mixed are distinctive only where nothing else is
        core = [w for w in words if w not in lettered and not NUMBER.fullmatch(w)]
    return core, initials, len(core) + len(initials) < len(words)


def generic_name(name: str, generic: dict[str, str] = GENERIC) -> str:
    """The generic words, each in one form, of a name that holds no other: without articles, and without legal forms
    unless there is nothing else."""
    said = {x for w in split_name(name) if len(w) > 1 for x in generic.get(w, "").replace("opensource", "open source").split()}
    return " ".join(sorted(said - LEGAL or said))


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or most + 1 when larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def close_words(a: str, b: str) -> bool:
    """Whether two words are one but for typing errors; digits are never errors."""
    most = edits(min(len(a), len(b)))
    if not most:
        return a == b
    if [c for c in a if c.isdigit()] != [c for c in b if c.isdigit()]:
        return False
    return distance(a, b, most) <= most


def grams(word: str) -> list[int]:
    padded = f"\x02{word}\x03"
    return [zlib.crc32(padded[i : i + Q].encode()) for i in range(max(1, len(padded) - Q + 1))]


def _hashes() -> tuple[np.ndarray, np.ndarray]:
    """The permutations of all bands; every word length takes as many of the first bands as it needs."""
    total = max(bands_for(least_resemblance(n)) for n in range(4, 40)) * ROWS
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**31 - 1, total, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**31 - 1, total, dtype=np.uint64)


def bands_of(word: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number per band of a word; words under four letters have no neighbours and no bands."""
    if len(word) < 4:
        return np.zeros(0, dtype=np.int64)
    bands = bands_for(least_resemblance(min(len(word), 39)))
    prime = np.uint64((1 << 31) - 1)
    g = np.array(grams(word), dtype=np.uint64) % prime
    least = ((g[:, None] * a[None, : bands * ROWS] + b[None, : bands * ROWS]) % prime).min(axis=0).reshape(bands, ROWS)
    mixed = least[:, 0]
    with np.errstate(over="ignore"):
        for r in range(1, ROWS):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + least[:, r]
        mixed = mixed * np.uint64(0xC2B2AE3D27D4EB4F) + np.arange(bands, dtype=np.uint64)
        mixed ^= mixed >> np.uint64(31)
    return mixed.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = _hashes()
    for batch in batches:
        words = batch.column("word").to_pylist()
        bands = [bands_of(w, a, b) for w in words]
        at = np.repeat(np.arange(len(words)), [len(x) for x in bands])
        flat = np.concatenate([*bands, np.zeros(0, dtype=np.int64)])
        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(flat)], names=["node", "n", "key"])


def meetings(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(node, ahead, n, m) of every two nodes that share a key, ``ahead`` being the one with the larger ``n`` or, of equal
    ones, the first in spelling, and ``m`` its ``n``. ``rows``: (node, n, key), distinct. The members of a bucket of more than ``bucket`` are spread
    over several tasks, each of which meets them all."""
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    spread = F.ceil(F.col("held") / bucket).cast("int")
    shared = rows.join(held, "key").withColumn("spread", spread)
    left = shared.select("key", F.pmod(F.xxhash64("node"), F.col("spread")).cast("int").alias("salt"), "node", "n")
    right = shared.select("key", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt"), F.col("node").alias("ahead"), F.col("n").alias("m"))
    first = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("ahead") < F.col("node")))
    return left.join(right, ["key", "salt"]).where(first).select("node", "ahead", "n", "m")


def stars(pairs: DataFrame) -> DataFrame:
    """(node, center) of all satellites among the nodes of ``pairs`` (node, ahead, n, m; n and m their weights), which are the edges
    of a graph: star clusters. Nodes of a heavier class (powers of WEIGHT_CLASS, so that chance does not rank rare ones) go first,
    in a class those with more edges, then the heavier, then the first in spelling. A node is a centre when none of those
    ahead of it is one; any other belongs to the first of the centres that it has an edge to. Rounds run until every node is
    settled, however long the chains are. Where the pairs have a similarity ``s``, the most similar centre comes first. ``pairs``
    are read several times, so they should be stored."""
    pairs = pairs.withColumn("s", F.col("s") if "s" in pairs.columns else F.lit(1.0)).select("node", "ahead", "n", "m", "s")
    edges_of = pairs.select(F.explode(F.array("node", "ahead")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    both = pairs.join(edges_of, "node").join(edges_of.select(F.col("node").alias("ahead"), F.col("degree").alias("d2")), "ahead")

    def rank(weight: str, degree: str, node: str) -> Column:
        grade = F.floor(F.log(F.greatest(F.col(weight), F.lit(1)).cast("double")) / math.log(WEIGHT_CLASS) + 1e-9)
        return F.struct((-grade).alias("g"), (-F.col(degree)).alias("d"), (-F.col(weight)).alias("w"), F.col(node).alias("v"))

    one, other = rank("n", "degree", "node"), rank("m", "d2", "ahead")
    behind_first = F.when(one > other, F.struct("node", "ahead", other.alias("r"), "s")).otherwise(F.struct(F.col("ahead").alias("node"), F.col("node").alias("ahead"), one.alias("r"), "s"))
    edges = cut(both.select(behind_first.alias("e")).select("e.*"))
    behind = edges.select(F.col("node").alias("ahead"), F.lit(False).alias("first")).distinct()
    rooted = F.coalesce("first", F.lit(True))
    state = edges.join(behind, "ahead", "left").groupBy("node").agg(F.max(rooted).alias("some"))
    state = cut(state.select("node", F.when(F.col("some"), False).alias("central")))
    while state.where("central is null").limit(1).count():
        seen = (
            edges.join(state.select(F.col("node").alias("ahead"), F.coalesce("central", F.lit(False)).alias("c"), F.col("central").isNull().alias("u")), "ahead", "left")
            .groupBy("node")
            .agg(F.max(F.coalesce("c", F.lit(True))).alias("some"), F.max(F.coalesce("u", F.lit(False))).alias("open"))
        )
        verdict = F.when(F.col("some"), False).when(~F.col("open"), True)
        state = cut(state.join(seen, "node").select("node", F.coalesce("central", verdict).alias("central")))
    satellite = state.where("not central").select("node")
    centers = edges.join(satellite.select(F.col("node").alias("ahead")), "ahead", "left_anti")
    best = centers.join(satellite, "node", "left_semi").groupBy("node").agg(F.min_by("ahead", F.struct(-F.col("s"), "r")).alias("center"))
    return best


def _verify_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[[close_words(a, b) for a, b in zip(batch["node"], batch["ahead"], strict=True)]]


def near_letters(a: str, b: str, most: Column) -> Column:
    """A quick test in the JVM that no pair within ``most`` edits fails (a transposition is two of its edits)."""
    return (F.abs(F.length(a) - F.length(b)) <= most) & F.when(most <= 1, F.levenshtein(a, b, 2) >= 0).otherwise(F.levenshtein(a, b, 4) >= 0)


def word_pairs(words: DataFrame) -> DataFrame:
    """(node, ahead, n, m) of the close ones among the words (``word``, ``n``: their number of names) that meet in a band."""
    banded = cut(words.where("length(word) >= 4").select("word", F.col("n").cast("bigint").alias("n")).mapInArrow(_signatures, "node string, n bigint, key bigint"))
    most = F.when(F.least(F.length("node"), F.length("ahead")) < 9, 1).otherwise(2)
    met = meetings(banded).where(near_letters("node", "ahead", most)).distinct()
    return cut(met.mapInPandas(_verify_words, "node string, ahead string, n bigint, m bigint"))


def word_families(words: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(word, family) for words with their number ``n`` of names: star clusters around the most frequent spelling."""
    found = stars(word_pairs(words) if pairs is None else pairs).select(F.col("node").alias("word"), F.col("center").alias("family"))
    return cut(words.join(found, "word", "left").select("word", F.coalesce("family", "word").alias("family")))


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean over the words of ``a`` of the best similarity in ``b``: 1 - distance / length; an initial or a part of at
    least three letters of a word counts as that word."""

    def one(x: str, y: str) -> float:
        short, long = sorted((x, y), key=len)
        if x == y or len(short) == 1 and long.startswith(short) or len(short) >= 3 and short in long:
            return 1.0
        return 0.95 if close_words(x, y) else 1 - distance(x, y, 99) / max(len(x), len(y))

    return sum(max(one(x, y) for y in b) for x in a) / len(a)


def same_given(a: str, b: str) -> bool:
    """Whether two given parts mean one: all words of that with fewer words stand in the other."""
    x, y = a.split(), b.split()
    if len(x) == len(y):
        return min(monge_elkan(x, y), monge_elkan(y, x)) >= 0.95
    return monge_elkan(*sorted((x, y), key=len)) >= 0.95


def _turned(pairs: DataFrame) -> DataFrame:
    """The pairs with the heavier node, or of equal ones the first in spelling, as ``ahead``."""
    right = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("ahead") < F.col("node")))
    node, ahead = F.when(right, F.col("node")).otherwise(F.col("ahead")), F.when(right, F.col("ahead")).otherwise(F.col("node"))
    return pairs.select(node.alias("node"), ahead.alias("ahead"), F.least("n", "m").alias("n"), F.greatest("n", "m").alias("m"))


def _verify_given(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[[same_given(a[a.index("\x01") + 1 :], b[b.index("\x01") + 1 :]) for a, b in zip(batch["node"], batch["ahead"], strict=True)]]


def parts_within(word: Column) -> Column:
    """All parts of a word of three letters or more that are at least two letters shorter."""
    longest = F.length(word) - 2
    return F.flatten(
        F.transform(
            F.sequence(F.lit(3), F.greatest(longest, F.lit(3))),
            lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - k + 1, F.lit(1))), lambda i: F.substring(word, i, k)),
        )
    )


def given_stars(parts_of: DataFrame, close: DataFrame) -> DataFrame:
    """(family, given, n, center) for the given parts of two letters and more beside each family word.

    A given part that is contained in a longer one of its family (``parts_of`` n > 1) is its nickname; all others meet where
    they share a word, where two of their words are ``close`` (pairs of words), or where a word of one is part of a word of
    the other."""
    full = parts_of.where("length(given) > 1").select(F.concat_ws("\x01", "family", "given").alias("node"), "family", "given", F.col("n").cast("bigint").alias("n"))
    long = full.where("n > 1 and length(given) >= 5").select("family", F.explode(F.array_distinct(parts_within(F.col("given")))).alias("given"), F.struct("n", "given").alias("longer"))
    nick = full.where("length(given) >= 3").join(long, ["family", "given"]).groupBy("family", "given").agg(F.max("n").alias("n"), F.max("longer").alias("best"))
    nick = cut(nick.select("family", "given", "n", F.col("best.given").alias("full")))
    up = nick.select("family", F.col("given").alias("full"), F.col("full").alias("fuller"))
    nick = nick.join(up, ["family", "full"], "left").select("family", "given", "n", F.coalesce("fuller", "full").alias("full"))
    rest = full.join(nick, ["family", "given"], "left_anti")
    words = cut(rest.select("node", "n", "family", F.explode(F.array_distinct(F.split("given", " "))).alias("word")))
    met = meetings(words.select("node", "n", F.xxhash64("family", "word").alias("key")).distinct())
    # words that are close meet in the family by way of the pairs of all words
    either = close.select(F.col("node").alias("word"), F.col("ahead").alias("other")).unionByName(close.select(F.col("ahead").alias("word"), F.col("node").alias("other")))
    beside = either.groupBy("word").agg(F.collect_list("other").alias("others")).join(words.groupBy("word").agg(F.count(F.lit(1)).alias("held")), "word")
    asked = join_skewed(words, cut(beside), ["word"], "held").select("node", "n", "family", F.explode("others").alias("word"))
    near = _turned(asked.join(words.select(F.col("node").alias("ahead"), F.col("n").alias("m"), "family", "word"), ["family", "word"]))
    # one word of a given part within a longer word of another
    inner = words.where("length(word) >= 5").select(F.col("node").alias("ahead"), F.col("n").alias("m"), "family", F.explode(F.array_distinct(parts_within(F.col("word")))).alias("word"))
    within = _turned(words.where("length(word) >= 3").join(inner, ["family", "word"]).where("node <> ahead"))
    pairs = cut(met.unionByName(near).unionByName(within).distinct().mapInPandas(_verify_given, "node string, ahead string, n bigint, m bigint"))
    star = stars(pairs)
    given = F.regexp_extract("center", "\x01(.*)$", 1)
    settled = rest.join(star, "node", "left").select("family", "given", "n", F.when(F.col("center").isNull(), F.col("given")).otherwise(given).alias("center"))
    above = settled.select("family", F.col("given").alias("full"), "center")
    nicked = nick.join(above, ["family", "full"], "left").select("family", "given", "n", F.coalesce("center", "full").alias("center"))
    return settled.select("family", "given", "n", "center").unionByName(nicked)


def placed_given(parts_of: DataFrame, close: DataFrame) -> DataFrame:
    """(family, given, center, likely): the star of every given part of a family, initials and the empty one included. An
    initial belongs to the only star that begins with it, nothing to the only star; else ``center`` is null and ``likely``
    the most frequent star that fits."""
    star = cut(given_stars(parts_of, close))
    centers = star.where("center = given").select("family", "center", F.col("n").alias("weight"))
    top = F.max_by("center", F.struct("weight", F.transform(F.split("center", ""), lambda c: -F.ascii(c)))).alias("top")
    by_family = centers.groupBy("family").agg(F.count(F.lit(1)).alias("many"), top)
    by_letter = centers.groupBy("family", F.substring("center", 1, 1).alias("given")).agg(F.count(F.lit(1)).alias("fits"), top.alias("fit"))
    told = parts_of.groupBy("family").agg(F.count(F.when(F.col("given") != "", 1)).alias("givens"))
    short = parts_of.where("length(given) <= 1").join(told, "family").join(by_family, "family", "left").join(by_letter, ["family", "given"], "left")
    many, fits = F.coalesce("many", F.lit(0)), F.coalesce("fits", F.lit(0))
    center = (
        F.when((many == 0) & (F.col("givens") <= 1), "=")  # nothing but one initial tells these names apart
        .when(F.col("given") == "", F.when(many == 1, F.col("top")).when(many == 0, "="))
        .otherwise(F.when(fits == 1, F.col("fit")).when(fits == 0, F.concat(F.lit("="), "given")))
    )
    likely = F.when(F.col("given") == "", F.col("top")).otherwise(F.col("fit"))
    settled = short.select("family", "given", center.alias("center"), F.when(center.isNull(), likely).alias("likely"))
    return star.select("family", "given", "center", F.lit(None).cast("string").alias("likely")).unionByName(settled)


def _parsed(generic: dict[str, str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        for batch in batches:
            said = batch.column("name").to_pylist()
            got = [parse(x, generic) for x in said]
            core, initials, some = ([g[k] for g in got] for k in range(3))
            key = ["" if c else generic_name(x, generic) for x, c in zip(said, core, strict=True)]
            columns = [pa.array(core, type=strings), pa.array(initials, type=strings), pa.array(some, type=pa.bool_()), pa.array(key, type=pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["name", "n", "core", "initials", "generic", "key"])

    return work


def _splits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ways to read a lone word as an account name: (name, prefix, word, suffix)."""
    for batch in batches:
        out = []
        for name, word in zip(batch["name"], batch["only"], strict=True):
            for k in range(len(word) - 3):
                out.append((name, word[:k], word[k:], ""))
            for e in ENDINGS:
                if word.endswith(e) and len(word) - len(e) > 3:
                    stem = word[: -len(e)]
                    out += [(name, stem[:k], stem[k:], e) for k in range(len(stem) - 3)]
        yield pd.DataFrame(out, columns=["name", "prefix", "word", "suffix"])


def entities(names: DataFrame, together: DataFrame | None = None, generic: dict[str, str] = GENERIC) -> DataFrame:
    """(name, entity) for names (``name``: key spelling, ``n``: occurrences). ``together`` (name, other, n) tells
    which names the records give for one and the same thing; it settles names that only give the family word.
    ``generic`` maps generic words and their abbreviations to one form each."""
    read = names.select("name", F.col("n").cast("bigint").alias("n")).where("name is not null and name <> ''")
    read = cut(read.mapInArrow(_parsed(generic), "name string, n bigint, core array<string>, initials array<string>, generic boolean, key string"))
    parsed = read.where("size(core) > 0")
    bare = read.where("key <> ''").select("name", F.concat(F.lit("= "), "key").alias("entity"))
    lone = (F.size("core") == 1) & (F.size("initials") == 0) & ~F.col("generic")
    spoken = parsed.where(~lone)
    worded = spoken.select("name", "n", "initials", "core", F.size("core").alias("cores"), F.posexplode("core").alias("at", "word"))
    words = cut(worded.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    close = word_pairs(words)
    family = word_families(words, close)
    release(names.sparkSession)
    placed = worded.join(family, "word")
    beside = (
        worded.select("name", "word", F.substring("word", 1, 1).alias("letter"))
        .alias("x")
        .join(worded.select("name", F.col("word").alias("w2"), F.substring("word", 1, 1).alias("l2")).alias("y"), "name")
        .where("word <> w2")
        .groupBy("word")
        .agg(F.countDistinct("l2").alias("letters"))
    )
    score = cut(
        placed.join(beside, "word", "left")
        .groupBy("family")
        .agg(
            F.max(F.coalesce("letters", F.lit(0))).alias("letters"),
            (
                F.sum(
                    F.when(F.col("cores") == 1, F.lit(2.0)).when(F.col("at") == F.col("cores") - 1, F.lit(1.0)).otherwise(F.lit(-1.0))
                )
                / F.count(F.lit(1))
            ).alias("score"),
        )
        .withColumn("score", F.when(F.col("letters") >= HUB_LETTERS, F.col("score") - 3).otherwise(F.col("score")))
    )
    # a short word that is part of a given-name-like word is a nickname, whatever its own position says
    long = worded.select("word").distinct().join(family, "word").join(score.where("score < 0"), "family")
    parts = long.where("length(word) >= 6").select(
        F.explode(
            F.expr(
                "flatten(transform(sequence(3, 7), k -> transform(sequence(1, greatest(length(word) - k + 1, 1)), "
                "i -> substr(word, i, k))))"
            )
        ).alias("part"),
        F.col("word").alias("full"),
    )
    nick = (
        words.where("length(word) <= 7")
        .join(parts, (F.col("part") == F.col("word")) & (F.length("full") > F.length("word") + 1))
        .select("word", F.lit(-2.0).alias("nick"))
        .distinct()
    )
    placed = placed.join(score, "family").join(nick, "word", "left").withColumn(
        "score", F.when(F.length("word") <= SHORT, F.lit(-2.0)).otherwise(F.coalesce("nick", "score"))
    )
    ranked = placed.groupBy("name").agg(
        F.max(F.struct("score", F.length("family"), "family", "word")).alias("s"),
        F.min(F.struct("score", F.length("family"), "family", "word")).alias("g"),
        F.first("cores").alias("cores"),
        F.first("core").alias("core"),
        F.first("initials").alias("initials"),
        F.first("n").alias("n"),
    )
    strong = ranked.select(
        F.col("s.family").alias("family"),
        "name",
        F.when(F.col("cores") > 1, F.array_join(F.array_remove("core", F.col("s.word")), " "))
        .when(F.size("initials") > 0, F.element_at("initials", 1))
        .otherwise(F.lit(""))
        .alias("given"),
        "n",
    )
    # account names: the longest known family word in them; what precedes it is an initial or a given name
    known = family.join(score.select("family", "score"), "family").where("score > -2")
    read = (
        parsed.where(lone)
        .select("name", "n", F.element_at("core", 1).alias("only"))
        .select("name", "only")
        .mapInPandas(_splits, "name string, prefix string, word string, suffix string")
        .join(known, "word")
    )
    given_known = family.select(F.col("word").alias("prefix"), F.lit(True).alias("is_word"))
    read = (
        read.join(given_known, "prefix", "left")
        .where((F.length("prefix") <= 1) | F.col("is_word"))
        .groupBy("name")
        .agg(F.max_by(F.struct("family", "prefix"), F.struct(F.length("word"), -F.length("prefix"), "family")).alias("r"))
    )
    weak = parsed.where(lone).join(read, "name", "left").select(
        F.coalesce("r.family", F.element_at("core", 1)).alias("family"), "name", F.coalesce("r.prefix", F.lit("")).alias("given"), "n"
    )
    grouped = cut(strong.unionByName(weak))
    # nicknames that share no letters' order with the full form show by the family words both stand beside
    beside_family = grouped.where("length(given) > 1").select("family", "given").distinct()
    total = beside_family.groupBy("given").agg(F.count(F.lit(1)).alias("families"))
    full = beside_family.where("length(given) >= 6").select("family", F.col("given").alias("full"))
    nicknames = (
        beside_family.where(F.length("given") <= SHORT + 1)
        .join(full, "family")
        .where((F.length("full") > F.length("given") + 1) & ((F.substring("full", 1, 1) == F.substring("given", 1, 1)) | F.expr("contains(full, substr(given, 1, 3))")))
        .groupBy("given", "full")
        .agg(F.count(F.lit(1)).alias("shared"))
        .join(total, "given")
        .where("shared >= 2 and shared * 3 >= families")
        .groupBy("given")
        .agg(F.max_by("full", F.struct("shared", "full")).alias("full"))
    )
    grouped = grouped.join(nicknames, "given", "left").withColumn("given", F.coalesce("full", "given")).drop("full")
    grouped = cut(grouped.select("family", "given", "name", "n"))
    release(names.sparkSession)
    # only the different given parts of a family meet, not its names
    parts_of = cut(grouped.groupBy("family", "given").agg(F.sum("n").alias("n")))
    stars_of = placed_given(parts_of, close)
    found = cut(grouped.join(stars_of, ["family", "given"]).select("family", "name", "center", "likely"))
    open_ = found.where("center is null")
    settled = found.where("center is not null")
    if together is not None:
        votes = (
            together.join(open_.select("name", "family"), "name")
            .join(settled.select(F.col("name").alias("other"), F.col("family").alias("f2"), F.col("center").alias("c2")), "other")
            .where("family = f2")
            .groupBy("name", "c2")
            .agg(F.sum("n").alias("votes"))
            .groupBy("name")
            .agg(F.max_by("c2", F.struct("votes", "c2")).alias("voted"))
        )
        open_ = open_.join(votes, "name", "left").withColumn("center", F.coalesce("voted", "likely")).drop("voted")
    else:
        open_ = open_.withColumn("center", F.col("likely"))
    placed_names = settled.unionByName(open_).select(
        "name", F.concat_ws(" ", "family", F.coalesce("center", F.concat(F.lit("?"), F.col("name")))).alias("entity")
    )
    return placed_names.unionByName(bare)


def link_pairs(members: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(name_a, name_b), name_a < name_b, of every two names of one entity. An entity of more than ``bucket`` names is
    spread over several tasks."""
    held = members.groupBy("entity").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = members.join(held, "entity").withColumn("spread", F.ceil(F.col("held") / bucket).cast("int"))
    left = shared.select("entity", F.pmod(F.xxhash64("name"), F.col("spread")).cast("int").alias("salt"), F.col("name").alias("name_a"))
    right = shared.select("entity", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt"), F.col("name").alias("name_b"))
    return left.join(right, ["entity", "salt"]).where("name_a < name_b").select("name_a", "name_b")


def members(entities_: DataFrame) -> DataFrame:
    """(name, entity, links): every name with its class and the number of its links; names linked to nothing have 0."""
    held = entities_.groupBy("entity").agg((F.count(F.lit(1)) - 1).alias("links"))
    return entities_.join(held, "entity").select("name", "entity", "links")
