"""Match the records of two sources that share no key, by several noisy attributes.

Both sources are reduced to distinct forms (publisher entity, product words). The forms of both are sorted by several
composite keys, all in one pass; in each order a window slides over them and compares every two forms in it by the weighted
similarities of publisher and product. Orders that begin with the publisher hold forms; orders that begin with the product
hold distinct products, so that a name shared by any number of publishers takes one place of a window. Beside the windows,
forms whose letters are the same but for one edit are joined exactly, however many forms lie between them. A record without
publisher gets the one that its hint, its own words or its product tell, and is then matched like the others. Similar forms
of one source become one product (star clustering); between the products of the two sources a one-to-one assignment
with the greatest total confidence is kept, and expanded to the records.

Stars are joins over pairs of forms; the assignment of one task holds the edges between the products of one connected
component, never forms or records.

Defined results: a record without a product name matches nothing; one without any publisher is matched only where its
product, its hint or its alternative names single out one publisher; ties are settled by spelling.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgloom.engine import cut, join_skewed
from pkgloom.llm.names import close_words, distance, monge_elkan, plain, stars

#: Forms that the window spans in each order.
WIDTH = 24
#: Weights of the attributes in the confidence; the product must reach PRODUCT_LEAST by itself.
PUBLISHER_WEIGHT, PRODUCT_WEIGHT, HINT_WEIGHT = 0.4, 0.5, 0.1
PRODUCT_LEAST = 0.85
#: Similarity that the names of two publishers of different entities must reach in the window.
PUBLISHER_LEAST = 0.95
#: A word that at most so many publishers use singles out a product.
RARE_OWNERS = 3
#: The prefix lib is no part of the name in words of so many letters.
LIB_LEAST = 9

# Abbreviations of product words, and words that add nothing to a product's name; defaults of parameters.
SHORT_FORMS = {
    "cc": "compiler", "mon": "monitor", "cli": "client", "srv": "server", "sched": "scheduler", "mgr": "manager",
    "conv": "converter", "arc": "archive", "img": "image", "tk": "toolkit", "net": "network", "sess": "session",
    "ed": "editor", "gw": "gateway", "idx": "indexer", "prx": "proxy", "pkt": "packet", "vid": "video", "aud": "audio",
    "txt": "text", "fnt": "font", "bkp": "backup", "flt": "filter", "bld": "builder", "eng": "engine", "prs": "parser",
    "plr": "player", "vwr": "viewer", "brw": "browser", "svr": "server", "clt": "client",
}
EMPTY_WORDS = {"main", "oss", "software", "the", "tm", "r", "inc", "project", "app", "legacy"}
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def product_words(text: str | None, entity: str, short_forms: dict[str, str] = SHORT_FORMS, empty_words: set[str] = EMPTY_WORDS) -> str:
    """The words of a product in one canonical form: short forms expanded, empty words and the publisher's own words
    (typing errors included) left out, unless nothing would remain."""
    text = CAMEL.sub(" ", plain(text or "").replace("™", " "))
    words = [short_forms.get(w, w) for w in re.findall(r"[^\W_]+", text.lower())]
    words = [w for w in words if w not in empty_words] or words
    words = [w[3:] if w.startswith("lib") and len(w) >= LIB_LEAST else w for w in words]
    mine = [w for w in entity.split() if len(w) > 3]
    rest = [w for w in words if not any(close_words(w, m) for m in mine)]
    return " ".join(rest or words)


def spells(words: tuple[str, ...], text: str, edits: int) -> bool:
    """Whether the words, each once and in some order, make up the text but for so many edits, all in one word."""
    if not words:
        return not text
    for w in dict.fromkeys(words):
        left = list(words)
        left.remove(w)
        if text.startswith(w) and spells(tuple(left), text[len(w) :], edits):
            return True
        if edits and any(distance(w, text[:n], edits) <= edits and spells(tuple(left), text[n:], 0) for n in range(max(0, len(w) - edits), len(w) + edits + 1) if n <= len(text)):
            return True
    return False


@functools.lru_cache(maxsize=100_000)
def shape(product: str) -> tuple[int, int]:
    """The number of characters but blanks, and which they are, as bits (of their code point modulo 61)."""
    letters = product.replace(" ", "")
    mask = 0
    for c in set(letters):
        mask |= 1 << ord(c) % 61
    return len(letters), mask


def product_similarity(a: str, b: str) -> float:
    """1 for the same words in any order, less for joined words and typing errors, 0 for different products."""
    (many, mine), (more, others) = shape(a), shape(b)
    # two edits change the length by two at most, and bring in or take away two characters each
    if not -2 <= many - more <= 2 or (mine & ~others).bit_count() > 2 or (others & ~mine).bit_count() > 2:
        return 0.0
    x, y = a.split(), b.split()
    if sorted(x) == sorted(y):
        return 1.0
    if len(x) == len(y):
        left, right = sorted(set(x) - set(y)), sorted(set(y) - set(x))
        if len(left) == len(right) == 1 and min(len(left[0]), len(right[0])) >= 5 and close_words(left[0], right[0]):
            return 0.9
    one, other = "".join(x), "".join(y)
    if abs(len(one) - len(other)) > 1:
        return 0.0
    if sorted(one) == sorted(other) and (spells(tuple(x), other, 0) or spells(tuple(y), one, 0)):
        return 0.97
    if len(x) != len(y) and min(len(one), len(other)) >= 8 and [c for c in one if c.isdigit()] == [c for c in other if c.isdigit()]:
        shared = Counter(one) & Counter(other)
        if shared.total() >= max(len(one), len(other)) - 1 and (spells(tuple(x), other, 1) or spells(tuple(y), one, 1)):
            return 0.87
    return 0.0


def sliding_pairs(rows: DataFrame, order: list[str], compare: Callable[[dict, dict], float], width: int = WIDTH, total: int | None = None, carry: list[str] = ()) -> DataFrame:
    """(form_a, form_b, similarity > 0) of forms that lie within ``width`` rows of each other in the given order.

    Rows are range-sorted; each partition also gets the first rows of the next one, so windows run across borders.
    ``total`` is the number of rows where the caller knows it; the columns of ``carry`` are those of the second form."""
    columns = rows.columns
    total = rows.count() if total is None else total
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(n, total // (width * 20)))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            yield batch.assign(part=part, at=range(at, at + len(batch)))
            at += len(batch)

    def slide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: deque = deque(maxlen=width - 1)
        part = None
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if row["part"] != part:
                    last.clear()
                    part = row["part"]
                for other in last:
                    if (other["halo"] and row["halo"]) or other["form"] == row["form"]:
                        continue
                    s = compare(other, row)
                    if s > 0:
                        out.append((other["form"], row["form"], s, *[row[c] for c in carry]))
                last.append(row)
            yield pd.DataFrame(out, columns=["form_a", "form_b", "similarity", *carry])

    kinds = dict(rows.dtypes)
    result = ", ".join(["form_a string", "form_b string", "similarity double", *[f"`{c}` {kinds[c]}" for c in carry]])
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", part int, at bigint"
    while True:
        ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
        numbered = cut(ranged.mapInPandas(number, schema))
        sizes = {r.part: r["count"] for r in numbered.groupBy("part").count().collect()} if n > 1 else {0: total}
        if n == 1 or min(sizes.values(), default=width) >= width:
            break
        n //= 2
    parts = sorted(sizes)
    before = {p: q for q, p in zip(parts, parts[1:], strict=False)}
    body = numbered.withColumn("halo", F.lit(False))
    if before:
        previous = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        halo = (
            numbered.where((F.col("at") < width - 1) & F.col("part").isin(list(before)))
            .withColumn("part", previous[F.col("part")])
            .withColumn("halo", F.lit(True))
        )
        body = body.unionByName(halo.select(body.columns))
    return (
        body.select(*columns, "part", "at", "halo")
        .repartition(max(1, len(parts)), "part")
        .sortWithinPartitions("part", "halo", "at")
        .mapInPandas(slide, result)
    )


def publisher_similarity(a: str, b: str) -> float:
    """1 for one entity, the Monge-Elkan similarity of the worse direction for the names of two."""
    if a == b:
        return 1.0
    x, y = a.split(), b.split()
    if x[0] != y[0] and not close_words(x[0], y[0]):
        return 0.0
    return min(monge_elkan(x, y), monge_elkan(y, x))


def weighted(a: dict, b: dict) -> float:
    """The weighted similarity of two entries of one order, 0 where publisher or product fall short. Entries of the orders
    that begin with the product have no publisher and are compared by the product alone."""
    if a["sorting"] != b["sorting"]:
        return 0.0
    product = product_similarity(a["product"], b["product"])
    if product < PRODUCT_LEAST:
        return 0.0
    publisher = publisher_similarity(a["entity"], b["entity"])
    if publisher < PUBLISHER_LEAST:
        return 0.0
    return (PUBLISHER_WEIGHT * publisher + PRODUCT_WEIGHT * product) / (PUBLISHER_WEIGHT + PRODUCT_WEIGHT) if publisher < 1 else product


def sort_keys(forms: DataFrame) -> DataFrame:
    """The composite sort keys: words in alphabetical order, letters joined, longest word first and from its end."""
    words = F.split("product", " ")
    return (
        forms.withColumn("by_words", F.array_join(F.array_sort(words), " "))
        .withColumn("by_letters", F.array_join(F.array_sort(F.split(F.regexp_replace("product", " ", ""), "")), ""))
        .withColumn("by_longest", F.array_join(F.transform(F.reverse(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), F.reverse(w).alias("w"))))), lambda x: x["w"]), " "))
    )


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Similarities of candidate pairs of one publisher, or the first without any, from what their forms hold."""
    for batch in batches:
        out = []
        for a, b in batch.itertuples(index=False):
            (owner, x), (other, y) = a[1:].split("\u0001"), b[1:].split("\u0001")
            s = product_similarity(x, y) if owner in ("", other) else 0.0
            if s >= PRODUCT_LEAST:
                out.append((a, b, s))
        yield pd.DataFrame(out, columns=["form_a", "form_b", "similarity"])


def edit_pairs(forms: DataFrame, loose: bool) -> DataFrame:
    """(form_a, form_b, similarity >= PRODUCT_LEAST) of all forms of one publisher, or with ``loose`` of all forms without
    one and those with one, whose joined letters are the same in some order but for at most one letter on either side.

    Each form stands under the sum of its letters' hashes and under the sums without one letter; a pair has
    exactly one of them in common, or is taken where nothing is left out."""
    letters = F.filter(F.split(F.regexp_replace("product", " ", ""), ""), lambda x: x != "")
    weights = F.transform(letters, lambda x: F.shiftright(F.xxhash64(x), 20))  # sums stay within 64 bits
    total = F.aggregate(weights, F.lit(0).cast("bigint"), lambda s, x: s + x)
    summed = forms.select("form", "entity", weights.alias("weights"), total.alias("total"))
    keys = F.concat(F.array("total"), F.transform(F.array_distinct("weights"), lambda x: F.col("total") - x))
    rows = summed.select("form", "entity", "total", F.explode(keys).alias("key"))

    def side(df: DataFrame, end: str) -> DataFrame:
        own = F.lit("") if loose else F.col("entity")
        return df.select(F.xxhash64(own, "key").alias("at"), F.col("form").alias(f"form_{end}"), F.col("total").alias(f"total_{end}"), (F.col("key") == F.col("total")).alias(f"whole_{end}"))

    left, right = (side(rows.where("entity = ''" if loose else "entity <> ''"), "a"), side(rows.where("entity <> ''"), "b"))
    once = (F.col("total_a") != F.col("total_b")) | (F.col("whole_a") & F.col("whole_b"))
    if not loose:
        once &= F.col("form_a") < F.col("form_b")
    met = left.join(right, "at").where(once).select("form_a", "form_b")
    return met.mapInPandas(_verified, "form_a string, form_b string, similarity double")


def _augmented(edges: list[tuple[float, str, str]]) -> list[tuple[float, str, str]]:
    """The one-to-one subset of least total of (-weight, left, right): every left takes in turn the shortest augmenting path
    over the sparse edges, to a free right or to a place of its own that stands for no partner."""
    top = max(-w for w, _, _ in edges)
    cost: dict[str, dict[tuple, float]] = {}
    for w, a, b in edges:
        cost.setdefault(a, {(1, a): top})[0, b] = top + w
    left: dict[str, float] = {}
    right: dict[tuple, float] = {}
    owner: dict[tuple, str] = {}
    mate: dict[str, tuple] = {}
    for a in sorted(cost):
        left[a] = min(c - right.get(b, 0.0) for b, c in cost[a].items())
        heap = [(c - left[a] - right.get(b, 0.0), b, a) for b, c in cost[a].items()]
        heapify(heap)
        done: dict[tuple, tuple[float, str]] = {}
        while True:
            far, b, via = heappop(heap)
            if b in done:
                continue
            done[b] = far, via
            if b not in owner:
                break
            u = owner[b]
            for c, w in cost[u].items():
                if c not in done:
                    heappush(heap, (far + w - left[u] - right.get(c, 0.0), c, u))
        left[a] += far
        for c, (d, _) in done.items():
            if c in owner:
                right[c] = right.get(c, 0.0) - (far - d)
                left[owner[c]] += far - d
        while True:
            via = done[b][1]
            before = mate.get(via)
            mate[via], owner[b] = b, via
            if via == a:
                break
            b = before
    return [(cost[a][b] - top, a, b[1]) for a, b in sorted(mate.items()) if b[0] == 0]


def _assign(group: pd.DataFrame) -> pd.DataFrame:
    """One component of edges (left, right, weight): the one-to-one subset of greatest total weight."""
    edges = sorted(zip(-group["weight"], group["left"], group["right"], strict=True))
    lefts, rights = sorted(set(group["left"])), sorted(set(group["right"]))
    if len(lefts) == 1 or len(rights) == 1:
        chosen = edges[:1]
    elif max(len(lefts), len(rights)) <= 6:
        weight = {(a, b): -w for w, a, b in edges}
        best, chosen = -1.0, []
        small, large, turned = (lefts, rights, False) if len(lefts) <= len(rights) else (rights, lefts, True)
        for p in permutations(large, len(small)):
            pairs = [(y, x) if turned else (x, y) for x, y in zip(small, p, strict=True)]
            pairs = [q for q in pairs if q in weight]
            total = sum(weight[q] for q in pairs)
            if total > best + 1e-12:
                best, chosen = total, [(-weight[q], *q) for q in pairs]
    else:
        chosen = _augmented(edges)
    return pd.DataFrame([(a, b, -w) for w, a, b in chosen], columns=["left", "right", "weight"])


def components(pairs: DataFrame) -> DataFrame:
    """(form, part): connected components of the pairs (form_a, form_b), named by their smallest form. Labels run along
    the pairs and jump to the label of the label until none changes, so no publisher's forms meet in one task."""
    both = pairs.select(F.col("form_a").alias("form"), F.col("form_b").alias("other")).unionByName(
        pairs.select(F.col("form_b").alias("form"), F.col("form_a").alias("other"))
    )
    label = cut(both.groupBy("form").agg(F.min("other").alias("least")).select("form", F.least("form", "least").alias("part")))
    while True:
        beside = both.join(label.select(F.col("form").alias("other"), F.col("part").alias("p")), "other").groupBy("form").agg(F.min("p").alias("p"))
        above = label.select(F.col("form").alias("part"), F.col("part").alias("q"))
        new = cut(
            label.join(beside, "form").join(above, "part", "left").select("form", F.least("part", "p", "q").alias("part"), (F.least("p", "q") < F.col("part")).alias("moved"))
        )
        label = new.select("form", "part")
        if new.where("moved").limit(1).count() == 0:
            return label


def candidates(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``forms`` (form, entity, product, n), distinct, form being its side's letter c or s, the entity, \\u0001, the product.

    Returns the similar pairs (form_a, form_b, similarity) of forms with publishers, and the same of those without one
    (form_a) with those that have one. All orders are sorted and compared in one pass."""
    keyed = cut(sort_keys(forms.select("form", "entity", "product")))
    keys = ("by_words", "by_letters", "by_longest")
    owned = keyed.where("entity <> ''").select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("sorting"), "entity", F.col(key).alias("sort")) for k, key in enumerate(keys)])).alias("o"), "form", "product"
    ).select("o.sorting", F.col("o.entity").alias("lead"), "o.sort", "form", F.col("o.entity").alias("entity"), "product")
    named = keyed.groupBy("product").agg(*[F.first(k).alias(k) for k in keys])
    bare = named.select(
        F.explode(F.array(*[F.struct(F.lit(k + len(keys)).alias("sorting"), F.col(key).alias("sort")) for k, key in enumerate(keys)])).alias("o"), "product"
    ).select("o.sorting", F.col("o.sort").alias("lead"), F.lit("").alias("sort"), F.col("product").alias("form"), F.lit("").alias("entity"), "product")
    found = cut(sliding_pairs(cut(owned.unionByName(bare)), ["sorting", "lead", "sort"], weighted, carry=["sorting"]))
    strict = found.where(F.col("sorting") < len(keys)).drop("sorting").unionByName(edit_pairs(keyed, loose=False))
    strict = strict.groupBy("form_a", "form_b").agg(F.max("similarity").alias("similarity"))
    # products that are alike, each also with itself, are those of forms without publisher and of others
    alike = found.where(F.col("sorting") >= len(keys)).select(F.col("form_a").alias("p"), F.col("form_b").alias("q"), "similarity")
    alike = alike.unionByName(alike.select(F.col("q").alias("p"), F.col("p").alias("q"), "similarity")).unionByName(named.select(F.col("product").alias("p"), F.col("product").alias("q"), F.lit(1.0).alias("similarity")))
    lacking = keyed.where("entity = ''").select(F.col("product").alias("p"), F.col("form").alias("form_a"))
    others = keyed.where("entity <> ''").select(F.col("product"), F.col("form").alias("form_b"))
    sizes = others.groupBy("product").agg(F.count(F.lit(1)).alias("held"))
    partners = alike.join(lacking, "p").groupBy(F.col("q").alias("product")).agg(F.collect_set(F.struct("form_a", "similarity")).alias("near")).join(sizes, "product")
    met = join_skewed(others, cut(partners), ["product"], "held").select(F.explode("near").alias("x"), "form_b").select("x.form_a", "form_b", "x.similarity")
    loose = met.unionByName(edit_pairs(keyed, loose=True)).groupBy("form_a", "form_b").agg(F.max("similarity").alias("similarity"))
    return cut(strict), cut(loose)


def products_of(forms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(form, product_id, weight) of all ``forms`` (form, n), given their similar ``pairs`` (form_a, form_b, similarity): stars of
    similar forms on either side, then the one-to-one assignment between them. Forms of both sides with equal product_id
    and a positive weight are one product."""
    counts = forms.select("form", F.col("n").cast("bigint").alias("n"))
    same = F.substring("form_a", 1, 1) == F.substring("form_b", 1, 1)
    sided = pairs.where(same).join(counts.select(F.col("form").alias("form_a"), "n"), "form_a").join(counts.select(F.col("form").alias("form_b"), F.col("n").alias("m")), "form_b")
    star = stars(cut(sided.select(F.col("form_a").alias("node"), F.col("form_b").alias("ahead"), "n", "m", F.col("similarity").alias("s"))))
    center = cut(counts.join(star.withColumnRenamed("node", "form"), "form", "left").select("form", F.coalesce("center", "form").alias("center")))
    crossed = pairs.where(~same).select(
        F.when(F.startswith("form_a", F.lit("c")), F.col("form_a")).otherwise(F.col("form_b")).alias("c"), F.when(F.startswith("form_a", F.lit("c")), F.col("form_b")).otherwise(F.col("form_a")).alias("s"), "similarity"
    )
    edges = (
        crossed.join(center.select(F.col("form").alias("c"), F.col("center").alias("left")), "c").join(center.select(F.col("form").alias("s"), F.col("center").alias("right")), "s")
        .groupBy("left", "right").agg(F.max("similarity").alias("weight"))
    )
    lefts, rights = edges.groupBy("left").agg(F.count(F.lit(1)).alias("nl")), edges.groupBy("right").agg(F.count(F.lit(1)).alias("nr"))
    edges = cut(edges.join(lefts, "left").join(rights, "right"))
    alone = edges.where("nl = 1 and nr = 1").select("left", "right", "weight")
    tangled = edges.where("nl > 1 or nr > 1").select("left", "right", "weight")
    part = components(tangled.select(F.col("left").alias("form_a"), F.col("right").alias("form_b"))).withColumnRenamed("form", "left")
    tasks = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = tangled.join(part, "left").repartition(tasks, "part").groupBy("part").applyInPandas(_assign, "left string, right string, weight double")
    matched = cut(alone.unionByName(chosen))
    product = matched.select(F.col("left").alias("center"), F.col("left").alias("product_id"), "weight").unionByName(matched.select(F.col("right").alias("center"), F.col("left").alias("product_id"), "weight"))
    return cut(center.join(product, "center", "left").select("form", F.coalesce("product_id", "center").alias("product_id"), F.coalesce("weight", F.lit(0.0)).alias("weight")))


def match_products(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``forms`` (form, entity, product, n): the products of those with a publisher, and the similar pairs of the others with them."""
    pairs, loose = candidates(forms)
    return products_of(forms.where("entity <> ''"), pairs), loose
