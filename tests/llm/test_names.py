"""Spelling variants of names: parsing, recall of the banding, planted entities."""

import random

from pkgloom.llm import names as N


def test_parse():
    assert N.parse("the foo bar linux foundation") == (["foo", "bar"], [], True)
    assert N.parse("foo bar group lists bar example") == (["foo", "bar"], [], True)
    assert N.parse("j bar") == (["bar"], ["j"], False)
    assert N.parse("7 16 8") == ([], [], False)
    assert N.parse("linux project") == ([], [], True)
    assert N.parse("") == ([], [], False)


def test_distance():
    assert N.distance("abcd", "abdc", 3) == 1
    assert N.distance("kitten", "sitting", 5) == 3
    assert N.distance("a", "abcdef", 2) == 3


def test_collision_curve():
    b = N.bands_for(0.4, 0.995, 3)
    assert 1 - (1 - 0.4**3) ** b >= 0.995 > 1 - (1 - 0.4**3) ** (b - 1)


def word(rnd):
    return "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(rnd.randint(4, 6)))


def typo(rnd, w):
    k = rnd.randrange(1, len(w) - 1)
    return rnd.choice([w[:k] + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :] if k + 2 <= len(w) else w, w[:k] + rnd.choice("bdgk") + w[k + 1 :]])


def test_word_families_find_typos(spark):
    rnd = random.Random(3)
    base = [word(rnd) for _ in range(150)]
    variants = {t: w for w in base for t in [typo(rnd, w)] if t not in base}
    rows = [(w, 10) for w in set(base)] + [(t, 1) for t in variants]
    family = {r.word: r.family for r in N.word_families(spark.createDataFrame(rows, "word string, n bigint")).collect()}
    found = sum(family[t] == family[w] for t, w in variants.items())
    brute = sum(N.close_words(t, w) for t, w in variants.items())
    assert found >= 0.97 * brute and len(set(family.values())) >= 0.95 * len(set(base))


def test_entities(spark):
    rnd = random.Random(5)
    people = [(word(rnd), word(rnd)) for _ in range(25)]
    rows, truth = [], {}
    for g, s in people:
        for n, k in ((f"{g} {s}", 20), (f"{g} {s} software foundation", 8), (f"{s} {g} software foundation", 2), (f"{g[0]} {s}", 3), (f"{s} foundation", 3), (f"{typo(rnd, g)} {s}", 1), (f"{s}soft", 2)):
            truth[n] = (g, s)
            rows.append((n, k, "x"))
    rows += [("1 2 3", 5, "x"), ("", 4, "x"), (None, 3, "x"), ("software foundation", 2, "x")]
    df = spark.createDataFrame(rows, "name string, n bigint, family string")
    pairs = {(r.name_a, r.name_b) for r in N.link_pairs(N.entities(df)).collect()}
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    assert len(pairs & want) >= 0.95 * len(want) and len(pairs - want) <= 0.03 * len(want)
    assert N.link_pairs(N.entities(df.where("false"))).count() == 0


def test_records_settle_ambiguous_names(spark):
    rows = [("anna zumberlin", 9), ("berta zumberlin", 5), ("zumberlin", 3), ("zumberlinhq", 1)]
    together = spark.createDataFrame([("zumberlin", "berta zumberlin", 2)], "name string, other string, n bigint")
    got = {r.name: r.entity for r in N.entities(spark.createDataFrame(rows, "name string, n bigint"), together).collect()}
    assert got["zumberlin"] == got["berta zumberlin"] != got["anna zumberlin"] == got["zumberlinhq"]


def links(spark, names):
    df = spark.createDataFrame([(n, k) for n, k in names], "name string, n bigint").repartition(4)
    return {(r.name_a, r.name_b) for r in N.link_pairs(N.entities(df)).collect()}


def test_names_of_generic_words_only(spark):
    assert links(spark, [("linux foundation", 1), ("the linux foundation", 1)]) == {("linux foundation", "the linux foundation")}
    got = links(spark, [("linux foundation", 3), ("linux fndn", 1), ("linux project", 2), ("open source collective", 2), ("opensource collective", 1), ("1 2 rc1", 4), ("the", 2)])
    assert got == {("linux fndn", "linux foundation"), ("open source collective", "opensource collective")}


def test_names_that_begin_with_digits(spark):
    assert links(spark, [("3com corp", 2), ("3com corporation", 2), ("4com corp", 2), ("7 16 alpha1", 2)]) == {("3com corp", "3com corporation")}


def test_banding_recall_at_every_length():
    rnd = random.Random(11)
    a, b = N._hashes()
    for n in range(4, 17):
        met = tried = 0
        while tried < 250:
            w = "".join(rnd.choice("abcdefghijklmnoprstuvwy") for _ in range(n))
            t = w
            for _ in range(N.edits(n)):
                k = rnd.randrange(len(t) - 1)
                t = rnd.choice([t[:k] + t[k + 1 :], t[:k] + rnd.choice("xzq") + t[k:], t[:k] + rnd.choice("xzq") + t[k + 1 :], t[:k] + t[k + 1] + t[k] + t[k + 2 :]])
            if t != w and N.close_words(w, t):
                x, y = N.bands_of(w, a, b), N.bands_of(t, a, b)
                tried += 1
                met += bool(set(x.tolist()) & set(y.tolist()))
        assert met >= 0.95 * tried, (n, met, tried)


def test_stars_of_a_chain(spark):
    rows = [(f"w{k}", f"w{k - 1}", 4 ** (9 - k), 4 ** (10 - k)) for k in range(1, 9)]
    got = {r.node: r.center for r in N.stars(spark.createDataFrame(rows, "node string, ahead string, n bigint, m bigint")).collect()}
    assert got == {"w1": "w0", "w3": "w2", "w5": "w4", "w7": "w6"}  # every satellite stands beside its centre


def test_different_given_names_stay_apart(spark):
    names = [(f"{g} {s}", 3) for g in ("martha", "martin") for s in ("kelbronsky", "zumberlin")]
    assert links(spark, names) == set()


def test_given_parts_of_several_words(spark):
    names = [("jean luc zumberlin", 5), ("jean zumberlin", 2), ("jaen luc zumberlin", 1), ("marie luise zumberlin", 4)]
    assert links(spark, names) == {("jaen luc zumberlin", "jean luc zumberlin"), ("jaen luc zumberlin", "jean zumberlin"), ("jean luc zumberlin", "jean zumberlin")}


def test_large_buckets_are_spread(spark):
    rows = [(f"n{k:03d}", k % 7, 1) for k in range(60)] + [("other", 1, 2)]
    df = spark.createDataFrame(rows, "node string, n bigint, key bigint")
    whole, spread = ({tuple(r) for r in N.meetings(df, size).collect()} for size in (1000, 8))
    assert whole == spread and len(whole) == 60 * 59 // 2
    same = spark.createDataFrame([(f"m{k}", "x") for k in range(30)], "name string, entity string")
    assert N.link_pairs(same, 4).count() == 30 * 29 // 2
    assert {r.links for r in N.members(same).collect()} == {29}
