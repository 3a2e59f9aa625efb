"""Products across sources: similarity, windows against all pairs, assignment, edge cases."""

import random
from itertools import permutations

import pandas as pd
from hypothesis import given
from hypothesis import strategies as st

from pkgloom.llm import linkage as L
from pkgloom.llm import queries as Q


def test_words():
    assert L.product_words("GiklivuklaSession Scheduler™ (main)", "giklivukla celestrin") == "session scheduler"
    assert L.product_words("log_mon", "x") == "log monitor"
    assert L.product_words("libdushachospal OSS", "") == "dushachospal"
    assert L.product_words("acme", "acme") == "acme"
    assert L.product_words(None, "") == ""


def test_similarity():
    s = L.product_similarity
    assert s("disk server", "server disk") == 1.0
    assert s("diskserver", "disk server") == 0.97
    assert s("fadrutheflil server", "fadrtheflil server") == 0.9
    assert s("fadrutheflil server", "fadrutheflil viewer") == 0
    assert s("disk server", "disk") == 0 and s("a b c d e", "a b") == 0


def test_similarity_of_many_words():
    s = L.product_similarity
    assert s("a1 bb cc dd ee ff", "ff ee dd cc bb a1") == 1.0
    assert s("alpha beta gamma delta omega", "gammadelta omega alphabeta") == 0.97
    assert s("alpha beta gamma delta omega", "omega gammadleta alphabeta") == 0.87 == s("alpha beta gamma delta omega", "omega gamadlta alphabeta") + 0.87 == s("alpha beta gamma delta omega", "omega gammadlta alphabeta") == 0.87
    assert s("log4 server", "log5server") == 0 and s("x" * 40, "y" * 40) == 0


def test_publishers_are_weighed():
    form = lambda e, p: {"sorting": 0, "entity": e, "product": p}
    assert L.weighted(form("quellenbrok marta", "disk server"), form("quellenbrok marta", "server disk")) == 1.0
    assert 0.9 < L.weighted(form("quellenbrok marta", "disk server"), form("quelenbrok marta", "disk server")) < 1
    assert L.weighted(form("quellenbrok martha", "disk server"), form("quellenbrok martin", "disk server")) == 0
    assert L.weighted(form("quellenbrok marta", "disk server"), form("quellenbrok marta", "disk viewer")) == 0


def test_word_lists_are_parameters():
    assert L.product_words("log mon (main)", "x", {}, set()) == "log mon main"


def test_windows_find_what_all_pairs_find(spark):
    words = [f"{a}{b}" for a in ("zubra", "tomal", "grite", "plosa") for b in ("ndor", "kesh", "miru", "vlot", "pexi")]
    rows = [(f"s{w}{e}", e, w, 1) for e in ("e1", "e2") for w in words] + [(f"c{w}{e}", e, w[:-1] + "q", 1) for e in ("e1", "e2") for w in words]
    df = L.sort_keys(spark.createDataFrame(rows, "form string, entity string, product string, n bigint")).selectExpr("*", "0 as sorting")
    got = set()
    for key in ("by_words", "by_letters", "by_longest"):
        got |= {frozenset((r.form_a, r.form_b)) for r in L.sliding_pairs(df.select("form", "entity", "product", "sorting", key), ["entity", key], L.weighted).collect()}
    want = {frozenset((a[0], b[0])) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and L.product_similarity(a[2], b[2]) >= L.PRODUCT_LEAST}
    assert got == want


def test_windows_cross_partitions(spark):
    df = spark.range(2_000).selectExpr("concat('s', lpad(id, 5, '0')) form", "'e' entity", "cast(id as string) product", "lpad(id, 5, '0') k")
    near = lambda a, b: 1.0 if abs(int(a["product"]) - int(b["product"])) == 5 else 0.0
    got = {tuple(sorted((r.form_a, r.form_b))) for r in L.sliding_pairs(df, ["entity", "k"], near, width=10).collect()}
    assert got == {(f"s{k:05d}", f"s{k + 5:05d}") for k in range(1_995)}


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(1, 9)), min_size=1, max_size=8, unique_by=lambda e: e[:2]))
def test_assignment_is_best(edges):
    frame = pd.DataFrame([(f"c{a}", f"s{b}", float(w)) for a, b, w in edges], columns=["left", "right", "weight"])
    got = L._assign(frame)
    assert got["left"].is_unique and got["right"].is_unique
    weight = {(a, b): w for a, b, w in edges}
    best = max(sum(weight.get((a, p[a]), 0) for a in range(4)) for p in permutations(range(4)))
    assert got["weight"].sum() == best


@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(1, 9)), min_size=20, max_size=40, unique_by=lambda e: e[:2]))
def test_large_assignment_is_best(edges):
    got = L._assign(pd.DataFrame([(f"c{a}", f"s{b}", float(w)) for a, b, w in edges], columns=["left", "right", "weight"]))
    assert got["left"].is_unique and got["right"].is_unique
    best = {0: 0}
    for a in range(8):
        for used, total in list(best.items()):
            for x, b, w in edges:
                if x == a and not used >> b & 1:
                    best[used | 1 << b] = max(best.get(used | 1 << b, 0), total + w)
    assert abs(got["weight"].sum() - max(best.values())) < 1e-9


def test_seventh_product_changes_nothing():
    edges = [("a1", "b1", 0.97), ("a1", "b2", 0.9), ("a2", "b1", 0.9)] + [(f"a{k}", f"b{k}", 0.97) for k in range(3, 9)]
    assert len(L._assign(pd.DataFrame(edges, columns=["left", "right", "weight"]))) == 8


def tables(spark, tmp_path, info, cpe):
    schema = "id bigint, fp_software string, fp_publisher string, fp_version string, software string, software_alternative array<string>, publisher string, publisher_alternative array<string>, cpe_string string"
    spark.createDataFrame(info, schema).write.mode("overwrite").parquet(str(tmp_path / "software_info.parquet"))
    spark.createDataFrame(cpe, "id bigint, publisher string, product string, version string").write.mode("overwrite").parquet(str(tmp_path / "cpe_entities.parquet"))
    return {(r.cpe_id, r.software_id) for r in Q.p2_found(spark, str(tmp_path)).collect()}


def test_end_to_end(spark, tmp_path):
    info = [
        (1, None, None, None, "Zubrandor Server", [], "Marta Quellenbrok", ["Quellenbrok"], None), (2, None, None, None, "ZubrandorServer (main)", None, "Quellenbrok, Marta", None, ""),
        (3, None, None, None, "Log Server", [], "Marta Quellenbrok", [], None), (4, None, None, None, "Log Server", [], "Tilda Vorganski", [], None),
        (5, None, None, None, "Zubrandor Server", [], None, None, "cpe:2.3:a:quellenbrok:zubrandor_server:1"), (6, None, None, None, None, None, None, None, None), (7, None, None, None, "", [None], "", [""], ""),
        (8, None, None, None, "Zubrandor Viewer", [], "Marta Quellenbrok", [], "cpe:2.3:a:quellenbrok:zubrandor_server:1"),
    ]
    cpe = [(1, "quellenbrok", "zubrandor_srv", "1"), (2, "quellenbrok", "zubrandor_srv", None), (3, "marta_quellenbrok", "log-server", "2"), (4, "vorganski", "logserver", "*"), (5, None, "zubrandor_server", "1"), (6, "x", None, None)]
    assert tables(spark, tmp_path, info, cpe) == {(1, 1), (2, 1), (1, 2), (2, 2), (1, 5), (2, 5), (3, 3), (4, 4)}


def test_publisher_among_many(spark, tmp_path):
    """A name that sixty publishers use: the hint, or what the record calls it, tells the one that is meant."""
    rnd = random.Random(4)
    makers = ["".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(6)) for _ in range(60)]
    cpe = [(k, m, "log_server", "1") for k, m in enumerate(makers)]
    info = [(1, None, None, None, "Log Server", [], None, None, f"cpe:2.3:a:{makers[40]}:log_server:1"), (2, None, None, None, f"{makers[50]} Log Server", [], "", [], None), (3, None, None, None, "Log Server", [], None, None, None)]
    info += [(10 + k, None, None, None, "Log Server", [], m.title(), [], None) for k, m in enumerate(makers)]
    got = tables(spark, tmp_path, info, cpe)
    assert got == {(40, 1), (50, 2)} | {(k, 10 + k) for k in range(60)}
    rows = {(r.side, r.id): r.links for r in Q.p2_products(spark, str(tmp_path)).collect()}
    assert rows["cpe", 40] == 2 and rows["software", 1] == 1 and ("software", 3) not in rows


def test_empty(spark, tmp_path):
    assert tables(spark, tmp_path, [], []) == set()


def test_components(spark):
    chain = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(40)] + [("s1", "s2"), ("x", "y"), ("y", "z"), ("z", "x")]
    got = {r.form: r.part for r in L.components(spark.createDataFrame(chain, "form_a string, form_b string")).collect()}
    assert got == {f"c{k:03d}": "c000" for k in range(41)} | {"s1": "s1", "s2": "s1", "x": "x", "y": "x", "z": "x"}
    assert L.components(spark.createDataFrame([], "form_a string, form_b string")).count() == 0


def one_edit(rnd, w):
    k = rnd.randrange(len(w) - 1)
    x = rnd.choice("abcdefghijklmnop")
    return rnd.choice([w[:k] + x + w[k:], w[:k] + w[k + 1 :], w[:k] + x + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :]])


def test_nothing_is_out_of_reach(spark):
    rnd = random.Random(8)
    row = lambda side, e, p: (f"{side}{e}\u0001{p}", e, p, 1)
    pairs = []
    for _ in range(800):
        w = "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(7, 12)))
        pairs.append((row("c", "big", f"{w} server"), row("s", "big", f"{one_edit(rnd, w)} server")))
    named = [row("c", f"p{k:02d}", "print filter") for k in range(70)]
    alone = row("s", "", "filter print")
    rows = {r for pair in pairs for r in pair} | {*named, alone}
    products, loose = L.match_products(spark.createDataFrame(sorted(rows), "form string, entity string, product string, n bigint"))
    assert {(r.form_a, r.form_b) for r in loose.collect() if alone[0] in (r.form_a, r.form_b)} >= {(alone[0], n[0]) for n in named}
    got = {r.form: r.product_id for r in products.where("weight > 0").collect()}
    assert [(a[2], b[2]) for a, b in pairs if got.get(a[0], 0) != got.get(b[0], 1)] == []
