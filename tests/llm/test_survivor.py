"""Surviving records against brute force."""

import random
from datetime import datetime, timedelta

from pkgloom.llm import survivor

SCHEMA = "id bigint, g string, home string, text string, lic array<string>, at timestamp, key string, value string"


def brute(rows):
    groups, out = {}, {}
    for r in rows:
        if r[1] is not None and r[0] is not None:
            groups.setdefault(" ".join("".join(c if c.isalnum() else " " for c in r[1].lower()).split()), []).append(r)
    bad = lambda s: not s.strip() or s.strip().lower() in survivor.STAND_INS
    old = datetime(1, 1, 1)
    for g in groups.values():
        if len(g) < 2:
            continue
        first = min(r[0] for r in g)
        for name, k in (("home", 2), ("text", 3), ("lic", 4)):
            held = {}
            for r in g:
                if r[k] is not None:
                    v = tuple(r[k]) if k == 4 else r[k]
                    at, i = held.get(v, (old, 9e9))
                    held[v] = max(at, r[5] or old), min(i, r[0])
            def usable(v):
                if k == 4:
                    if all(x is None or bad(x) for x in v):
                        return False
                    return not any(w != v and (w[: len(v)] == v or {x for x in v if x} < {x for x in w if x}) for w in held)
                return not bad(v) and not any(w != v and w.startswith(v) for w in held)
            left = [v for v in held if usable(v)]
            if left:
                size = lambda v: len(v) if k != 4 else sum(len(x or "?") + 1 for x in v)
                out[first, name] = held[min(left, key=lambda v: (old - held[v][0], -size(v), held[v][1]))][1]
    return out


def make(n, seed):
    rnd, start = random.Random(seed), datetime(2020, 1, 1)
    homes = [None, "", " ", "N/A", "http://", "https://x.example", "https://x.ex", "https://y.example/a", "https://y.example/ab"]
    texts = [None, "-", "TODO", "A thing", "A thing that works", "Other thing", "B"]
    lics = [None, [], ["-"], ["A"], ["A", "B"], ["B", "A", "C"], ["D"], ["", None], ["A", "A"]]
    rows = []
    for i in range(n):
        g = rnd.choice(["One Two", "one-two", "ONE_TWO", "b", "c", "d", None, "", f"s{i}"])
        at = None if rnd.random() < 0.1 else start + timedelta(days=rnd.randrange(30))
        rows.append((i, g, rnd.choice(homes), rnd.choice(texts), rnd.choice(lics), at, "k", "v"))
    return rows


def test_equals_brute_force(spark):
    for seed in range(4):
        rows = make(60, seed)
        df = spark.createDataFrame(rows, SCHEMA)
        got = [tuple(r) for r in survivor.best_values(df, "g", ["home", "text"], ["lic"], "at").collect()]
        assert len(got) == len({r[:2] for r in got})
        assert {(a, b): c for a, b, c in got} == brute(rows)


def test_beginnings_across_partitions(spark):
    values = [("k", "f", "a" * n, n) for n in range(1, 200)] + [("k", "f", "b", 1), ("k", "g", "a", 1), ("l", "f", "a", 1)]
    df = spark.createDataFrame(values, "key string, field_name string, value string, n int")
    got = {tuple(r)[:3] for r in survivor.drop_beginnings(df).collect()}
    assert got == {("k", "f", "a" * 199), ("k", "f", "b"), ("k", "g", "a"), ("l", "f", "a")}


def test_edges(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert survivor.best_values(df, "g", ["home"], ["lic"], "at").count() == 0
    rows = [(1, "p", "x" * 100_000, None, None, None, "", ""), (2, "P ", None, None, None, None, "", ""), (None, "p", "z", None, None, None, "", "")]
    got = survivor.surviving_records(spark.createDataFrame(rows, SCHEMA), "g", ["home", "text"], ["lic"], "at").collect()
    assert [(r.first_id, len(r.home), r.text, r.lic) for r in got] == [(1, 100_000, None, None)]
