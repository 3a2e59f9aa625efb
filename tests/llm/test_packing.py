"""Packing: validity, quality and edge cases."""

from hypothesis import given
from hypothesis import strategies as st

from pkgloom.llm import packing as P
from pkgloom.llm import queries as Q


@given(st.lists(st.integers(0, 50), max_size=60))
def test_best_fit(sizes):
    bins = P.best_fit(sizes, 50)
    assert sorted(k for b in bins for k in b) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in b) <= 50 for b in bins)
    assert sum(1 for b in bins if 2 * sum(sizes[k] for k in b) <= 50) <= 1 or not any(sizes)


def check(rows, sizes, capacity):
    used, spans, places = {}, {}, {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.tokens
        spans.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
        places.setdefault(r.container, []).append(r.place)
    assert all(v <= capacity for v in used.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    for doc, size in sizes.items():
        got = sorted(spans[doc])
        assert sum(n for _, n in got) == size and len(got) == max(1, -(-size // capacity))
        at = 0
        for start, n in got:
            assert start == at
            at += n


def test_pack(spark):
    sizes = {k: (k * 37) % 301 for k in range(900)} | {1000: 2_048, 1001: 256, 1002: 257, 1003: 0}
    df = spark.createDataFrame([(k, v, "x") for k, v in sizes.items()], "doc_id bigint, tokens bigint, container string").repartition(6)
    rows = P.pack(df, 256).collect()
    check(rows, sizes, 256)
    best = -(-sum(sizes.values()) // 256)
    assert len({r.container for r in rows}) <= 1.03 * best
    assert P.pack(df.where("false"), 256).count() == 0


def test_many_levels(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_ITEMS", 40)
    sizes = {k: 1 + (k * 7) % 90 for k in range(1_500)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, tokens bigint").repartition(16)
    rows = P.pack(df, 100).collect()
    check(rows, sizes, 100)
    assert len({r.container for r in rows}) <= 1.1 * -(-sum(sizes.values()) // 100)


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (None, "a"), (2**60, "x " * 60_000), (1, "Hello world")], "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0), r.tokens) for r in P.token_sizes(df).collect())
    assert got == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0), (2**60, 60_001)]


def test_texts_without_tokens_are_dealt_out(spark):
    sizes = {k: 0 for k in range(2_000)} | {3_000 + k: 9 for k in range(12)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, tokens bigint").coalesce(2)
    rows = P.pack(df, 50).collect()
    check(rows, sizes, 50)
    held = {}
    for r in rows:
        held[r.container] = held.get(r.container, 0) + (r.tokens == 0)
    assert max(held.values()) <= 50 and len(rows) == len(sizes)


def test_every_profile_is_packed(spark, folder):
    rows = Q.p7_packed(spark, folder).groupBy("profile").count().collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert {r.profile for r in rows} == set(Q.capacities(spark, folder)) and all(r["count"] >= docs for r in rows)
