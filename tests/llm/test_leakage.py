"""Leaked passages: the FM-index and the runs against brute force."""

import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from pkgloom.llm import leakage as L


@given(st.lists(st.integers(0, 5), min_size=1, max_size=120), st.lists(st.lists(st.integers(1, 5), min_size=2, max_size=2), min_size=1, max_size=10))
def test_index_finds_every_occurrence(seq, patterns):
    text = np.array([*seq, 0], dtype=np.int64)
    index = L.FMIndex(text, 6)
    low, high = index.search(np.array(patterns, dtype=np.int64))
    for k, (a, b) in enumerate(patterns):
        found = sorted(index.locate(np.arange(low[k], high[k])).tolist()) if high[k] > low[k] else []
        assert found == [i for i in range(len(text) - 1) if text[i] == a and text[i + 1] == b]


def brute(docs, items):
    """All runs of one offset with single changed words, by comparing every offset."""
    out = set()
    for d, text in docs:
        w = L.words_of(text or "")
        for i, item in items:
            v = L.words_of(item or "")
            got = set()
            for shift in range(-len(v), len(w)):
                same = [0 <= p + shift < len(w) and w[p + shift] == v[p] for p in range(len(v))]
                parts, p = [], 0  # stretches of two equal words and more; one changed word may lie between
                while p < len(v):
                    end = p
                    while end < len(v) and same[end]:
                        end += 1
                    if end - p >= 2:
                        if parts and parts[-1][-1][1] == p - 1 and 0 <= p - 1 + shift < len(w):
                            parts[-1].append((p, end))
                        else:
                            parts.append([(p, end)])
                    p = end + 1
                for run in parts:
                    if run[-1][1] - run[0][0] >= 8 and any(z - a >= 4 for a, z in run):
                        got |= set(range(run[0][0], run[-1][1]))
            if v and len(got) / len(v) >= 1 / 3:
                out.add((d, i))
    return out


def build(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(20, 50)))) for k in range(12)]
    docs = []
    for d in range(40):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 200))]
        if rnd.random() < 0.6:
            v = items[rnd.randrange(12)][1].split()
            a = rnd.randrange(len(v) - 8)
            part = v[a : a + rnd.randint(6, 40)]
            if rnd.random() < 0.5 and len(part) > 10:
                part[len(part) // 2] = "changed"
            at = rnd.randrange(len(words) + 1)
            words[at:at] = [p.upper() + rnd.choice(["", ",", "\n> ", " <b>"]) for p in part]
        docs.append((d, " ".join(words)))
    return docs, items


def test_equals_brute_force(spark):
    for seed in range(3):
        docs, items = build(seed)
        df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, item bigint").repartition(5)
        it = spark.createDataFrame(items, "item_id bigint, text string")
        got = {(r.doc_id, r.item_id) for r in L.leaks(df, it)[0].collect()}
        assert got == brute(docs, items)


def test_blocks_and_notices(spark, monkeypatch):
    notice = "you may pass on copies as long as this notice stays in place"
    own = [" ".join(f"x{i}y{k}" for k in range(24)) for i in range(6)]
    items = [(i, f"{own[i]} {notice}" if i < 4 else own[i]) for i in range(6)]
    docs = [(d, f"text {d} {notice} end") for d in range(30)] + [(100 + i, own[i]) for i in range(6)] + [(200, None), (201, ""), (None, own[0])]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*items, (90, None), (91, ""), (92, "short one")], "item_id bigint, text string")
    want = {(100 + i, i) for i in range(6)} | {(None, 0)}
    assert {(r.doc_id, r.item_id) for r in L.leaks(df, it)[0].collect()} == want
    monkeypatch.setattr(L, "BLOCK", 2)
    found, spans = L.leaks(df, it)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert {(r.first_word, r.last_word) for r in spans.where("doc_id between 100 and 105").collect()} == {(0, 23)}
    assert L.leaks(df.where("false"), it)[0].count() == 0 and L.leaks(df, it.where("false"))[0].count() == 0


def test_run_beyond_a_changed_word(spark):
    item = [f"q{k}" for k in range(20)]
    texts = {1: item[:3] + ["x"] + item[4:9], 2: item[:3] + ["x", "y"] + item[5:9], 3: item[:2] + ["x"] + item[3:5] + ["y"] + item[6:8], 4: [*item[:3], "x", *item[4:6], "y", *item[7:11]], 5: [*item[:5], "x", item[6], "y", item[8]]}
    df = spark.createDataFrame([(k, " ".join(["a", *v, "b"])) for k, v in texts.items()], "doc_id bigint, text string")
    it = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    assert {(r.doc_id, r.share) for r in L.leaks(df, it)[0].collect()} == {(1, 0.45), (4, 0.55)}


def test_many_shards(spark, monkeypatch):
    docs, items = build(9)
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), spark.createDataFrame(items, "item_id bigint, text string")
    whole = [{tuple(r) for r in f.collect()} for f in L.leaks(df, it)]
    monkeypatch.setattr(L, "SHARD", 700)
    assert [{tuple(r) for r in f.collect()} for f in L.leaks(df, it)] == whole and whole[0]


def test_very_long_text(spark):
    rnd = random.Random(1)
    item = " ".join(f"q{k}" for k in range(30))
    text = " ".join(rnd.choice("abcdef") for _ in range(300_000)) + " " + item
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert L.leaks(df, spark.createDataFrame([(1, item)], "item_id bigint, text string"))[0].count() == 1


def test_copies_make_no_notice(spark, monkeypatch):
    own = [" ".join(f"x{i}y{k}" for k in range(24)) for i in range(3)]
    items = [(0, own[0]), (1, own[1]), (2, own[1].upper()), (3, own[1]), (4, own[2])]
    docs = [(d, f"filler {d} of no item at all") for d in range(30)]
    docs += [(100 + d, f"copied {own[0]} end") for d in range(20)] + [(150, f"alone {own[0]} end")]
    docs += [(200, own[1]), (300, " / ".join([own[2]] * 20))]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {(100 + d, 0) for d in range(20)} | {(150, 0), (200, 1), (200, 2), (200, 3), (300, 4)}
    found, spans = L.leaks(df, it)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert {r.doc_id for r in spans.collect()} == {d for d, _ in want}
    # a phrase of three distinct items is a notice wherever the blocks part them
    phrase = " ".join(f"common{k}" for k in range(10))
    three = spark.createDataFrame([(i, f"{phrase} {o}") for i, o in enumerate(own)], "item_id bigint, text string")
    text = spark.createDataFrame([(1, f"{phrase} {' '.join(own[0].split()[:9])}")], "doc_id bigint, text string")
    monkeypatch.setattr(L, "BLOCK", 1)
    assert L.leaks(text, three)[0].count() == 0
