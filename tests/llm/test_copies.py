"""Copies by rolling hashes against canonical strings."""

import re

from hypothesis import given
from hypothesis import strategies as st

from pkgloom.llm import fingerprints
from pkgloom.llm.rolling import same_spelling, text_hashes

FP = ["a", "b", "c"]


def spelling(s):
    return re.sub(r"[\W_]+", " ", (s or "").lower()).strip()


TEXT = st.text(alphabet="aAbé É_-. \t1²ß中'", max_size=12)


@given(st.lists(TEXT, min_size=1, max_size=30))
def test_hashes_follow_spelling(texts):
    pairs = list(zip(*[h.tolist() for h in text_hashes(texts)], strict=True))
    for x, hx in zip(texts, pairs, strict=True):
        for y, hy in zip(texts, pairs, strict=True):
            if same_spelling(x, y):
                assert hx == hy
            else:
                assert hx != hy


@given(TEXT, TEXT)
def test_two_pointers(x, y):
    plain = lambda s: " ".join("".join(c if c.isalpha() or c.isdecimal() else " " for c in s.lower()).split())
    assert same_spelling(x, y) == (plain(x) == plain(y))


def brute(rows):
    first, out = {}, set()
    for i, *f in sorted(rows):
        k = tuple(sorted(map(spelling, f)))
        if k in first:
            out.add((first[k], i))
        first.setdefault(k, i)
    return out


ROWS = [
    (1, "Foo-Bar", "Acme Inc.", "1.0"), (2, "foo bar", " ACME, inc", "1 0"), (3, "1.0", "Foo Bar", "acme inc"), (4, None, "", "..."), (5, "", None, None),
    (6, "foobar", "Acme Inc", "1.0"), (7, "Foo-Bar", "Acme Inc.", "1.0"), (8, "x" * 50_000, "é", "E"), (9, "X" * 50_000, "É", "e"), (10, "e", "e", "x"), (11, "e", "x", "x"),
]


def test_links(spark):
    df = spark.createDataFrame([(*r, "t", 1) for r in ROWS], "id bigint, a string, b string, c string, hash_a string, copies int")
    got = [tuple(r) for r in fingerprints.copy_links(df, FP).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ROWS)
    one = {r.id: (r.copies, r.hash_a) for r in fingerprints.collapse(df, FP).collect()}
    assert one == {1: (4, "t"), 4: (2, "t"), 6: (1, "t"), 8: (2, "t"), 10: (1, "t"), 11: (1, "t")}
    assert fingerprints.copy_links(df.where("false"), FP).count() == 0
    assert fingerprints.copy_links(df.selectExpr("cast(null as bigint) id", "a", "b", "c"), FP).count() == 0


def test_hot_group(spark):
    df = spark.range(3_000).selectExpr("id", "case when id % 3 = 0 then concat('Hot', repeat(' ', cast(id % 7 as int))) else cast(id as string) end a", "'' b", "cast(null as string) c")
    got = {tuple(r) for r in fingerprints.copy_links(df, FP).collect()}
    assert got == {(0, k) for k in range(3, 3_000, 3)}


def test_collisions_are_settled(spark, monkeypatch):
    """With hashes that all collide, the exact fallback still gives the right groups."""
    import pandas as pd

    def all_equal(fields):
        def work(batches):
            for b in batches:
                yield b.assign(hash_a=pd.Series([7] * len(b), dtype="int64"), hash_b=pd.Series([7] * len(b), dtype="int64"))

        return work

    monkeypatch.setattr(fingerprints, "_hashed", all_equal)
    df = spark.createDataFrame(ROWS, "id bigint, a string, b string, c string")
    assert {tuple(r) for r in fingerprints.copy_links(df, FP).collect()} == brute(ROWS)
