"""Packed fields: hand cases, a composed round trip and edge cases."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pkgloom.operators.multivalue import explode_values, split_values

PROSE = {
    "A first thing / Second thing": ["A first thing", "Second thing"],
    "Client/server tool": ["Client/server tool"],
    "3D mesh and/or font plugins": ["3D mesh and/or font plugins"],
    "Lazy, small graph with roots": ["Lazy, small graph with roots"],
    "Tool for Disk, Mail and Log files": ["Tool for Disk, Mail and Log files"],
    "Tool for Disk, Mail and Log files, Other tool": ["Tool for Disk, Mail and Log files", "Other tool"],
    'Cache with the "flat" mode, Shared root': ['Cache with the "flat" mode', "Shared root"],
    '"Cache with the ""flat"" mode"; Root': ['Cache with the "flat" mode', "Root"],
    '"Cache with the \\"flat\\" mode" | \'Root, mostly small\'': ['Cache with the "flat" mode', "Root, mostly small"],
    "- One thing\n- Two things": ["One thing", "Two things"],
    "* One\n* Two\n* Three": ["One", "Two", "Three"],
    "1) One thing 2) Two things": ["One thing", "Two things"],
    "One\tTwo\t\tThree": ["One", "Two", "Three"],
    "One thing;Two things;": ["One thing", "Two things"],
    "One • Two": ["One", "Two"],
    "Wrapped thing\n over a line": ["Wrapped thing\n over a line"],
    '"Only one"': ["Only one"],
    ", ;": [],
    "   ": [],
    "": [],
    None: [],
}
TERMS = {
    "A-1.0 OR B-2.0": ["A-1.0", "B-2.0"],
    "(A-1.0 and B-2.0) or C": ["A-1.0", "B-2.0", "C"],
    "A-1.0 or later": ["A-1.0 or later"],
    "Foo License 1.0 or any later version AND 'B 2'": ["Foo License 1.0 or any later version", "B 2"],
    "The Foo License, version 2.0, B-1": ["The Foo License, version 2.0", "B-1"],
    "A-1.0 B-2.0": ["A-1.0", "B-2.0"],
    'A-1.0 "Foo License 2"': ["A-1.0", "Foo License 2"],
    "Foo License 2.0": ["Foo License 2.0"],
    "Foo License v1.0 (see COPYING)": ["Foo License v1.0 (see COPYING)"],
    "Known  B-2.0": ["Known", "B-2.0"],
    "Known Known2-1": ["Known", "Known2-1"],
    "A-1.0 | | B-2.0,": ["A-1.0", "B-2.0"],
    "Give and Take Terms 1.0": ["Give and Take Terms 1.0"],
    "see https://x.example/a/b; B-1": ["see https://x.example/a/b", "B-1"],
    "A-1.0 / B-2": ["A-1.0", "B-2"],
    None: [],
}


def values(spark, texts, dialect, **more):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    got = {r.id: list(r.values_ or []) for r in split_values(df, "t", dialect, **more).collect()}
    return [got[k] for k in range(len(texts))]


def test_prose(spark):
    assert values(spark, list(PROSE), "prose") == list(PROSE.values())


def test_terms(spark):
    got = values(spark, list(TERMS), "terms", vocabulary=["Known"], names=["Give and Take Terms v1.0"])
    assert got == list(TERMS.values())


def test_positions_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(1, "One / Two", 5, "x"), (1, "One / Two", 6, "y"), (2, None, 7, "z")], "id int, t string, rule_ int, SKELETON_ string")
    out = explode_values(split_values(df, "t"), ["id", "rule_"])
    assert sorted(map(tuple, out.collect())) == [(1, 5, 1, "One"), (1, 5, 2, "Two"), (1, 6, 1, "One"), (1, 6, 2, "Two")]
    assert split_values(df.where("id > 5"), "t").count() == 0


def test_very_long(spark):
    text = " / ".join(f"Item number {k}" for k in range(5_000))
    (got,) = values(spark, [text], "prose")
    assert len(got) == 5_000 and got[-1] == "Item number 4999"


@pytest.fixture(scope="module")
def cases(spark):
    seen: list[tuple[list[str], str, str]] = []
    item = st.from_regex(r"[A-Z][a-z]{1,8}( [a-z]{1,8}){0,3}", fullmatch=True)

    @given(st.lists(item, min_size=2, max_size=6), st.sampled_from([" / ", "; ", " | ", "\t", ";", "\n"]), st.sampled_from(['"', "'", ""]))
    def draw(items, sep, quote):
        seen.append((items, sep, quote))

    draw()
    return seen


def test_round_trip(spark, cases):
    texts = [sep.join(f"{q}{i}{q}" for i in items) for items, sep, q in cases]
    assert values(spark, texts, "prose") == [items for items, _, _ in cases]


def test_common_skeletons_are_joined_apart(spark):
    texts = [f"Some thing {k} / Other" for k in range(200)] + [f"{'a, B; ' * (k % 9)}end {k}" for k in range(60)] + [None, ""]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "id int, t string, held_ int")
    rows = [{(r.id, tuple(r.values_), r.held_) for r in split_values(df, "t", broadcast=b).collect()} for b in (50_000, 0)]
    assert rows[0] == rows[1] and len(rows[0]) == len(texts)
