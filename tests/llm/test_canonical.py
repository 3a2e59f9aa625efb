"""Canonical list mapping: hand cases and brute-force distance."""

from hypothesis import given
from hypothesis import strategies as st

from pkgloom.llm.canonical import CanonicalList, map_values, parse
from pkgloom.llm.names import distance

ENTRIES = [
    ("HwPL-2.0-only", "Harrowgate Public License v2.0 only"), ("HwPL-2.0-or-later", "Harrowgate Public License v2.0 or later"),
    ("LHwPL-2.0-only", "Lesser Harrowgate Public License v2.0 only"), ("TwL-1.1", "Tidewater License v1.1"), ("Brindle-3-Clause", "Brindle 3-Clause License"),
    ("Brindle-2-Clause", "Brindle 2-Clause License"), ("Saffron", "Saffron License"), ("Marl-Att-3.0", "Marl Credit Terms v3.0"), ("Kelp-1.0", "Kelp Source License v1.0"),
]
CASES = {
    "hwpl_2.0_only": "HwPL-2.0-only", "HwPL 2+": "HwPL-2.0-or-later", "HwPLv2 only": "HwPL-2.0-only", "The Harrowgate Public Licence, version 2.0 or any later version": "HwPL-2.0-or-later",
    "Harrowgaet Pub. Lic. 2 only": "HwPL-2.0-only", "Public License of Harrowgate 2 only": "HwPL-2.0-only", "Harrowgate Public License of Lesser 2 only": "LHwPL-2.0-only",
    "LicenseRef-Distro-TwL-1.1": "TwL-1.1", "Tidewtaer License 1.1 (see COPYING)": "TwL-1.1", "TwL-1.0": "", "TwL 9": "", "HwPL-2.0": "", "Brindle 3C-lause License": "Brindle-3-Clause",
    "Brindle 4-Clause License": "", "saffron license - full text in LICENSE": "Saffron", "Saffron 2.0": "", "Credit Terms of Marl 3": "Marl-Att-3.0", "Kelp Source style": "Kelp-1.0",
    "none": "", "?": "", "x" * 20_000: "", "Unheard License": "",
}


def test_cases():
    listed = CanonicalList(ENTRIES)
    assert {k: listed.resolve(k) for k in CASES} == CASES
    assert all(listed.resolve(i) == i and listed.resolve(n) == i for i, n in ENTRIES)
    assert CanonicalList([]).resolve("x") == ""
    assert CanonicalList([("A", None)]).resolve("a") == "A"


@given(st.text(alphabet="abcde", max_size=7), st.lists(st.text(alphabet="abcde", min_size=1, max_size=7), max_size=12), st.integers(0, 2))
def test_automaton_equals_brute_force(word, stems, most):
    listed = CanonicalList([(s, None) for s in stems])
    got = {(d, listed.stems[k]) for d, k in listed.within(word, most)}
    want = {(distance(word, s, 9), s) for s in listed.stems if distance(word, s, 9) <= most}
    assert got == want


def test_parse():
    assert parse("FdnDL-1.1+") == ("fdndl", (1, 1), "later")
    assert parse("Foo, v. 2.0 only") == ("foo", (2,), "only")
    assert parse("") == ("", None, "")


def test_table(spark):
    df = spark.createDataFrame([(1, "hwpl 2+", "old"), (2, None, "x"), (3, "", "y"), (4, "no such", None), (1, "hwpl 2+", "old")], "id int, v string, identifier string")
    got = sorted((r.id, r.v, r.identifier) for r in map_values(df, "v", ENTRIES).collect())
    assert got == [(1, "hwpl 2+", "HwPL-2.0-or-later"), (1, "hwpl 2+", "HwPL-2.0-or-later"), (4, "no such", "")]
    assert map_values(df.where("false"), "v", ENTRIES).count() == 0
