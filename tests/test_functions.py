"""Scalar functions against hand-made values."""

import pytest
from pyspark.sql import functions as F

from pkgloom.functions import dates, html, names, specfile, versions
from pkgloom.functions.normalize import fingerprints, normalized

GOLDEN = [  # software, version -> software, version, uncut, date, is_date, suffix
    ("perl-Digest-SHA", "5.85-4.el7", "perl-Digest-SHA", "5.85", "5.85", None, False, None),
    ("libpython2.7-stdlib:i386", "2.7.12-1ubuntu0~16.04.18", "libpython2.7-stdlib", "2.7", "2.7.12", None, False, None),
    ("munin", "2.0.49-1~bpo9+1", "munin", "2.0", "2.0.49", None, False, None),
    ("python3-typing", "3.7.4.3-1.el7pc", "python3-typing", "3.7.4", "3.7.4.3", None, False, None),
    ("libavcodec", "7:4.2.7-0ubuntu0.1", "libavcodec", "4.2", "4.2.7", None, False, None),
    ("ntp", "1:4.2.8p4+dfsg-3ubuntu5.5", "ntp", "4.2", "4.2.8p4", None, False, None),
    ("update", "1:16.04.3", "update", "16.04", "16.04.3", None, False, None),
    ("x::y:amd64", "20210715", "x::y", "20210715", "20210715", "2021-07-15", True, None),
    ("x::y:amd64", "2021.07", "x::y", "2021.07", "2021.07", "2021-07-31", True, None),
    ("x::y:amd64", "2.0.0-rc1-1", "x::y", "2.0", "2.0.0-rc1", None, False, "rc1"),
    ("x::y:amd64", "1.0rc1", "x::y", "1.0", "1.0rc1", None, False, "rc1"),
    ("x::y:amd64", "1.2.3beta2", "x::y", "1.2", "1.2.3beta2", None, False, "beta2"),
    ("x::y:amd64", "1-2", "x::y", "2", "2", None, False, None),
    ("x::y:amd64", "5:6.7+git2020", "x::y", "6.7", "6.7", None, False, None),
    ("x::y:amd64", "~1.0", "x::y", "1.0", "1.0", None, False, None),
    ("x::y:amd64", "", "x::y", "", "", None, False, None),
    (None, None, "", "", "", None, False, None),
]


def test_normalised(spark):
    df = spark.createDataFrame([(k, s, v) for k, (s, v, *_) in enumerate(GOLDEN)], "publisher string, software string, version string")
    got = {int(r.publisher): r for r in normalized(df).collect()}
    for k, (_, _, software, version, uncut, date, is_date, suffix) in enumerate(GOLDEN):
        r = got[k]
        assert (r.software, r.version, r.version_uncut, r.version_date, r.version_is_date, r.version_suffix) == (software, version, uncut, date, is_date, suffix)


def test_fingerprints_once(spark):
    df = spark.createDataFrame([("a", "p", "1.2.3"), ("a ", "p", "1.2.4"), (None, None, None), (None, "", "")], "software string, publisher string, version string")
    assert sorted((r.software, r.publisher, r.version, r.version_uncut) for r in fingerprints(df).collect()) == [("", "", "", ""), ("a", "p", "1.2", "1.2.3")]
    assert fingerprints(df.where("false")).count() == 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names(spark):
    lit = F.lit
    assert one(spark, names.without_lib(lit("libfoo"))) == "foo"
    assert one(spark, names.without_lib(lit("library"))) == "library"
    assert one(spark, names.without_version_suffix(lit("boost-1.2"), lit("1.2.3"))) == "boost"
    assert one(spark, names.perl_distribution(lit("perl-Test-Simple-tests"))) == "Test-Simple"
    assert one(spark, names.perl_distribution(lit("libclass-singleton-perl"))) == "Class-Singleton"
    assert one(spark, names.library_package(lit("python3-chameleon"))) == "chameleon"
    assert one(spark, names.python_standard_part(lit("python27-tkinter"), lit("2.7.5"))) is True
    assert one(spark, names.like_pattern(lit("12.34"))) == "1_.3%"
    assert one(spark, names.like_pattern(lit("r5"))) == "r5"
    assert one(spark, names.license_names(F.array(lit("(MIT OR Apache-2.0) and BSD")))) == ["MIT", "Apache-2.0", "BSD"]
    assert one(spark, names.project_service(lit("https://rubygems.org/gems/pg"))) == "rubygem"
    assert one(spark, names.project_service(lit("https://rubygems.org/gems/pg"), strict=True)) is None
    assert one(spark, names.project_service(lit("https://github.com/"))) == "github"
    assert one(spark, names.project_service(lit("github.com"))) is None
    assert one(spark, names.corrected_url(lit("https://github.com/o/r/tree/x?y"))) == "https://github.com/o/r"
    assert one(spark, names.corrected_url(lit("https://metacpan.org/"), lit("Foo-Bar"))) == "https://fastapi.metacpan.org/v1/release/Foo-Bar"
    assert one(spark, names.corrected_url(lit("https://metacpan.org/release/Foo::Bar-1.2"))) == "https://fastapi.metacpan.org/v1/release/Foo-Bar"
    assert one(spark, names.owner_page(lit("https://github.com/o/o.github.io"))) is True
    assert one(spark, names.author_list(F.array(lit("B <b@x>"), lit("A")))) == "A, B"
    assert one(spark, names.control_description(lit("Package: x\nDescription: y\n line\n more\n .\nend"))) == "line\n more"
    assert one(spark, names.control_description(lit("Package: x\nDescription: y\n line"))) == ""
    assert one(spark, names.source_name(lit("foo5-bar5"), lit("5.1"))) == "foo-bar"
    assert one(spark, names.distinct_names(F.array(lit("a"), lit("A"), lit("b"), lit(None)), F.array(lit("B")))) == ["A"]
    assert one(spark, names.with_suffix(lit("1.0"), lit("rc1"))) == "1.0 rc1"
    assert one(spark, names.distribution(lit("The Ubuntu Team"))) == "ubuntu"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("released 2021-03-04", "2021-03-04"), ("on 25/12/2020", "2020-12-25"), ("05/06/2020", "2020-06-05"), ("2020-05-06", "2020-05-06"),
        ("12 March 2019", "2019-03-12"), ("Mar 12, 2019", "2019-03-12"), ("20190312", "2019-03-12"), ("201903", "2019-03-01"), ("5.6.2020", None),
        ("31/02/2020", None), ("12Mar2019", "2019-03-12"), ("", None), (None, None), ("version 1.2.3", None), ("032019", "2019-03-01"),
    ],
)
def test_dates(text, want):
    assert dates.iso(dates.parse(text)) == want


def test_yearless():
    assert dates.iso(dates.parse_yearless("25 March")) == "03-25"
    assert dates.iso(dates.parse_yearless("3/25")) == "03-25"
    assert dates.iso(dates.parse_yearless("3/5")) is None


def test_changelog():
    text = "v1.5.2 - 2020-01-02\n\nv1.5 - 12 Mar 2019\nv1.50 - 2018-01-01"
    assert versions.changelog_release(text, "1.5", None) == "2019-03-12"
    assert versions.changelog_release(text, "1.5.2", None) == "2020-01-02"
    assert versions.changelog_release("v2.0rc1 (2020-02-03)", "2.0", "rc1") == "2020-02-03"
    assert versions.changelog_release("v2.1 25 March\n\n2017", "2.1", None) == "2017-03-25"
    assert versions.changelog_release("nothing", "9", None) is None
    assert versions.changelog_release(None, "9", None) is None


def test_best_tag(spark):
    tags = [("1.5", None, t, k) for k, t in enumerate(["v1.5.3", "v1.5.2", "v1.5.0-rc1", "v2.0", "v1.50"])]
    tags += [("2.0", None, t, k) for k, t in enumerate(["v2.0.0", "v2.0.1"])] + [("3.0", "rc1", t, k) for k, t in enumerate(["v3.0", "v3.0-rc1"])]
    df = spark.createDataFrame(tags, "wanted string, suffix string, tag string, pos int")
    got = {r.wanted: (r.tag, r.is_exact) for r in versions.best_matches(df, ["wanted"], "tag", "wanted", "suffix", ["pos"]).collect()}
    assert got == {"1.5": ("v1.5.2", False), "2.0": ("v2.0.0", True), "3.0": ("v3.0-rc1", True)}


def test_head_key_keeps_matches(spark):
    """Joining by head keys loses no match of a brute-force join."""
    wanted = ["1.5", "2.0", "10.4.1", "7", "1.5a"]
    tags = ["v1.5.3", "1.5", "v1.50", "2_0_1", "v10.4.1rc1", "7", "v7.1", "1-5", "x1.5", "v1.5a2", "v70"]
    a = spark.createDataFrame([(w, None) for w in wanted], "wanted string, suffix string")
    b = spark.createDataFrame([(t, k) for k, t in enumerate(tags)], "tag string, pos int")
    brute = versions.best_matches(a.crossJoin(b), ["wanted", "tag"], "tag", "wanted", "suffix", ["pos"]).select("wanted", "tag")
    keyed = versions.best_matches(
        a.withColumn("h", versions.head_key(F.col("wanted"))).join(b.withColumn("h", F.explode(versions.head_keys(F.col("tag")))), "h"),
        ["wanted", "tag"], "tag", "wanted", "suffix", ["pos"],
    ).select("wanted", "tag")
    assert {tuple(r) for r in brute.collect()} == {tuple(r) for r in keyed.collect()}


def test_spec():
    text = (
        "%global base foo\n%define full %{base}-tool\nName: %{full}\nVersion: 1.2\nRelease: 1%{?dist}\nLicense: MIT\nURL: https://x.example/%{name}\n"
        "Source0: %{name}-%{version}.tar.gz\nRequires: bar >= 1.0, baz\n# Requires: gone\n%description\nA tool.\nSecond line.\n%package devel\nRequires: %{name} = %{version}\n%description devel\nHeaders\n%prep\nName: no\n%changelog\n* first"
    )
    s = specfile.parse(text)
    assert s["name"] == "foo-tool" and s["url"] == "https://x.example/foo-tool" and s["release"] == "1"
    assert s["sources"] == ["foo-tool-1.2.tar.gz"] and s["requires"] == ["bar >= 1.0", "baz", "foo-tool = 1.2"]
    assert s["description"] == "A tool.\nSecond line." and s["changelog"] == "* first" and s["packages"] == ["foo-tool-devel"]
    assert specfile.parse(None)["name"] is None
    assert specfile.expand("%{!?x:a}%{?x:b}%{y}", {"x": "1"}) == "b%{y}"
    assert specfile.expand("%{a}", {"a": "%{b}", "b": "%{a}"}) in ("%{a}", "%{b}")


def test_spec_parts():
    text = (
        "%{!?rel: %global rel 3}\n%global tool \\\n foo\nName: foo\nVersion: 1\nVersion: 2\nRelease: %{rel}\nSource: a-%{version}.tgz\nSource7: b\nPatch1: p.diff\n"
        "%description\nMain.\n%package -n libfoo\nSummary: Library of %{name}\nGroup: Libs\nRequires: %{name} >= %{version}, bar\nProvides: foo(lib)\n%description -n libfoo\nShared parts.\n"
        "%package doc\nSummary: Texts\n%description doc -l de\nTexte.\n%files -n libfoo\n/usr\n%changelog\n* one"
    )
    s = specfile.parse(text)
    assert (s["version"], s["release"], s["macros"]["tool"].strip(), s["packages"]) == ("1", "3", "foo", ["libfoo", "foo-doc"])
    assert s["files"] == {"source0": "a-1.tgz", "source7": "b", "patch1": "p.diff"}
    one, two = s["parts"]
    assert (one["name"], one["summary"], one["group"], one["description"], one["requires"], one["provides"]) == ("libfoo", "Library of foo", "Libs", "Shared parts.", ["foo >= 1", "bar"], ["foo(lib)"])
    assert (two["name"], two["description"], s["description"], s["changelog"]) == ("foo-doc", "Texte.", "Main.", "* one")


def test_spec_struct(spark):
    df = spark.createDataFrame([("Name: a\n%package b\nSummary: x",), (None,), ("",)], "t string").select(specfile.spec_struct("t").alias("s"))
    rows = df.select("s.name", F.transform("s.parts", lambda p: p["name"]).alias("parts")).collect()
    assert [(r.name, r.parts) for r in rows] == [("a", ["a-b"]), (None, []), (None, [])]


def test_html(spark):
    assert html.text_of("<html><head><title>no</title></head><p>Hello <b>you</b></p><ul><li>item</li></ul><img alt='pic'><script>x</script>end") == "Hello you picend"
    assert html.text_of(None) == ""
    assert one(spark, html.refresh_target(F.lit('<meta http-equiv="refresh" content="0; url=https://x.example/a">'))) == "https://x.example/a"


def test_copyright_cell(spark):
    df = spark.createDataFrame([("<div id='copyright_info'><table><tr><td>a</td><td>b</td><td> MIT </td></tr></table></div>",), ("<p>no</p>",), (None,)], "h string")
    assert [r.x for r in df.select(html.copyright_license("h").alias("x")).collect()] == ["MIT", None, None]


def test_date_tags(spark):
    rows = [(1, "2021-07-15", None, t, k) for k, t in enumerate(["release-2021-07-01", "r2021-07-15rc1", "2021-07-15", "2020-07-15"])]
    df = spark.createDataFrame(rows, "id int, day string, suffix string, tag string, pos int")
    assert [(r.tag, r.fit) for r in versions.best_date_tags(df, ["id"], "tag", "day", "suffix", ["pos"]).collect()] == [("2021-07-15", 0)]


def test_repository_choice(spark):
    from pkgloom.resolvers.packages import best_repository

    rows = [(1, 0, "foo-bar", "foo", "u0"), (1, 1, "foo-bar", "bar_foo", "u1"), (1, 2, "foo-bar", "foo_bar", "u2"), (2, 0, "foo", "other", "u3"), (3, 0, "foo", "foo-x", "u4")]
    df = spark.createDataFrame(rows, "id int, pos int, package string, repo string, url string")
    assert {(r.id, r.url) for r in best_repository(df, ["id"]).collect()} == {(1, "u2"), (3, "u4")}
