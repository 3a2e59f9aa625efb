"""Relational operators on hand cases and edge cases."""

import json

from pyspark.sql import functions as F

from pkgloom.engine import join_skewed
from pkgloom.operators import alpine, identity, lookup, package_index, upserts
from pkgloom.pipeline import recognise
from pkgloom.plans import images
from pkgloom.providers import FirstSentences, define_texts, extract_licenses
from pkgloom.resolvers import packages as P
from pkgloom.resolvers import projects as R
from pkgloom.resolvers import releases

PACKAGES = (
    "projectname_seed string, family string, repo string, srcname string, binname string, visiblename string, trackname string, "
    "binnames array<string>, comment string, licenses array<string>, version string, flags int, links string"
)


def package(seed, family="f", names=(None,) * 4, versions=None, flags=0, links=None, comment=None, repo="r"):
    return (seed, family, repo, *names, None, comment, None, versions, flags, links)


def test_lockstep_and_urls(spark):
    rows = [
        package("a", names=("b", None, None, None), versions="1", links="[[0,1],[0,2],[4,9]]", flags=4, comment="x"),
        package("a", names=("c", None, None, None), versions="1", links="[[0,3]]", flags=0, comment="w", repo="q"),
        package("n", versions="1"), package("n", versions="2"), package("z", family=None, versions="1"), package("u", versions=None),
    ]
    packages = spark.createDataFrame(rows, PACKAGES)
    links = spark.createDataFrame([(1, "one", 5), (2, "two", 9), (3, "three", 1)], "id int, url string, refcount int")
    got = sorted(map(str, ((r.package, r.projectname_seed, r.version, r.homepage, r.project_url, r.repo, r.description) for r in package_index.build_package_index(packages, links).collect())))
    want = [
        ("a", "a", "1", "three", None, "q", "w, x"), ("b", "a", None, "three", None, "q", "w, x"), ("c", "a", None, "three", None, "q", "w, x"),
        ("n", "n", "1", None, None, "r", None), (None, "n", "2", None, None, "r", None), ("u", "u", None, None, None, "r", None),
    ]
    assert got == sorted(map(str, want))
    assert package_index.build_package_index(packages.where("false"), links).count() == 0


def test_ignored_links_fall_back(spark):
    df = spark.createDataFrame([package("a", links="[[0,1]]", flags=8), package("a", links="[[0,2]]", flags=16), package("b", links="[[0,1]]", flags=8), package("b", links="[[0,2]]", flags=1)], PACKAGES)
    assert {(r.projectname_seed, tuple(r.ids)) for r in package_index.link_groups(df).collect()} == {("a", (1, 2)), ("b", (2,))}


def test_keep_old_if_empty(spark):
    old = spark.createDataFrame([("k", "x", None), ("l", "y", "z")], "package string, a string, b string")
    new = spark.createDataFrame([("k", "", "n"), ("m", "", None)], "package string, a string, b string")
    got = {tuple(r) for r in upserts.keep_old_if_empty(old, new, "package", ["a", "b"]).collect()}
    assert got == {("k", "x", "n"), ("l", "y", "z"), ("m", "", None)}


def test_insert_ignore_nulls(spark):
    schema = "publisher string, product string, version string, id int"
    old = spark.createDataFrame([("p", "q", None, 1)], schema)
    new = spark.createDataFrame([("p", "q", None, 2), ("p", "q", "1", 3), ("p", "q", "1", 4), (None, "q", None, 5)], schema)
    got = {tuple(r) for r in upserts.insert_ignore(old, new, ["publisher", "product", "version"], "id").collect()}
    assert got == {("p", "q", "1", 3), (None, "q", None, 5)}


def test_stored_fingerprints(spark):
    fp = spark.createDataFrame([("a", "p", ""), ("b", "p", "1")], "software string, publisher string, version string")
    stored = spark.createDataFrame([("a", "p", None), ("b", "p", "1")], "fp_software string, fp_publisher string, fp_version string")
    assert lookup.not_yet_stored(fp, stored).count() == 0
    assert [r.software for r in lookup.not_yet_stored(fp, stored, strict=True).collect()] == ["a"]
    assert lookup.not_yet_stored(fp, stored.where("false")).count() == 2


def test_nearest_is_exact(spark, folder, monkeypatch):
    base = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit(1).alias("d2"))
    queries = base.where("id % 50 = 0")
    got = {r.query_id: (r.near_id, round(r.distance, 6)) for r in identity.nearest(queries, base, exclude_self=True).collect()}
    pairs = queries.select(F.col("id").alias("q"), F.col("vector").alias("v")).crossJoin(base.select("id", "vector")).where("q <> id").collect()
    want = {}
    for p in pairs:
        d = sum((float(x) - float(y)) ** 2 for x, y in zip(p.v, p.vector, strict=True)) ** 0.5
        want[p.q] = min(want.get(p.q, (9e9, 0)), (d, p.id))
    assert got == {q: (i, round(d, 6)) for q, (d, i) in want.items()}
    monkeypatch.setattr(identity, "QUERY_BLOCK", 3)
    assert {r.query_id: (r.near_id, round(r.distance, 6)) for r in identity.nearest(queries, base, exclude_self=True).collect()} == got
    assert identity.nearest(queries, base, threshold=0.0, exclude_self=True).count() == 0
    blank = spark.createDataFrame([], "id bigint, vector array<float>")
    assert identity.nearest(blank, base).count() == 0 and identity.nearest(queries, blank).count() == 0


def test_cpe_identity(spark):
    software = spark.createDataFrame([(1, ["Foo Bar"], ["Some Body"], "1.2"), (2, ["Foo Bar"], ["Else"], "1.2"), (3, ["Foo Bar"], [], ""), (4, [], ["Some Body"], None)], "id int, names array<string>, publishers array<string>, version string")
    cpe = spark.createDataFrame([(1, "x", "foo_bar", "1.20"), (2, "x", "foo_bar", "1.2.7"), (3, "some_body", "foo_bar", None), (4, None, "foo_bar", "9")], "id int, publisher string, product string, version string")
    got = {r.id: (r.cpe_id, r.cpe_string) for r in identity.cpe_identity(software, cpe).collect()}
    assert got == {1: (2, "cpe:2.3:a:x:foo_bar:"), 2: (2, "cpe:2.3:a:x:foo_bar:")}


def test_source_descriptions(spark):
    rows = [(0, 1, "a", "1.0", "src", "", "da", "L"), (0, 2, "b", "1.0", "src", "", "db", "L"), (1, 1, "a", "2.0", "other", "", "no", "L"), (1, 2, "c", "1.0", "src", "", "dc", "L"), (1, 3, "d", "1.0", "", "", "alone", "L")]
    df = spark.createDataFrame(rows, "file_rank int, pos bigint, package string, version string, srcname string, homepage string, description string, licenses string")
    got = {r.package: r.description for r in alpine.described_sources(alpine.merged_index(df)).collect()}
    assert got == {k: "c - dc, a - da, b - db" for k in "abc"} | {"d": "alone"}


def test_skewed_join(spark):
    rows = spark.createDataFrame([("hot", k) for k in range(300)] + [(f"k{k}", k) for k in range(200)], "key string, n int")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("most"))
    assert join_skewed(rows, groups, ["key"], "size").count() == 500
    assert join_skewed(rows, groups.where("key <> 'k3'"), ["key"], "size", "left").where("most is null").count() == 1
    assert join_skewed(rows, groups.where("false"), ["key"], "size").count() == 0


def test_project_records(spark):
    body = json.dumps({"info": {"name": "Defused", "author": "", "home_page": "https://github.com/tiran/defused", "summary": "Short.", "description": "Line\n![no](x)\nMore", "license": "PSF", "project_urls": None}, "releases": {"0.7.1": [{"upload_time": "2021-03-08T00:00:00"}], "0.7": [{"upload_time": "2021-03-04T10:00:00"}], "0.8": []}})
    df = spark.createDataFrame([("defused", "https://pypi.org/project/defused", "0.7", None, body), ("x", "https://pypi.org/project/x", "1", None, None)], "package string, url string, version string, version_suffix string, project string")
    got = {r.package: r for r in R.pypi(df, ["package"]).collect()}
    assert got["defused"].publisher == "Tiran" and got["defused"].release_date == "2021-03-04" and got["defused"].description == "Short. Line More"
    assert got["x"].software == "x" and got["x"].licenses == [] and got["x"].release_date == ""
    hub = spark.createDataFrame(
        [("cham", "https://github.com/malthe/chameleon", "4.4", "", json.dumps({"name": "chameleon", "homepage": "", "description": ["no"], "license": {"name": "Other"}}), json.dumps({"name": "Malthe", "login": "malthe"}), json.dumps({"content": "VGVtcGxhdGUgZW5naW5l"}), json.dumps({"content": "TGljZW5zZSB0ZXh0"}), json.dumps({"commit": {"committer": {"date": "2023-12-12T01:02:03Z"}}}))],
        "package string, url string, version string, inherited string, project string, owner string, readme string, license string, tag_commit string",
    )
    r = R.github(hub, ["package"]).first()
    assert (r.software, r.publisher, r.publisher_alternative, r.description, r.license_text, r.release_date) == ("chameleon", "Malthe", [], "Template engine", "License text", "2023-12-12")
    lab = spark.createDataFrame([("dodock", "https://gitlab.example.org/o/dodock", "4.51", None, json.dumps({"name": "Dodock", "path": "dodock", "namespace": {"name": "Dokos"}, "license": {"key": "mit"}, "description": "A long enough text"}), None, None, json.dumps({"commit": {"committed_date": "2025-02-04T00:00"}}))], "package string, url string, version string, inherited string, project string, readme string, license_file string, tag string")
    r = R.gitlab(lab, ["package"]).first()
    assert (r.software, r.publisher, r.licenses, r.release_date) == ("Dodock", "Dokos", ["mit"], "2025-02-04")
    cpan = spark.createDataFrame([("Class-Singleton", "u", "1.5", json.dumps({"distribution": "Class-Singleton", "author": "SHAY", "license": ["perl_5"], "provides": ["Class::Singleton"], "date": "2014-11-07T10:00", "version": "1.5"}), json.dumps({"name": "Steve Hay"}), None)], "package string, url string, version string, release string, author string, module string")
    r = R.metacpan(cpan, ["package"]).first()
    assert (r.publisher, r.publisher_alternative, r.licenses, r.release_date) == ("Steve Hay", ["SHAY"], ["Artistic-1.0-Perl", "GPL-1.0-or-later"], "2014-11-07")
    forge = spark.createDataFrame([("soprano", "https://sourceforge.net/projects/soprano", "2.9", None, json.dumps({"name": "Soprano", "developers": [{"name": "B"}, {"name": "A"}], "external_homepage": "http://soprano.sourceforge.net", "categories": {"license": [{"fullname": "LGPL"}]}, "short_description": "RDF"}), "2013-01-02")], "package string, url string, version string, inherited string, project string, release_date string")
    r = R.sourceforge(forge, ["package"]).first()
    assert (r.publisher, r.homepage, r.licenses, r.release_date) == ("A, B", "https://sourceforge.net/projects/soprano", ["LGPL"], "2013-01-02")
    gem = spark.createDataFrame([("pg", "u", "1.5", None, json.dumps({"name": "pg", "info": "Pg is the interface", "authors": "Michael", "licenses": ["BSD"]}), None, None, "2023-04-24")], "package string, url string, version string, inherited string, gem string, source_publisher string, source_description string, source_release_date string")
    r = R.rubygem(gem, ["package"]).first()
    assert (r.software, r.software_alternative, r.publisher, r.release_date) == ("Pg", ["rubygem-pg"], "Michael", "2023-04-24")
    pag = spark.createDataFrame([("mailcap", "https://pagure.io/mailcap", "2.1", "Mime", None)], "package string, url string, version string, inherited string, spec struct<description:string,license:string>")
    r = R.pagure(pag, ["package"]).first()
    assert (r.software, r.publisher, r.description) == ("Mailcap", "Red Hat", "Mime")


def test_metacpan_tells_every_module(spark):
    names = [f"Foo::M{k}" for k in range(30)]
    release = json.dumps({"distribution": "Foo", "main_module": "Foo::M0", "provides": names, "abstract": "All of Foo"})
    body = lambda n, d, of="Foo": {"documentation": n, "description": d, "distribution": of}
    several = json.dumps([body(n, "" if k == 1 else f"About {k}.") for k, n in enumerate(names)])
    bare = json.dumps({"distribution": "Foo", "abstract": "unknown"})
    rows = [
        ("a", release, several), ("b", release, json.dumps(body("Foo::M0", "About 0."))), ("Foo-Bar", bare, None),
        ("d", release, json.dumps(body("Foo::M3", "About 3.", "Foo-New"))), ("perl", json.dumps({"distribution": "perl"}), json.dumps({"description": "The language"})),
    ]
    df = spark.createDataFrame([(p, "u", None, r, None, m) for p, r, m in rows], "package string, url string, version string, release string, author string, module string")
    got = {r.package: r.description for r in R.metacpan(df, ["package"]).collect()}
    head = f"Foo is a distribution of Perl modules.\nThe modules included are: {', '.join(names)}."
    tell = lambda k: f"The following is a description of Foo::M{k}, {'the main module of' if k == 0 else 'one of the modules within'} the distribution: About {k}."
    assert got["a"] == "\n".join([head, *[tell(k) for k in range(30) if k != 1], "All of Foo"])
    assert got["b"] == "\n".join([head, tell(0), "All of Foo"])
    assert got["Foo-Bar"] == "Foo is a distribution of Perl modules.\nOne of the included modules is Foo::Bar."
    assert got["d"] == "Foo is a distribution of Perl modules. It provided the Foo::M3 module. At the present time, the mentioned module is a part of Foo-New distribution. The following is a description of the Foo::M3 module: About 3."
    assert got["perl"] == "The language"


def test_package_records(spark):
    found = spark.createDataFrame([("libboost-1.2", "Debian", "1.2.3", "libboost-1.2", "", "https://tracker/x")], "software string, publisher string, version string, source string, homepage string, tracker_url string")
    r = P.debian(found, ["software"]).first()
    assert (r.name, r.vendor, r.package_url) == ("boost", "Debian", "https://tracker/x")
    assert P.debian(found, ["software"], ubuntu=True).first().package_url == "https://launchpad.net/ubuntu/+source/libboost-1.2"
    results = spark.createDataFrame([(1, k, f"p{k}", f"pkg{k}") for k in range(3)] + [(2, 0, "openSUSE:Factory", "a"), (2, 1, "x", "b")], "id int, pos int, project string, package string")
    assert {(r.id, r.project, r.package) for r in P.opensuse_choice(results, ["id"]).collect()} == {(1, "p0", "pkg2"), (2, "openSUSE:Factory", "a")}
    search = spark.createDataFrame([(1, 0, "foo-git", "foo-git", "u0", "d", ["L"], "page", "foo"), (1, 1, "foo", "foobase", "u1", "d", ["L"], "page", "foo"), (1, 2, "foo", "foo", "u2", "d", ["L"], "page", "foo")], "id int, pos int, pkgname string, pkgbase string, url string, pkgdesc string, licenses array<string>, page_url string, raw string")
    r = P.arch(search, ["id"]).first()
    assert (r.name, r.homepage, r.licenses) == ("foo", "u2", ["L"])


def test_recognise(spark, folder):
    raw = images.package_fingerprints(spark, folder)
    tables = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("alpine_packages", "cpe_entities", "licenses", "software_info")]
    index = images.index(spark, folder)
    out = recognise(raw, index, *tables)
    rows = out.collect()
    assert rows and len({(r.fp_software, r.fp_publisher, r.fp_version) for r in rows}) == len(rows)
    assert recognise(raw, index, *tables[:3], out.unionByName(tables[3].select(out.columns))).count() == 0
    assert recognise(raw.where("false"), index, *tables).count() == 0


def sample(spark, **rows):
    empty = {
        "index": "package string, projectname_seed string, family string, description string, licenses array<string>, index_version string, homepage string, project_url string, package_url string, id bigint",
        "alpine": "package string, srcname string, homepage string, description string, licenses string", "cpe": "id bigint, publisher string, product string, version string",
        "licenses": "identifier string, name string, osi_approved boolean", "stored": "fp_software string, fp_publisher string, fp_version string",
    }
    return [spark.createDataFrame(rows.get(k, []), v) for k, v in empty.items()]


def test_every_way_of_recognition(spark):
    raw = spark.createDataFrame(
        [("python3-idle", "Debian", "3.11"), ("python3-defused", "Debian", "0.7"), ("perl-Class-Singleton", "Fedora Project", "1.5"), ("ruby-pg", "Ubuntu Developers", "1.5"), ("cham", "Debian", "4.4"), ("zlib", "Alpine Linux", "1.3"),
         ("aptlike", "Ubuntu Developers", "2.0"), ("mailer", "Fedora Project", "1.0"), ("archtool", "Arch Linux", "5"), ("nowhere", "Debian", "1"), ("lost", "CentOS", "1"), ("gone", "Debian", "1")],
        "software string, publisher string, version string",
    )
    ix = lambda i, p, fam, home, url=None, about=None: (p, p, fam, about, ["MIT"], "1.0", home, None, url, i)
    tables = sample(
        spark, index=[ix(1, "cham", "debuntu", "https://github.com/malthe/chameleon/tree/main"), ix(2, "lost", "centos", None, "https://pkgs.example/lost"), ix(3, "gone", "debuntu", "https://pypi.org/project/gone")],
        alpine=[("zlib", "zlib", "https://zlib.example", "Compression", "Zlib")], cpe=[(1, "zlib_team", "zlib", "1.3.1")], licenses=[("MIT", "MIT License", True), ("Zlib", "zlib License", True), ("BSD-3-Clause", "BSD 3", True)],
    )
    pypi = json.dumps({"info": {"name": "Defused", "author": "Tiran", "summary": "Guards.", "license": "MIT"}, "releases": {"0.7": [{"upload_time": "2021-03-04T10:00:00"}]}})
    hub = {"name": "Chameleon", "description": "A template engine", "license": {"name": "BSD-3-Clause "}}
    payloads = {
        "pypi": spark.createDataFrame([("https://pypi.org/project/defused", pypi), ("https://pypi.org/project/gone", None)], "url string, project string"),
        "metacpan": spark.createDataFrame([("https://fastapi.metacpan.org/v1/release/Class-Singleton", json.dumps({"distribution": "Class-Singleton", "author": "SHAY", "license": ["perl_5"]}), None, None)], "url string, release string, author string, module string"),
        "rubygem": spark.createDataFrame([("https://rubygems.org/api/v1/search.json?query=pg", json.dumps({"name": "pg", "info": "Pg", "authors": "Michael"}), None, None, None)], "url string, gem string, source_publisher string, source_description string, source_release_date string"),
        "github": spark.createDataFrame([("https://github.com/malthe/chameleon", json.dumps(hub), json.dumps({"name": "Malthe"}), None, None, None)], "url string, project string, owner string, readme string, license string, tag_commit string"),
    }
    spec = "name string, url string, description string, license string, macros map<string,string>"
    answers = {
        "ubuntu": spark.createDataFrame([("aptlike", "Ubuntu Developers", "2.0", "libaptlike2.0", None, None)], "software string, publisher string, version string, source string, homepage string, tracker_url string"),
        "fedora": spark.createDataFrame([("mailer", "Fedora Project", "1.0", ("mailer", "https://mailer.example", "Sends mail", "MIT", {}), None, "https://page")], f"software string, publisher string, version string, spec struct<{spec.replace(' string', ':string').replace(' map', ':map')}>, spec_url string, page_url string"),
        "arch": spark.createDataFrame([("archtool", "Arch Linux", "5", 0, "archtool", "archtool", "https://arch.example", "A tool", ["BSD-3-Clause"], "p", "archtool")], "software string, publisher string, version string, pos int, pkgname string, pkgbase string, url string, pkgdesc string, licenses array<string>, page_url string, raw string"),
    }
    pages = spark.createDataFrame([("https://github.com/none", "x", "y")], "url string, final_url string, text string")
    got = {r.fp_software: r for r in recognise(raw, *tables, payloads=payloads, answers=answers, pages=pages, model=lambda: FirstSentences(["MIT License"])).collect()}
    assert set(got) == {"python3-idle", "python3-defused", "perl-Class-Singleton", "ruby-pg", "cham", "zlib", "aptlike", "mailer", "archtool", "lost"}
    tell = {k: (r.software, r.publisher, r.homepage, r.licenses, r.release_date) for k, r in got.items()}
    assert tell["python3-defused"] == ("Defused", "Tiran", "https://pypi.org/project/defused", ["MIT License"], "2021-03-04")
    assert tell["perl-Class-Singleton"][:2] == ("Class-Singleton", "SHAY") and tell["ruby-pg"][:2] == ("Pg", "Michael")
    assert tell["cham"] == ("Chameleon", "Malthe", "https://github.com/malthe/chameleon", ["BSD 3"], "")
    assert tell["zlib"] == ("zlib", "Zlib Team", "https://zlib.example", ["zlib License"], "") and got["zlib"].cpe_string == "cpe:2.3:a:zlib_team:zlib:"
    assert tell["aptlike"] == ("aptlike", "Canonical", "https://launchpad.net/ubuntu/+source/libaptlike2.0", [], "")
    assert tell["mailer"] == ("mailer", "mailer", "https://mailer.example", ["MIT License"], "") and tell["archtool"][:3] == ("archtool", "archtool", "https://arch.example")
    assert tell["lost"] == ("lost", "CentOS", "https://pkgs.example/lost", ["MIT License"], "")
    assert (got["python3-idle"].licenses, got["python3-idle"].unspsc, got["python3-idle"].publisher_alternative) == (["Python Software Foundation License"], "43232311", ["Python"])


def test_license_fallback(spark):
    licenses = spark.createDataFrame([("Foo-2.0-or-later", "Foo License 2", True), ("Bar-1", "Bar License", True), (None, "Nameless", None)], "identifier string, name string, osi_approved boolean")
    values = spark.createDataFrame([(1, 0, "Qux"), (1, 1, "Foo-2.0-or-later"), (1, 2, "foo-2.0-or-LATER"), (1, 3, "Bar-1"), (2, 0, None), (3, 0, ""), (3, 1, "Qux")], "id int, at int, identifier string")
    names, kept = identity.resolve_licenses(values, licenses, ["id"])
    assert {r.id: r.names for r in names.collect()} == {1: ["Foo License 2", "Bar License", "Foo License 2", "Qux"], 3: ["", "Qux"]}
    assert {r.identifier for r in kept.collect()} == {"Qux", ""}
    names, kept = identity.resolve_licenses(values.where("false"), licenses, ["id"])
    assert names.count() == 0 and kept.count() == 0


def test_vendors(spark):
    df = spark.createDataFrame([("Ubuntu Developers",), ("openSUSE",), ("Rocky",), ("Arch Linux",), ("Red Hat",), (None,)], "p string")
    from pkgloom.functions import names as N

    assert [tuple(r) for r in df.select(N.vendor(F.col("p")), N.record_vendor(F.col("p"))).collect()] == [
        ("Ubuntu", "Canonical"), ("openSUSE", "OpenSuse"), ("Rocky Enterprise Software Foundation", "Rocky Enterprise Software Foundation"), (None, "Arch Linux"), ("Red Hat", "Fedora"), (None, None)
    ]
    pages = spark.createDataFrame([("foo-x", "https://x/foo", ""), ("ab-c", "https://q", "ab and c"), ("ab-c", "https://ab", "c only"), ("foo", "https://bar", "none")], "p string, u string, t string")
    assert [r[0] for r in pages.select(N.related_page(F.col("p"), F.col("u"), F.col("t"))).collect()] == [True, True, False, False]


def test_providers(spark):
    df = spark.createDataFrame([("One. Two! Three.", "x"), (None, None)], "description string, software string")
    assert {r.definition for r in define_texts(df, FirstSentences).collect()} == {"One. Two!", ""}
    names = extract_licenses(df.withColumn("description", F.lit("under the Foo License")), lambda: FirstSentences(["Foo License", "Bar"]), "description", "software")
    assert names.first().found_licenses == ["Foo License"]


def test_release_ways(spark):
    asked = spark.createDataFrame([(1, "1.2", None), (2, "1.2", None), (3, "2.0", None), (4, "9", None), (5, "", None)], "id int, version string, version_suffix string")
    tags = spark.createDataFrame([(1, "v1.2", "2020-01-02T00", 1, 0), (1, "1.2.0", "2021-01-01", 2, 0), (2, "v1.23", "2020-05-05", 0, 0), (3, "v2.0rc1", "2019-01-01", 0, 0), (3, "v2.0.1", None, 0, 1)], "id int, name string, date string, page int, pos int")
    by_tag = releases.by_tag(asked, tags, ["id"])
    assert {(r.id, r.name, r.release_date, r.is_exact) for r in by_tag.collect()} == {(1, "v1.2", "2020-01-02", True), (3, "v2.0.1", "", False)}
    log = spark.createDataFrame([(2, "1.3 (2022-02-02)\n1.2 (2021-03-04)\n"), (3, "2.0 - 5 May 2020"), (4, None)], "id int, text string")
    by_log = releases.by_changelog(asked, log, ["id"])
    assert {(r.id, r.release_date) for r in releases.first_known(asked, ["id"], by_tag, by_log).collect()} == {(1, "2020-01-02"), (2, "2021-03-04"), (3, "2020-05-05"), (4, ""), (5, "")}
    assert releases.by_feed(asked, spark.createDataFrame([], "id int, body string"), ["id"]).count() == 0


def test_perl_releases(spark):
    release = json.dumps({"distribution": "Foo", "version": "2.0", "date": "2024-01-01T10:00"})
    other = json.dumps([{"version": "1.5", "date": "2020-02-03T00:00"}])
    rows = [("a", "2.0", None, None), ("b", "1.5", other, None), ("c", "1.2", other, "1.2 2019-04-05\n - fix"), ("d", "0.1", None, None)]
    df = spark.createDataFrame([(p, "u", v, None, release, None, None, o, c, None) for p, v, o, c in rows], "package string, url string, version string, version_suffix string, release string, author string, module string, author_releases string, changes string, latest_changes string")
    assert {r.package: (r.release_version, r.release_date) for r in R.metacpan(df, ["package"]).collect()} == {"a": ("2.0", "2024-01-01"), "b": ("1.5", "2020-02-03"), "c": ("1.2", "2019-04-05"), "d": ("2.0", "2024-01-01")}
