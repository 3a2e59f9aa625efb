"""Package records of the distributions: name, vendor, homepage, package_url, description, licenses.

Alpine and the universal index are pure joins; the others project search results and spec files. Results of several
ways are united with a priority and the first that names an address is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgloom.functions import names as N
from pkgloom.operators.lookup import best_of

FIELDS = ["name", "vendor", "homepage", "package_url", "description", "licenses"]


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def record(df: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    out = {f: F.lit("") for f in FIELDS} | {"licenses": F.array().cast("array<string>")} | values
    return df.select(*keys, *[(out[f] if f == "licenses" else filled(out[f])).alias(f) for f in FIELDS])


def from_index(found: DataFrame, keys: list[str], own_records: bool = False) -> DataFrame:
    """Universal record of rows found in the package index (software, publisher, version and the index columns). With
    ``own_records`` the vendor is that of the distribution's own package records."""
    name = N.without_version_suffix(F.coalesce("projectname_seed", "software"), F.col("version"))
    home = F.coalesce(F.nullif("homepage", F.lit("")), "project_url")
    return record(
        found, keys, name=name, vendor=(N.record_vendor if own_records else N.vendor)(F.col("publisher")), homepage=home, package_url=F.coalesce(home, "package_url"),
        description=F.col("description"), licenses=F.coalesce("licenses", F.array().cast("array<string>")),
    )


def debian(found: DataFrame, keys: list[str], ubuntu: bool = False) -> DataFrame:
    """Rows with source, homepage (two-hop lookup) and tracker_url (sources search); names lose lib prefix and version."""
    name = N.without_lib(N.without_version_suffix(F.coalesce("source", "software"), F.col("version")))
    page = F.concat(F.lit("https://launchpad.net/ubuntu/+source/"), "source") if ubuntu else F.col("tracker_url")
    return record(
        found, keys, name=name, vendor=F.lit("Canonical" if ubuntu else "Debian"), homepage=F.col("homepage"),
        package_url=F.coalesce(F.nullif("homepage", F.lit("")), page),
    )


def fedora(found: DataFrame, keys: list[str], vendor: str = "Fedora") -> DataFrame:
    """Rows with spec (parsed struct), spec_url and page_url."""
    name = F.coalesce(F.col("spec.macros")["srcname"], F.col("spec.macros")["package_name"], F.col("spec.name"), F.col("software"))
    return record(
        found, keys, name=N.without_version_suffix(name, F.col("version")), vendor=F.lit(vendor), homepage=F.col("spec.url"),
        package_url=F.coalesce("spec_url", "page_url"), description=F.col("spec.description"),
        licenses=F.when(F.col("spec.license").isNotNull(), F.array(N.without_license_ref(F.col("spec.license")))).otherwise(F.array().cast("array<string>")),
    )


def opensuse_choice(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the search result to follow: the last whose project names suse, else the last package under the first
    result's project. Results have pos, project and package."""
    w = Window.partitionBy(*keys)
    return (
        results.withColumn("suse_", F.max(F.when(F.lower("project").contains("suse"), F.col("pos"))).over(w))
        .withColumn("last_", F.max("pos").over(w))
        .withColumn("first_project_", F.min_by("project", "pos").over(w))
        .where("pos = coalesce(suse_, last_)")
        .select(*keys, F.when(F.col("suse_").isNull(), F.col("first_project_")).otherwise(F.col("project")).alias("project"), "package")
    )


def alpine(fingerprints: DataFrame, packages: DataFrame) -> DataFrame:
    """Exact-name lookup in the merged index files."""
    keys = fingerprints.columns
    found = fingerprints.withColumn("package", F.replace("software", F.lit(" "), F.lit("-"))).join(packages, "package")
    return record(
        found, keys, name=F.coalesce(F.nullif("srcname", F.lit("")), "software"), vendor=F.lit("Alpine Linux"), homepage=F.col("homepage"),
        package_url=F.col("homepage"), description=F.col("description"),
        licenses=F.when(filled(F.col("licenses")) != "", F.array("licenses")).otherwise(F.array().cast("array<string>")),
    )


def arch(results: DataFrame, keys: list[str]) -> DataFrame:
    """Search results (pos, pkgname, pkgbase, url, pkgdesc, licenses, page_url, raw): of the exactly named ones, or of
    those that hold a hyphenated name, a base package first."""
    named = results.where((F.col("pkgname") == F.col("raw")) | (F.col("raw").contains("-") & F.col("pkgname").contains(F.col("raw"))))
    exact = (F.col("pkgname") != F.col("raw")).cast("int")
    base = (F.coalesce("pkgbase", F.lit("")) != F.col("pkgname")).cast("int")
    chosen = best_of(named, keys, [exact, base, F.col("pos")])
    return record(
        chosen, keys, name=F.coalesce("pkgbase", "pkgname"), vendor=F.lit("Arch Linux"), homepage=F.col("url"), package_url=F.coalesce("url", "page_url"),
        description=F.col("pkgdesc"), licenses=F.coalesce("licenses", F.array().cast("array<string>")),
    )


#: What a distribution's own tables of answers must hold beside the key software, publisher, version.
OWN_WAYS = {"debian": debian, "ubuntu": lambda found, keys: debian(found, keys, ubuntu=True), "fedora": fedora, "opensuse": lambda found, keys: fedora(found, keys, "OpenSuse"), "arch": arch}
#: Which of these a publisher's distribution takes.
OWN_WAY_OF = {"debian": "debian", "ubuntu": "ubuntu", "fedora": "fedora", "red hat": "fedora", "amazon": "fedora", "opensuse": "opensuse", "suse": "opensuse", "arch": "arch"}


def own_records(fingerprints: DataFrame, answers: dict[str, DataFrame], keys: list[str]) -> DataFrame | None:
    """Records out of the answers of the distributions' own services, ``answers``: name in OWN_WAYS -> table with the key and
    the columns that the record takes. Null without any answers."""
    united = None
    way = F.lit(None).cast("string")
    for name, taken in OWN_WAY_OF.items():
        way = F.when(N.distribution(F.col("publisher")) == name, F.lit(taken)).otherwise(way)
    asked = fingerprints.select(*keys).withColumn("way_", way)
    for name, table in answers.items():
        mine = asked.where(F.col("way_") == name).drop("way_").join(table, keys)
        one = OWN_WAYS[name](mine, keys).select(*keys, *FIELDS)
        united = one if united is None else united.unionByName(one)
    return united


def first_way(keys: list[str], *ways: DataFrame | None) -> DataFrame:
    """Of several ways in order of priority, per key the first with an address."""
    united = None
    for k, way in enumerate(ways):
        if way is None:
            continue
        one = way.select(*keys, *FIELDS).withColumn("way", F.lit(k))
        united = one if united is None else united.unionByName(one)
    return best_of(united.where("package_url <> ''"), keys, [F.col("way"), F.col("name"), F.col("package_url")])


def best_repository(repositories: DataFrame, keys: list[str]) -> DataFrame:
    """Of an owner's repositories (pos, package, repo, url) that whose name parts are the package's, else the first whose
    parts contain the package's or are contained in them."""
    def parts(c: str) -> Column:
        return F.split(F.lower(c), r"[-_\s]+")

    mine, theirs = parts("package"), parts("repo")
    fits = (F.size(F.array_except(mine, theirs)) == 0) | (F.size(F.array_except(theirs, mine)) == 0)
    hits = repositories.where((filled(F.col("repo")) != "") & (filled(F.col("url")) != "")).where(fits)
    return best_of(hits, keys, [(mine != theirs).cast("int"), F.col("pos")])
