"""Project records out of the payloads of public services.

A payload row holds the JSON bodies that a service returned for one asked package; missing bodies are null. Every
resolver maps its payload columns to the same record, so that the results can be united by name:
software, software_alternative, publisher, publisher_alternative, homepage, description, licenses, license_text,
release_version, release_date. A member of the wrong type counts as missing, and '' is the missing text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgloom.functions.names import distinct_names, title
from pkgloom.functions.versions import changelog_date, exact_pattern

#: Texts from which a description or license is made are cut to so many characters.
HEAD = 4_096
#: At most so many lines of a long PyPI description are told.
LINES = 25
FIELDS = [
    "software", "software_alternative", "publisher", "publisher_alternative", "homepage", "description", "licenses",
    "license_text", "release_version", "release_date",
]


def empty() -> Column:
    return F.array().cast("array<string>")


def text(body: Column | str, path: str) -> Column:
    """A string member, '' where it is missing or no string."""
    column = F.col(body) if isinstance(body, str) else body
    raw = F.get_json_object(column, path)
    return F.when(F.coalesce(raw, F.lit("")).rlike(r"^\s*[\[{]"), F.lit("")).otherwise(F.coalesce(raw, F.lit("")))


def strings(body: str, path: str) -> Column:
    """A member that is a list of strings, empty otherwise."""
    return F.coalesce(F.from_json(F.get_json_object(body, path), "array<string>"), empty())


def first(*columns: Column) -> Column:
    """The first text that is not empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def segment(url: Column | str, back: int = 1) -> Column:
    """A path segment of an address, counted from the end."""
    column = F.col(url) if isinstance(url, str) else url
    path = F.regexp_replace(F.regexp_replace(column, r"^(?:https?://)?[^/]*/?", ""), r"[/?#]+$", "")
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-back)), F.lit(""))


def record(df: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """The common record: alternatives never repeat the name, in any case of letters."""
    defaults = {
        "software": F.lit(""), "software_alternative": empty(), "publisher": F.lit(""), "publisher_alternative": empty(), "homepage": F.lit(""),
        "description": F.lit(""), "licenses": empty(), "license_text": F.lit(""), "release_version": F.lit(""), "release_date": F.lit(""),
    } | values
    staged = df.select(*keys, *[defaults[f].alias(f) for f in FIELDS])
    return staged.withColumn("software_alternative", distinct_names(F.col("software_alternative"), F.array("software"))).withColumn(
        "publisher_alternative", distinct_names(F.col("publisher_alternative"), F.array("publisher"))
    )


def told(*columns: Column, least: int = 10) -> Column:
    """The first text of at least so many characters."""
    out = F.lit("")
    for c in reversed(columns):
        out = F.when(F.length(c) >= least, c).otherwise(out)
    return out


def given(df: DataFrame, column: str) -> Column:
    """A column that a payload may lack, '' where it does."""
    return F.coalesce(F.col(column), F.lit("")) if column in df.columns else F.lit("")


def known_license(name: Column) -> Column:
    return F.when((name != "") & ~F.lower(name).contains("other"), F.array(name)).otherwise(empty())


def github(df: DataFrame, keys: list[str]) -> DataFrame:
    """Payload: package, url, version, inherited, project, owner, readme (base64 JSON), license (JSON), tag_commit, and release_date
    where ``releases`` found one in a changelog or among the tags."""
    readme = F.coalesce(F.unbase64(F.regexp_replace(text("readme", "$.content"), r"\s", "")).cast("string"), F.lit(""))
    raw = F.coalesce(F.unbase64(F.regexp_replace(text("license", "$.content"), r"\s", "")).cast("string"), F.lit(""))
    named = F.when(F.size(known_license(text("project", "$.license.name"))) > 0, text("project", "$.license.name")).otherwise(text("license", "$.license.name"))
    name = first(text("project", "$.name"), segment("url"), F.col("package"))
    login, owner = text("owner", "$.login"), segment("url", 2)
    return record(
        df, keys,
        software=name, software_alternative=F.array(segment("url"), "package"),
        publisher=first(text("owner", "$.name"), login, owner), publisher_alternative=F.array(login, owner),
        homepage=first(text("project", "$.homepage"), F.col("url")),
        description=told(text("project", "$.description"), F.coalesce("inherited", F.lit("")), F.trim(F.concat_ws(" ", text("project", "$.description"), F.substring(readme, 1, HEAD))), least=10),
        licenses=known_license(named), license_text=F.when(F.size(known_license(named)) == 0, F.substring(raw, 1, HEAD)).otherwise(F.lit("")),
        release_version=F.coalesce("version", F.lit("")), release_date=first(given(df, "release_date"), F.substring(text("tag_commit", "$.commit.committer.date"), 1, 10)),
    )


def gitlab(df: DataFrame, keys: list[str]) -> DataFrame:
    """Payload: package, url, version, inherited, project, readme and license_file (texts), tag (JSON), and release_date as above."""
    name = first(text("project", "$.name"), text("project", "$.path"))
    space = first(text("project", "$.namespace.name"), text("project", "$.namespace.path"), F.regexp_extract("url", r"\.([^./]+)\.org", 1))
    named = first(text("project", "$.license.name"), text("project", "$.license.key"))
    head = F.regexp_extract(F.coalesce("license_file", F.lit("")), r"(?s)^((?:[^\n]*\n){0,5}.*?)(?:\n\s*\n|$)", 1)
    return record(
        df, keys,
        software=name, software_alternative=F.array(text("project", "$.path"), "package"),
        publisher=space, publisher_alternative=F.array(text("project", "$.namespace.path")),
        homepage=first(text("project", "$.web_url"), F.col("url")),
        description=told(text("project", "$.description"), F.coalesce("inherited", F.lit("")), F.substring(F.coalesce("readme", F.lit("")), 1, HEAD)),
        licenses=known_license(named), license_text=F.when(F.size(known_license(named)) == 0, head).otherwise(F.lit("")),
        release_version=F.coalesce("version", F.lit("")), release_date=first(given(df, "release_date"), F.substring(text("tag", "$.commit.committed_date"), 1, 10)),
    )


def pagure(df: DataFrame, keys: list[str]) -> DataFrame:
    """Payload: package, url, version, inherited, spec (parsed struct or null)."""
    return record(
        df, keys,
        software=title(segment("url")), software_alternative=F.array("package"), publisher=F.lit("Red Hat"), homepage=F.col("url"),
        description=first(F.coalesce("inherited", F.lit("")), F.coalesce(F.col("spec.description"), F.lit(""))),
        licenses=F.when(F.col("spec.license").isNotNull(), F.array("spec.license")).otherwise(empty()),
        release_version=F.coalesce("version", F.lit("")),
    )


def perl_release(df: DataFrame) -> tuple[Column, Column]:
    """(version, day) of a Perl distribution's release, see ``metacpan``."""
    latest, latest_day = text("release", "$.version"), F.substring(text("release", "$.date"), 1, 10)
    if not {"author_releases", "changes", "latest_changes"} & set(df.columns):
        return first(latest, F.coalesce("version", F.lit(""))), latest_day
    asked = F.coalesce("version", F.lit(""))
    suffix = F.nullif(given(df, "version_suffix"), F.lit(""))
    exact = exact_pattern(asked, suffix)
    own = (asked == "") | F.regexp(latest, exact)
    listed = F.coalesce(F.from_json(given(df, "author_releases"), "array<struct<version:string,date:string>>"), F.from_json(F.lit("[]"), "array<struct<version:string,date:string>>"))
    theirs = F.get(F.filter(listed, lambda r: F.regexp(F.coalesce(r["version"], F.lit("")), exact)), F.lit(0))
    told = [F.coalesce(changelog_date(given(df, c), asked, suffix), F.lit("")) for c in ("changes", "latest_changes")]
    in_changes = first(*told)
    version = F.when(own, first(latest, asked)).when(theirs.isNotNull() | (in_changes != ""), F.coalesce(theirs["version"], asked)).otherwise(first(latest, asked))
    day = F.when(own, latest_day).when(theirs.isNotNull(), F.substring(F.coalesce(theirs["date"], F.lit("")), 1, 10)).when(in_changes != "", in_changes).otherwise(latest_day)
    return version, day


def metacpan(df: DataFrame, keys: list[str]) -> DataFrame:
    """Payload: package, url, version, release, author, module (JSON bodies; module is one body or a list of them in order), and
    where the service gave them version_suffix, author_releases (a list of release bodies), changes and latest_changes (texts).

    The release is the asked one if ``release`` or one of the author's is of that version; else a changelog may tell its day; else
    it is the latest one. A distribution is obsolete when a module of it now belongs to another one. Every described module is told, once."""
    name = first(text("release", "$.distribution"), F.col("package"))
    alone = text("release", "$.provides")
    modules = F.when(alone != "", F.array(alone)).otherwise(strings("release", "$.provides"))
    listing = F.when(F.trim("module").startswith("["), F.col("module")).otherwise(F.concat(F.lit("["), "module", F.lit("]")))
    bodies = F.filter(F.coalesce(F.from_json(listing, "array<string>"), empty()), lambda x: x.isNotNull())
    asked = F.regexp_replace("package", "-", "::")
    called = lambda x: first(text(x, "$.documentation"), text(x, "$.module[0].name"), asked)
    perl = F.lower(name) == "perl"
    moved = F.get(F.filter(bodies, lambda x: (text(x, "$.distribution") != "") & (text(x, "$.distribution") != name)), F.lit(0))
    told_modules = F.aggregate(
        bodies, F.lit(""),
        lambda merged, x: F.when(F.trim(text(x, "$.description")) == "", merged).otherwise(F.concat(
            merged, F.when(merged != "", F.lit("\n")).otherwise(F.lit("")), F.lit("The following is a description of "), called(x),
            F.when(called(x) == text("release", "$.main_module"), F.lit(", the main module of")).otherwise(F.lit(", one of the modules within")),
            F.lit(" the distribution: "), F.trim(text(x, "$.description")),
        )),
    )
    opening = F.when(perl, F.coalesce(F.trim(text(F.get(bodies, F.lit(0)), "$.description")), F.lit(""))).otherwise(F.concat(name, F.lit(" is a distribution of Perl modules.")))
    provided = (
        F.when(F.size(modules) > 0, F.concat(F.lit("The modules included are: "), F.array_join(modules, ", "), F.lit(".")))
        .when(~perl, F.concat(F.lit("One of the included modules is "), F.coalesce(F.when(F.size(bodies) > 0, called(F.get(bodies, F.lit(0)))), asked), F.lit(".")))
    )
    abstract = text("release", "$.abstract")
    present = F.concat_ws(
        "\n", F.nullif(opening, F.lit("")), provided, F.when(~perl, F.nullif(told_modules, F.lit(""))),
        F.when(~abstract.isin("", "unknown"), abstract),
    )
    about = F.trim(text(moved, "$.description"))
    obsolete = F.concat(
        opening, F.lit(" It provided the "), called(moved), F.lit(" module. At the present time, the mentioned module is a part of "),
        text(moved, "$.distribution"), F.lit(" distribution."),
        F.when(about != "", F.concat(F.lit(" The following is a description of the "), called(moved), F.lit(" module: "), about)).otherwise(F.lit("")),
    )
    author = first(text("author", "$.name"), text("release", "$.author"), F.lit("CPAN"))
    listed = strings("release", "$.license")
    licenses = F.when(F.size(listed) == 0, F.array(F.lit("perl_5"))).otherwise(listed)
    version, day = perl_release(df)
    return record(
        df, keys,
        software=name,
        software_alternative=F.concat(F.array(F.concat(F.lit("perl-"), name), F.concat(F.lit("lib"), F.lower(name), F.lit("-perl"))), modules),
        publisher=F.when(F.lower(name) == "perl", F.lit("Perl")).otherwise(author), publisher_alternative=F.array(text("release", "$.author")),
        homepage=first(text("release", "$.resources.homepage.web"), text("release", "$.resources.homepage"), F.concat(F.lit("https://metacpan.org/dist/"), name)),
        description=F.when(moved.isNotNull() & ~perl, obsolete).otherwise(present),
        licenses=F.flatten(F.transform(licenses, lambda x: F.when(x == "perl_5", F.array(F.lit("Artistic-1.0-Perl"), F.lit("GPL-1.0-or-later"))).otherwise(F.array(x)))),
        release_version=version, release_date=day,
    )


def sourceforge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Payload: package, url, version, inherited, project (JSON), release_date."""
    developers = F.coalesce(F.from_json(F.get_json_object("project", "$.developers"), "array<struct<name:string,username:string>>"), F.array().cast("array<struct<name:string,username:string>>"))
    people = F.array_sort(F.transform(developers, lambda x: first(F.coalesce(x["name"], F.lit("")), F.coalesce(x["username"], F.lit("")))))
    external = text("project", "$.external_homepage")
    named = F.coalesce(F.from_json(F.get_json_object("project", "$.categories.license"), "array<struct<fullname:string,shortname:string>>"), F.array().cast("array<struct<fullname:string,shortname:string>>"))
    name = first(text("project", "$.name"), text("project", "$.shortname"), title(segment("url")))
    return record(
        df, keys,
        software=name, software_alternative=F.array(text("project", "$.shortname"), "package"),
        publisher=F.when(F.size(people) == 0, F.lit("SourceForge")).otherwise(F.array_join(people, ", ")),
        homepage=F.when((external != "") & ~F.lower(external).contains("sourceforge"), external).otherwise(F.col("url")),
        description=first(text("project", "$.short_description"), F.coalesce("inherited", F.lit(""))),
        licenses=F.transform(named, lambda x: first(F.coalesce(x["fullname"], F.lit("")), F.coalesce(x["shortname"], F.lit("")))),
        release_version=F.coalesce("version", F.lit("")), release_date=F.coalesce("release_date", F.lit("")),
    )


def pypi_release(project: str, version: str, suffix: str) -> Column:
    """(version, date) of the first release whose name is exactly the version."""
    releases = F.map_entries(F.coalesce(F.from_json(F.get_json_object(project, "$.releases"), "map<string,array<struct<upload_time:string>>>"), F.expr("map()").cast("map<string,array<struct<upload_time:string>>>")))
    exact = exact_pattern(F.col(version), F.col(suffix))
    return F.get(F.filter(releases, lambda r: F.regexp(r["key"], exact)), F.lit(0))


def pypi(df: DataFrame, keys: list[str]) -> DataFrame:
    """Payload: package, url, version, version_suffix, project (JSON), and release_date where the project's feed has one."""
    lines = F.split(text("project", "$.info.description"), r"\r?\n")
    kept = F.slice(F.filter(F.transform(lines, F.trim), lambda x: (x != "") & ~x.rlike(r"^(?:\.\. |!\[|\[!|https?://|:target:|:alt:)")), 1, LINES)
    owner = F.regexp_extract(text("project", "$.info.home_page"), r"^https?://(?:www\.)?git(?:hub|lab)\.com/([^/]+)", 1)
    release = pypi_release("project", "version", "version_suffix")
    return record(
        df.withColumn("release_", release), keys,
        software=first(text("project", "$.info.name"), segment("url"), F.col("package")), software_alternative=F.array("package"),
        publisher=first(text("project", "$.info.author"), title(owner)), publisher_alternative=F.array(title(owner)),
        homepage=first(text("project", "$.info.home_page"), text("project", "$.info.project_urls.Homepage"), text("project", "$.info.project_url"), F.col("url")),
        description=F.trim(F.concat_ws(" ", F.nullif(text("project", "$.info.summary"), F.lit("")), F.nullif(F.array_join(kept, " "), F.lit("")))),
        licenses=F.when(text("project", "$.info.license") != "", F.array(text("project", "$.info.license"))).otherwise(empty()),
        release_version=F.coalesce("version", F.lit("")),
        release_date=first(F.coalesce(F.substring(F.get(F.col("release_.value"), F.lit(0))["upload_time"], 1, 10), F.lit("")), given(df, "release_date")),
    )


def rubygem(df: DataFrame, keys: list[str]) -> DataFrame:
    """Payload: package, url, version, inherited, gem (JSON), and the record of the source project where there is one
    (columns source_publisher, source_description, source_release_date), and release_date where the gem's changelog has one."""
    info = text("gem", "$.info")
    spelled = F.regexp_substr(info, F.concat(F.lit(r"(?i)\b"), F.regexp_replace("package", r"([^\p{L}\p{Nd}])", r"\\$1"), F.lit(r"\b")))
    return record(
        df, keys,
        software=first(F.coalesce(spelled, F.lit("")), text("gem", "$.name"), F.col("package")), software_alternative=F.array("package", F.concat(F.lit("rubygem-"), "package")),
        publisher=first(F.coalesce("source_publisher", F.lit("")), text("gem", "$.authors")),
        homepage=first(text("gem", "$.homepage_uri"), text("gem", "$.project_uri"), F.col("url")),
        description=first(info, F.coalesce("inherited", F.lit("")), F.coalesce("source_description", F.lit(""))),
        licenses=strings("gem", "$.licenses"),
        release_version=F.coalesce("version", F.lit("")), release_date=first(given(df, "release_date"), F.coalesce("source_release_date", F.lit(""))),
    )


RESOLVERS = {"github": github, "gitlab": gitlab, "pagure": pagure, "metacpan": metacpan, "sourceforge": sourceforge, "pypi": pypi, "rubygem": rubygem}
