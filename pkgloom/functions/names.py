"""Expressions over package names, licenses, versions and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pkgloom.functions.normalize import let

# Distributions in the order in which they are looked for, with package family and the vendor that their own
# package records name (null: the record comes from the index, see INDEX_VENDORS).
DISTRIBUTIONS = [
    ("debian", "debuntu", "Debian"), ("ubuntu", "debuntu", "Canonical"), ("fedora", "fedora", "Fedora"),
    ("red hat", "fedora", "Fedora"), ("opensuse", "opensuse", "OpenSuse"), ("suse", "opensuse", "OpenSuse"),
    ("alpine", "alpine", "Alpine Linux"), ("amazon", "fedora", "Fedora"), ("rocky", "centos", None),
    ("alma", "centos", None), ("centos", "centos", None), ("arch", "arch", "Arch Linux"),
]

# Vendors of records that come from the package index, in the order in which they are looked for.
INDEX_VENDORS = [
    ("debian", "Debian"), ("ubuntu", "Ubuntu"), ("fedora", "Fedora"), ("red hat", "Red Hat"), ("opensuse", "openSUSE"), ("suse", "SUSE"),
    ("alpine", "Alpine Linux"), ("amazon", "Amazon"), ("rocky", "Rocky Enterprise Software Foundation"), ("alma", "AlmaLinux"), ("centos", "CentOS"),
]

# What a host must contain for a public project service.
HOSTS = [
    ("github", ["github.com"]), ("gitlab", ["gitlab.", "invent.kde."]), ("metacpan", ["metacpan."]),
    ("pagure", ["pagure."]), ("pypi", ["pypi."]), ("rubygem", ["rubygems."]), ("sourceforge", ["sourceforge."]),
]


def distribution(publisher: Column) -> Column:
    """The first distribution whose name is part of the publisher."""
    out = F.lit(None).cast("string")
    for name, _, _ in reversed(DISTRIBUTIONS):
        out = F.when(F.lower(publisher).contains(name), F.lit(name)).otherwise(out)
    return out


def family(publisher: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kind, _ in reversed(DISTRIBUTIONS):
        out = F.when(F.lower(publisher).contains(name), F.lit(kind)).otherwise(out)
    return out


def vendor(publisher: Column) -> Column:
    """The vendor of a record from the package index."""
    out = F.lit(None).cast("string")
    for name, maker in reversed(INDEX_VENDORS):
        out = F.when(F.lower(publisher).contains(name), F.lit(maker)).otherwise(out)
    return out


def record_vendor(publisher: Column) -> Column:
    """The vendor that a distribution's own package record names; that of the index for distributions without such records."""
    out = F.lit(None).cast("string")
    for name, _, maker in reversed(DISTRIBUTIONS):
        out = F.when(F.lower(publisher).contains(name), F.lit(maker).cast("string")).otherwise(out)
    return F.coalesce(out, vendor(publisher))


def host(url: Column) -> Column:
    text = F.coalesce(url, F.lit(""))
    return F.lower(F.regexp_extract(text, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1))


def project_service(url: Column, strict: bool = False) -> Column:
    """The public service that hosts a project address, null for none. An address needs a host and a path.
    ``strict`` keeps the historical misspelling under which gem addresses are never recognised."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]+(/[^?#]*)", 1)
    out = F.lit(None).cast("string")
    for name, keys in reversed(HOSTS):
        keys = ["rubgems."] if strict and name == "rubygem" else keys
        hit = F.lit(False)
        for key in keys:
            hit = hit | host(url).contains(key)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.when(F.length(path) > 0, out)


def supported_host(url: Column) -> Column:
    hit = F.lit(False)
    for _, keys in HOSTS:
        for key in keys:
            hit = hit | host(url).contains(key)
    return F.coalesce(hit, F.lit(False)) & (F.coalesce(url, F.lit("")) != "")


def corrected_url(url: Column, package: Column | None = None) -> Column:
    """The address that a project is read from: a code host's cut to owner and repository, a download site's to the
    project, a Perl index address turned into that of the release; others stay. A Perl address without a path takes the
    distribution from the package name. A repository whose name has a dot is a page of its owner (see ``owner_page``)."""
    text = F.regexp_replace(url, r"[?#].*$", "")
    github = F.regexp_extract(text, r"github\.com/([^/]+/[^/]+)", 1)
    forge = F.regexp_extract(text, r"^(.*?sourceforge\.net/projects/[^/]+)", 1)
    bare = F.regexp_replace(text, "/+$", "")
    path = F.regexp_extract(bare, r"^(?:https?://)?+[^/]+/(.+)$", 1)
    named = F.coalesce(F.nullif(F.regexp_extract(path, "([^/]+)$", 1), F.lit("")), package if package is not None else F.lit(None).cast("string"))
    release = F.regexp_replace(F.regexp_replace(named, r"-\d+\.\d+", ""), "::", "-")
    return (
        F.when(github != "", F.concat(F.lit("https://github.com/"), github))
        .when(forge != "", forge)
        .when(host(url).contains("fastapi.metacpan."), bare)
        .when(host(url).contains("metacpan.") & release.isNotNull(), F.concat(F.lit("https://fastapi.metacpan.org/v1/release/"), release))
        .otherwise(url)
    )


def owner_page(url: Column) -> Column:
    """Whether a code host's address names a page of its owner, so that the repository has to be looked for."""
    return F.regexp_extract(url, r"github\.com/[^/]+/([^/?#]+)", 1).contains(".")


def service_name(url: Column) -> Column:
    """The project's name in the address of a package service, '' for none."""
    return F.regexp_extract(url, r"(?:pypi\.[^/]+/(?:project|pypi)|rubygems\.org/gems|sourceforge\.net/projects|github\.com/[^/]+)/([^/?#]+)", 1)


def without_version_suffix(name: Column, version: Column) -> Column:
    """The name without its longest ending that begins the version."""
    n = F.coalesce(name, F.lit(""))
    at = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(n), F.lit(1))),
        lambda i: (F.length(n) > 0) & F.startswith(F.coalesce(version, F.lit("")), F.substring(n, i, F.length(n))),
    )
    return let(
        F.get(at, F.lit(0)), lambda i: F.when(i.isNull(), n).otherwise(F.rtrim(F.substring(n, F.lit(1), i - 1), F.lit(" -")))
    )


def without_lib(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)^lib(?!rary|ert|erat|ellous)-?", "")


def title(text: Column) -> Column:
    """Capital after every character that is no letter, lower case elsewhere."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


# How library packages of three languages are named, and the parts of the Python distribution.
PYTHON = r"(?i)python([23]\d{0,2})[\s-]+([^\s-]\S*)"
RUBY = r"(?i)ruby(?:gem)?[\s-]+([^\s-]\S*)"
PERL = r"(?i)perl-\s*([^\s-].+)$|^lib([^\s-].+)-\s*perl$"


def library_language(name: Column) -> Column:
    return F.when(name.rlike(PYTHON), F.lit("python")).when(name.rlike(RUBY), F.lit("ruby")).when(name.rlike(PERL), F.lit("perl"))


def library_package(name: Column) -> Column:
    return (
        F.when(name.rlike(PYTHON), F.regexp_extract(name, PYTHON, 2))
        .when(name.rlike(RUBY), F.regexp_extract(name, RUBY, 1))
        .when(name.rlike(PERL), perl_distribution(name))
    )


STANDARD_PARTS = ["debug", "devel", "idle", "libs", "python", "stdlib", "test", "tkinter"]


def python_standard_part(name: Column, version: Column) -> Column:
    """Whether a package is a part of the Python distribution of that very version."""
    short = F.regexp_extract(name, PYTHON, 1)
    dotted = F.when(F.length(short) <= 1, short).otherwise(F.concat(F.substring(short, 1, 1), F.lit("."), F.substring(short, F.lit(2), F.length(short))))
    return name.rlike(PYTHON) & F.lower(F.regexp_extract(name, PYTHON, 2)).isin(STANDARD_PARTS) & F.startswith(F.coalesce(version, F.lit("")), dotted)


def perl_distribution(name: Column) -> Column:
    """The distribution name of a Perl package of either packaging style."""
    raw = F.when(F.regexp_extract(name, PERL, 2) != "", title(F.regexp_extract(name, PERL, 2))).otherwise(F.regexp_extract(name, PERL, 1))
    parts = F.regexp_extract_all(raw, F.lit(r"[^:\s_-]+"), F.lit(0))

    def cut(p: Column) -> Column:
        lower_at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), lambda i: (i > 1) & ~F.element_at(p, i.cast("int")).rlike(r"^\p{Lu}"))
        first_upper = F.get(p, F.lit(0)).rlike(r"^\p{Lu}")
        return F.array_join(
            F.when(first_upper & (F.size(lower_at) > 0), F.slice(p, F.lit(1), F.get(lower_at, F.lit(0)).cast("int") - 1)).otherwise(p), "-"
        )

    return let(parts, cut)


def license_names(licenses: Column) -> Column:
    """Single names out of license expressions: outer brackets off, split at bracketed or blank-separated and/or."""
    return F.flatten(
        F.transform(licenses, lambda x: F.split(F.regexp_replace(x, r"^[ ()]+|[ ()]+$", ""), r"(?i)[()\s]+(?:or|and)[()\s]+"))
    )


def without_license_ref(name: Column) -> Column:
    return F.regexp_replace(name, r"LicenseRef-[^-]+-", "")


def source_name(srcname: Column, version: Column) -> Column:
    """A source name without the digits that its version begins with, in every hyphenated part."""
    start = F.regexp_extract(F.coalesce(version, F.lit("")), r"^(\d+)(?:\.|$)", 1)
    return let(
        start,
        lambda v: F.when(v == "", srcname).otherwise(
            F.array_join(F.transform(F.split(srcname, "-"), lambda p: F.replace(p, v, F.lit(""))), "-")
        ),
    )


def like_pattern(version: Column) -> Column:
    """LIKE pattern for versions of a similar size: 12.34 gives 1_.3%; others stand for themselves."""
    major, minor = (F.regexp_extract(version, r"^(\d+)\.(\d)", k) for k in (1, 2))
    return F.when(major == "", version).otherwise(
        F.concat(F.substring(major, 1, 1), F.repeat(F.lit("_"), F.length(major) - 1), F.lit("."), minor, F.lit("%"))
    )


def with_suffix(version: Column, suffix: Column) -> Column:
    return F.concat_ws(" ", version, suffix)


def lookup_name(software: Column) -> Column:
    return F.lower(F.replace(software, F.lit(" "), F.lit("-")))


def distinct_names(names: Column, redundant: Column) -> Column:
    """Names without regard to case, the last spelling of each kept, without the redundant ones, sorted."""
    kept = F.filter(names, lambda n: n.isNotNull() & (n != "") & ~F.array_contains(F.transform(redundant, F.lower), F.lower(n)))
    return F.array_sort(
        F.filter(
            F.transform(kept, lambda n, i: F.when(~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda m: F.lower(m) == F.lower(n)), n)),
            lambda n: n.isNotNull(),
        )
    )


def control_description(text: Column) -> Column:
    """The lines after that with "description:" up to the first one without a letter or digit; '' where the text has no
    such end."""
    lines = F.split(text, r"\r?\n")
    starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda k: F.contains(F.lower(F.element_at(lines, k.cast("int"))), F.lit("description:")))

    def body(at: Column) -> Column:
        rest = F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0)))
        blank = F.get(F.filter(F.transform(rest, lambda x, i: F.when(~x.rlike(r"(?U)\w"), i)), lambda i: i.isNotNull()), F.lit(0))
        return F.when(blank.isNull(), F.lit("")).otherwise(F.trim(F.array_join(F.slice(rest, F.lit(1), blank), "\n")))

    return F.when(F.size(starts) > 0, let(F.get(starts, F.lit(0)), body)).otherwise(F.lit(""))


def author_list(authors: Column) -> Column:
    """Authors without their addresses, sorted, as one text."""
    return F.array_join(F.array_sort(F.transform(authors, lambda a: F.trim(F.regexp_replace(a, r"<[^>]*>", "")))), ", ")


def related_page(package: Column, url: Column, content: Column) -> Column:
    """Whether a page that was reached under another address belongs to a package: a part of its name of three letters or more
    is in the address or on the page; if there is no such part, all parts are in one of them."""
    parts = F.filter(F.split(F.lower(F.coalesce(package, F.lit(""))), r"[-\s]+"), lambda p: p != "")
    long = F.filter(parts, lambda p: F.length(p) >= 3)
    where, what = F.coalesce(url, F.lit("")), F.lower(F.coalesce(content, F.lit("")))
    some = F.exists(long, lambda p: F.contains(where, p) | F.contains(what, p))
    return F.when(F.size(long) > 0, some).otherwise(F.forall(parts, lambda p: F.contains(where, p)) | F.forall(parts, lambda p: F.contains(what, p)))
