"""Recognition of a batch of fingerprints against the reference tables, set at a time.

The ways are tried in tiers, and only what one tier left goes on to the next: the predefined product; library packages at the service
of their language; the record of the distribution (its own index or the rows of its family, then the answers of its own
service); the rows of any family. A record whose homepage is a public project service takes what that service
answers; the others are external projects, or, without a homepage, products of the distribution.

Answers of services come as tables (a payload row per asked address, see ``resolvers.projects``), so that a batch is joined with
them and nothing is asked while it runs. Where no table of a service is given, its projects count as external; where one is
given, a project without an answer is not recognised.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgloom.engine import cut
from pkgloom.functions import names as N
from pkgloom.functions.normalize import fingerprints
from pkgloom.operators import identity, lookup
from pkgloom.providers import TextModel, define_texts, extract_licenses
from pkgloom.resolvers import packages as P
from pkgloom.resolvers import projects as R

# The one predefined product.
PYTHON = {
    "software": "Python", "publisher": "Python Software Foundation", "publisher_alternative": ["Python"], "homepage": "https://www.python.org/",
    "cpe_string": "cpe:2.3:a:python:python:", "licenses": ["Python Software Foundation License"], "unspsc": "43232311",
    "description": "Python is a high-level, interpreted programming language that supports multiple programming paradigms, including object-oriented, "
    "procedural, and functional programming. It features dynamic typing, robust modules, and clear syntax, and is extensible via C or C++, making it "
    "portable across various systems including Unix, Linux, macOS, and Windows.",
}

KEY = ["software", "publisher", "version"]
TEXTS = ["r_software", "r_publisher", "r_homepage", "r_description", "r_license_text", "r_version", "r_date", "r_cpe_string", "r_unspsc"]
LISTS = ["r_software_alternative", "r_publisher_alternative", "r_licenses"]
#: The services of library packages, and where they are asked for one.
LIBRARIES = {"python": ("pypi", "https://pypi.org/project/"), "ruby": ("rubygem", "https://rubygems.org/api/v1/search.json?query="), "perl": ("metacpan", "https://fastapi.metacpan.org/v1/release/")}


def staged(df: DataFrame, **values: Column) -> DataFrame:
    """The key and every column of a result in the making; texts that are not given are '', lists empty."""
    texts = [F.coalesce(values.get(c, F.lit("")), F.lit("")).alias(c) for c in TEXTS]
    return df.select(*KEY, *texts, *[F.coalesce(values.get(c, R.empty()), R.empty()).alias(c) for c in LISTS])


def scanned(asked: DataFrame, payloads: dict[str, DataFrame]) -> DataFrame:
    """Results of the projects that their services know. ``asked``: key, version_suffix, service_, url, package, inherited. A row of
    a service's table whose bodies are all null is no answer; the first of several rows of one address counts."""
    united, own = staged(asked.where("false")), [f"k_{c}" for c in KEY]
    for service, answers in payloads.items():
        bodies = [c for c in answers.columns if c not in ("url", "package", "version", "version_suffix", "inherited")]
        known = answers.where(F.coalesce(*[F.col(c).cast("string") for c in bodies]).isNotNull()).groupBy("url").agg(F.min_by(F.struct(*bodies), F.struct(*[F.col(c).cast("string") for c in bodies])).alias("b_"))
        mine = asked.where(F.col("service_") == service).select(*[F.col(c).alias(f"k_{c}") for c in KEY], "version", "version_suffix", "url", "package", "inherited")
        record = R.RESOLVERS[service](mine.join(known, "url").select(*mine.columns, "b_.*"), own)
        values = {f"r_{c}": F.col(f"f_{c}") for c in ("software", "publisher", "software_alternative", "publisher_alternative", "homepage", "description", "licenses", "license_text")}
        renamed = record.select(*[F.col(f"k_{c}").alias(c) for c in KEY], *[F.col(c).alias(f"f_{c}") for c in R.FIELDS])
        united = united.unionByName(staged(renamed, **values, r_version=F.col("f_release_version"), r_date=F.col("f_release_date")))
    return united


def recognise(
    raw: DataFrame, index: DataFrame, alpine: DataFrame, cpe: DataFrame, licenses: DataFrame, stored: DataFrame,
    payloads: dict[str, DataFrame] | None = None, answers: dict[str, DataFrame] | None = None, pages: DataFrame | None = None,
    model: Callable[[], TextModel] | None = None, embed: Callable[[pd.Series], pd.Series] = identity.ngram_vectors,
) -> DataFrame:
    """New results for raw fingerprints, in the columns of the result table. ``index`` has index_version.

    ``payloads``: service -> answers of project services, by url; ``answers``: distribution -> answers of its own service, by key
    (``packages.OWN_WAYS``); ``pages`` (url, final_url, text): web pages of external projects without a description; ``model``
    defines descriptions and reads licenses out of texts; ``embed`` places license identifiers for the nearest one."""
    payloads, answers = payloads or {}, answers or {}
    new = cut(lookup.not_yet_stored(fingerprints(raw), stored)).where("software <> ''")
    shown = N.with_suffix(F.col("version"), F.col("version_suffix"))
    versions = new.select(*KEY, "version_suffix", shown.alias("shown"), F.when(F.col("version_is_date"), F.col("version_date")).alias("dated"))
    standard = N.python_standard_part(F.col("software"), F.col("version"))
    python = staged(new.where(standard), **{f"r_{k}": F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for k, v in PYTHON.items()})
    rest = versions.where(~F.coalesce(standard, F.lit(False)))
    done = python
    # library packages at the service of their language
    language = N.library_language(F.col("software"))
    if any(service in payloads for service, _ in LIBRARIES.values()):
        at, service = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, (kind, where) in LIBRARIES.items():
            at, service = F.when(language == name, F.lit(where)).otherwise(at), F.when(language == name, F.lit(kind)).otherwise(service)
        called = N.library_package(F.col("software"))
        library = rest.where(language.isNotNull()).select(*KEY, "version_suffix", service.alias("service_"), F.concat(at, called).alias("url"), called.alias("package"), F.lit(None).cast("string").alias("inherited"))
        known = cut(scanned(library, {s: p for s, p in payloads.items() if s in {k for k, _ in LIBRARIES.values()}}))
        done, rest = done.unionByName(known), rest.join(known.select(*KEY), KEY, "left_anti")
    # the distribution's own records, then those of any family for what they left
    key = cut(rest.select(*KEY))
    of_alpine = N.distribution(F.col("publisher")) == "alpine"
    own = P.first_way(
        KEY, P.alpine(key.where(of_alpine), alpine), P.from_index(lookup.family_lookup(key.where(~F.coalesce(of_alpine, F.lit(False))), index), KEY, own_records=True),
        P.own_records(key, answers, KEY),
    )
    own = cut(own)
    other = P.from_index(lookup.universal_lookup(key.join(own.select(*KEY), KEY, "left_anti"), index), KEY)
    found = own.select(*KEY, *P.FIELDS).unionByName(other.where("package_url <> ''").select(*KEY, *P.FIELDS))
    found = found.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "software")).withColumn("url", N.corrected_url(F.col("homepage"), F.col("name")))
    found = found.withColumn("service_", F.when(F.col("homepage") != "", N.project_service(F.col("url")))).join(versions, KEY)
    scans = F.coalesce(F.col("service_").isin(*payloads), F.lit(False)) if payloads else F.lit(False)
    found = cut(found)
    if payloads:
        projects = scanned(found.where(scans).select(*KEY, "version_suffix", "service_", "url", F.col("name").alias("package"), F.col("description").alias("inherited")), payloads)
        done = done.unionByName(projects)
    outside = found.where(~scans)
    if pages is not None:
        outside = outside.join(pages.select("url", "final_url", "text"), "url", "left")
    else:
        outside = outside.withColumn("final_url", F.lit(None).cast("string")).withColumn("text", F.lit(None).cast("string"))
    lacks = (F.coalesce("description", F.lit("")) == "") & F.col("final_url").isNotNull()
    fits = lacks & ((F.col("final_url") == F.col("url")) | N.related_page(F.col("name"), F.col("final_url"), F.col("text")))
    external = F.col("homepage") != ""
    done = done.unionByName(
        staged(
            outside, r_software=F.col("name"), r_publisher=F.when(external, F.col("name")).otherwise(F.coalesce(F.nullif("vendor", F.lit("")), "name")),
            r_homepage=F.when(fits, F.col("final_url")).when(external, F.col("url")).otherwise(F.col("package_url")),
            r_description=F.when(fits, F.col("text")).otherwise(F.col("description")), r_licenses=F.col("licenses"), r_date=F.col("dated"),
        )
    )
    records = cut(done.join(versions.select(*KEY, "shown"), KEY).withColumn("r_version", F.coalesce(F.nullif("r_version", F.lit("")), "shown")))
    return told(records, cpe, licenses, model, embed)


def told(records: DataFrame, cpe: DataFrame, licenses: DataFrame, model: Callable[[], TextModel] | None, embed: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """The rows of the result table: dictionary identity, definition and licenses of the staged records."""
    if model is not None:
        records = define_texts(records, model, "r_description", "r_software").withColumn("r_description", F.col("definition")).drop("definition")
        records = extract_licenses(records, model, "r_license_text", "r_software")
        records = records.withColumn("r_licenses", F.when((F.size("r_licenses") == 0) & (F.col("r_license_text") != ""), F.col("found_licenses")).otherwise(F.col("r_licenses"))).drop("found_licenses")
        records = cut(records)
    ident = F.struct(*KEY)
    asked = records.select(ident.alias("id"), F.concat(F.array("r_software"), "r_software_alternative").alias("names"), F.filter(F.concat(F.array("r_publisher"), "r_publisher_alternative"), lambda x: x != "").alias("publishers"), F.col("r_version").alias("version")).where(
        records["r_cpe_string"] == ""
    )
    named = identity.cpe_identity(asked, cpe).select("id.*", F.col("cpe_string").alias("c_"))
    values = records.select(*KEY, F.posexplode(N.license_names(F.col("r_licenses"))).alias("at", "identifier")).where("identifier <> ''")
    resolved, _ = identity.resolve_licenses(values, licenses, KEY, embed)
    out = records.join(named, KEY, "left").join(resolved, KEY, "left")
    # the dictionary's publisher takes the place of the record's, which stays as another name where it holds the former
    maker = F.regexp_extract("c_", r"^cpe:2\.3:a:([^:]*):", 1)
    readable, stem = F.replace(maker, F.lit("_"), F.lit(" ")), F.replace(F.regexp_replace(maker, "_[^_]*$", ""), F.lit("_"), F.lit(" "))
    others = F.filter(F.concat(F.array("r_publisher"), "r_publisher_alternative"), lambda n: (n != "") & F.contains(F.lower(n), stem) & (F.lower(n) != readable))
    return out.select(
        *[F.nullif(c, F.lit("")).alias(f"fp_{c}") for c in KEY], F.col("r_software").alias("software"), F.col("r_software_alternative").alias("software_alternative"),
        F.when(F.col("c_").isNull(), F.col("r_publisher")).otherwise(N.title(readable)).alias("publisher"),
        F.when(F.col("c_").isNull(), F.col("r_publisher_alternative")).otherwise(others).alias("publisher_alternative"),
        F.col("r_description").alias("description"), F.coalesce("names", R.empty()).alias("licenses"), F.col("r_homepage").alias("homepage"), F.col("r_version").alias("version"),
        F.col("r_date").alias("release_date"), F.coalesce(F.nullif("r_cpe_string", F.lit("")), "c_", F.lit("")).alias("cpe_string"), F.col("r_unspsc").alias("unspsc"),
    )
