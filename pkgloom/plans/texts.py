"""Queries of the text operators, with DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgloom.engine import table
from pkgloom.functions import dates, html, specfile
from pkgloom.functions import names as N
from pkgloom.functions import normalize as Z
from pkgloom.functions import versions as V
from pkgloom.operators import identity
from pkgloom.pipeline import recognise
from pkgloom.plans import images
from pkgloom.plans.relational import query
from pkgloom.resolvers import packages, projects
from pkgloom.sources.readers import rss_items

PY = r"(?i)python([23]\d{0,2})[\s-]+([^\s-]\S*)"
RB = r"(?i)ruby(?:gem)?[\s-]+([^\s-]\S*)"
PL = r"(?i)perl-\s*([^\s-].+)$|^lib([^\s-].+)-\s*perl$"


@query(rf"""select id, case when regexp_matches(fp_software, '{PY}') then 'python' when regexp_matches(fp_software, '{RB}') then 'ruby'
 when regexp_matches(fp_software, '{PL}') then 'perl' end as language, case when regexp_matches(fp_software, '{PY}') then regexp_extract(fp_software, '{PY}', 2)
 when regexp_matches(fp_software, '{RB}') then regexp_extract(fp_software, '{RB}', 1) end as library from software_info""")
def library_class(spark: SparkSession, d: str) -> DataFrame:
    info = table(spark, d, "software_info")
    language = N.library_language(F.col("fp_software"))
    return info.select("id", language.alias("language"), F.when(language != "perl", N.library_package(F.col("fp_software"))).alias("library"))


@query(rf"""with m as (select id, regexp_extract(fp_software, '{PL}', 1) as g1, regexp_extract(fp_software, '{PL}', 2) as g2 from software_info
 where not regexp_matches(fp_software, '{PY}') and not regexp_matches(fp_software, '{RB}') and regexp_matches(fp_software, '{PL}')),
r as (select id, case when g2 = '' then g1 else array_to_string(list_transform(regexp_extract_all(g2, '\pL+|[^\pL]+'), lambda x: concat(upper(substr(x, 1, 1)), lower(substr(x, 2)))), '') end as raw from m),
p as (select id, regexp_extract_all(raw, '[^:\s_-]+') as parts from r),
k as (select *, list_filter(range(2, len(parts) + 1), lambda i: not regexp_matches(parts[i], '^\p{{Lu}}'))[1] as k from p)
select id, array_to_string(case when regexp_matches(parts[1], '^\p{{Lu}}') and k is not null then parts[1:k - 1] else parts end, '-') as distribution from k""")
def perl_dist_name(spark: SparkSession, d: str) -> DataFrame:
    info = table(spark, d, "software_info").where(N.library_language(F.col("fp_software")) == "perl")
    return info.select("id", N.perl_distribution(F.col("fp_software")).alias("distribution"))


@query("""with c as (select id, package, version, list_filter(range(1, length(package) + 1), lambda i: starts_with(coalesce(version, ''), substr(package, i)))[1] as k from packages_info)
select id, case when k is null then package else rtrim(substr(package, 1, k - 1), ' -') end as name from c""")
def strip_version_suffix_from_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "packages_info").select("id", N.without_version_suffix(F.col("package"), F.col("version")).alias("name"))


@query(r"""select id, case when regexp_matches(lower(package), '^lib(rary|ert|erat|ellous)') then package else regexp_replace(package, '(?i)^lib-?', '') end as name from packages_info""")
def strip_lib_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "packages_info").select("id", N.without_lib(F.col("package")).alias("name"))


#: Addresses of public services made of the index rows: (Spark and DuckDB expression).
ADDRESS = """case id % 6 when 0 then concat('https://github.com/', coalesce(family, 'x'), '/', package, '/tree/main?tab=1') when 1 then concat('https://www.sourceforge.net/projects/', package, '/files')
 when 2 then concat('https://metacpan.org/dist/', package, '-1.20') when 3 then concat('gitlab.example.org/', package) when 4 then concat('https://pypi.org/project/', package) else homepage end"""


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "packages_info").select("id", F.expr(ADDRESS).alias("url"))


_H = r"lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)', 1))"
_P = r"regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]+(/[^?#]*)', 1)"


@query(
    f"with u as (select id, {ADDRESS} as url from packages_info) select id, case when length({_P}) > 0 then case "
    + " ".join(f"when {' or '.join(f'''contains({_H}, '{k}')''' for k in ks)} then '{n}'" for n, ks in N.HOSTS)
    + " end end as service from u"
)
def url_to_project(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("id", N.project_service(F.col("url")).alias("service"))


@query(rf"""with u as (select id, {ADDRESS} as url from packages_info), t as (select *, regexp_replace(url, '[?#].*$', '') as t from u)
select id, case when regexp_extract(t, 'github\.com/([^/]+/[^/]+)', 1) <> '' then concat('https://github.com/', regexp_extract(t, 'github\.com/([^/]+/[^/]+)', 1))
 when contains(t, 'sourceforge.net/projects/') then regexp_extract(t, '^(.*?sourceforge\.net/projects/[^/]+)', 1)
 when contains(t, '//metacpan.org/') then concat('https://fastapi.metacpan.org/v1/release/', regexp_replace(regexp_extract(t, '([^/]+)$', 1), '-\d+\.\d+', '', 'g')) else url end as url from t""")
def correct_url(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("id", N.corrected_url(F.col("url")).alias("url"))


@query(rf"""with u as (select id, {ADDRESS} as url from packages_info)
select id, coalesce(regexp_extract(url, '(?:pypi\.[^/]+/(?:project|pypi)|rubygems\.org/gems|sourceforge\.net/projects|github\.com/[^/]+)/([^/?#]+)', 1), '') as name from u""")
def service_names(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("id", F.coalesce(N.service_name(F.col("url")), F.lit("")).alias("name"))


@query(r"""select doc_id, trim(regexp_extract(text, '(?is)^.*?description:[^\n]*\n(.*?\w[^\n]*)\n[^\pL\pN_\n]*(?:\n|$)', 1), ' ') as description from documents where source = 'control'""")
def control_description(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source = 'control'")
    return docs.select("doc_id", N.control_description(F.col("text")).alias("description"))


@query("with l as (select id, unnest(licenses) as license from packages_info) select id, license, regexp_replace(license, 'LicenseRef-[^-]+-', '', 'g') as plain from l")
def spec_license_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "packages_info").select("id", F.explode("licenses").alias("license")).withColumn("plain", N.without_license_ref(F.col("license")))


@query(r"""select distinct version, nullif(regexp_extract(version, '\b\d*((?:rc|alpha|beta)(?:_?\d+)?)\b', 1), '') as suffix from packages_info where version is not null""")
def version_suffix(spark: SparkSession, d: str) -> DataFrame:
    versions = table(spark, d, "packages_info").select("version").where("version is not null").distinct()
    return versions.withColumn("suffix", Z.version_suffix(F.col("version")))


@query("select id, lower(replace(software, ' ', '-')) as name from software_info")
def lookup_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "software_info").select("id", N.lookup_name(F.col("software")).alias("name"))


@query("""with a as (select id, publisher, unnest(publisher_alternative) as n, generate_subscripts(publisher_alternative, 1) as i from software_info),
k as (select id, n from a where n is not null and n <> '' and lower(n) <> lower(coalesce(publisher, '')) qualify row_number() over (partition by id, lower(n) order by i desc) = 1)
select s.id, coalesce((select string_agg(n, '|' order by n) from k where k.id = s.id), '') as names from software_info s""")
def names_dedup_ci(spark: SparkSession, d: str) -> DataFrame:
    kept = N.distinct_names(F.coalesce("publisher_alternative", F.array().cast("array<string>")), F.array(F.coalesce("publisher", F.lit(""))))
    return table(spark, d, "software_info").select("id", F.array_join(kept, "|").alias("names"))


@query("""select doc_id, regexp_extract(text, '(?m)^Name: *(.*?) *$', 1) as name, regexp_extract(text, '(?m)^Version: *(.*?) *$', 1) as version,
regexp_extract(text, '(?m)^Release: *(.*?) *$', 1) as release, regexp_extract(text, '(?m)^License: *(.*?) *$', 1) as license from documents where source = 'specfile'""")
def spec_parse(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source = 'specfile'").select("doc_id", specfile.spec_struct("text").alias("s"))
    return docs.select("doc_id", *[F.coalesce(f"s.{c}", F.lit("")).alias(c) for c in ("name", "version", "release", "license")])


@query(r"""with h as (select doc_id, regexp_extract(text, '^[^\n]*?(\d[^\s()]*) \((\d{4}-\d{2}-\d{2})\)', ['v', 'd']) as r from documents where source = 'changelog')
select doc_id, r.v as version, nullif(r.d, '') as released from h where r.v <> ''""")
def changelog_release(spark: SparkSession, d: str) -> DataFrame:
    """The release date of the version that each changelog begins with."""
    docs = table(spark, d, "documents").where("source = 'changelog'")
    asked = docs.select("doc_id", "text", F.regexp_extract("text", r"^[^\n]*?(\d[^\s()]*) \(\d{4}-\d{2}-\d{2}\)", 1).alias("version")).where("version <> ''")
    return asked.select("doc_id", "version", V.changelog_date("text", "version", F.lit(None).cast("string")).alias("released"))


@query(r"""select doc_id, nullif(regexp_extract(text, '\b(\d{4}-\d{2}-\d{2})\b', 1), '') as first_date from documents where source = 'changelog'""")
def extract_date_like(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source = 'changelog'")
    return docs.select("doc_id", dates.first_date(F.regexp_extract("text", r"\b(\d{4}-\d{2}-\d{2})\b", 1)).alias("first_date"))


@query()
def parse_date(spark: SparkSession, d: str) -> DataFrame:
    """The first date of every text, in any notation."""
    return table(spark, d, "documents").select("doc_id", dates.first_date("text").alias("first_date"))


@query()
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source = 'webpage'").select("doc_id", html.html_text("text").alias("plain"))


def _tags(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The versions of each project shortened as fingerprints are, and its tags."""
    rows = table(spark, d, "packages_info").where("version is not null and projectname_seed is not null")
    named = rows.select(F.lower("projectname_seed").alias("project"), "version", "id")
    suffix = Z.version_suffix(F.col("version"))
    short = Z.truncated(Z.without_suffix(F.col("version"), suffix))
    asked = named.select("project", short.alias("wanted"), suffix.alias("suffix")).distinct().where("wanted <> ''")
    tags = named.groupBy("project", F.concat(F.lit("v"), "version").alias("tag")).agg(F.min("id").alias("pos"))
    return asked, tags


@query()
def tag_match(spark: SparkSession, d: str) -> DataFrame:
    """Per project and shortened version the tag that fits it best."""
    asked, tags = _tags(spark, d)
    pairs = asked.withColumn("head", V.head_key(F.col("wanted"))).join(tags.withColumn("head", F.explode(V.head_keys(F.col("tag")))), ["project", "head"])
    best = V.best_matches(pairs, ["project", "wanted", "suffix"], "tag", "wanted", "suffix", ["pos", "tag"])
    return best.select("project", "wanted", "suffix", "tag", "is_exact")


@query("select id, version, strftime(observed_at, '%Y-%m-%d') as released from packages_info where coalesce(version, '') <> ''")
def rss_release(spark: SparkSession, d: str) -> DataFrame:
    """The publishing date of a version in a feed, over one feed per package row."""
    rows = table(spark, d, "packages_info").where("version is not null")
    feed = F.concat(
        F.lit("<rss><channel><item><title>"), "package", F.lit(" "), "version", F.lit("</title><pubDate>"),
        F.date_format("observed_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item></channel></rss>"),
    )
    items = rss_items(rows.select("id", "version", Z.version_suffix(F.col("version")).alias("suffix"), feed.alias("body")))
    best = V.best_matches(items, ["id"], "title", "version", "suffix", ["pos"])
    return best.select("id", "version", dates.first_date("published").alias("released"))


@query("select event_id, json_extract_string(props, '$.k') as k, coalesce(json_extract_string(props, '$.missing.deep'), '') as missing from events")
def json_fetch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), projects.text("props", "$.missing.deep").alias("missing"))


@query("""select id, package as software, coalesce(family, '') as publisher, coalesce(nullif(homepage, ''), project_url, concat('https://pypi.org/project/', package)) as homepage,
trim(coalesce(description, '')) as description, coalesce(licenses[1], '') as license,
case when version is null then '' else strftime(observed_at, '%Y-%m-%d') end as release_date from packages_info""")
def resolve_pypi(spark: SparkSession, d: str) -> DataFrame:
    """The index rows as payloads of a package service, resolved back into records."""
    rows = table(spark, d, "packages_info")
    body = F.to_json(
        F.struct(
            F.struct(
                F.col("package").alias("name"), F.col("family").alias("author"), F.col("homepage").alias("home_page"), F.col("project_url"),
                F.col("description").alias("summary"), F.get("licenses", F.lit(0)).alias("license"),
            ).alias("info"),
            F.when(
                F.col("version").isNotNull(),
                F.create_map(F.coalesce("version", F.lit("")), F.array(F.struct(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("upload_time")))),
            ).alias("releases"),
        )
    )
    payload = rows.select(
        "id", "package", F.concat(F.lit("https://pypi.org/project/"), "package").alias("url"),
        Z.without_suffix(F.col("version"), Z.version_suffix(F.col("version"))).alias("version"),
        Z.version_suffix(F.col("version")).alias("version_suffix"), body.alias("project"),
    )
    out = projects.pypi(payload, ["id"])
    return out.select(
        "id", "software", "publisher", "homepage", "description", F.coalesce(F.get("licenses", F.lit(0)), F.lit("")).alias("license"), "release_date"
    )


@query("""with v as (select id, unnest(licenses) as identifier, generate_subscripts(licenses, 1) as k from packages_info),
m as (select v.id, v.k, coalesce(l.name, v.identifier) as name, case when l.name is null then 1 else 0 end as o from v left join licenses l using (identifier) where v.identifier is not null)
select id, string_agg(name, '|' order by o, k) as names from m group by all""")
def license_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Names of a row's licenses: the listed ones first, then those that are kept as they are."""
    values = table(spark, d, "packages_info").select("id", F.posexplode("licenses").alias("at", "identifier"))
    exact, unknown = identity.exact_licenses(values, table(spark, d, "licenses"))
    both = exact.select("id", "at", "name", F.lit(0).alias("o")).unionByName(
        unknown.where("identifier is not null").select("id", "at", F.col("identifier").alias("name"), F.lit(1).alias("o"))
    )
    lists = both.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("o", "at", "name"))).alias("l"))
    return lists.select("id", F.array_join(F.transform("l", lambda x: x["name"]), "|").alias("names"))


@query(r"""select id, list_bool_or(list_transform(list_filter(regexp_split_to_array(lower(package), '[-\s]+'), lambda p: length(p) >= 3), lambda p: contains(homepage, p)
 or contains(lower(coalesce(description, '')), p))) as related from packages_info where homepage is not null""")
def webpage_relevance(spark: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.split(F.lower("package"), r"[-\s]+"), lambda p: F.length(p) >= 3)
    told = F.lower(F.coalesce("description", F.lit("")))
    related = F.exists(parts, lambda p: F.contains(F.col("homepage"), p) | F.contains(told, p))
    return table(spark, d, "packages_info").where("homepage is not null").select("id", F.when(F.size(parts) > 0, related).alias("related"))


@query()
def recognise_batch(spark: SparkSession, d: str) -> DataFrame:
    """The whole recognition of the raw fingerprints and of the index's own names against the reference tables."""
    raw = table(spark, d, "fingerprints_raw").select("software", "publisher", "version").unionByName(images.package_fingerprints(spark, d))
    return recognise(
        raw, images.index(spark, d), table(spark, d, "alpine_packages"), table(spark, d, "cpe_entities"), table(spark, d, "licenses"), table(spark, d, "software_info")
    )


# --- records of project services, over payloads made of the index rows ---------------------------------------------


def _payload(spark: SparkSession, d: str, url: str, **bodies) -> DataFrame:
    """Index rows as answers of a service: id, package, url, version, inherited, and the JSON bodies."""
    rows = table(spark, d, "packages_info")
    none = F.lit(None).cast("string")
    return rows.select("id", "package", F.expr(url).alias("url"), "version", none.alias("inherited"), *[(none if b is None else F.to_json(F.expr(b))).alias(n) for n, b in bodies.items()])


def _told(df: DataFrame) -> DataFrame:
    """A record with its lists as texts."""
    return df.select(
        "id", "software", "publisher", "homepage", "description", F.array_join("licenses", "|").alias("licenses"), F.array_join("software_alternative", "|").alias("software_alternative"),
        F.array_join("publisher_alternative", "|").alias("publisher_alternative"), "release_version", "release_date",
    )


def _said(column: str) -> str:
    """SQL for a member that is a text: '' for null and for what looks like a list or object."""
    return rf"case when regexp_matches(coalesce({column}, ''), '^\s*[\[{{]') then '' else coalesce({column}, '') end"


def _several(*names: str, apart: str) -> str:
    """SQL for the distinct names of a list, sorted, without those that equal ``apart`` in any case."""
    listed = f"list_filter([{', '.join(names)}], lambda n: n <> '' and lower(n) <> lower({apart}))"
    return f"array_to_string(list_sort(list_filter({listed}, lambda n, i: not list_contains(list_transform(list_slice({listed}, i + 1, 9), lambda m: lower(m)), lower(n)))), '|')"


_DAY, _VERSION = "strftime(observed_at, '%Y-%m-%d') as release_date", "coalesce(version, '') as release_version"
_ONE_LICENSE = f"case when lower({_said('licenses[1]')}) like '%other%' then '' else {_said('licenses[1]')} end as licenses"


@query(f"""with r as (select *, coalesce(family, 'x') as f, concat('https://github.com/', coalesce(family, 'x'), '/', package) as url from packages_info)
select id, package as software, upper(f) as publisher, case when {_said('homepage')} = '' then url else {_said('homepage')} end as homepage,
case when length({_said('description')}) >= 10 then {_said('description')} else '' end as description, {_ONE_LICENSE}, '' as software_alternative, '' as publisher_alternative, {_VERSION}, {_DAY} from r""")
def resolve_github(spark: SparkSession, d: str) -> DataFrame:
    rows = _payload(
        spark, d, "concat('https://github.com/', coalesce(family, 'x'), '/', package)",
        project="struct(package as name, homepage, description, struct(get(licenses, 0) as name) as license)", owner="struct(upper(coalesce(family, 'x')) as name, coalesce(family, 'x') as login)",
        readme=None, license=None, tag_commit="struct(struct(struct(date_format(observed_at, 'yyyy-MM-dd') as date) as committer) as commit)",
    )
    return _told(projects.github(rows, ["id"]))


@query(f"""with r as (select *, coalesce(family, 'x') as f, concat('https://gitlab.example.org/', package) as url from packages_info)
select id, upper(package) as software, concat('Team ', f) as publisher, case when {_said('homepage')} = '' then url else {_said('homepage')} end as homepage,
case when length({_said('description')}) >= 10 then {_said('description')} else '' end as description, {_ONE_LICENSE}, '' as software_alternative, f as publisher_alternative, {_VERSION}, {_DAY} from r""")
def resolve_gitlab(spark: SparkSession, d: str) -> DataFrame:
    rows = _payload(
        spark, d, "concat('https://gitlab.example.org/', package)",
        project="struct(upper(package) as name, package as path, struct(concat('Team ', coalesce(family, 'x')) as name, coalesce(family, 'x') as path) as namespace, homepage as web_url, description, struct(get(licenses, 0) as key) as license)",
        readme=None, license_file=None, tag="struct(struct(date_format(observed_at, 'yyyy-MM-dd') as committed_date) as commit)",
    )
    return _told(projects.gitlab(rows, ["id"]))


@query(f"""with r as (select *, concat('https://sourceforge.net/projects/', package) as url, list_sort([coalesce(family, 'x'), coalesce(repo, 'y')]) as people from packages_info)
select id, package as software, concat(people[1], ', ', people[2]) as publisher, case when {_said('homepage')} <> '' and lower({_said('homepage')}) not like '%sourceforge%' then {_said('homepage')} else url end as homepage,
{_said('description')} as description, coalesce(array_to_string(list_transform(licenses, lambda x: coalesce(x, '')), '|'), '') as licenses, '' as software_alternative, '' as publisher_alternative, {_VERSION}, {_DAY} from r""")
def resolve_sourceforge(spark: SparkSession, d: str) -> DataFrame:
    rows = _payload(
        spark, d, "concat('https://sourceforge.net/projects/', package)",
        project="struct(package as name, upper(package) as shortname, array(named_struct('name', coalesce(family, 'x'), 'username', null), named_struct('name', null, 'username', coalesce(repo, 'y'))) as developers, "
        "homepage as external_homepage, description as short_description, struct(transform(licenses, x -> struct(x as fullname)) as license) as categories)",
    ).join(table(spark, d, "packages_info").select("id", F.date_format("observed_at", "yyyy-MM-dd").alias("release_date")), "id")
    return _told(projects.sourceforge(rows, ["id"]))


@query(f"""with r as (select *, {_said('description')} as abstract, case when coalesce(len(licenses), 0) = 0 then ['perl_5'] else list_transform(licenses, lambda x: coalesce(x, '')) end as listed from packages_info)
select id, package as software, coalesce(family, 'CPAN') as publisher, concat('https://metacpan.org/dist/', package) as homepage,
concat(package, ' is a distribution of Perl modules.', chr(10), 'The modules included are: ', package, ', Two.', case when abstract in ('', 'unknown') then '' else concat(chr(10), abstract) end) as description,
array_to_string(list_transform(listed, lambda x: case when x = 'perl_5' then 'Artistic-1.0-Perl|GPL-1.0-or-later' else x end), '|') as licenses,
{_several("concat('perl-', package)", "concat('lib', lower(package), '-perl')", "package", "'Two'", apart='package')} as software_alternative, '' as publisher_alternative, {_VERSION}, {_DAY} from r""")
def resolve_metacpan(spark: SparkSession, d: str) -> DataFrame:
    rows = _payload(
        spark, d, "concat('https://fastapi.metacpan.org/v1/release/', package)",
        release="struct(package as distribution, family as author, transform(licenses, x -> coalesce(x, '')) as license, array(package, 'Two') as provides, version, date_format(observed_at, 'yyyy-MM-dd') as date, description as abstract)",
        author=None, module=None,
    )
    return _told(projects.metacpan(rows, ["id"]))


@query(rf"""with r as (select *, {_said('description')} as info, concat('https://rubygems.org/gems/', package) as url from packages_info),
n as (select *, regexp_extract(info, concat('(?i)\b', regexp_replace(package, '([^\pL\p{{Nd}}])', '\\\1', 'g'), '\b')) as spelled from r),
k as (select *, case when spelled = '' then package else spelled end as software from n)
select id, software, coalesce(family, '') as publisher, coalesce(nullif({_said('homepage')}, ''), nullif({_said('project_url')}, ''), url) as homepage, info as description,
coalesce(array_to_string(list_transform(licenses, lambda x: coalesce(x, '')), '|'), '') as licenses, concat('rubygem-', package) as software_alternative, '' as publisher_alternative, {_VERSION}, '' as release_date from k""")
def resolve_rubygem(spark: SparkSession, d: str) -> DataFrame:
    rows = _payload(
        spark, d, "concat('https://rubygems.org/gems/', package)",
        gem="struct(package as name, description as info, family as authors, homepage as homepage_uri, project_url as project_uri, transform(licenses, x -> coalesce(x, '')) as licenses)",
        source_publisher=None, source_description=None, source_release_date=None,
    )
    return _told(projects.rubygem(rows, ["id"]))


@query("""select id, concat(upper(substr(package, 1, 1)), substr(package, 2)) as software, 'Red Hat' as publisher, concat('https://pagure.io/', package) as homepage, '' as description, '' as licenses,
'' as software_alternative, '' as publisher_alternative, coalesce(version, '') as release_version, '' as release_date from packages_info where regexp_matches(package, '^[a-z]+$')""")
def resolve_pagure(spark: SparkSession, d: str) -> DataFrame:
    rows = _payload(spark, d, "concat('https://pagure.io/', package)").where("package rlike '^[a-z]+$'")
    spec = F.lit(None).cast("struct<description:string,license:string>")
    return _told(projects.pagure(rows.withColumn("spec", spec), ["id"]))


# --- records of the distributions' own services --------------------------------------------------------------------

@query("""with f as (select distinct package as software, coalesce(version, '') as version, projectname_seed as seed, case id % 3 when 0 then 'debian' when 1 then 'ubuntu' else 'arch' end as way, id,
 case when homepage like 'http%' then homepage else '' end as home, coalesce(description, '') as description from packages_info where projectname_seed is not null),
c as (select *, list_filter(range(1, length(seed) + 1), lambda i: starts_with(version, substr(seed, i)))[1] as k from f),
m as (select *, case when k is null then seed else rtrim(substr(seed, 1, k - 1), ' -') end as cut from c)
select id, case when way = 'arch' then seed when regexp_matches(lower(cut), '^lib(rary|ert|erat|ellous)') then cut else regexp_replace(cut, '(?i)^lib-?', '') end as name,
 case way when 'debian' then 'Debian' when 'ubuntu' then 'Canonical' else 'Arch Linux' end as vendor, home as homepage,
 case when home <> '' then home when way = 'ubuntu' then concat('https://launchpad.net/ubuntu/+source/', seed) when way = 'debian' then concat('https://tracker.example/', seed) else concat('https://archlinux.org/packages/?q=', seed) end as package_url,
 case when way = 'arch' then description else '' end as description from m""")
def own_records(spark: SparkSession, d: str) -> DataFrame:
    """The index rows as answers of the services of three distributions, resolved into package records."""
    home = F.when(F.col("homepage").like("http%"), F.col("homepage")).otherwise(F.lit(""))
    rows = table(spark, d, "packages_info").where("projectname_seed is not null").select(
        F.col("package").alias("software"), F.element_at(F.array(F.lit("Debian QA"), F.lit("Ubuntu Developers"), F.lit("Arch Linux")), (F.col("id") % 3 + 1).cast("int")).alias("publisher"),
        F.coalesce("version", F.lit("")).alias("version"), "id", F.col("projectname_seed").alias("source"), home.alias("homepage"), F.coalesce("description", F.lit("")).alias("pkgdesc"),
    )
    keys = ["id", "software", "publisher", "version"]
    debian = rows.select(*keys, "source", "homepage", F.concat(F.lit("https://tracker.example/"), "source").alias("tracker_url"))
    arch = rows.select(
        *keys, F.lit(0).alias("pos"), F.col("software").alias("pkgname"), F.col("source").alias("pkgbase"), F.nullif("homepage", F.lit("")).alias("url"), "pkgdesc",
        F.array().cast("array<string>").alias("licenses"), F.concat(F.lit("https://archlinux.org/packages/?q="), "source").alias("page_url"), F.col("software").alias("raw"),
    )
    found = packages.own_records(rows, {"debian": debian, "ubuntu": debian, "arch": arch}, keys)
    return found.select("id", "name", "vendor", "homepage", "package_url", "description")


@query(r"""with v as (select p.id, u.k as place, u.x as identifier from (select id, licenses from packages_info where licenses is not null) p, lateral (select unnest(licenses) as x, generate_subscripts(licenses, 1) as k) u where u.x is not null),
m as (select v.id, v.place, coalesce(l.name, v.identifier) as name, case when l.name is not null then 0 else 2 end as o from v left join licenses l using (identifier))
select id, string_agg(name, '|' order by o, place) as names from m group by all""")
def license_keep_unlisted(spark: SparkSession, d: str) -> DataFrame:
    """Exact, then nearest (at no distance but 0, so that SQL can follow), then as it is."""
    values = table(spark, d, "packages_info").select("id", F.posexplode("licenses").alias("at", "identifier"))
    names, _ = identity.resolve_licenses(values, table(spark, d, "licenses"), ["id"], threshold=-1.0)
    return names.select("id", F.array_join("names", "|").alias("names"))


@query()
def license_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Exact, then nearest within the distance, then as it is."""
    values = table(spark, d, "packages_info").select("id", F.posexplode("licenses").alias("at", "identifier"))
    names, _ = identity.resolve_licenses(values, table(spark, d, "licenses"), ["id"])
    return names.select("id", F.array_join("names", "|").alias("names"))
