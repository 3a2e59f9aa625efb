"""Queries of the relational core, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgloom.engine import table
from pkgloom.functions import names as N
from pkgloom.functions import normalize as Z
from pkgloom.operators import alpine, identity, lookup, package_index, upserts
from pkgloom.plans import images
from pkgloom.plans.images import LINKS_SQL, PACKAGES_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with the SQL that gives the same rows where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def joined(column: str, sep: str = "|") -> Column:
    return F.array_join(F.transform(F.col(column), lambda x: F.coalesce(x.cast("string"), F.lit("~"))), sep)


def sql_list(column: str, sep: str = "|") -> str:
    return f"array_to_string(list_transform({column}, lambda x: coalesce(cast(x as varchar), '~')), '{sep}')"


# --- package index -------------------------------------------------------------------------------------------------

NAMES_SQL = """names as (
  select projectname_seed, family, srcname as name from packages where srcname is not null
  union select projectname_seed, family, binname from packages where binname is not null
  union select projectname_seed, family, visiblename from packages where visiblename is not null
  union select projectname_seed, family, trackname from packages where trackname is not null
  union select projectname_seed, family, b from packages, unnest(binnames) as t(b) where b is not null)"""


@query(f"with {PACKAGES_SQL}, {NAMES_SQL} select * from names")
def names_union(spark: SparkSession, d: str) -> DataFrame:
    return package_index.all_names(images.packages(spark, d))


@query(f"""with {PACKAGES_SQL}, {NAMES_SQL}
select projectname_seed, family, string_agg(distinct name, '|' order by name) as other_names from names group by all""")
def names_agg(spark: SparkSession, d: str) -> DataFrame:
    return package_index.attributes(images.packages(spark, d)).select("projectname_seed", "family", joined("other_names").alias("other_names"))


@query(f"""with {PACKAGES_SQL}
select projectname_seed, family, string_agg(distinct comment, ', ' order by comment) as description from packages group by all""")
def description_agg(spark: SparkSession, d: str) -> DataFrame:
    return package_index.attributes(images.packages(spark, d)).select("projectname_seed", "family", "description")


@query(f"""with {PACKAGES_SQL}, l as (select distinct projectname_seed, family, x from packages, unnest(licenses) as t(x)),
k as (select distinct projectname_seed, family from packages)
select k.projectname_seed, k.family, string_agg(x, '|' order by x) as licenses
from k left join l on l.projectname_seed = k.projectname_seed and l.family = k.family group by all""")
def licenses_agg(spark: SparkSession, d: str) -> DataFrame:
    return package_index.attributes(images.packages(spark, d)).select("projectname_seed", "family", joined("licenses").alias("licenses"))


@query(f"""with {PACKAGES_SQL}, v as (select distinct projectname_seed, family, version from packages)
select projectname_seed, family, string_agg(coalesce(version, '~'), '|' order by version nulls last) as versions from v group by all""")
def version_agg(spark: SparkSession, d: str) -> DataFrame:
    return package_index.attributes(images.packages(spark, d)).select("projectname_seed", "family", joined("versions").alias("versions"))


@query(f"""with {PACKAGES_SQL} select distinct on (projectname_seed, family) projectname_seed, family, repo
from packages order by projectname_seed, family, repo""")
def distinct_on_key(spark: SparkSession, d: str) -> DataFrame:
    return package_index.attributes(images.packages(spark, d)).select("projectname_seed", "family", "repo")


ATTR_SQL = f"""{NAMES_SQL},
n as (select projectname_seed, family, list(distinct name order by name) as other_names from names group by all),
d as (select projectname_seed, family, string_agg(distinct comment, ', ' order by comment) as description from packages where comment is not null group by all),
lx as (select distinct projectname_seed, family, x from packages, unnest(licenses) as t(x)),
l as (select projectname_seed, family, list(x order by x) as licenses from lx group by all),
vx as (select distinct projectname_seed, family, version from packages),
v as (select projectname_seed, family, list(version order by version nulls last) as versions from vx group by all),
attrs as (select distinct on (p.projectname_seed, p.family) p.projectname_seed, p.family, p.repo, n.other_names, d.description, l.licenses, v.versions
 from packages p left join n using (projectname_seed, family) left join d using (projectname_seed, family)
 left join l using (projectname_seed, family) left join v using (projectname_seed, family)
 order by p.projectname_seed, p.family, p.repo)"""


@query(f"""with {PACKAGES_SQL}, {ATTR_SQL} select projectname_seed, family, repo, {sql_list("other_names")} as other_names,
description, {sql_list("licenses")} as licenses, {sql_list("versions")} as versions from attrs""")
def seed_attr_join(spark: SparkSession, d: str) -> DataFrame:
    return package_index.attributes(images.packages(spark, d)).select(
        "projectname_seed", "family", "repo", joined("other_names").alias("other_names"), "description",
        joined("licenses").alias("licenses"), joined("versions").alias("versions"),
    )


GROUPS_SQL = """expanded as (
  select projectname_seed, family, cast(l->>0 as int) as link_type, cast(l->>1 as int) as link_id, flags
  from packages, unnest(cast(links as json[])) as t(l) where links is not null),
groups as (select projectname_seed, family, link_type,
  coalesce(list(distinct link_id order by link_id) filter (where (flags & 60) = 0), list(distinct link_id order by link_id)) as ids
  from expanded group by all)"""


@query(f"with {PACKAGES_SQL}, {GROUPS_SQL} select projectname_seed, family, link_type, {sql_list('ids')} as ids from groups")
def links_filter_agg(spark: SparkSession, d: str) -> DataFrame:
    return package_index.link_groups(images.packages(spark, d)).select("projectname_seed", "family", "link_type", joined("ids").alias("ids"))


PIVOT_SQL = f"""{GROUPS_SQL}, g as (select distinct projectname_seed, family from packages),
pivoted as (select g.projectname_seed, g.family, c0.ids as homepage_ids, c4.ids as project_url_ids, c5.ids as package_url_ids from g
left join groups c0 on c0.projectname_seed = g.projectname_seed and c0.family = g.family and c0.link_type = 0
left join groups c4 on c4.projectname_seed = g.projectname_seed and c4.family = g.family and c4.link_type = 4
left join groups c5 on c5.projectname_seed = g.projectname_seed and c5.family = g.family and c5.link_type = 5)"""


@query(f"""with {PACKAGES_SQL}, {PIVOT_SQL} select projectname_seed, family, {sql_list('homepage_ids')} as homepage_ids,
{sql_list('project_url_ids')} as project_url_ids, {sql_list('package_url_ids')} as package_url_ids from pivoted""")
def links_pivot_join(spark: SparkSession, d: str) -> DataFrame:
    return package_index.link_roles(images.packages(spark, d)).select(
        "projectname_seed", "family", *[joined(f"{n}_ids").alias(f"{n}_ids") for _, n in package_index.ROLES]
    )


def _best(role: str) -> str:
    return f"""{role}_b as (select projectname_seed, family, arg_max(url, (refcount, -id)) as {role} from
 (select projectname_seed, family, unnest({role}_ids) as id from pivoted) i join links using (id) group by all)"""


URL_SQL = f"""{PIVOT_SQL}, {_best('homepage')}, {_best('project_url')}, {_best('package_url')},
urls as (select g.projectname_seed, g.family, homepage, project_url, package_url from g
left join homepage_b using (projectname_seed, family) left join project_url_b using (projectname_seed, family)
left join package_url_b using (projectname_seed, family))"""


@query(f"with {PACKAGES_SQL}, {LINKS_SQL}, {URL_SQL} select * from urls")
def lateral_top1_url(spark: SparkSession, d: str) -> DataFrame:
    return package_index.best_urls(images.packages(spark, d), images.links(spark, d))


INDEX_SQL = f"""{ATTR_SQL}, {URL_SQL}, info as (select * from attrs join urls using (projectname_seed, family))"""


@query(f"""with {PACKAGES_SQL}, {LINKS_SQL}, {INDEX_SQL} select projectname_seed, family, repo, description,
{sql_list('other_names')} as other_names, homepage, project_url, package_url from info""")
def seed_info_join(spark: SparkSession, d: str) -> DataFrame:
    packages = images.packages(spark, d)
    return package_index.attributes(packages).join(package_index.best_urls(packages, images.links(spark, d)), package_index.KEY).select(
        "projectname_seed", "family", "repo", "description", joined("other_names").alias("other_names"), "homepage", "project_url", "package_url"
    )


@query(f"""with {PACKAGES_SQL}, {LINKS_SQL}, {INDEX_SQL}
select unnest(list_concat([projectname_seed], other_names)) as package, projectname_seed, family, repo, description,
{sql_list('licenses')} as licenses, unnest(versions) as version, homepage, project_url, package_url from info""")
def package_index_(spark: SparkSession, d: str) -> DataFrame:
    return package_index.build_package_index(images.packages(spark, d), images.links(spark, d)).withColumn("licenses", joined("licenses"))


QUERIES["package_index"] = QUERIES.pop("package_index_")
SQL["package_index"] = SQL.pop("package_index_")


@query("""select id, unnest(list_concat([coalesce(software, '')], coalesce(software_alternative, []))) as name,
unnest(coalesce(publisher_alternative, [])) as publisher_name from software_info""")
def lockstep_unnest(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    zipped = F.arrays_zip(
        F.concat(F.array(F.coalesce("software", F.lit(""))), F.coalesce("software_alternative", none)).alias("name"),
        F.coalesce("publisher_alternative", none).alias("publisher_name"),
    )
    return table(spark, d, "software_info").select("id", F.explode(zipped).alias("z")).select("id", "z.name", "z.publisher_name")


# --- fingerprints --------------------------------------------------------------------------------------------------

BL = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^{BL}|{BL}$', '', 'g')"


_SOFT = _strip(rf"""regexp_replace(regexp_replace({_strip("coalesce(software, '')")}, '(?s):[^:]*$', ''), '(?s)([^:]):[^:]+$', '\1')""")
NORMAL_SQL = rf"""a as (select software as s0, {_SOFT} as software, {_strip("coalesce(publisher, '')")} as publisher, {_strip("coalesce(version, '')")} as v0 from fingerprints_raw),
b as (select *, regexp_extract(v0, '(?s)^(.*)-[^-]*$', 1) as head from a),
c as (select *, case when length({_strip('head')}) > 1 then head else regexp_extract(v0, '(?s)([^-]*)$', 1) end as v1 from b),
d as (select *, rtrim(regexp_replace(regexp_replace(ltrim(v1, '+ ~'), '(?s)~[^~]*$', ''), '(?s)\+[^+]*$', ''), ': ') as v2 from c),
e as (select *, regexp_replace(v2, '(?s)^[^:]*:', '') as v3 from d),
f as (select *, regexp_extract(v3, '[^\pL\pN_]*(?:git|svn|\bfc\d|\bel\d|debian|ubuntu)', 0) as m from e),
g as (select *, {_strip("case when m = '' then v3 when instr(v3, m) > 1 then substr(v3, 1, instr(v3, m) - 1) else substr(v3, instr(v3, m) + length(m)) end")} as version_uncut from f),
h as (select *, nullif(regexp_extract(version_uncut, '\b\d*((?:rc|alpha|beta)(?:_?\d+)?)\b', 1), '') as version_suffix,
 regexp_extract(version_uncut, '((?:19|20)\d{{2}})\.?(\d{{1,2}})\.?(\d{{1,2}})?', 0) as dm,
 regexp_extract(version_uncut, '((?:19|20)\d{{2}})\.?(\d{{1,2}})\.?(\d{{1,2}})?', ['y', 'm', 'd']) as dp from g),
i as (select *, case when version_suffix is null then version_uncut else substr(version_uncut, 1, instr(version_uncut, version_suffix) - 1) end as short,
 case when dm <> '' and try_cast(dp.m as int) between 1 and 12 then
  case when dp.d = '' then last_day(make_date(try_cast(dp.y as int), try_cast(dp.m as int), 1))
   when try_cast(dp.d as int) between 1 and day(last_day(make_date(try_cast(dp.y as int), try_cast(dp.m as int), 1)))
   then make_date(try_cast(dp.y as int), try_cast(dp.m as int), try_cast(dp.d as int)) end end as dt from h),
normal as (select software, publisher,
 case when dt is not null and dm = short then short
  else regexp_replace(regexp_replace(short, '[^\pL\pN]+$', ''), '^([\pL\pN]+(?:[^\pL\pN]+[\pL\pN]+)+)[^\pL\pN]+[\pL\pN]+$', '\1') end as version,
 version_uncut, version_suffix, strftime(dt, '%Y-%m-%d') as version_date, dt is not null and dm = short as version_is_date from i)"""


@query(f"with {NORMAL_SQL} select * from normal")
def normalize_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return Z.normalized(table(spark, d, "fingerprints_raw"))


@query(f"""with {NORMAL_SQL} select software, publisher, version, r.version_uncut, r.version_suffix, r.version_date, r.version_is_date from (
select software, publisher, version, arg_min({{'version_uncut': version_uncut, 'version_suffix': version_suffix, 'version_date': version_date, 'version_is_date': version_is_date}},
 (version_uncut, version_suffix)) as r from normal group by all)""")
def fingerprint_dedup(spark: SparkSession, d: str) -> DataFrame:
    return Z.fingerprints(table(spark, d, "fingerprints_raw"))


@query(f"""with {NORMAL_SQL}, fp as (select distinct software, publisher, version from normal),
st as (select distinct coalesce(fp_software, '') as s, coalesce(fp_publisher, '') as p, coalesce(fp_version, '') as v from software_info)
select * from fp where not exists (select 1 from st where s = software and p = publisher and v = version)""")
def recognized_anti_join(spark: SparkSession, d: str) -> DataFrame:
    fp = Z.normalized(table(spark, d, "fingerprints_raw")).select("software", "publisher", "version").distinct()
    return lookup.not_yet_stored(fp, table(spark, d, "software_info"))


@query(f"""with {NORMAL_SQL}, fp as (select distinct software, publisher, version from normal),
st as (select distinct nullif(fp_software, '') as s, nullif(fp_publisher, '') as p, nullif(fp_version, '') as v from software_info)
select * from fp where not exists (select 1 from st where s = nullif(software, '') and p = nullif(publisher, '') and v = nullif(version, ''))""")
def recognized_anti_join_strict(spark: SparkSession, d: str) -> DataFrame:
    fp = Z.normalized(table(spark, d, "fingerprints_raw")).select("software", "publisher", "version").distinct()
    return lookup.not_yet_stored(fp, table(spark, d, "software_info"), strict=True)


# --- lookups -------------------------------------------------------------------------------------------------------

HOST_SQL = r"lower(regexp_extract(coalesce(homepage, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)', 1))"
OK_SQL = "(" + " or ".join(f"contains({HOST_SQL}, '{k}')" for _, ks in N.HOSTS for k in ks) + ") and coalesce(homepage, '') <> ''"
TIER_SQL = f"""case when {OK_SQL} and coalesce(description, '') <> '' and len(coalesce(licenses, [])) > 0 then 1 when {OK_SQL} then 2
 when coalesce(homepage, '') <> '' and coalesce(description, '') <> '' and len(coalesce(licenses, [])) > 0 then 3
 when coalesce(homepage, '') <> '' then 4 when coalesce(project_url, '') <> '' then 5 when coalesce(package_url, '') <> '' then 6 else 7 end"""
FAMILY_SQL = "case " + " ".join(f"when contains(lower(publisher), '{n}') then '{f}'" for n, f, _ in N.DISTRIBUTIONS) + " end"
# the vendors as the recognition names them, written out apart from the library's list
VENDOR_SQL = """case when lower(publisher) like '%debian%' then 'Debian' when lower(publisher) like '%ubuntu%' then 'Ubuntu' when lower(publisher) like '%fedora%' then 'Fedora'
 when lower(publisher) like '%red hat%' then 'Red Hat' when lower(publisher) like '%opensuse%' then 'openSUSE' when lower(publisher) like '%suse%' then 'SUSE'
 when lower(publisher) like '%alpine%' then 'Alpine Linux' when lower(publisher) like '%amazon%' then 'Amazon' when lower(publisher) like '%rocky%' then 'Rocky Enterprise Software Foundation'
 when lower(publisher) like '%alma%' then 'AlmaLinux' when lower(publisher) like '%centos%' then 'CentOS' end"""
FP_SQL = f"""fp as (select distinct {_strip("coalesce(software, '')")} as software, {_strip("coalesce(publisher, '')")} as publisher, {_strip("coalesce(version, '')")} as version from fingerprints_raw)"""


@query(f"""with {images.PACKAGE_FP_SQL}, hits as (select fp.software, fp.publisher, fp.version, p.id, p.projectname_seed, {TIER_SQL} as tier
 from fp join packages_info p on p.package = lower(replace(fp.software, ' ', '-'))
 where coalesce(homepage, project_url, package_url) is not null)
select * from hits qualify row_number() over (partition by software, publisher, version order by tier, id) = 1""")
def universal_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup.universal_lookup(images.package_fingerprints(spark, d), images.index(spark, d)).select(
        "software", "publisher", "version", "id", "projectname_seed", "tier"
    )


@query(f"""select id, projectname_seed, family, {TIER_SQL} as tier from packages_info
qualify row_number() over (partition by projectname_seed, family order by tier, id) = 1""")
def tiered_best_record(spark: SparkSession, d: str) -> DataFrame:
    ranked = images.index(spark, d).withColumn("tier", lookup.tier())
    return lookup.best_of(ranked, ["projectname_seed", "family"], [F.col("tier"), F.col("id")]).select("id", "projectname_seed", "family", "tier")


PATTERN_SQL = r"""case when regexp_matches(x, '^\d+\.\d') then concat(substr(x, 1, 1), repeat('_', length(regexp_extract(x, '^(\d+)\.', 1)) - 1), '.',
 regexp_extract(x, '^\d+\.(\d)', 1), '%') else x end"""


@query(f"select version, {PATTERN_SQL.replace('(x', '(version').replace(' x ', ' version ').replace(', x', ', version')} as pattern from (select distinct version from packages_info where version is not null)")
def version_like_patterns(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "packages_info").select("version").where("version is not null").distinct()
    return v.withColumn("pattern", N.like_pattern(F.col("version")))


@query(f"""with {images.PACKAGE_FP_SQL}, k as (select *, {FAMILY_SQL} as fam from fp),
h as (select k.software, k.publisher, k.version as fpv, p.*, p.version as iv,
 case when {OK_SQL} then 1 when coalesce(homepage, '') <> '' then 4 else 7 end as t3, {TIER_SQL} as t7
 from k join packages_info p on p.package = lower(replace(k.software, ' ', '-')) and p.family = k.fam),
own as (select * from h qualify row_number() over (partition by software, publisher, fpv order by t3, id) = 1),
pat as (select distinct software, publisher, fpv, {PATTERN_SQL.replace('(x', '(iv').replace(' x ', ' iv ').replace(', x', ', iv')} as pattern from h where coalesce(iv, '') <> ''),
sim as (select distinct o.software, o.publisher, o.fpv, p.id, {TIER_SQL.replace('homepage', 'p.homepage').replace('description', 'p.description').replace('licenses', 'p.licenses').replace('project_url', 'p.project_url').replace('package_url', 'p.package_url')} as tier, 0 as own, p.version as iv
 from own o join pat using (software, publisher, fpv) join packages_info p on p.projectname_seed = o.projectname_seed and p.version like pat.pattern
 where o.t3 > 1 and coalesce(p.homepage, p.project_url, p.package_url) is not null),
cand as (select software, publisher, fpv, id, tier, own, iv from sim union all
 select software, publisher, fpv, id, greatest(t7, 4), 1, iv from own where t3 > 1),
best as (select * from cand qualify row_number() over (partition by software, publisher, fpv order by tier, own desc, iv desc nulls last, id) = 1)
select software, publisher, fpv as version, id, 0 as tier from own where t3 = 1
union all select software, publisher, fpv, id, tier from best""")
def family_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup.family_lookup(images.package_fingerprints(spark, d), images.index(spark, d)).select("software", "publisher", "version", "id", "tier")


def _published(spark: SparkSession, d: str) -> DataFrame:
    """The publishers of the results, and every row of the index as published by a distribution of its family."""
    own = table(spark, d, "software_info").select(F.concat(F.lit("s"), "id").alias("id"), F.col("fp_publisher").alias("publisher"))
    return own.unionByName(table(spark, d, "packages_info").select(F.concat(F.lit("p"), "id").alias("id"), F.expr(images.DISTRIBUTED).alias("publisher")))


@query(f"""with u as (select concat('s', id) as id, fp_publisher as publisher from software_info
union all select concat('p', id), {images.DISTRIBUTED} from packages_info) select id, {FAMILY_SQL} as family, {VENDOR_SQL} as vendor from u""")
def distribution_of_publisher(spark: SparkSession, d: str) -> DataFrame:
    return _published(spark, d).select("id", N.family(F.col("publisher")).alias("family"), N.vendor(F.col("publisher")).alias("vendor"))


@query("""select i.software_id, a.package, a.srcname, a.homepage from (select id as software_id, fp_software from software_info) i
join alpine_packages a on a.package = i.fp_software""")
def alpine_exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    info = table(spark, d, "software_info").select(F.col("id").alias("software_id"), F.col("fp_software").alias("package"))
    return info.join(table(spark, d, "alpine_packages").select("package", "srcname", "homepage"), "package")


@query("""with act as (select package, min(srcname) as source from alpine_packages where srcname is not null group by all),
arc as (select package, min(projectname_seed) as source from packages_info where projectname_seed is not null group by all),
home as (select projectname_seed as source, max(homepage) as homepage from packages_info where homepage like 'http%' group by all),
asked as (select distinct fp_software as package from software_info where fp_software is not null)
select asked.package, coalesce(act.source, arc.source) as source, coalesce(h1.homepage, h2.homepage) as homepage from asked
left join act using (package) left join arc using (package) left join home h1 on h1.source = act.source left join home h2 on h2.source = arc.source""")
def udd_two_hop(spark: SparkSession, d: str) -> DataFrame:
    info = table(spark, d, "packages_info")
    homes = info.select(F.col("projectname_seed").alias("source"), "homepage").where("homepage like 'http%'")
    active = table(spark, d, "alpine_packages").select("package", F.col("srcname").alias("source"))
    archived = info.select("package", F.col("projectname_seed").alias("source"))
    asked = table(spark, d, "software_info").select(F.col("fp_software").alias("package"))
    return lookup.two_hops(asked, [(active, homes), (archived, homes)])


# --- upserts -------------------------------------------------------------------------------------------------------

ALPINE_NEW = "select package, max(projectname_seed) as srcname, max(homepage) as homepage, max(description) as description, max(list_first(licenses)) as licenses from packages_info group by all"


@query(f"""with n as ({ALPINE_NEW}), o as (select * from alpine_packages)
select coalesce(o.package, n.package) as package, """
+ ", ".join(f"case when o.package is null then n.{c} when coalesce(n.{c}, '') <> '' then n.{c} else o.{c} end as {c}" for c in ("srcname", "homepage", "description", "licenses"))
+ " from o full join n on o.package = n.package")
def alpine_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "packages_info").groupBy("package").agg(
        F.max("projectname_seed").alias("srcname"), F.max("homepage").alias("homepage"), F.max("description").alias("description"),
        F.max(F.get("licenses", F.lit(0))).alias("licenses"),
    )
    return upserts.keep_old_if_empty(table(spark, d, "alpine_packages"), new, "package", ["srcname", "homepage", "description", "licenses"])


@query("""with r as (select identifier, name, osi_approved, 0 as seq from licenses
union all select name, name, osi_approved, 1 from licenses union all select identifier, upper(name), false, 2 from licenses where osi_approved is null)
select identifier, name, osi_approved from r qualify row_number() over (partition by identifier order by seq desc) = 1""")
def license_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "licenses")
    rows = (
        old.withColumn("seq", F.lit(0))
        .unionByName(old.select(F.col("name").alias("identifier"), "name", "osi_approved", F.lit(1).alias("seq")))
        .unionByName(old.where("osi_approved is null").select("identifier", F.upper("name").alias("name"), F.lit(False).alias("osi_approved"), F.lit(2).alias("seq")))
    )
    return upserts.last_wins(rows, ["identifier"], "seq").drop("seq")


@query("""with n as (select publisher, product, nullif(version, '-') as version, id from cpe_entities),
o as (select publisher, product, version from cpe_entities where version not in ('-', '*'))
select publisher, product, version, min(id) as id from n where not exists (select 1 from o where o.publisher is not distinct from n.publisher
 and o.product is not distinct from n.product and o.version is not distinct from n.version) group by all""")
def cpe_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """The whole dictionary against its stored entries, which are those with a stated version."""
    cpe = table(spark, d, "cpe_entities")
    return upserts.insert_ignore(
        cpe.where("version not in ('-', '*')"), cpe.withColumn("version", F.nullif("version", F.lit("-"))), ["publisher", "product", "version"], "id"
    )


# --- identities and licenses ---------------------------------------------------------------------------------------

SW_SQL = """s as (select id, list_filter(list_concat([software], coalesce(software_alternative, [])), lambda x: coalesce(x, '') <> '') as names,
 list_filter(list_concat([publisher], coalesce(publisher_alternative, [])), lambda x: coalesce(x, '') <> '') as publishers, version from software_info),
cand as (select distinct s.id, s.publishers, s.version, c.id as cpe_id, c.publisher as cpe_publisher, c.product, c.version as cpe_version
 from (select id, publishers, version, unnest(names) as name from s) s join cpe_entities c on c.product = replace(lower(name), ' ', '_'))"""


def _software(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")

    def given(one: str, more: str) -> Column:
        return F.filter(F.concat(F.array(one), F.coalesce(more, none)), lambda x: F.coalesce(x, F.lit("")) != "")

    return table(spark, d, "software_info").select(
        "id", given("software", "software_alternative").alias("names"), given("publisher", "publisher_alternative").alias("publishers"), "version"
    )


@query(f"with {SW_SQL} select id, cpe_id from cand")
def cpe_lookup(spark: SparkSession, d: str) -> DataFrame:
    return identity.cpe_candidates(_software(spark, d), table(spark, d, "cpe_entities")).select("id", "cpe_id")


@query(rf"""with {SW_SQL}, parts as (select *, regexp_extract_all(coalesce(version, ''), '[\pL\pN]+') as a, regexp_extract_all(coalesce(cpe_version, ''), '[\pL\pN]+') as b from cand)
select id, cpe_id, concat('cpe:2.3:a:', cpe_publisher, ':', product, ':') as cpe_string from parts
where list_contains(list_transform(publishers, lambda x: lower(x)), replace(cpe_publisher, '_', ' ')) or (len(a) > 0 and len(b) >= len(a) and b[1:len(a)] = a)
qualify row_number() over (partition by id order by cpe_id) = 1""")
def cpe_first_match(spark: SparkSession, d: str) -> DataFrame:
    return identity.cpe_identity(_software(spark, d), table(spark, d, "cpe_entities"))


@query(r"""select id, pos, value from (select id, unnest(regexp_split_to_array(regexp_replace(l, '^[ ()]+|[ ()]+$', '', 'g'), '(?i)[()\s]+(?:or|and)[()\s]+')) as value,
 generate_subscripts(regexp_split_to_array(regexp_replace(l, '^[ ()]+|[ ()]+$', '', 'g'), '(?i)[()\s]+(?:or|and)[()\s]+'), 1) as pos from
 (select id, array_to_string(licenses, ' AND ') as l from packages_info where licenses is not null))""")
def license_split(spark: SparkSession, d: str) -> DataFrame:
    packed = table(spark, d, "packages_info").where("licenses is not null").select("id", F.array(F.array_join("licenses", " AND ")).alias("l"))
    return packed.select("id", F.posexplode(N.license_names(F.col("l"))).alias("p", "value")).select("id", (F.col("p") + 1).alias("pos"), "value")


@query("""with v as (select id, unnest(licenses) as identifier from packages_info)
select v.id, v.identifier, l.name from v join licenses l using (identifier)""")
def license_exact_join(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "packages_info").select("id", F.explode("licenses").alias("identifier"))
    return identity.exact_licenses(values, table(spark, d, "licenses"))[0]


@query("""with v as (select id, unnest(licenses) as identifier from packages_info)
select identifier, count(*) as n from v where not exists (select 1 from licenses l where l.identifier = v.identifier) group by all""")
def license_unmatched(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "packages_info").select("id", F.explode("licenses").alias("identifier"))
    return identity.exact_licenses(values, table(spark, d, "licenses"))[1].groupBy("identifier").agg(F.count(F.lit(1)).alias("n"))


@query("""with p as (select q.vec_id as query_id, b.vec_id as near_id, list_distance(q.embedding::double[], b.embedding::double[]) as distance
 from embeddings q, embeddings b where q.vec_id % 50 = 0 and b.vec_id <> q.vec_id)
select query_id, near_id, round(distance, 6) as distance from p where distance <= 1.3 qualify row_number() over (partition by query_id order by distance, near_id) = 1""")
def knn_threshold(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return identity.nearest(base.where("id % 50 = 0"), base, threshold=1.3, exclude_self=True).withColumn("distance", F.round("distance", 6))


# --- index files ---------------------------------------------------------------------------------------------------


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Index files: the stored packages as the first file, the package index by family as later ones."""
    first = table(spark, d, "alpine_packages").select(
        F.lit(0).alias("file_rank"), F.lit(0).cast("bigint").alias("pos"), "package", F.lit("1.0").alias("version"), "srcname", "homepage", "description", "licenses"
    )
    later = table(spark, d, "packages_info").select(
        F.when(F.col("family") == "alpine", 1).otherwise(2).alias("file_rank"), F.col("id").alias("pos"), "package", "version",
        F.coalesce("projectname_seed", F.lit("")).alias("srcname"), "homepage", F.coalesce("description", F.lit("")).alias("description"), F.get("licenses", F.lit(0)).alias("licenses"),
    )
    return first.unionByName(later)


RECORDS_SQL = """records as (select 0 as file_rank, 0::bigint as pos, package, '1.0' as version, srcname, homepage, description, licenses from alpine_packages
union all select case when family = 'alpine' then 1 else 2 end, id, package, version, coalesce(projectname_seed, ''), homepage, coalesce(description, ''), licenses[1] from packages_info),
merged as (select * from records qualify row_number() over (partition by package order by file_rank, pos desc) = 1)"""


@query(f"with {RECORDS_SQL} select file_rank, pos, package, version from merged")
def chainmap_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return alpine.merged_index(_records(spark, d)).select("file_rank", "pos", "package", "version")


SRC_SQL = r"""case when regexp_extract(coalesce(version, ''), '^(\d+)(?:\.|$)', 1) = '' then srcname else replace(srcname, regexp_extract(coalesce(version, ''), '^(\d+)(?:\.|$)', 1), '') end"""


@query(f"select package, version, {SRC_SQL.replace('srcname', 'projectname_seed')} as cleaned from packages_info where projectname_seed is not null")
def apk_srcname(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "packages_info").where("projectname_seed is not null")
    return rows.select("package", "version", N.source_name(F.col("projectname_seed"), F.col("version")).alias("cleaned"))


@query(f"""with {RECORDS_SQL}, c as (select *, {SRC_SQL} as src from merged),
t as (select src, string_agg(concat(package, ' - ', coalesce(description, '')), ', ' order by file_rank desc, pos, package) as told from c where src <> '' group by all)
select package, c.src as srcname, homepage, coalesce(told, description) as description, licenses from c left join t using (src)""")
def srcname_description_agg(spark: SparkSession, d: str) -> DataFrame:
    return alpine.described_sources(alpine.merged_index(_records(spark, d)))
