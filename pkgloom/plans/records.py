"""Queries of name, version, date and release operators over images of the driver's tables, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgloom.engine import table
from pkgloom.functions import dates, specfile
from pkgloom.functions import names as N
from pkgloom.functions import versions as V
from pkgloom.plans.relational import query
from pkgloom.resolvers import packages, releases

#: Notations of a date, by number: (Spark expression over the day d, DuckDB expression).
NOTATIONS = [
    ("date_format(d, 'yyyy-MM-dd')", "strftime(d, '%Y-%m-%d')"), ("date_format(d, 'dd MMMM yyyy')", "strftime(d, '%d %B %Y')"),
    ("concat('built ', date_format(d, 'MMM d, yyyy'), ' at night')", "concat('built ', strftime(d, '%b %-d, %Y'), ' at night')"), ("date_format(d, 'yyyyMMdd')", "strftime(d, '%Y%m%d')"),
    ("date_format(d, 'EEE, dd MMM yyyy HH:mm:ss')", "strftime(d, '%a, %d %b %Y %H:%M:%S')"), ("date_format(d, 'dd/MM/yyyy')", "strftime(d, '%d/%m/%Y')"),
    ("date_format(d, 'yyyyMM')", "strftime(d, '%Y%m')"), ("date_format(d, 'ddMMMyyyy')", "strftime(d, '%d%b%Y')"), ("date_format(d, 'yyyy.MM.dd')", "strftime(d, '%Y.%m.%d')"),
    ("concat('v', year(d), '.13.45')", "concat('v', year(d), '.13.45')"), ("'no date'", "'no date'"),
]


@query("""with o as (select o_orderkey as id, o_orderdate::date as d, o_orderkey % 11 as k from orders)
select id, case when k = 6 then strftime(d, '%Y-%m-01') when k = 8 then case when day(d) > 12 then strftime(d, '%Y-%m-%d') end when k >= 9 then null else strftime(d, '%Y-%m-%d') end as found from o""")
def date_notations(spark: SparkSession, d: str) -> DataFrame:
    """The day of every order, written in turn in eleven notations, some of them no dates or open ones, and read back."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    said = F.element_at(F.array(*[F.expr(e).cast("string") for e, _ in NOTATIONS]), (F.col("id") % len(NOTATIONS) + 1).cast("int"))
    return orders.select("id", dates.first_date(said).alias("found"))


@query("""with o as (select o_orderkey as id, o_orderdate::date as d, o_orderkey % 4 as k from orders)
select id, case when k = 3 then null when k = 2 and day(d) <= 12 then null else strftime(d, '%m-%d') end as found from o""")
def yearless_dates(spark: SparkSession, d: str) -> DataFrame:
    """Month and day without a year: with the month's name, as digits, and where there is none."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    said = F.element_at(F.array(F.date_format("d", "d MMM"), F.date_format("d", "MMMM d"), F.date_format("d", "MM/dd"), F.lit("none")), (F.col("id") % 4 + 1).cast("int"))
    return orders.select("id", dates.first_yearless_date(said).alias("found"))


@query(r"""with h as (select doc_id, text, regexp_extract(text, '^[^\n]*?(\d[^\s()]*) \((\d{4}-\d{2}-\d{2})\)', 1) as first_version from documents where source = 'changelog'),
l as (select doc_id, unnest(regexp_extract_all(text, '(?m)^[^\s\d][^\n\d]*\d+\.\d+\.\d+ \(\d{4}-\d{2}-\d{2}\)')) as line from h where first_version <> ''),
v as (select doc_id, regexp_extract(line, '(\d+\.\d+\.\d+) \(', 1) as version, regexp_extract(line, '\((\d{4}-\d{2}-\d{2})\)', 1) as released from l)
select doc_id, version, min(released) as released from v group by all having count(*) = 1""")
def changelog_releases(spark: SparkSession, d: str) -> DataFrame:
    """The release date of every version that heads a part of a changelog, looked up by version."""
    docs = table(spark, d, "documents").where("source = 'changelog'").where(F.col("text").rlike(r"^[^\n]*?\d[^\s()]* \(\d{4}-\d{2}-\d{2}\)"))
    heads = F.regexp_extract_all("text", F.lit(r"(?m)^[^\s\d][^\n\d]*(\d+\.\d+\.\d+) \(\d{4}-\d{2}-\d{2}\)"), F.lit(1))
    asked = docs.select("doc_id", "text", F.explode(heads).alias("version")).groupBy("doc_id", "text", "version").count().where("count = 1")
    return asked.select("doc_id", "version", V.changelog_date("text", "version", F.lit(None).cast("string")).alias("released"))


#: Tags of a project, one per order of a customer: the version is the day, or three numbers.
TAGS = "struct(concat('v', o_orderkey % 7, '.', o_orderkey % 10, '.', o_custkey % 5 + 1) as name, date_format(o_orderdate, 'yyyy-MM-dd') as date, o_orderkey as pos)"


@query("""with t as (select o_custkey as project, o_orderkey as pos, concat(o_orderkey % 7, '.', o_orderkey % 10, '.', o_custkey % 5 + 1) as version, strftime(o_orderdate::date, '%Y-%m-%d') as day from orders),
asked as (select distinct project, version from t)
select a.project, a.version, arg_min(t.day, t.pos) as release_date, concat('v', a.version) as tag from asked a join t on t.project = a.project and t.version = a.version group by all""")
def tag_releases(spark: SparkSession, d: str) -> DataFrame:
    """The tag and date of every version of a project, with the orders of a customer as its tags; page and place settle ties."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.expr(TAGS).alias("t"))
    tags = orders.select("project", F.col("t.name").alias("name"), F.col("t.date").alias("date"), (F.col("t.pos") / 100).cast("int").alias("page"), F.col("t.pos").alias("pos"))
    asked = tags.select("project", F.regexp_replace("name", "^v", "").alias("version"), F.lit(None).cast("string").alias("version_suffix")).distinct()
    return releases.by_tag(asked, tags, ["project"]).select("project", "version", "release_date", F.col("name").alias("tag"))


@query(r"""with o as (select o_custkey as project, o_orderkey as pos, o_orderdate::date as d from orders),
asked as (select project, max(d) as d from o group by all), near as (select a.project, strftime(a.d, '%Y-%m-%d') as version_date, o.pos, o.d = a.d as same from asked a join o on o.project = a.project and year(o.d) = year(a.d) and month(o.d) = month(a.d))
select project, version_date, pos from near qualify row_number() over (partition by project order by same desc, pos) = 1""")
def date_tag_releases(spark: SparkSession, d: str) -> DataFrame:
    """The tag that fits a version that is a date: the same day, else the same month."""
    tags = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.date_format("o_orderdate", "'release-'yyyy-MM-dd").alias("name"), F.col("o_orderkey").alias("pos"))
    asked = tags.groupBy("project").agg(F.substring(F.max("name"), 9, 10).alias("version_date")).withColumn("suffix", F.lit(None).cast("string"))
    best = V.best_date_tags(asked.join(tags, "project"), ["project"], "name", "version_date", "suffix", ["pos"])
    return best.select("project", "version_date", "pos")


@query(r"""with i as (select o_custkey as project, o_orderkey as pos, concat('Release ', o_orderkey % 7, '.', o_orderkey % 10, '.', o_custkey % 5 + 1) as title, case when o_orderkey % 3 > 0 then strftime(o_orderdate::date, '%Y-%m-%d') end as day from orders),
asked as (select distinct project, replace(title, 'Release ', '') as version from i)
select a.project, a.version, (select day from i where i.project = a.project and i.title = concat('Release ', a.version) order by pos limit 1) as released from asked a""")
def feed_releases(spark: SparkSession, d: str) -> DataFrame:
    """The date of every version in a feed of many items, with the orders of a customer as items, a third of them undated."""
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("pos"), F.expr("concat('Release ', o_orderkey % 7, '.', o_orderkey % 10, '.', o_custkey % 5 + 1)").alias("title"),
        F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "EEE, dd MMM yyyy")).alias("day"),
    )
    item = F.concat(F.lit("<item><title>"), "title", F.lit("</title>"), F.coalesce(F.concat(F.lit("<pubDate>"), "day", F.lit("</pubDate>")), F.lit("")), F.lit("</item>"))
    feeds = orders.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("x")))), lambda s: s["x"]), "").alias("x"))
    feeds = feeds.select("project", F.concat(F.lit("<rss><channel>"), "x", F.lit("</channel></rss>")).alias("body"))
    asked = orders.select("project", F.replace("title", F.lit("Release "), F.lit("")).alias("version"), F.lit(None).cast("string").alias("version_suffix")).distinct()
    return releases.by_feed(asked, feeds, ["project"]).select("project", "version", F.nullif("release_date", F.lit("")).alias("released"))


@query(r"""with a as (select id, list_transform(list_concat([coalesce(publisher, '')], coalesce(publisher_alternative, [])), lambda x: concat(x, ' <', lower(x), '@x.example>')) as authors from software_info)
select id, array_to_string(list_sort(list_transform(authors, lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g')))), ', ') as authors from a""")
def author_lists(spark: SparkSession, d: str) -> DataFrame:
    """Authors without their addresses, as one text."""
    given = F.concat(F.array(F.coalesce("publisher", F.lit(""))), F.coalesce("publisher_alternative", F.array().cast("array<string>")))
    authors = F.transform(F.filter(given, lambda x: x.isNotNull()), lambda x: F.concat(x, F.lit(" <"), F.lower(x), F.lit("@x.example>")))
    return table(spark, d, "software_info").select("id", N.author_list(authors).alias("authors"))


@query("""select distinct version, case when id % 3 = 0 then concat(version, ' rc1') else version end as shown from packages_info where version is not null""")
def version_shown(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "packages_info").where("version is not null")
    return rows.select("version", N.with_suffix(F.col("version"), F.when(F.col("id") % 3 == 0, F.lit("rc1"))).alias("shown")).distinct()


_PY = r"(?i)python([23]\d{0,2})[\s-]+([^\s-]\S*)"


@query(rf"""with r as (select id, case id % 4 when 0 then concat('python3-', coalesce(family, 'debug')) when 1 then 'python310-devel' when 2 then 'Python2 tkinter' else concat('lib', package) end as software,
 case id % 5 when 0 then '3.10.2' when 1 then '2.7' when 2 then '3.1' else coalesce(version, '') end as version from packages_info),
m as (select *, regexp_extract(software, '{_PY}', 1) as short, lower(regexp_extract(software, '{_PY}', 2)) as part from r)
select id, software, version, regexp_matches(software, '{_PY}') and part in ('debug', 'devel', 'idle', 'libs', 'python', 'stdlib', 'test', 'tkinter')
 and starts_with(version, case when length(short) <= 1 then short else concat(substr(short, 1, 1), '.', substr(short, 2)) end) as standard from m""")
def python_standard_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the Python distribution of the very version."""
    software = "case id % 4 when 0 then concat('python3-', coalesce(family, 'debug')) when 1 then 'python310-devel' when 2 then 'Python2 tkinter' else concat('lib', package) end"
    version = "case id % 5 when 0 then '3.10.2' when 1 then '2.7' when 2 then '3.1' else coalesce(version, '') end"
    rows = table(spark, d, "packages_info").selectExpr("id", f"{software} as software", f"{version} as version")
    return rows.withColumn("standard", N.python_standard_part(F.col("software"), F.col("version")))


@query("""with r as (select l_orderkey as id, l_linenumber as pos, concat(case when min(l_suppkey) % 5 = 0 then 'openSUSE:' else 'home:' end, min(l_suppkey) % 9) as project, concat('p', min(l_partkey)) as package from lineitem group by l_orderkey, l_linenumber),
k as (select id, max(case when contains(lower(project), 'suse') then pos end) as suse, max(pos) as last, arg_min(project, pos) as first_project from r group by all)
select r.id, case when k.suse is null then k.first_project else r.project end as project, r.package from r join k on r.id = k.id and r.pos = coalesce(k.suse, k.last)""")
def opensuse_search(spark: SparkSession, d: str) -> DataFrame:
    """The search result that is followed, with the lines of an order as results."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos")).agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    rows = lines.selectExpr("id", "pos", "concat(case when s % 5 = 0 then 'openSUSE:' else 'home:' end, s % 9) as project", "concat('p', p) as package")
    return packages.opensuse_choice(rows, ["id"])


@query("""with r as (select p_partkey as id, concat(string_split(p_name, ' ')[1], '-', string_split(p_name, ' ')[2]) as package, string_split(p_name, ' ') as w from part),
x as (select id, package, 0 as pos, concat(package, '-extra') as repo from r where id % 4 <> 3 union all select id, package, 1, concat(w[2], '_', upper(w[1])) from r where id % 2 = 0
 union all select id, package, 2, package from r where id % 3 = 0 union all select id, package, 3, concat(w[3], '-other') from r)
select id, repo from x where pos < 3 qualify row_number() over (partition by id order by case when pos = 2 then 0 else 1 end, pos) = 1""")
def owner_repository(spark: SparkSession, d: str) -> DataFrame:
    """The repository of an owner that a package is looked for in."""
    words = F.split("p_name", " ")
    package = F.concat_ws("-", F.get(words, F.lit(0)), F.get(words, F.lit(1)))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), package.alias("package"), words.alias("w"))
    at = F.array(
        F.when(F.col("id") % 4 != 3, F.concat("package", F.lit("-extra"))), F.when(F.col("id") % 2 == 0, F.concat(F.get("w", F.lit(1)), F.lit("_"), F.upper(F.get("w", F.lit(0))))),
        F.when(F.col("id") % 3 == 0, F.col("package")), F.concat(F.get("w", F.lit(2)), F.lit("-other")),
    )
    rows = parts.select("id", "package", F.posexplode(at).alias("pos", "repo")).where("repo is not null").withColumn("url", F.concat(F.lit("https://github.com/x/"), "repo"))
    return packages.best_repository(rows, ["id"]).select("id", "repo")


@query(r"""select doc_id, coalesce(nullif(regexp_extract(text, '(?m)^Name: *(.*?) *$', 1), ''), '') as name, 'Fedora' as vendor, regexp_extract(text, '(?m)^URL: *(.*?) *$', 1) as homepage, concat('https://src.example/', doc_id) as package_url,
regexp_replace(regexp_extract(text, '(?m)^License: *(.*?) *$', 1), 'LicenseRef-[^-]+-', '', 'g') as license from documents where source = 'specfile'""")
def fedora_records(spark: SparkSession, d: str) -> DataFrame:
    """Package records out of spec files."""
    docs = table(spark, d, "documents").where("source = 'specfile'")
    rows = docs.select(
        "doc_id", F.lit("").alias("software"), F.lit("").alias("version"), specfile.spec_struct("text").alias("spec"), F.concat(F.lit("https://src.example/"), "doc_id").alias("spec_url"), F.lit("").alias("page_url")
    )
    found = packages.fedora(rows, ["doc_id"])
    return found.select("doc_id", "name", "vendor", "homepage", "package_url", F.coalesce(F.get("licenses", F.lit(0)), F.lit("")).alias("license"))
