"""The queries of this subpackage: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgloom.engine import cut, join_skewed, key_spelling, release, small, table
from pkgloom.llm import canonical, fingerprints, leakage, linkage, names, packing, survivor, truncation
from pkgloom.plans.packed import MAX_LICENSES, alpine_license_values

#: Records of one product that one task joins with its dictionary entries.
SPREAD = 2_000

FP = ["fp_software", "fp_publisher", "fp_version"]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.copy_links(table(spark, folder, "software_info").select("id", *FP), FP)


def p3_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.collapse(table(spark, folder, "software_info").select("id", *FP), FP)


def license_values(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, record_key, pos, value) of every license value of both tables."""
    packages = table(spark, folder, "packages_info").select(
        F.lit("packages_info").alias("table_name"),
        F.col("id").cast("string").alias("record_key"),
        F.posexplode("licenses").alias("pos", "value"),
    )
    alpine = alpine_license_values(spark, folder).select(
        F.lit("alpine_packages").alias("table_name"),
        F.col("package").alias("record_key"),
        F.posexplode("values_").alias("pos", "value"),
    )
    return packages.unionByName(alpine).withColumn("pos", (F.col("pos") + 1).cast("int"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    entries = small(table(spark, folder, "licenses").select("identifier", "name"), MAX_LICENSES, "licenses")
    known = [r.identifier for r in entries if r.identifier]
    loose = license_values(spark, folder).where(~F.col("value").isin(known))
    mapped = canonical.map_values(loose, "value", [(r.identifier, r.name) for r in entries if r.identifier])
    return mapped.select("table_name", "record_key", "pos", "identifier")


def p4_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct values without a counterpart and how often each occurs."""
    entries = small(table(spark, folder, "licenses").select("identifier", "name"), MAX_LICENSES, "licenses")
    known = [r.identifier for r in entries if r.identifier]
    loose = license_values(spark, folder).where(~F.col("value").isin(known)).select("value")
    mapped = canonical.map_values(loose, "value", [(r.identifier, r.name) for r in entries if r.identifier])
    return mapped.where("identifier = ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    packages = table(spark, folder, "packages_info").select(
        "id", "projectname_seed", "homepage", "description", "licenses", "observed_at"
    )
    return survivor.best_values(packages, "projectname_seed", ["homepage", "description"], ["licenses"], "observed_at")


def publisher_names(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct key spellings of the publisher fields, with occurrences."""
    info = table(spark, folder, "software_info")
    fields = F.concat(F.array("fp_publisher", "publisher"), F.coalesce("publisher_alternative", F.array().cast("array<string>")))
    spelled = info.select(F.explode(fields).alias("v")).select(key_spelling(F.col("v")).alias("name"))
    return spelled.where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def publishers_together(spark: SparkSession, folder: str) -> DataFrame:
    """(name, other, n): spellings that one record gives for its publisher."""
    info = table(spark, folder, "software_info")
    fields = F.concat(F.array("publisher"), F.coalesce("publisher_alternative", F.array().cast("array<string>")))
    one = info.select(F.array_distinct(F.transform(fields, key_spelling)).alias("v"))
    pairs = one.select("v", F.explode("v").alias("name")).select("name", F.explode("v").alias("other"))
    return pairs.where("name <> other and name <> '' and other <> ''").groupBy("name", "other").agg(F.count(F.lit(1)).alias("n"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.link_pairs(names.entities(publisher_names(spark, folder), publishers_together(spark, folder)))


def p6_members(spark: SparkSession, folder: str) -> DataFrame:
    """(name, entity, links): the class of every name and the number of names that it is linked to."""
    return names.members(names.entities(publisher_names(spark, folder), publishers_together(spark, folder)))


#: A worker forgets its answers when it holds so many, so memory stays bounded whatever the number of spellings.
MEMO = 200_000


def _words_of(short_forms: dict[str, str], empty_words: set[str]):
    """Adds the canonical product words of (text, entity) to each row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[tuple, str] = {}
        for batch in batches:
            if len(memo) > MEMO:
                memo.clear()
            keys = list(zip(batch["text"], batch["entity"], strict=True))
            for k in keys:
                if k not in memo:
                    memo[k] = linkage.product_words(*k, short_forms, empty_words)
            yield batch.assign(product=[memo[k] for k in keys])

    return work


def product_classes(
    spark: SparkSession, folder: str, short_forms: dict[str, str] = linkage.SHORT_FORMS, empty_words: set[str] = linkage.EMPTY_WORDS
) -> tuple[DataFrame, DataFrame]:
    """((cpe_id, product_id), (software_id, product_id, confidence)): the products of both sources that are matched. The lists of
    short forms and empty words of product names are parameters."""
    worded = _words_of(short_forms, empty_words)
    info, cpe = table(spark, folder, "software_info"), table(spark, folder, "cpe_entities")
    none = F.array().cast("array<string>")
    hint = F.split(F.lower(F.regexp_replace("cpe_string", r"^(?i)cpe:(?:2\.3:|/)a:", "")), ":")
    cpe_forms = cpe.where("product is not null and product <> ''").groupBy("publisher", "product").agg(F.count(F.lit(1)).alias("n"))
    cpe_forms = cut(cpe_forms.withColumn("name", key_spelling(F.col("publisher"))))
    records = info.select(
        F.col("id").alias("software_id"),
        F.filter(
            F.array_distinct(F.transform(F.concat(F.array("publisher"), F.coalesce("publisher_alternative", none)), key_spelling)),
            lambda x: x != "",
        ).alias("said"),
        F.filter(F.concat(F.array("software"), F.coalesce("software_alternative", none)), lambda x: F.coalesce(x, F.lit("")) != "").alias("texts"),
        F.filter(F.array(key_spelling(hint[0]), key_spelling(F.col("fp_publisher"))), lambda x: x != "").alias("beside"),
    )
    spelled = (
        publisher_names(spark, folder)
        .unionByName(cpe_forms.where("name <> ''").groupBy("name").agg(F.sum("n").alias("n")))
        .unionByName(records.select(F.explode("beside").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")))
        .groupBy("name")
        .agg(F.sum("n").alias("n"))
    )
    spelled = cut(spelled)
    entity = cut(names.entities(spelled, publishers_together(spark, folder)).join(spelled, "name").select("name", "entity", "n"))
    release(spark)
    # what a record says of its publisher, in order, and what stands beside it (place -1)
    called = records.select("software_id", F.posexplode("said").alias("at", "name")).unionByName(records.select("software_id", F.lit(-1).alias("at"), F.explode("beside").alias("name")))
    meant = join_skewed(called, entity, ["name"], "n").groupBy("software_id").agg(
        F.min(F.when(F.col("at") >= 0, F.struct("at", "entity"))).alias("e"), F.collect_set(F.when(F.col("at") < 0, F.col("entity"))).alias("asides")
    )
    known = records.join(meant, "software_id", "left").select("software_id", "texts", F.coalesce("e.entity", F.lit("")).alias("entity"), F.coalesce("asides", none).alias("asides"))
    # without a publisher, the first word may be the publisher's; the rest then counts only if it is
    _tail = F.regexp_replace(F.trim("said"), r"^\S+\s+(?=\S)", "")
    s_rows = cut(
        known.select("software_id", "entity", "asides", F.explode("texts").alias("said"))
        .select("software_id", "entity", "asides", "said", F.explode(F.array_distinct(F.array("said", _tail))).alias("text"))
        .where("text = said or entity = ''")
        .mapInPandas(worded, "software_id bigint, entity string, asides array<string>, said string, text string, product string")
        .withColumn("form", F.concat(F.lit("s"), F.concat_ws("\u0001", "entity", "product")))
    )
    c_rows = cut(
        cpe_forms.join(entity.drop("n"), "name", "left")
        .select("publisher", F.col("product").alias("text"), "n", F.coalesce("entity", F.concat(F.lit("? "), "name")).alias("entity"))
        .mapInPandas(worded, "publisher string, text string, n bigint, entity string, product string")
        .withColumn("form", F.concat(F.lit("c"), F.concat_ws("\u0001", "entity", "product")))
    )
    s_forms = s_rows.groupBy("form", "entity", "product").agg(F.count(F.lit(1)).alias("n"))
    c_forms = c_rows.groupBy("form", "entity", "product").agg(F.sum("n").alias("n"))
    forms = cut(s_forms.unionByName(c_forms).where("product <> ''"))
    pairs, loose = linkage.candidates(forms)
    release(spark)
    placed, bridges = guessed_publishers(s_rows.where("entity = ''"), forms, loose)
    said = s_rows.where("entity <> ''").select("software_id", "form", F.array_contains("asides", F.col("entity")).cast("int").alias("hinted"), F.lit(1).alias("named"))
    placed = cut(said.unionByName(placed.withColumn("named", F.lit(0))))
    release(spark)
    sizes = placed.groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    everything = sizes.unionByName(c_forms.where("product <> ''").select("form", "n"))
    products = linkage.products_of(everything, pairs.unionByName(bridges).groupBy("form_a", "form_b").agg(F.max("similarity").alias("similarity")))
    told = (
        join_skewed(placed, products.join(sizes, "form"), ["form"], "n")
        .where("weight > 0")
        .groupBy("software_id", "product_id")
        .agg(F.max(linkage.PUBLISHER_WEIGHT * F.col("named") + linkage.PRODUCT_WEIGHT * F.col("weight") + linkage.HINT_WEIGHT * F.col("hinted")).alias("confidence"))
        .withColumn("confidence", F.round("confidence", 4))
    )
    entries = (
        cpe.where("product is not null and product <> ''").select(F.col("id").alias("cpe_id"), F.coalesce("publisher", F.lit("")).alias("publisher"), "product")
        .join(c_rows.select(F.coalesce("publisher", F.lit("")).alias("publisher"), F.col("text").alias("product"), "form").distinct(), ["publisher", "product"])
        .join(products.where("weight > 0").select("form", "product_id"), "form")
        .select("cpe_id", "product_id").distinct()
    )
    return entries, told


def guessed_publishers(blank: DataFrame, forms: DataFrame, loose: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Publishers for the rows of records without one (``blank``: software_id, asides, said, text, form).

    Returns (software_id, form, hinted), the form being that of the publisher that stands out for the record: one whose words
    are part of what the record calls its product, or that its hint or distributor's field names, or the only one of a
    product of telling words; and the pairs (form_a, form_b, similarity) that tie these forms to the others. Publishers
    without any such evidence are never joined to a record, so a product name of many publishers stays cheap."""
    offers = loose.select(F.col("form_a").alias("form"), F.col("form_b").alias("other"), "similarity").where(F.startswith("form", F.lit("s")))
    offers = cut(offers.withColumn("aside", F.regexp_extract("other", "(?s)^.([^\u0001]*)", 1)))
    # a product of words that many publishers use says nothing by itself
    worded = forms.where("entity <> ''").select("entity", F.explode(F.split("product", " ")).alias("word"))
    used = worded.groupBy("word").agg(F.countDistinct("entity").alias("owners"))
    rarest = (
        forms.where("entity = ''").select("form", F.explode(F.split("product", " ")).alias("word")).join(used, "word", "left")
        .groupBy("form").agg(F.min(F.coalesce("owners", F.lit(0))).alias("owners"))
    )
    choices = offers.select("form", "aside").distinct()
    only = choices.groupBy("form").agg(F.count(F.lit(1)).alias("choices"), F.first("aside").alias("aside")).join(rarest, "form")
    only = only.where((F.col("choices") == 1) & (F.col("owners") <= linkage.RARE_OWNERS)).select("form", "aside")
    spoken = cut(blank.groupBy("form", "said", "text").agg(F.count(F.lit(1)).alias("n")))
    own_word = F.exists(F.split("aside", " "), lambda w: (F.length(w) > 3) & F.contains(F.lower(F.col("said")), w))
    own = spoken.join(choices, "form").where(own_word).select("form", "said", "text", "aside", F.lit(1).alias("own"))
    telling = spoken.where("text = said").join(only, "form").select("form", "said", "text", "aside", F.lit(0).alias("own"))
    evidence = own.unionByName(telling).groupBy("form", "said", "text", "aside").agg(F.max("own").alias("own"))
    listed = evidence.groupBy("form", "said", "text").agg(F.collect_list(F.struct("aside", "own")).alias("l")).join(spoken, ["form", "said", "text"])
    by_text = join_skewed(blank.select("software_id", "form", "said", "text"), cut(listed), ["form", "said", "text"], "n").select("software_id", "form", F.explode("l").alias("x"))
    by_text = by_text.select("software_id", "form", "x.aside", "x.own", F.lit(0).alias("backed"), F.lit(True).alias("enough"))
    hinted = blank.select("software_id", "form", F.explode("asides").alias("aside"), (F.col("text") == F.col("said")).alias("enough"))
    asked = hinted.groupBy("form", "aside").agg(F.count(F.lit(1)).alias("n")).join(choices, ["form", "aside"])
    by_hint = join_skewed(hinted, cut(asked), ["form", "aside"], "n").select("software_id", "form", "aside", F.lit(0).alias("own"), F.lit(1).alias("backed"), "enough")
    judged = (
        by_text.unionByName(by_hint).groupBy("software_id", "form", "aside").agg(F.max("own").alias("own"), F.max("backed").alias("hinted"), F.max("enough").alias("enough"))
        .where("enough").withColumn("support", F.col("own") + F.col("hinted"))
        .withColumn("most", F.expr("max(support) over (partition by software_id)")).where("support = most")
    )
    chosen = cut(judged.select("software_id", F.col("form").alias("blank"), "aside", F.least("support", F.lit(1)).alias("hinted")))
    moved = F.concat(F.lit("s"), F.col("aside"), F.expr("substr(blank, 2)"))
    placed = chosen.select("software_id", moved.alias("form"), "hinted")
    ties = chosen.select("blank", "aside").distinct().join(offers.withColumnRenamed("form", "blank"), ["blank", "aside"])
    bridges = ties.select(moved.alias("form_a"), F.col("other").alias("form_b"), "similarity").where("form_a <> form_b")
    return placed, bridges


def product_matches(spark: SparkSession, folder: str) -> DataFrame:
    """(cpe_id, software_id, confidence): see TESTDATA problem 2. A product is spread by the number of its records."""
    entries, told = product_classes(spark, folder)
    held = told.groupBy("product_id").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("spread"))
    spread = told.join(held, "product_id").withColumn("salt", F.pmod(F.xxhash64("software_id"), F.col("spread")).cast("int"))
    salted = entries.join(held, "product_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("spread") - 1))).drop("spread")
    return salted.join(spread.drop("spread"), ["product_id", "salt"]).groupBy("cpe_id", "software_id").agg(F.max("confidence").alias("confidence"))


def p2_products(spark: SparkSession, folder: str) -> DataFrame:
    """(side, id, product_id, links): every matched entry and record with its class and the number of its partners."""
    entries, told = (cut(x) for x in product_classes(spark, folder))
    many = told.groupBy("product_id").agg(F.count(F.lit(1)).alias("records")).join(entries.groupBy("product_id").agg(F.count(F.lit(1)).alias("entries")), "product_id")
    one = entries.join(many, "product_id").select(F.lit("cpe").alias("side"), F.col("cpe_id").alias("id"), "product_id", F.col("records").alias("links"))
    return one.unionByName(told.join(many, "product_id").select(F.lit("software").alias("side"), F.col("software_id").alias("id"), "product_id", F.col("entries").alias("links")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return product_matches(spark, folder).select("cpe_id", "software_id")


def capacities(spark: SparkSession, folder: str) -> dict[str, int]:
    rows = small(table(spark, folder, "pack_capacities"), 1_000, "pack_capacities")
    return {r.profile: int(r.capacity_tokens) for r in rows}


def _per_profile(spark: SparkSession, folder: str, report) -> DataFrame:
    """What ``report`` makes of (packed, capacity) for every profile, with the profile; the texts are measured once."""
    sizes = cut(packing.token_sizes(table(spark, folder, "documents")))
    shares = [
        report(packing.pack(sizes, capacity), capacity).withColumn("profile", F.lit(profile)) for profile, capacity in sorted(capacities(spark, folder).items())
    ] or [report(packing.pack(sizes.limit(0), 1), 1).withColumn("profile", F.lit(""))]
    out = functools.reduce(DataFrame.unionByName, shares)
    return out.select("profile", *[c for c in out.columns if c != "profile"])


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Container and place of every text, in the capacity of every profile."""
    return _per_profile(spark, folder, lambda packed, capacity: packed)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of every profile get."""
    return _per_profile(spark, folder, lambda packed, capacity: packing.fill(packed, capacity).withColumn("capacity", F.lit(capacity)))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return leakage.leaks(docs, table(spark, folder, "eval_items"))[0].select("doc_id", "item_id")


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The merged word spans to remove from each text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return leakage.leaks(docs, table(spark, folder, "eval_items"))[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_texts(table(spark, folder, "documents").select("doc_id", "source", "text"))


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_rates(table(spark, folder, "documents").select("doc_id", "source", "text"))


QUERIES = {f.__name__: f for f in (p2_found, p2_products, p3_found, p3_collapsed, p4_found, p4_unmatched, p5_found, p6_found, p6_members, p7_packed, p7_fill, p8_found, p8_spans, p9_found, p9_rates)}



def _spelled(column: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({column}, '')), '[^\pL\p{{Nd}}]+', ' ', 'g'))"


_COPIES = f"""k as (select *, list_sort([{_spelled("fp_software")}, {_spelled("fp_publisher")}, {_spelled("fp_version")}]) as k from software_info),
g as (select k, min(id) as first_id, count(*) as copies from k group by k)"""
_STAND_INS = ", ".join(f"'{s}'" for s in survivor.STAND_INS)


def _silent(value: str) -> str:
    return rf"(lower(trim(regexp_replace({value}, '[\s\x{{a0}}]+', ' ', 'g'))) in ({_STAND_INS}, ''))"


_VALUES = f"""r as (select *, {_spelled("projectname_seed")} as k from packages_info where projectname_seed is not null),
p as (select k, min(id) as first_id from r group by k having count(*) > 1),
st as (select k, id, observed_at, 'homepage' as field_name, homepage as v, null::varchar[] as items from r
 union all select k, id, observed_at, 'description', description, null from r
 union all select k, id, observed_at, 'licenses', array_to_string(list_transform(licenses, lambda x: concat(coalesce(x, chr(2)), chr(1))), ''), licenses from r),
d as (select k, field_name, v, any_value(items) as items, max(observed_at) as at, min(id) as best_id from st where v is not null group by all),
u as (select * from d where case when items is null then not {_silent("v")} else len(list_filter(items, lambda x: x is not null and not {_silent("x")})) > 0 end
 and not exists (select 1 from d w where w.k = d.k and w.field_name = d.field_name and w.v <> d.v and starts_with(w.v, d.v))
 and (items is null or not exists (select 1 from d w where w.k = d.k and w.field_name = d.field_name and len(list_distinct(w.items)) > len(list_distinct(d.items)) and list_has_all(w.items, list_distinct(d.items)))))"""

#: DuckDB counterparts of the queries that plain SQL can express.
SQL: dict[str, str] = {
    "p3_found": f"with {_COPIES} select g.first_id, k.id as copy_id from k join g using (k) where k.id <> g.first_id",
    "p3_collapsed": f"with {_COPIES} select k.id, fp_software, fp_publisher, fp_version, g.copies from k join g using (k) where k.id = g.first_id",
    "p5_found": f"""with {_VALUES} select p.first_id, u.field_name, u.best_id from u join p using (k)
qualify row_number() over (partition by u.k, u.field_name order by u.at desc nulls last, length(u.v) desc, u.best_id) = 1""",
}
