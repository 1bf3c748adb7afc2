"""Queries over items: components, audits, parsing, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions import exprs as X
from kinfold.operators import groups as G
from kinfold.operators import units as U
from kinfold.plans.views import ITEMS, items, split_of, table

SETS = ("label", "source", "split")
_COMP = f"""with {ITEMS}, comp as (select content, count(*) as component_size,
  string_agg(distinct label, '|' order by label) as labels, count(distinct label) as n_labels, string_agg(distinct source, '|' order by source) as sources, count(distinct source) as n_sources,
  string_agg(distinct split, '|' order by split) as splits, count(distinct split) as n_splits, min(struct_pack(s := source, d := doc_id)) as f from items group by content)"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.exact_components(items(spark, sf_dir), "doc_id", "content", SETS)


def exact_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir)


def duplicate_groups_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = G.numbered(components(spark, sf_dir).filter("component_size > 1").select("content", "component_size"), "content", "EXACT", "exact_group_id")
    return items(spark, sf_dir).join(groups, "content").select("exact_group_id", "component_size", "doc_id", "source", "split")


def component_conflict_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.conflicts(components(spark, sf_dir), SETS).select("content", "cross_label", "cross_source", "cross_split")


def exact_label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = items(spark, sf_dir).select("doc_id", "content").join(table(spark, sf_dir, "labels"), "doc_id")
    found = marked.groupBy("content").agg(F.count("*").alias("n_labelled"), F.countDistinct("quality").alias("n_quality"), F.countDistinct("toxic").alias("n_toxic"))
    return found.filter("n_quality > 1 or n_toxic > 1")


def exact_split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir).filter("n_splits > 1").groupBy("splits").agg(F.count("*").alias("n_components"), F.sum("component_size").alias("n_items"))


def cross_source_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir).filter("n_sources > 1").select("content", "component_size", "sources", "n_sources")


def pairwise_source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.overlap(items(spark, sf_dir), "source", "content")


def source_overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.overlap(items(spark, sf_dir), "source", "content", full=True)


_OVERLAP = f"""with {ITEMS}, u as (select distinct source as s, content as c from items), n as (select s, count(*) as n from u group by s),
m as (select x.s as a, y.s as b, count(*) as k from u x join u y on x.c = y.c group by 1, 2)
select n1.s as source_a, n2.s as source_b, n1.n as units_a, n2.n as units_b, coalesce(m.k, 0) as shared,
  round(100.0 * coalesce(m.k, 0) / greatest(n1.n, 1), 6) as percent_of_a, round(100.0 * coalesce(m.k, 0) / greatest(n2.n, 1), 6) as percent_of_b
from n n1 join n n2 on true left join m on m.a = n1.s and m.b = n2.s"""


def loso_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.leave_one_out(items(spark, sf_dir), "source", "content")


def canonical_manifest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row ids from source and path, and exactly one representative of each component."""
    i = items(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("content").orderBy("source", "doc_id")) == 1
    name = F.concat(F.lit("ITEM_"), F.substring(F.sha2(F.concat_ws("\n", "source", F.col("doc_id").cast("string")), 256), 1, 20))
    return i.select(name.alias("item_id"), "doc_id", "content", X.yes_no(first).alias("is_representative"))


def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    size = F.count("*").over(Window.partitionBy("content"))
    i = i.withColumn("copies", size)
    rules = {"UNLABELLED": F.col("quality").isNull(), "LOW_QUALITY": F.col("quality") == 0, "TOXIC": F.col("toxic") == 1, "TOO_SHORT": F.col("n_chars") < 200, "HAS_COPIES": F.col("copies") > 1}
    return G.eligibility(i, rules).select("doc_id", "eligible", "exclusion_reason")


def archive_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return i.groupBy("source").agg(F.count("*").alias("n_items"), F.countDistinct("content").alias("n_contents"), F.count_if(F.col("quality").isNotNull()).alias("n_labelled"), F.count_if(F.col("quality") == 0).alias("n_low_quality"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(F.col("n_chars") < 200).alias("n_short"), F.sum("n_chars").alias("n_chars"))


def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("source", "label", "split").agg(F.count("*").alias("n_items"))


def audit_kv_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.col("component_size") > 1
    return G.findings(components(spark, sf_dir), {"items": F.sum("component_size"), "components": F.count("*"), "duplicate_components": F.count_if(big), "surplus_copies": F.sum(F.col("component_size") - 1), "cross_source": F.count_if(F.col("n_sources") > 1), "cross_split": F.count_if(F.col("n_splits") > 1), "label_conflicts": F.count_if(F.col("n_labels") > 1)})


_PATH = "regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"
LANGUAGES = {"en": "english", "de": "german", "fr": "french", "es": "spanish"}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract(url, r"^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract(url, r"^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))


def url_split_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", X.path_part("path", LANGUAGES, "unspecified").alias("label"), X.normal_path("path").alias("path"))


def url_role_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("url").contains("utm_"), "tracked").when(F.col("url").contains("?"), "query").when(F.col("path").endswith(".html"), "page").when(F.col("path").endswith("/"), "directory").otherwise("other")
    return _pages(spark, sf_dir).select("page_id", role.alias("role"), X.extension("path").alias("extension"), F.element_at(F.split("host", r"\."), -1).alias("top_domain"))


def family_key_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family of a url: host without www, m or blog, and path without its trailing number and extension."""
    host = F.regexp_replace("host", r"^(www|m|blog)\.", "")
    base = F.regexp_replace(F.regexp_replace("path", r"(\.html|/)$", ""), r"\d+$", "")
    number = F.regexp_extract("path", r"(\d+)(\.html|/)?$", 1)
    return _pages(spark, sf_dir).select("page_id", F.concat(host, base).alias("family"), number.alias("member"))


def prefix_extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.concat(F.lit("/"), F.element_at(F.split("path", "/"), 2))
    return _pages(spark, sf_dir).groupBy(first.alias("prefix"), X.extension("path").alias("extension")).agg(F.count("*").alias("n_pages"))


def json_props_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "struct<k: bigint>")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n_events"), F.count(k).alias("n_with_k"), F.sum(k).alias("sum_k"), F.countDistinct(k).alias("n_distinct_k"))


def annotation_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages matched to documents by the number in the name, all spellings tried; ambiguous matches keep their first 20."""
    number = F.regexp_extract("path", r"(\d+)(\.html|/)?$", 1)
    spelt = _pages(spark, sf_dir).select("page_id", F.explode(F.array_distinct(F.array(number, F.substring(number, 1, 3), F.substring(number, 1, 2)))).alias("name")).filter("name <> ''")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "doc_id")
    found = spelt.join(docs, "name", "left").groupBy("page_id").agg(F.countDistinct("doc_id").alias("n_matches"), F.array_join(F.slice(F.array_sort(F.collect_set("doc_id")), 1, 20), "|").alias("matches"))
    return found.withColumn("status", F.when(F.col("n_matches") == 0, "missing").when(F.col("n_matches") == 1, "matched").otherwise("ambiguous"))


def split_reconcile_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reconcile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").groupBy("side").agg(F.count("*").alias("n_keys"))


def metadata_mismatch_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.year("o_orderdate").alias("year"))
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")) * 100).cast("long").alias("cents"), F.year(F.min("l_shipdate")).alias("year"))
    return G.mismatches(o, li, "o_orderkey", ("cents", "year")).groupBy("field").agg(F.count("*").alias("n_mismatches"))


def completeness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, got = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return G.completeness(wanted, got, "o_orderkey", F.col("l_quantity") >= 50)


def two_sided_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that follow each other, with both customers' segments."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    b = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("cust_b"))
    pairs = o.withColumnRenamed("o_custkey", "cust_a").join(b, "o_orderkey")
    for side in ("a", "b"):
        pairs = pairs.join(c.select(F.col("c_custkey").alias(f"cust_{side}"), F.col("c_mktsegment").alias(f"segment_{side}"), F.col("c_nationkey").alias(f"nation_{side}")), f"cust_{side}", "left")
    return pairs.groupBy("segment_a", "segment_b").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("nation_a") == F.col("nation_b")).alias("n_same_nation"))


def semi_contaminated_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return i.filter("split = 'train'").join(i.filter("split = 'test'").select("content"), "content", "left_semi").select("doc_id", "source")


def anti_scene_safe_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return i.filter("split = 'train'").join(i.filter("split = 'test'").select("content"), "content", "left_anti").groupBy("source").agg(F.count("*").alias("n_safe"))


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    order = [F.coalesce("quality", F.lit(-1)).desc(), F.col("n_chars").desc(), F.col("split").asc(), F.col("source").asc(), F.col("doc_id").asc()]
    return U.representatives(i, "content", order).select("content", "doc_id", "source", "split")


def split_origin_crossing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.crossing_audit(items(spark, sf_dir), "content", "split")


def wilson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    t = m.groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").cast("long").alias("k"))
    low, high = X.wilson(F.col("k"), F.col("n"))
    return t.select("source", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def conversation_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that follow each other, by the roles that meet."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role")
    c = table(spark, sf_dir, "conversations").select("role", "turn", F.lead("role").over(order).alias("next_role"), F.lead("turn").over(order).alias("next_turn"))
    return c.filter("next_turn - turn = 1").groupBy("role", "next_role").agg(F.count("*").alias("n_pairs"))


ORACLE = {
    "exact_components": _COMP + " select content, component_size, labels, n_labels, sources, n_sources, splits, n_splits, f.s as representative_source, f.d as representative_item from comp",
    "duplicate_groups_members": _COMP + ", g as (select content, component_size, 'EXACT' || lpad((row_number() over (order by content))::varchar, 6, '0') as exact_group_id from comp where component_size > 1) select exact_group_id, component_size, doc_id, source, split from items join g using (content)",
    "component_conflict_flags": _COMP + " select content, case when n_labels > 1 then 'YES' else 'NO' end as cross_label, case when n_sources > 1 then 'YES' else 'NO' end as cross_source, case when n_splits > 1 then 'YES' else 'NO' end as cross_split from comp",
    "exact_label_conflicts": f"with {ITEMS} select content, count(*) as n_labelled, count(distinct quality) as n_quality, count(distinct toxic) as n_toxic from items join labels using (doc_id) group by content having count(distinct quality) > 1 or count(distinct toxic) > 1",
    "exact_split_leakage": _COMP + " select splits, count(*) as n_components, sum(component_size)::bigint as n_items from comp where n_splits > 1 group by splits",
    "cross_source_components": _COMP + " select content, component_size, sources, n_sources from comp where n_sources > 1",
    "pairwise_source_overlap": _OVERLAP + " where n1.s < n2.s",
    "source_overlap_matrix": _OVERLAP,
    "loso_contamination": f"with {ITEMS}, s as (select content, count(distinct source) as k from items group by content) select source as held_out_source, count(*) as n_items, sum((k > 1)::int)::bigint as n_contaminated, round(sum((k > 1)::int) / greatest(count(*), 1), 6) as contamination_rate from items join s using (content) group by source",
    "canonical_manifest_ids": f"with {ITEMS} select 'ITEM_' || substr(sha256(source || chr(10) || doc_id::varchar), 1, 20) as item_id, doc_id, content, case when row_number() over (partition by content order by source, doc_id) = 1 then 'YES' else 'NO' end as is_representative from items",
    "eligibility_reasons": f"with {ITEMS}, i as (select items.*, quality, toxic, count(*) over (partition by content) as copies from items left join labels using (doc_id)), r as (select doc_id, concat_ws(';', case when quality is null then 'UNLABELLED' end, case when quality = 0 then 'LOW_QUALITY' end, case when toxic = 1 then 'TOXIC' end, case when n_chars < 200 then 'TOO_SHORT' end, case when copies > 1 then 'HAS_COPIES' end) as exclusion_reason from i) select doc_id, case when exclusion_reason = '' then 'YES' else 'NO' end as eligible, exclusion_reason from r",
    "archive_qc": f"with {ITEMS} select source, count(*) as n_items, count(distinct content) as n_contents, count(quality) as n_labelled, count(*) filter (quality = 0) as n_low_quality, count(*) filter (toxic = 1) as n_toxic, count(*) filter (n_chars < 200) as n_short, sum(n_chars)::bigint as n_chars from items left join labels using (doc_id) group by source",
    "dataset_counts": f"with {ITEMS} select source, label, split, count(*) as n_items from items group by all",
    "audit_kv_findings": _COMP + ", r as (select sum(component_size)::bigint as items, count(*) as components, count(*) filter (component_size > 1) as duplicate_components, sum(component_size - 1)::bigint as surplus_copies, count(*) filter (n_sources > 1) as cross_source, count(*) filter (n_splits > 1) as cross_split, count(*) filter (n_labels > 1) as label_conflicts from comp) unpivot r on columns(*) into name finding value value",
    "url_split_label_parse": f"with p as (select page_id, {_PATH} as path from pages), s as (select page_id, path, list_filter(list_transform(string_split(lower(path), '/'), lambda x: case x when 'en' then 'english' when 'de' then 'german' when 'fr' then 'french' when 'es' then 'spanish' end), lambda x: x is not null) as l from p) select page_id, coalesce(l[1], 'unspecified') as label, lower(regexp_replace(path, '/{{2,}}', '/', 'g')) as path from s",
    "url_role_classify": f"with p as (select page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, {_PATH} as path from pages) select page_id, case when contains(url, 'utm_') then 'tracked' when contains(url, '?') then 'query' when ends_with(path, '.html') then 'page' when ends_with(path, '/') then 'directory' else 'other' end as role, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) as extension, string_split(host, '.')[-1] as top_domain from p",
    "family_key_regex": f"with p as (select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, {_PATH} as path from pages) select page_id, regexp_replace(host, '^(www|m|blog)\\.', '') || regexp_replace(regexp_replace(path, '(\\.html|/)$', ''), '[0-9]+$', '') as family, regexp_extract(path, '([0-9]+)(\\.html|/)?$', 1) as member from p",
    "prefix_extension_counts": f"with p as (select {_PATH} as path from pages) select '/' || string_split(path, '/')[2] as prefix, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) as extension, count(*) as n_pages from p group by all",
    "json_props_parse": "select event_type, count(*) as n_events, count(props ->> 'k') as n_with_k, sum((props ->> 'k')::bigint)::bigint as sum_k, count(distinct (props ->> 'k')::bigint) as n_distinct_k from events group by event_type",
    "annotation_reconcile": f"with p as (select page_id, regexp_extract({_PATH}, '([0-9]+)(\\.html|/)?$', 1) as n from pages), s as (select distinct page_id, unnest([n, substr(n, 1, 3), substr(n, 1, 2)]) as name from p), m as (select page_id, list_sort(list_distinct(list(doc_id) filter (doc_id is not null))) as l from s left join documents on doc_id::varchar = name where name <> '' group by page_id) select page_id, coalesce(len(l), 0)::bigint as n_matches, coalesce(array_to_string(list_slice(l, 1, 20), '|'), '') as matches, case coalesce(len(l), 0) when 0 then 'missing' when 1 then 'matched' else 'ambiguous' end as status from m",
    "split_reconcile_outer": "with a as (select distinct doc_id from documents), b as (select distinct doc_id from labels) select case when a.doc_id is null then 'right_only' when b.doc_id is null then 'left_only' else 'both' end as side, count(*) as n_keys from a full join b on a.doc_id = b.doc_id group by 1",
    "metadata_mismatch_unpivot": "with o as (select o_orderkey, round(o_totalprice * 100)::bigint as cents, year(o_orderdate) as y from orders), l as (select l_orderkey as o_orderkey, round(sum(l_extendedprice::decimal(18,2)) * 100)::bigint as cents, year(min(l_shipdate)) as y from lineitem group by 1), m as (select 'cents' as field, o.cents <> l.cents as d from o join l using (o_orderkey) union all select 'year', o.y <> l.y from o join l using (o_orderkey)) select field, count(*) as n_mismatches from m where d group by field",
    "completeness_audit": "with g as (select l_orderkey as k, count(*) as n, max((l_quantity >= 50)::int) as f from lineitem group by 1), j as (select coalesce(o.o_orderkey, g.k) as o_orderkey, o.o_orderkey as w, n, f from (select distinct o_orderkey from orders) o full join g on g.k = o.o_orderkey), u as (select o_orderkey, unnest([case when n is null then 'missing' end, case when w is null then 'unexpected' end, case when n > 1 then 'duplicate' end, case when f = 1 then 'failed' end]) as problem from j) select * from u where problem is not null",
    "two_sided_enrichment": "select ca.c_mktsegment as segment_a, cb.c_mktsegment as segment_b, count(*) as n_pairs, count(*) filter (ca.c_nationkey = cb.c_nationkey) as n_same_nation from orders a join orders b on b.o_orderkey = a.o_orderkey + 1 left join customer ca on ca.c_custkey = a.o_custkey left join customer cb on cb.c_custkey = b.o_custkey group by all",
    "semi_contaminated_train": f"with {ITEMS} select doc_id, source from items where split = 'train' and content in (select content from items where split = 'test')",
    "anti_scene_safe_train": f"with {ITEMS} select source, count(*) as n_safe from items where split = 'train' and content not in (select content from items where split = 'test') group by source",
    "representatives": f"with {ITEMS}, r as (select content, doc_id, source, split, row_number() over (partition by content order by coalesce(quality, -1) desc, n_chars desc, split, source, doc_id) as k from items left join labels using (doc_id)) select content, doc_id, source, split from r where k = 1",
    "split_origin_crossing_audit": f"with {ITEMS}, b as (select content, string_agg(distinct split, '|' order by split) as split_pattern, count(distinct split) as n, count(*) as items from items group by content) select split_pattern, count(*) as n_blocks, sum(items)::bigint as n_items from b where n > 1 group by 1",
    "wilson_by_group": "with t as (select source, count(*) as n, sum(toxic)::bigint as k, 1.959963984540054::double as z from labels join documents using (doc_id) group by source), u as (select *, k::double / n as p from t) select source, n, k, round(greatest(0, ((p + z*z/(2*n)) / (1 + z*z/n)) - z*sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) as low, round(least(1, ((p + z*z/(2*n)) / (1 + z*z/n)) + z*sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) as high from u",
    "conversation_adjacency": "with c as (select role, turn, lead(role) over w as next_role, lead(turn) over w as next_turn from conversations window w as (partition by conv_id order by turn, role)) select role, next_role, count(*) as n_pairs from c where next_turn - turn = 1 group by all",
}
QUERIES = {name: globals()[name] for name in ORACLE}
