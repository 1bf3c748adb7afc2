"""Queries over pairs: candidates, gates, relations, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions import exprs as X
from kinfold.operators import candidates as C
from kinfold.operators import graph as R
from kinfold.operators import groups as G
from kinfold.operators import units as U
from kinfold.plans.views import COMPONENTS, EDGES, EVIDENCE_PAIRS, LEVELS, TOP, edges, evidence_pairs, split_of, table


def _bits(vector: str, n: int = 63) -> Column:
    """Signs of the first n components as bits of a number."""
    return F.expr(f"aggregate(sequence(0, {n - 1}), 0L, (a, i) -> a + case when {vector}[i] > 0 then shiftleft(1L, i) else 0L end)")


def origin_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one host and directory, where these are not too many."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+/[^/]*)", 1).alias("origin"))
    return C.origin_pairs(p, "page_id", "origin")


def crowded_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+/[^/]*)", 1).alias("origin"))
    return C.crowded_origins(p, "page_id", "origin")


def _signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", _bits("embedding").alias("bits"))


def hamming_sign_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose sign patterns differ in at most 18 of 63 places."""
    return C.hamming_within(_signs(spark, sf_dir), "vec_id", "bits", 18)


def hamming_band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign patterns and disturbed copies of them (two bits turned over), within four bits."""
    s = _signs(spark, sf_dir)
    turned = F.expr("bits ^ shiftleft(1L, cast(vec_id % 63 as int)) ^ shiftleft(1L, cast((vec_id * 7 + 1) % 63 as int))")
    both = s.unionByName(s.select((F.col("vec_id") + 10_000_000).alias("vec_id"), turned.alias("bits")))
    return C.hamming_pairs(both, "vec_id", "bits", 4)


def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.top_cosine(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 12))


def topk_cosine_cross_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.top_cosine(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5, apart="label", least=0.3))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("item_a", "item_b", F.round("similarity", 6).alias("similarity"), "rank")


def _seconds(c: str) -> Column:
    """Seconds since 1970 of a moment without a zone, whatever the session's."""
    return F.unix_date(F.to_date(c)) * 86400.0 + F.hour(c) * 3600 + F.minute(c) * 60 + F.date_part(F.lit("SECOND"), c).cast("double")


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return C.adjacent_pairs(e, "event_id", "user_id", _seconds("ts"), 600, 60)


def sequence_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequence(spark, sf_dir).select("user_id", "item_a", "item_b", F.round("delta", 3).alias("delta"), "reason")


def pair_union_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    near, across = C.top_cosine(e, "vec_id", "embedding", 6), C.top_cosine(e, "vec_id", "embedding", 3, apart="label")
    next_ids = e.select(F.col("vec_id").alias("item_a"), (F.col("vec_id") + 1).alias("item_b")).join(e.select(F.col("vec_id").alias("item_b")), "item_b", "left_semi")
    u = C.union_reasons([("near", near), ("cross_label", across), ("sequence", next_ids)])
    return u.withColumn("similarity", F.round("similarity", 6))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = evidence_pairs(spark, sf_dir)
    name, weight = X.risk(F.col("cross_split"), F.col("cross_source"), F.col("label_conflict"))
    return p.withColumn("tier", X.gate(F.col("first_similarity"), F.col("second_similarity"), F.col("in_sequence"))).withColumn("risk", name).withColumn("risk_score", weight)


_RISK = """concat_ws('|', case when cross_split then 'CROSS_SPLIT' end, case when cross_source then 'CROSS_ARCHIVE' end, case when label_conflict then 'LABEL_CONFLICT' end)"""
_GATED = f"""with {EVIDENCE_PAIRS}, gated as (select *, case when first_similarity >= 0.80 then 'A' when first_similarity >= 0.78 and second_similarity >= 0.85 then 'B' when in_sequence and first_similarity >= 0.70 and second_similarity >= 0.85 then 'C' else 'D' end as tier,
  case when {_RISK} = '' then 'LOW' else {_RISK} end as risk, 4 * cross_split::int + 2 * cross_source::int + label_conflict::int as risk_score from pairs)"""


def evidence_gate_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("item_a", "item_b", "tier", "risk", "risk_score", F.round(F.col("first_similarity") + 0.5 * F.col("second_similarity") + 0.1 * F.col("risk_score"), 6).alias("evidence_score"))


def gate_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).groupBy("risk").agg(F.count("*").alias("n"), F.round(F.avg((F.col("tier") != "D").cast("int")), 9).alias("pass_rate"), F.round(F.avg((F.col("tier") == "A").cast("int")), 9).alias("primary_rate"))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label: quantiles of the best similarity, and how often a vector of the same label is among the k nearest."""
    e = table(spark, sf_dir, "embeddings")
    names = e.select(F.col("vec_id").alias("item_b"), F.col("label").alias("label_b"))
    top = C.top_cosine(e, "vec_id", "embedding", 20).join(names, "item_b").join(e.select(F.col("vec_id").alias("item_a"), F.col("label").alias("label_a")), "item_a")
    per = top.groupBy("item_a", "label_a").agg(F.max("similarity").alias("best"), F.min(F.when(F.col("label_a") == F.col("label_b"), F.col("rank"))).alias("hit"))
    rate = lambda k: F.round(F.avg(F.coalesce((F.col("hit") <= k).cast("int"), F.lit(0))), 9).alias(f"recall_{k}")
    q = lambda p: F.round(F.percentile("best", F.lit(p)), 6)
    return per.groupBy(F.col("label_a").alias("label")).agg(F.count("*").alias("n"), q(0.5).alias("median"), q(0.05).alias("q05"), q(0.95).alias("q95"), *[rate(k) for k in (1, 5, 10, 20)])


def shortlist_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gated(spark, sf_dir).filter("tier <> 'D'")
    g = g.select("item_a", "item_b", "cross_split", "cross_source", "label_conflict", "risk_score", "first_similarity")
    return C.shortlist(g, [("cross_split", 20), ("cross_source", 20), ("label_conflict", 20)], 120, 1, [F.desc("risk_score"), F.desc("first_similarity"), F.asc("item_a"), F.asc("item_b")])


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = evidence_pairs(spark, sf_dir)
    return p.withColumn("r", X.relation(p.columns, F.col("in_sequence"))).select("*", "r.relation", "r.reason", F.round("r.score", 6).alias("score"))


_R = lambda x, low, span: f"greatest(0.0, least(1.0, ({x} - {low}) / {span}))"
_RELATED = f"""with {EVIDENCE_PAIRS}, e as (select *, least(entropy_a, entropy_b) as entropy, least(coverage_a, coverage_b) as cmin, greatest(coverage_a, coverage_b) as cmax, trunc(inliers)::int as inl from pairs),
tests as (select *, inl >= 18 and ratio >= 0.3 and cmin >= 0.015 and cmax >= 0.08 and reproj <= 5 and overlap >= 0.08 as scene,
  entropy >= 4 and direct_ncc >= 0.965 and direct_grad >= 0.9 and direct_ssim >= 0.78 as ds, entropy >= 4.5 and direct_ncc >= 0.94 and direct_grad >= 0.82 and direct_ssim >= 0.68 as dm,
  inl >= 18 and ratio >= 0.35 and cmin >= 0.02 and cmax >= 0.08 and reproj <= 4.5 and overlap >= 0.1 and aligned_ncc >= 0.7 and aligned_grad >= 0.55 and aligned_ssim >= 0.4 as gs,
  inl >= 12 and ratio >= 0.25 and cmin >= 0.008 and cmax >= 0.05 and reproj <= 6.5 and overlap >= 0.06 and aligned_ncc >= 0.58 and aligned_grad >= 0.4 and aligned_ssim >= 0.28 as gm from e),
related as (select *, case when in_sequence and scene then 'GEOMETRIC_SAME_SCENE_ONLY' when ds or gs then 'VERIFIED_DERIVATIVE_STRONG' when dm or gm then 'VERIFIED_DERIVATIVE_MODERATE' when scene then 'GEOMETRIC_SAME_SCENE_ONLY'
    when inl >= 8 or direct_ncc >= 0.9 then 'AMBIGUOUS_MANUAL_REVIEW' else 'REJECTED_NOT_DERIVATIVE' end as relation,
  case when in_sequence and scene then 'sequence_with_overlap' when ds then 'direct_match' when gs then 'geometry_and_photometry' when dm then 'moderate_direct_match' when gm then 'moderate_geometry_and_photometry'
    when scene then 'geometry_without_photometry' when inl >= 8 or direct_ncc >= 0.9 then 'partial_support' else 'insufficient_support' end as reason,
  round(100.0 * greatest(({_R('direct_ncc', 0.7, 0.3)} + {_R('direct_grad', 0.5, 0.5)} + {_R('direct_ssim', 0.4, 0.6)}) / 3,
    0.6 * ({_R('inl', 0.0, 40.0)} + {_R('ratio', 0.0, 0.6)} + {_R('cmin', 0.0, 0.08)} + {_R('cmax', 0.0, 0.25)} + {_R('reproj', 7.0, '(-7.0)')} + {_R('overlap', 0.0, 0.35)}) / 6
    + 0.4 * ({_R('aligned_ncc', 0.3, 0.7)} + {_R('aligned_grad', 0.2, 0.8)} + {_R('aligned_ssim', 0.15, 0.85)}) / 3), 6) as score from tests)"""


def relation_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(spark, sf_dir).select("item_a", "item_b", "relation", "reason", "score")


def control_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one label as positive controls, others as negative ones: rates at which they are called derivatives."""
    r = _related(spark, sf_dir).withColumn("expected", F.when(~F.col("label_conflict"), "positive").otherwise("negative"))
    called = F.col("relation").isin(*X.DERIVATIVE).cast("int")
    return r.groupBy("expected").agg(F.count("*").alias("n"), F.round(F.avg(called), 9).alias("derivative_rate"), F.count_if(F.col("relation") == X.SAME_SCENE).alias("n_same_scene"), F.count_if(F.col("relation") == X.RELATIONS[4]).alias("n_rejected"), X.yes_no(F.avg(called) <= 0.01).alias("passes_false_positive_limit"))


def yield_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivative yield by several sets of keys in one pass, with Wilson bounds."""
    p = _related(spark, sf_dir)
    name, _ = X.risk(F.col("cross_split"), F.col("cross_source"), F.col("label_conflict"))
    p = p.select(name.alias("risk"), X.yes_no(F.col("in_sequence")).alias("sequence"), F.col("relation").isin(*X.DERIVATIVE).cast("int").alias("hit"))
    t = p.groupingSets([["risk"], ["sequence"], ["risk", "sequence"], []], "risk", "sequence").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum("hit").alias("k"))
    low, high = X.wilson(F.col("k"), F.col("n"))
    return t.select("risk", "sequence", "level", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


_Z = "1.959963984540054::double"
_WILSON = f"round(greatest(0, ((k::double/n + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n)) - {_Z}*sqrt((k::double/n)*(1-k::double/n)/n + {_Z}*{_Z}/(4.0*n*n)) / (1 + {_Z}*{_Z}/n)), 9) as low, round(least(1, ((k::double/n + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n)) + {_Z}*sqrt((k::double/n)*(1-k::double/n)/n + {_Z}*{_Z}/(4.0*n*n)) / (1 + {_Z}*{_Z}/n)), 9) as high"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with their place in the order of evidence, over all and within their tier."""
    g = _gated(spark, sf_dir).select("item_a", "item_b", "tier", F.round("first_similarity", 9).alias("s"))
    r = _related(spark, sf_dir).select("item_a", "item_b", F.col("relation").isin(*X.DERIVATIVE).cast("int").alias("hit"))
    j = g.join(r, ["item_a", "item_b"])
    order = [F.desc("s"), F.asc("item_a"), F.asc("item_b")]
    j = G.ranked(j, order)
    return j.withColumn("n", F.lit(j.count())).withColumn("tier_rank", F.row_number().over(Window.partitionBy("tier").orderBy(*order))).withColumn("tier_n", F.count("*").over(Window.partitionBy("tier")))


def yield_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _ranked(spark, sf_dir).groupBy(X.decile(F.col("rank"), F.col("n")).alias("decile")).agg(F.count("*").alias("n"), F.sum("hit").alias("k"))
    low, high = X.wilson(F.col("k"), F.col("n"))
    return t.select("decile", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def within_tier_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).groupBy("tier", X.decile(F.col("tier_rank"), F.col("tier_n")).alias("decile")).agg(F.count("*").alias("n"), F.sum("hit").alias("k"))


_RANKED = _GATED + ", " + _RELATED.removeprefix(f"with {EVIDENCE_PAIRS}, ") + """,
ranked as (select tier, relation in ('VERIFIED_DERIVATIVE_STRONG', 'VERIFIED_DERIVATIVE_MODERATE') as hit, row_number() over (order by s desc, item_a, item_b) as rank, count(*) over () as n, row_number() over (partition by tier order by s desc, item_a, item_b) as tier_rank, count(*) over (partition by tier) as tier_n
  from (select g.item_a, g.item_b, tier, round(g.first_similarity, 9) as s, relation from gated g join related r on g.item_a = r.item_a and g.item_b = r.item_b))"""


def reserve_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivatives to expect among unreviewed pairs (odd ids) from the rate among reviewed ones of the same tier."""
    r = _related(spark, sf_dir).select("item_a", "item_b", F.col("relation").isin(*X.DERIVATIVE).cast("int").alias("hit"))
    j = _gated(spark, sf_dir).select("item_a", "item_b", "tier").join(r, ["item_a", "item_b"])
    seen = j.filter("item_a % 2 = 0").groupBy("tier").agg(F.count("*").alias("reviewed"), F.sum("hit").alias("found"))
    rest = j.filter("item_a % 2 = 1").groupBy("tier").agg(F.count("*").alias("reserve"))
    return rest.join(seen, "tier", "left").select("tier", "reserve", F.coalesce("reviewed", F.lit(0)).alias("reviewed"), F.coalesce("found", F.lit(0)).alias("found"), F.round(F.col("reserve") * F.coalesce("found", F.lit(0)) / F.greatest(F.coalesce("reviewed", F.lit(0)), F.lit(1)), 6).alias("expected"))


def edge_ledger_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest-neighbour edges and the reviewed neighbours as two stages of one ledger."""
    a = edges(spark, sf_dir).select("item_a", "item_b", "relation", F.lit("embedding").alias("stage"))
    b = _related(spark, sf_dir).select(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"), "relation", F.lit("review").alias("stage"))
    return U.edge_ledger(a.unionByName(b))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item"), F.col("label").cast("string").alias("label"), F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("source"), split_of(F.col("vec_id")).alias("split"))


def _components(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    return R.grouped(_members(spark, sf_dir).select("item"), U.relation_subset(edges(spark, sf_dir), level), "item", "item_a", "item_b")


def components_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir, "strict")


def components_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir, "extended")


def components_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ids that only depend on the members."""
    return R.named_groups(_components(spark, sf_dir, "block"), "item", "BLOCK_")


def ambiguity_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks merged further by ambiguous edges between splits: components of the graph of blocks."""
    e = edges(spark, sf_dir)
    base = R.grouped(_members(spark, sf_dir).select("item"), U.relation_subset(e, "block"), "item", "item_a", "item_b")
    risky = e.filter((F.col("relation") == X.RELATIONS[3]) & (split_of(F.col("item_a")) != split_of(F.col("item_b"))))
    between = R.contracted(risky, base, "item_a", "item_b", "item", "component")
    merged = R.connected_components(between, "group_a", "group_b")
    return base.join(merged.select(F.col("node").alias("component"), F.col("component").alias("m")), "component", "left").select("item", F.col("component").alias("block"), F.coalesce("m", "component").alias("ambiguity_block"))


def incremental_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges in the order of similarity that join two components, with the count of merges so far."""
    e = G.ranked(edges(spark, sf_dir).filter(F.col("similarity") >= 0.35), [F.desc("similarity"), F.asc("item_a"), F.asc("item_b")])
    m = R.merging_edges(e, "item_a", "item_b", "rank").select("rank", "item_a", "item_b", "relation")
    return G.ranked(m, [F.asc("rank")], "merges_so_far")


def bridge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = U.relation_subset(edges(spark, sf_dir), "block")
    g = R.grouped(_members(spark, sf_dir).select("item"), e, "item", "item_a", "item_b")
    return R.bridge_edges(e.join(g.select(F.col("item").alias("item_a"), F.col("component").alias("block")), "item_a"), "block", "item_a", "item_b")


def lineage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _members(spark, sf_dir).join(_components(spark, sf_dir, "extended"), "item").withColumn("content", F.col("item"))
    return U.lineages(g, "component", "label")


def split_block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    m = _members(spark, sf_dir)
    block = R.grouped(m.select("item"), U.relation_subset(e, "block"), "item", "item_a", "item_b").withColumnRenamed("component", "block")
    lineage = R.grouped(m.select("item"), U.relation_subset(e, "extended"), "item", "item_a", "item_b").withColumnRenamed("component", "lineage")
    return U.blocks(m.join(block, "item").join(lineage, "item"), e, "block", "lineage")


def analysis_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineages of one label as units of two tasks, each with a representative."""
    e = edges(spark, sf_dir)
    m = _members(spark, sf_dir)
    block = R.grouped(m.select("item"), U.relation_subset(e, "block"), "item", "item_a", "item_b").withColumnRenamed("component", "block")
    lineage = R.grouped(m.select("item"), U.relation_subset(e, "strict"), "item", "item_a", "item_b").withColumnRenamed("component", "lineage")
    tasks = {"low": [str(i) for i in range(5)], "even": [str(i) for i in range(0, 10, 2)]}
    return U.analysis_units(m.join(block, "item").join(lineage, "item"), "lineage", "block", "label", tasks, [F.col("split").asc(), F.col("item").desc()])


def matching_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir)
    block = _components(spark, sf_dir, "block").withColumnRenamed("component", "block")
    return U.matching_blocks(m.join(block, "item"), "block", "item").groupBy("pure", "size_bin").agg(F.count("*").alias("n_blocks"), F.sum("paths").alias("n_items"))


def method_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two made-up methods for a pair the one that the evidence prefers."""
    p = evidence_pairs(spark, sf_dir)
    own = F.struct(F.lit("first").alias("method"), F.floor("inliers").cast("int").alias("inliers"), "ratio", "aligned_ncc", "aligned_ssim", "overlap", "reproj")
    other = F.struct(F.lit("second").alias("method"), F.floor(40 - F.col("inliers")).cast("int").alias("inliers"), *[F.col(c) for c in ("ratio", "aligned_ncc", "aligned_ssim", "overlap", "reproj")])
    rows = p.select("item_a", "item_b", F.explode(F.array(own, other)).alias("r"))
    return rows.groupBy("item_a", "item_b").agg(X.best_method("r", "r").alias("b")).select("item_a", "item_b", "b.method", "b.inliers")


_SIGNS = "signs as (select vec_id, list_sum(list_transform(range(63), lambda i: case when embedding[i + 1] > 0 then (1::bigint << i) else 0 end))::bigint as bits from embeddings)"
_MEMBERS = "members as (select vec_id as item, label::varchar as label, 's' || (vec_id % 3)::varchar as source, case when vec_id % 10 <= 6 then 'train' when vec_id % 10 <= 8 then 'validation' else 'test' end as split from embeddings)"
_LEVEL = lambda level: "with recursive " + COMPONENTS.format(relations=LEVELS[level])
ORACLE = {
    "origin_pairs": "with p as (select page_id, regexp_extract(url, '^[a-z]+://([^/]+/[^/]*)', 1) as origin from pages), k as (select origin from p where origin <> '' group by origin having count(*) between 2 and 100) select a.page_id as item_a, b.page_id as item_b, a.origin from p a join p b on a.origin = b.origin and a.page_id < b.page_id where a.origin in (select origin from k)",
    "crowded_origins": "select regexp_extract(url, '^[a-z]+://([^/]+/[^/]*)', 1) as origin, count(distinct page_id) as n_items from pages group by 1 having origin <> '' and count(distinct page_id) > 100",
    "hamming_sign_pairs": f"with {_SIGNS} select a.vec_id as item_a, b.vec_id as item_b, bit_count(xor(a.bits, b.bits))::int as distance from signs a join signs b on a.vec_id < b.vec_id where bit_count(xor(a.bits, b.bits)) <= 18",
    "hamming_band_pairs": f"with {_SIGNS}, both_ as (select vec_id, bits from signs union all select vec_id + 10000000, xor(xor(bits, (1::bigint << (vec_id % 63))), (1::bigint << ((vec_id * 7 + 1) % 63))) from signs) select a.vec_id as item_a, b.vec_id as item_b, bit_count(xor(a.bits, b.bits))::int as distance from both_ a join both_ b on a.vec_id < b.vec_id where bit_count(xor(a.bits, b.bits)) <= 4",
    "topk_cosine": f"with {TOP} select item_a, item_b, round(similarity, 6) as similarity, rank::int as rank from top where rank <= 12",
    "topk_cosine_cross_label": f"with {TOP}, t as (select item_a, item_b, similarity, row_number() over (partition by item_a order by round(similarity, 9) desc, item_b) as rank from sims where label_a <> label_b) select item_a, item_b, round(similarity, 6) as similarity, rank::int as rank from t where rank <= 5 and similarity >= 0.3",
    "sequence_adjacent": "with s as (select user_id, event_id as item_a, lead(event_id) over w as item_b, lead(epoch_us(ts) / 1e6) over w - epoch_us(ts) / 1e6 as delta from events window w as (partition by user_id order by epoch_us(ts) / 1e6, event_id)) select user_id, item_a, item_b, round(delta, 3) as delta, case when delta <= 60 then 'near' else 'adjacent' end as reason from s where delta > 0 and delta <= 600",
    "pair_union_reasons": f"with {TOP}, x as (select item_a, item_b, similarity, row_number() over (partition by item_a order by round(similarity, 9) desc, item_b) as rank from sims where label_a <> label_b), u as (select item_a, item_b, 'near' as reason, similarity, rank from top where rank <= 6 union all select item_a, item_b, 'cross_label', similarity, rank from x where rank <= 3 union all select a.vec_id, b.vec_id, 'sequence', null, null from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) select least(item_a, item_b) as item_a, greatest(item_a, item_b) as item_b, string_agg(distinct reason, '|' order by reason) as reasons, round(max(similarity), 6) as similarity, min(rank)::int as best_rank from u group by 1, 2",
    "evidence_gate_tiers": _GATED + " select item_a, item_b, tier, risk, risk_score, round(first_similarity + 0.5 * second_similarity + 0.1 * risk_score, 6) as evidence_score from gated",
    "gate_performance": _GATED + " select risk, count(*) as n, round(avg((tier <> 'D')::int), 9) as pass_rate, round(avg((tier = 'A')::int), 9) as primary_rate from gated group by risk",
    "recall_at_k": f"with {TOP}, p as (select item_a, label_a, max(similarity) as best, min(rank) filter (label_a = label_b) as hit from top where rank <= 20 group by 1, 2) select label_a as label, count(*) as n, round(quantile_cont(best, 0.5), 6) as median, round(quantile_cont(best, 0.05), 6) as q05, round(quantile_cont(best, 0.95), 6) as q95, " + ", ".join(f"round(avg(coalesce((hit <= {k})::int, 0)), 9) as recall_{k}" for k in (1, 5, 10, 20)) + " from p group by 1",
    "relation_classify": _RELATED + " select item_a, item_b, relation, reason, score from related",
    "control_performance": _RELATED + ", c as (select case when label_conflict then 'negative' else 'positive' end as expected, (relation in ('VERIFIED_DERIVATIVE_STRONG', 'VERIFIED_DERIVATIVE_MODERATE'))::int as d, relation from related) select expected, count(*) as n, round(avg(d), 9) as derivative_rate, count(*) filter (relation = 'GEOMETRIC_SAME_SCENE_ONLY') as n_same_scene, count(*) filter (relation = 'REJECTED_NOT_DERIVATIVE') as n_rejected, case when avg(d) <= 0.01 then 'YES' else 'NO' end as passes_false_positive_limit from c group by 1",
    "yield_grouping_sets": _RELATED + f", g as (select case when {_RISK} = '' then 'LOW' else {_RISK} end as risk, case when in_sequence then 'YES' else 'NO' end as sequence, (relation in ('VERIFIED_DERIVATIVE_STRONG', 'VERIFIED_DERIVATIVE_MODERATE'))::int as hit from related), t as (select risk, sequence, grouping(risk, sequence)::bigint as level, count(*) as n, sum(hit)::bigint as k from g group by grouping sets ((risk), (sequence), (risk, sequence), ())) select risk, sequence, level, n, k, {_WILSON} from t",
    "yield_deciles": _RANKED + f", t as (select least(10, ceil(rank * 10.0 / n))::int as decile, count(*) as n, sum(hit::int)::bigint as k from ranked group by 1) select decile, n, k, {_WILSON} from t",
    "within_tier_deciles": _RANKED + " select tier, least(10, ceil(tier_rank * 10.0 / tier_n))::int as decile, count(*) as n, sum(hit::int)::bigint as k from ranked group by 1, 2",
    "reserve_projection": _GATED + ", " + _RELATED.removeprefix(f"with {EVIDENCE_PAIRS}, ") + ", j as (select g.item_a, tier, (relation in ('VERIFIED_DERIVATIVE_STRONG', 'VERIFIED_DERIVATIVE_MODERATE'))::int as hit from gated g join related r on g.item_a = r.item_a and g.item_b = r.item_b), s as (select tier, count(*) as reviewed, sum(hit)::bigint as found from j where item_a % 2 = 0 group by 1), q as (select tier, count(*) as reserve from j where item_a % 2 = 1 group by 1) select tier, reserve, coalesce(reviewed, 0) as reviewed, coalesce(found, 0) as found, round(reserve * coalesce(found, 0) / greatest(coalesce(reviewed, 0), 1), 6) as expected from q left join s using (tier)",
    "edge_ledger_dedup": "with " + EDGES + ", " + _RELATED.removeprefix("with ") + ", l as (select item_a, item_b, relation, 'embedding' as stage from edges union all select item_b, item_a, relation, 'review' from related), k as (select concat_ws('||', least(item_a::varchar, item_b::varchar), greatest(item_a::varchar, item_b::varchar)) as edge_key, least(item_a, item_b) as item_a, greatest(item_a, item_b) as item_b, relation, stage, list_position(['VERIFIED_DERIVATIVE_STRONG', 'VERIFIED_DERIVATIVE_MODERATE', 'GEOMETRIC_SAME_SCENE_ONLY', 'AMBIGUOUS_MANUAL_REVIEW', 'REJECTED_NOT_DERIVATIVE'], relation)::int as p from l), r as (select *, row_number() over (partition by edge_key order by p, stage) as i, count(*) over (partition by edge_key) as n_rows from k), d as (select edge_key, string_agg(distinct relation, '|' order by relation) as relations, count(distinct relation) as c from k group by 1) select edge_key, item_a, item_b, relation, p as relation_priority, stage as edge_stage, n_rows, relations, case when c > 1 then 'YES' else 'NO' end as disagreement from r join d using (edge_key) where i = 1",
    **{f"components_{level}": _LEVEL(level) + " select item, component from comp" for level in ("strict", "extended")},
    "components_block": _LEVEL("block") + ", g as (select component, 'BLOCK_' || substr(sha256(string_agg(item::varchar, chr(10) order by item::varchar)), 1, 16) as group_id from comp group by 1) select item, component, group_id from comp join g using (component)",
    "ambiguity_blocks": _LEVEL("block") + ", risky as (select distinct ca.component as x, cb.component as y from edges e join comp ca on ca.item = e.item_a join comp cb on cb.item = e.item_b where e.relation = 'AMBIGUOUS_MANUAL_REVIEW' and ca.component <> cb.component and (case when e.item_a % 10 <= 6 then 0 when e.item_a % 10 <= 8 then 1 else 2 end) <> (case when e.item_b % 10 <= 6 then 0 when e.item_b % 10 <= 8 then 1 else 2 end)), l2 as (select x, y from risky union select y, x from risky), r2(node, other) as (select component, component from comp union select r2.node, l2.y from r2 join l2 on r2.other = l2.x), m as (select node, min(other) as ambiguity_block from r2 group by 1) select item, component as block, ambiguity_block from comp join m on m.node = comp.component",
    "matching_blocks": _LEVEL("block") + f", {_MEMBERS}, b as (select component, count(distinct source) as s, count(distinct label) as l, count(*) as paths from comp join members using (item) group by 1) select case when s = 1 and l = 1 then 'YES' else 'NO' end as pure, case when paths <= 1 then '1' when paths <= 2 then '2' when paths <= 4 then '3-4' else '5+' end as size_bin, count(*) as n_blocks, sum(paths)::bigint as n_items from b group by 1, 2",
    "method_choice": f"with {EVIDENCE_PAIRS} select item_a, item_b, case when floor(inliers) >= floor(40 - inliers) then 'first' else 'second' end as method, greatest(floor(inliers), floor(40 - inliers))::int as inliers from pairs",
    "lineage_table": _LEVEL("extended") + f", {_MEMBERS}, t as (select component, count(*) as n_items, count(distinct item) as n_exact_components, string_agg(distinct label, '|' order by label) as labels, count(distinct label) as n_labels, string_agg(distinct source, '|' order by source) as sources, count(distinct source) as n_sources, string_agg(distinct split, '|' order by split) as splits, count(distinct split) as n_splits from comp join members using (item) group by 1) select *, case when n_labels > 1 then 'LABEL_CONFLICT' else '' end as exclusion_reason, case when n_labels > 1 then 'NO' else 'YES' end as eligible, case when n_sources > 1 then 'YES' else 'NO' end as cross_source, case when n_splits > 1 then 'YES' else 'NO' end as cross_split from t",
}



def _second_level(level: str) -> str:
    """Common table expressions that name the components of another level `lin`."""
    kinds = LEVELS[level]
    return (
        f", links2 as (select item_a as x, item_b as y from edges where relation in ({kinds}) union all select item_b, item_a from edges where relation in ({kinds})),"
        " reach2(node, other) as (select vec_id, vec_id from embeddings union select reach2.node, links2.y from reach2 join links2 on reach2.other = links2.x),"
        " lin as (select node as item, min(other) as lineage from reach2 group by node)"
    )


#: By brute force: what each edge joins is reached again without it.
ORACLE |= {
    # an edge merges if no path of edges that come before it joins its ends
    "incremental_merges": f"""with recursive {EDGES},
 e as (select *, row_number() over (order by similarity desc, item_a, item_b) as rank from edges where similarity >= 0.35),
 l as (select rank, item_a as x, item_b as y from e union all select rank, item_b, item_a from e),
 r(edge, node) as (select rank, item_a from e union select r.edge, l.y from r join l on l.x = r.node and l.rank < r.edge),
 joined as (select e.rank from e join r on r.edge = e.rank and r.node = e.item_b)
 select rank, item_a, item_b, relation, row_number() over (order by rank) as merges_so_far from e where rank not in (select rank from joined)""",
    # an edge is a bridge if no path of the others joins its ends; its block has three items or more
    "bridge_edges": _LEVEL("block") + f""", e as (select item_a, item_b from edges where relation in ({LEVELS['block']})),
 r(a, b, node) as (select item_a, item_b, item_a from e union select r.a, r.b, links.y from r join links on links.x = r.node and not (links.x = r.a and links.y = r.b) and not (links.x = r.b and links.y = r.a)),
 sizes as (select component, count(*) as n from comp group by 1)
 select component as block, item_a, item_b from e join comp on comp.item = e.item_a join sizes using (component) where n >= 3 and not exists (select 1 from r where r.a = e.item_a and r.b = e.item_b and r.node = e.item_b)""",
    "split_block_table": _LEVEL("block") + _second_level("extended") + f""", {_MEMBERS},
 s as (select component as block, count(*) as n_items, count(distinct lineage) as n_lineages, string_agg(distinct split, '|' order by split) as splits, count(distinct split) as n_splits, count(distinct label) as n_labels
   from comp join lin using (item) join members using (item) group by 1),
 c as (select component as block, count(*) filter (relation like 'VERIFIED%') as d, count(*) filter (relation = 'GEOMETRIC_SAME_SCENE_ONLY') as g from edges join comp on comp.item = edges.item_a group by 1),
 w as (select s.*, coalesce(d, 0) as n_derivative_edges, coalesce(g, 0) as n_scene_edges,
   concat_ws(';', case when n_splits > 1 then 'CROSS_SPLIT' end, case when n_labels > 1 then 'LABEL_CONFLICT' end, case when n_items >= 10 then 'LARGE_BLOCK' end) as audit_reason from s left join c using (block))
 select *, case when audit_reason <> '' then 'YES' else 'NO' end as audit_required from w""",
    "analysis_units": _LEVEL("block") + _second_level("strict") + f""", {_MEMBERS},
 m as (select lineage, component as block, item, label, split from comp join lin using (item) join members using (item)),
 t as (select lineage, min(block) as block, min(label) as label, count(*) as n_items, count(distinct label) as k from m group by 1),
 first as (select lineage, item as representative from (select *, row_number() over (partition by lineage order by split, item desc) as k from m) where k = 1)
 select task, lineage, block, label, n_items, representative from t join first using (lineage), (values ('low', ['0', '1', '2', '3', '4']), ('even', ['0', '2', '4', '6', '8'])) x(task, labels) where k = 1 and list_contains(labels, label)""",
}
QUERIES = {name: globals()[name] for name in (*ORACLE, "shortlist_greedy")}
