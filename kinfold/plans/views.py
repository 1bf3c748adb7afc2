"""The test tables seen as items, pairs, edges and predictions, in Spark and as the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.exprs import RELATIONS, seed_of
from kinfold.operators.candidates import top_cosine


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(i: Column) -> Column:
    return F.when(i % 10 <= 6, "train").when(i % 10 <= 8, "validation").otherwise("test")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: doc_id, source, label (language), content (hash), split, n_chars."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.col("lang").alias("label"), F.sha2("text", 256).alias("content"), split_of(F.col("doc_id")).alias("split"), "n_chars")


ITEMS = """items as (select doc_id, source, lang as label, sha256(text) as content,
  case when doc_id % 10 <= 6 then 'train' when doc_id % 10 <= 8 then 'validation' else 'test' end as split, n_chars from documents)"""


def unit_draw(*parts: Column | str) -> Column:
    """A number from 0 to 1 that only depends on the parts."""
    return seed_of(*parts) / 4294967296.0


def draw_sql(*parts: str) -> str:
    return f"(('0x' || substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 8))::bigint / 4294967296.0)"


#: Evidence columns of neighbouring vectors: (name, offset, span); value = offset + span * draw.
EVIDENCE = (
    ("entropy_a", 3.0, 5.0), ("entropy_b", 3.0, 5.0), ("direct_ncc", 0.70, 0.30), ("direct_grad", 0.70, 0.30), ("direct_ssim", 0.60, 0.40),
    ("inliers", 0.0, 40.0), ("ratio", 0.1, 0.6), ("reproj", 1.0, 7.0), ("coverage_a", 0.0, 0.2), ("coverage_b", 0.0, 0.2), ("overlap", 0.0, 0.5),
    ("aligned_ncc", 0.3, 0.7), ("aligned_grad", 0.2, 0.7), ("aligned_ssim", 0.1, 0.7),
)


def evidence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring vectors as pairs with evidence drawn from their ids, and what a pair would leak."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    p = e.select(F.col("vec_id").alias("item_a"), F.col("label").alias("label_a")).join(e.select(F.col("vec_id").alias("item_b"), F.col("label").alias("label_b"), (F.col("vec_id") - 1).alias("item_a")), "item_a")
    a, b = F.col("item_a").cast("string"), F.col("item_b").cast("string")
    p = p.select("*", *[(F.lit(low) + span * unit_draw(a, b, name)).alias(name) for name, low, span in EVIDENCE])
    return p.select(
        "*", (F.col("item_a") % 4 == 0).alias("in_sequence"), (split_of(F.col("item_a")) != split_of(F.col("item_b"))).alias("cross_split"), (F.col("item_a") % 3 != F.col("item_b") % 3).alias("cross_source"), (F.col("label_a") != F.col("label_b")).alias("label_conflict"),
        unit_draw(a, b, "first").alias("first_similarity"), unit_draw(a, b, "second").alias("second_similarity"),
    )


_SPLIT = "case when {0} % 10 <= 6 then 'train' when {0} % 10 <= 8 then 'validation' else 'test' end"
EVIDENCE_PAIRS = (
    "pairs as (select a.vec_id as item_a, b.vec_id as item_b, a.label as label_a, b.label as label_b, "
    + ", ".join(f"{low} + {span} * " + draw_sql("a.vec_id::varchar", "b.vec_id::varchar", f"'{name}'") + f" as {name}" for name, low, span in EVIDENCE)
    + f", a.vec_id % 4 = 0 as in_sequence, {_SPLIT.format('a.vec_id')} <> {_SPLIT.format('b.vec_id')} as cross_split, a.vec_id % 3 <> b.vec_id % 3 as cross_source, a.label <> b.label as label_conflict, "
    + draw_sql("a.vec_id::varchar", "b.vec_id::varchar", "'first'") + " as first_similarity, " + draw_sql("a.vec_id::varchar", "b.vec_id::varchar", "'second'") + " as second_similarity "
    + "from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"
)

#: Least similarity of each relation among the vectors; below the last, pairs are rejected.
LEAST = (0.45, 0.42, 0.38, 0.35)


def relation_of(similarity: Column) -> Column:
    out = F
    for least, name in zip(LEAST, RELATIONS, strict=False):
        out = out.when(similarity >= least, name)
    return out.otherwise(RELATIONS[4])


def edges(spark: SparkSession, sf_dir: str, k: int = 6) -> DataFrame:
    """item_a < item_b, similarity, relation: pairs of vectors of which one is among the other's k nearest."""
    top = top_cosine(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k)
    pairs = top.select(F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b"), F.round("similarity", 6).alias("similarity")).distinct()
    return pairs.withColumn("relation", relation_of(F.col("similarity")))


TOP = """sims as (select a.vec_id as item_a, b.vec_id as item_b, a.label as label_a, b.label as label_b, list_inner_product(a.embedding::double[], b.embedding::double[]) as similarity
  from embeddings a join embeddings b on a.vec_id <> b.vec_id),
top as (select *, row_number() over (partition by item_a order by round(similarity, 9) desc, item_b) as rank from sims)"""
EDGES = TOP + """,
edges as (select distinct least(item_a, item_b) as item_a, greatest(item_a, item_b) as item_b, round(similarity, 6) as similarity,
  case when round(similarity, 6) >= 0.45 then 'VERIFIED_DERIVATIVE_STRONG' when round(similarity, 6) >= 0.42 then 'VERIFIED_DERIVATIVE_MODERATE' when round(similarity, 6) >= 0.38 then 'GEOMETRIC_SAME_SCENE_ONLY'
       when round(similarity, 6) >= 0.35 then 'AMBIGUOUS_MANUAL_REVIEW' else 'REJECTED_NOT_DERIVATIVE' end as relation from top where rank <= 6)"""
#: Components by reachability, for each level; small graphs only.
COMPONENTS = EDGES + """,
links as (select item_a as x, item_b as y from edges where relation in ({relations}) union all select item_b, item_a from edges where relation in ({relations})),
reach(node, other) as (select vec_id, vec_id from embeddings union select reach.node, links.y from reach join links on reach.other = links.x),
comp as (select node as item, min(other) as component from reach group by node)"""
LEVELS = {
    "strict": "'VERIFIED_DERIVATIVE_STRONG'",
    "extended": "'VERIFIED_DERIVATIVE_STRONG', 'VERIFIED_DERIVATIVE_MODERATE'",
    "block": "'VERIFIED_DERIVATIVE_STRONG', 'VERIFIED_DERIVATIVE_MODERATE', 'GEOMETRIC_SAME_SCENE_ONLY'",
}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with predictions of a made-up model: right four times of five, else the next label; scores as an array over labels 0 to 9; four folds, three runs."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"))
    p = e.select("*", F.explode(F.array(F.lit("base"), F.lit("safe"), F.lit("strict"))).alias("run"))
    i = F.col("vec_id").cast("string")
    pred = F.when(unit_draw(F.col("run"), i, "hit") < 0.8, F.col("label")).otherwise((F.col("label") + 1) % 10)
    p = p.withColumn("pred", pred.cast("int")).withColumn("top", 0.4 + 0.55 * unit_draw(F.col("run"), i, "top"))
    scores = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.when(c == F.col("pred"), F.col("top")).otherwise((1 - F.col("top")) / 9))
    return p.select("vec_id", "run", F.col("label").cast("string").alias("y_true"), F.col("pred").cast("string").alias("y_pred"), "top", scores.alias("scores"), F.concat_ws("-", F.col("label").cast("string"), F.floor(F.col("vec_id") / 20).cast("string")).alias("unit"), (F.col("vec_id") % 4).cast("int").alias("fold"))


PREDICTIONS = f"""p0 as (select vec_id, label::int as label, run from embeddings, (values ('base'), ('safe'), ('strict')) r(run)),
p1 as (select *, case when {draw_sql('run', 'vec_id::varchar', "'hit'")} < 0.8 then label else (label + 1) % 10 end as pred, 0.4 + 0.55 * {draw_sql('run', 'vec_id::varchar', "'top'")} as top from p0),
preds as (select vec_id, run, label::varchar as y_true, pred::varchar as y_pred, top, list_transform(range(10), lambda c: case when c = pred then top else (1 - top) / 9 end) as scores,
  label::varchar || '-' || (vec_id // 20)::varchar as unit, (vec_id % 4)::int as fold from p1)"""
