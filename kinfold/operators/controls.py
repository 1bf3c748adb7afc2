"""Control pairs: what must be found, and what must not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.exprs import DERIVATIVE, SAME_SCENE, draw, hamming, pair_key
from kinfold.operators.groups import ranked, ranked_within
from kinfold.runtime import written_table


def exact_positives(items: DataFrame, item: str, content: str, source: str, limit: int, seed: int = 0) -> DataFrame:
    """(item_a, item_b): one pair of each content with copies, from two sources where there are two; no source gives the first
    item of more than max(20, limit / 5) pairs."""
    first = F.min(F.struct(source, item))
    ends = items.groupBy(content).agg(first.alias("a"), F.max(F.struct(source, item)).alias("b"), F.count("*").alias("n")).filter("n > 1")
    pairs = ends.select(F.col(f"a.{item}").alias("item_a"), F.col(f"b.{item}").alias("item_b"), F.col(f"a.{source}").alias("_s"), (F.col(f"a.{source}") != F.col(f"b.{source}")).alias("cross_source"))
    order = [F.desc("cross_source"), draw(seed, F.col("item_a")), F.col("item_a")]
    capped = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("_s").orderBy(*order))).filter(F.col("_n") <= max(20, limit // 5))
    return capped.orderBy(*order).limit(limit).select("item_a", "item_b", "cross_source")


def stratified(items: DataFrame, item: str, strata: list[str], seed: int = 0) -> DataFrame:
    """items with stratum and place within it, in an order dealt by the seed."""
    stratum = F.concat_ws("||", *[F.col(c).cast("string") for c in strata])
    return ranked_within(items.withColumn("stratum", stratum), ["stratum"], [draw(seed, F.col(item)), F.col(item)], "place")


def synthetic_positives(items: DataFrame, item: str, strata: list[str], transforms: list[str], each: int, seed: int = 0) -> DataFrame:
    """(item, transform): for each transform `each` items, in turns over the strata; another order for each transform."""
    spread = items.select(item, *strata, F.explode(F.array(*[F.lit(t) for t in transforms])).alias("transform"))
    turn = ranked_within(spread, ["transform", *strata], [draw(seed, F.concat_ws("|", "transform", F.col(item).cast("string"))), F.col(item)], "_turn")
    # no more turns than `each` can be needed of a stratum, so what is ranked by transform is bounded by strata, not by items
    few = ranked_within(turn.filter(F.col("_turn") <= each), ["transform"], [F.col("_turn"), *[F.col(c) for c in strata], F.col(item)], "_n")
    return few.filter(F.col("_n") <= each).select(item, "transform", *strata)


def random_negatives(items: DataFrame, item: str, stratum: str, bits: str, origin: str, known: DataFrame, limit: int, least: int = 12, uses: int = 3, reach: int = 20, seed: int = 0) -> DataFrame:
    """(item_a, item_b): pairs within a stratum that are no known candidates, of unlike origin and at least `least` bits apart,
    with no item in more than `uses` of them.

    Each item is paired with the `reach` next ones of its stratum in an order dealt by
    the seed, so that a stratum never becomes all its pairs. The final choice walks
    through the pairs in their dealt order, ten times `limit` at a time, until it has
    `limit` or none are left: what the driver holds is bounded by the limit alone.
    """
    order = Window.partitionBy(stratum).orderBy(draw(seed, F.col(item)), item)
    row = F.struct(F.col(item).alias("i"), F.col(bits).alias("v"), F.col(origin).alias("o"))
    near = items.select(F.col(stratum), F.col(item), F.col(bits), F.col(origin), F.collect_list(row).over(order.rowsBetween(1, reach)).alias("_next"))
    pairs = near.select(F.col(item).alias("a"), F.col(bits).alias("v"), F.col(origin).alias("o"), F.explode("_next").alias("n")).filter((F.col("o") != F.col("n.o")) & (hamming(F.col("v"), F.col("n.v")) >= least))
    keyed = pairs.select(F.least("a", "n.i").alias("item_a"), F.greatest("a", "n.i").alias("item_b")).distinct()
    fresh = keyed.join(known.select("item_a", "item_b"), ["item_a", "item_b"], "left_anti")
    dealt = written_table(fresh.withColumn("_d", draw(seed, pair_key(F.col("item_a").cast("string"), F.col("item_b").cast("string")))))
    used: dict = {}
    keep: list[tuple] = []
    last = ""
    while len(keep) < limit:
        part = dealt.filter(F.col("_d") > last).orderBy("_d").limit(10 * limit).collect()
        if not part:
            break
        for row in part:
            a, b = row["item_a"], row["item_b"]
            if len(keep) < limit and used.get(a, 0) < uses and used.get(b, 0) < uses:
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
                keep.append((a, b))
        last = part[-1]["_d"]
    return items.sparkSession.createDataFrame(keep, dealt.select("item_a", "item_b").schema)


def performance(controls: DataFrame) -> DataFrame:
    """For each group of controls (columns group, expected, relation): rates, and whether it passes: at least 0.95 of strict and
    0.75 of hard positives called derivatives, at most 0.01 of negatives."""
    hit = F.col("relation").isin(*DERIVATIVE).cast("int")
    least = F.when(F.col("expected") == "negative", F.avg(hit) <= 0.01).when(F.col("expected") == "hard_positive", F.avg(hit) >= 0.75).otherwise(F.avg(hit) >= 0.95)
    return controls.groupBy("group", "expected").agg(F.count("*").alias("n"), F.avg(hit).alias("derivative_rate"), F.count_if(F.col("relation") == SAME_SCENE).alias("n_same_scene"), least.alias("passes"))


def hidden_relations(controls: DataFrame) -> DataFrame:
    """Random negatives that turned out to be related: edges for the ledger, not false alarms."""
    return controls.filter((F.col("expected") == "negative") & F.col("relation").isin(*DERIVATIVE, SAME_SCENE)).select("item_a", "item_b", "relation", F.lit("hidden_control").alias("stage"))


def disjoint(left: DataFrame, right: DataFrame) -> int:
    """How many unordered pairs two sets share; guards ask for 0."""
    key = pair_key(F.col("item_a").cast("string"), F.col("item_b").cast("string"))
    return left.select(key).intersect(right.select(key)).count()


def check_vectors(table: DataFrame, item: str, vector: str, tolerance: float = 3e-4) -> DataFrame:
    """One row: rows, distinct items, least and largest size, rows with components that aren't finite, rows whose norm isn't 1."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return table.agg(F.count("*").alias("n_rows"), F.countDistinct(item).alias("n_items"), F.min(F.size(vector)).alias("least_size"), F.max(F.size(vector)).alias("largest_size"), F.count_if(F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("n_not_finite"), F.count_if(F.abs(norm - 1) > tolerance).alias("n_not_normed"))


def task_manifest(files: DataFrame, name: str, key: str) -> DataFrame:
    """files with slug, unique by a suffix, and a running task id in the order of the key."""
    from kinfold.functions.exprs import slug

    again = F.row_number().over(Window.partitionBy("_slug").orderBy(key))
    slugged = files.withColumn("_slug", slug(name)).withColumn("_n", again)
    unique = F.when(F.col("_n") == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", F.col("_n").cast("string")))
    return ranked(slugged.withColumn("slug", unique), [F.col(key).asc()], "task_id").drop("_slug", "_n")
