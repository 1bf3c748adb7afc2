"""All queries of the library's own operators by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import graph, groups, splits
from kinfold.plans import item_queries, pair_queries, source_queries, study_queries
from kinfold.plans.views import items, table


def lineage_leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source: its items, those with exact copies in other sources, components that cross splits, and what a random fold assignment tears apart."""
    i = items(spark, sf_dir)
    loso = groups.leave_one_out(i, "source", "content")
    spread = i.groupBy("content").agg(F.countDistinct("split").alias("s"))
    crossing = i.join(spread.filter("s > 1").select("content"), "content", "left_semi").groupBy(F.col("source").alias("held_out_source")).agg(F.count("*").alias("n_in_crossing_components"))
    folds = splits.stratified_folds(i, "doc_id", "label", 7)
    torn = folds.groupBy("content").agg(F.countDistinct("fold").alias("f")).filter("f > 1").select("content")
    hit = folds.join(torn, "content", "left_semi").groupBy(F.col("source").alias("held_out_source")).agg(F.count("*").alias("n_torn_by_random_folds"))
    return loso.join(crossing, "held_out_source", "left").join(hit, "held_out_source", "left").na.fill(0)


FLAGSHIP_SQL = f"""with {item_queries.ITEMS}, s as (select content, count(distinct source) as k, count(distinct split) as sp from items group by content),
f as (select doc_id, content, source, (row_number() over (partition by label order by sha256('7|' || doc_id::varchar), doc_id) - 1) % 5 as fold from items),
t as (select content, count(distinct fold) as f from f group by content)
select items.source as held_out_source, count(*) as n_items, sum((k > 1)::int)::bigint as n_contaminated, round(sum((k > 1)::int) / greatest(count(*), 1), 6) as contamination_rate,
  sum((sp > 1)::int)::bigint as n_in_crossing_components, sum((t.f > 1)::int)::bigint as n_torn_by_random_folds
from items join s using (content) join t using (content) group by items.source"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"lineage_leakage_audit": lineage_leakage_audit, **item_queries.QUERIES, **pair_queries.QUERIES, **study_queries.QUERIES, **source_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"lineage_leakage_audit": FLAGSHIP_SQL, **item_queries.ORACLE, **pair_queries.ORACLE, **study_queries.ORACLE, **source_queries.ORACLE}
