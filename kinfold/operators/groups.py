"""Exact components: what is byte-identical, and what that means across sources, labels and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.exprs import set_join, yes_no
from kinfold.runtime import written_table


def exact_components(items: DataFrame, item: str, content: str, sets: Sequence[str] = (), source: str = "source") -> DataFrame:
    """One row for each distinct content (a hash): size, member sets of the named columns with their counts, first member.

    Items without a hash belong to no component; count them with missing_content().
    """
    rows = items.filter(F.col(content).isNotNull() & (F.col(content) != ""))
    many = [x for name in sets for x in (set_join(name).alias(f"{name}s"), F.countDistinct(F.when(F.col(name).cast("string") != "", F.col(name))).alias(f"n_{name}s"))]
    first = F.min(F.struct(F.col(source), F.col(item)))
    return rows.groupBy(content).agg(F.count("*").alias("component_size"), *many, first.alias("_first")).select(
        content, "component_size", *[c for name in sets for c in (f"{name}s", f"n_{name}s")], F.col(f"_first.{source}").alias("representative_source"), F.col(f"_first.{item}").alias("representative_item")
    )


def missing_content(items: DataFrame, content: str) -> DataFrame:
    return items.filter(F.col(content).isNull() | (F.col(content) == "")).agg(F.count("*").alias("n_without_content"))


def ranked(table: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """The table with each row's place (from 1) in a total order that ends in a unique key.

    Rows are sorted in ranges, one task each, and a range's rows count on from those of
    the ranges before it, which are a row each: no task holds all rows. The ranges are
    written once, since a second run could cut them elsewhere.
    """
    ranges = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = written_table(table.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = spread.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return spread.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + place + 1).drop("_p", "_m", "_b")


def ranked_within(table: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """The table with each row's place (from 1) within its group, in an order that ends in a unique key.

    Places are those in the order of all groups, less the group's first: a group that
    holds a third of all rows is still sorted by many tasks. Nulls are a group.
    """
    # groups in the order of their hashes, so that values of any kind can be told apart, nulls too
    group = F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in by])
    every = ranked(table.withColumn("_g", group), [F.col("_g").asc(), *order], "_r")
    firsts = every.groupBy("_g").agg(F.min("_r").alias("_f"))
    return every.join(firsts, "_g").withColumn(name, (F.col("_r") - F.col("_f") + 1).cast("long")).drop("_g", "_r", "_f")


def numbered(table: DataFrame, key: str, prefix: str, name: str) -> DataFrame:
    """The table with ids PREFIX000001, ... in the order of a unique key."""
    return ranked(table, [F.col(key).asc()], "_rank").withColumn(name, F.format_string(f"{prefix}%06d", "_rank")).drop("_rank")


def members(items: DataFrame, components: DataFrame, content: str) -> DataFrame:
    """Component attributes on every member; exactly one member of each component is its representative."""
    return items.join(components, content).withColumn("is_representative", yes_no((F.col("source") == F.col("representative_source")) & (F.col("doc_id") == F.col("representative_item"))))


def conflicts(components: DataFrame, sets: Sequence[str]) -> DataFrame:
    """YES/NO for each set with more than one value."""
    return components.select("*", *[yes_no(F.col(f"n_{name}s") > 1).alias(f"cross_{name}") for name in sets])


def overlap(units: DataFrame, source: str, unit: str, full: bool = False) -> DataFrame:
    """Shared units of each pair of sources, with shares of either; pairs without any are zeros. full: both orders and the diagonal.

    Sources that meet in a unit are paired within it, so the work follows the
    sources of a unit, not the square of all units. Only the list of sources,
    one row each, is combined with itself.
    """
    distinct = units.select(F.col(source).cast("string").alias("s"), F.col(unit).alias("u")).filter("s is not null and u is not null").distinct()
    sizes = distinct.groupBy("s").agg(F.count("*").alias("n"))
    per_unit = distinct.groupBy("u").agg(F.collect_set("s").alias("ss"))
    met = per_unit.select(F.explode("ss").alias("source_a"), "ss").select("source_a", F.explode("ss").alias("source_b")).groupBy("source_a", "source_b").agg(F.count("*").alias("shared"))
    listed = sizes.agg(F.collect_list(F.struct("s", "n")).alias("all"))  # one row for each source
    pairs = listed.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).select(F.col("a.s").alias("source_a"), F.col("a.n").alias("units_a"), F.col("b.s").alias("source_b"), F.col("b.n").alias("units_b"))
    if not full:
        pairs = pairs.filter("source_a < source_b")
    joined = pairs.join(met, ["source_a", "source_b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    share = lambda n: F.round(100.0 * F.col("shared") / F.greatest(F.col(n), F.lit(1)), 6)
    return joined.select("source_a", "source_b", "units_a", "units_b", "shared", share("units_a").alias("percent_of_a"), share("units_b").alias("percent_of_b"))


def leave_one_out(items: DataFrame, source: str, content: str) -> DataFrame:
    """For each source, how many of its items have a copy in another one."""
    spread = items.groupBy(content).agg(F.countDistinct(source).alias("_s"))
    marked = items.join(spread, content, "left")
    hit = F.coalesce(F.col("_s") > 1, F.lit(False)).cast("int")
    return marked.groupBy(F.col(source).alias("held_out_source")).agg(
        F.count("*").alias("n_items"), F.sum(hit).alias("n_contaminated"), F.round(F.sum(hit) / F.greatest(F.count("*"), F.lit(1)), 6).alias("contamination_rate")
    )


def findings(table: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One row (finding, value) for each measure of the whole table: a single aggregate, unpivoted."""
    row = table.agg(*[m.cast("long").alias(k) for k, m in measures.items()])
    pairs = ", ".join(f"'{k}', `{k}`" for k in measures)
    return row.select(F.expr(f"stack({len(measures)}, {pairs}) as (finding, value)"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two tables has, or both."""
    a = left.select(F.col(key)).distinct().withColumn("_l", F.lit(1))
    b = right.select(F.col(key)).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both").alias("side"))


def mismatches(observed: DataFrame, expected: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, observed, expected) for each field that two tables give differently for a key that both have."""
    o = observed.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"o_{c}") for c in columns])
    e = expected.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"e_{c}") for c in columns])
    pairs = ", ".join(f"'{c}', o_{c}, e_{c}" for c in columns)
    return o.join(e, key).select(key, F.expr(f"stack({len(columns)}, {pairs}) as (field, observed, expected)")).filter("observed <> expected")


def completeness(wanted: DataFrame, got: DataFrame, key: str, failed: Column) -> DataFrame:
    """(key, problem): wanted keys that are missing, keys that came unasked, several times, or failed."""
    counts = got.groupBy(key).agg(F.count("*").alias("_n"), F.max(failed.cast("int")).alias("_f"))
    joined = wanted.select(key).distinct().withColumn("_w", F.lit(1)).join(counts, key, "full_outer")
    problems = F.array_compact(F.array(F.when(F.col("_n").isNull(), "missing"), F.when(F.col("_w").isNull(), "unexpected"), F.when(F.col("_n") > 1, "duplicate"), F.when(F.col("_f") == 1, "failed")))
    return joined.select(key, F.explode(problems).alias("problem"))


def eligibility(items: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """items with exclusion_reason (the names of all rules that exclude, joined by ;) and eligible."""
    reasons = F.array_join(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules.items()]), ";")
    return items.withColumn("exclusion_reason", reasons).withColumn("eligible", yes_no(F.col("exclusion_reason") == ""))


def require(table: DataFrame, columns: Sequence[str], unique: Sequence[str] = (), count: int | None = None) -> DataFrame:
    """The table itself, or an error that says which columns are absent, which keys repeat or how many rows are there."""
    if absent := sorted(set(columns) - set(table.columns)):
        raise ValueError(f"missing columns: {', '.join(absent)}")
    if unique and (again := table.groupBy(*unique).count().filter("count > 1").take(5)):
        raise ValueError(f"repeated keys: {[r.asDict() for r in again]}")
    if count is not None and (there := table.count()) != count:
        raise ValueError(f"{there} rows instead of {count}")
    return table
