"""Train and test designs, and the audits that say whether they hold."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions.exprs import draw
from kinfold.operators.groups import ranked_within


def stratified_folds(samples: DataFrame, item: str, label: str, seed: int, folds: int = 5) -> DataFrame:
    """samples with fold: each label's items dealt out in turn, in an order that only depends on seed and id."""
    placed = ranked_within(samples, [label], [draw(seed, F.col(item)), F.col(item)], "_place")
    return placed.withColumn("fold", F.pmod(F.col("_place") - 1, F.lit(folds)).cast("int")).drop("_place")


def group_folds(samples: DataFrame, group: str, label: str, seed: int, folds: int = 5) -> DataFrame:
    """(group, fold): whole groups dealt so that each fold has about its share of each label.

    Groups with the same counts of labels are alike, so the greedy choice runs over
    distinct count vectors, and of each vector's groups every fold gets as many as the
    choice gives it. The vectors are few however many groups there are; groups of one
    item, the bulk, make one vector for each label.
    """
    counts = samples.groupBy(group, label).agg(F.count("*").alias("n"))
    vectors = counts.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col(label).cast("string"), F.col("n").cast("string")))), ",").alias("kind"))
    kinds = {r["kind"]: r["n"] for r in vectors.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    parsed = {k: {x.rpartition(":")[0]: int(x.rpartition(":")[2]) for x in k.split(",")} for k in kinds}
    labels = sorted({x for p in parsed.values() for x in p})
    held = np.zeros((folds, len(labels)))
    total = np.array([sum(parsed[k].get(x, 0) * n for k, n in kinds.items()) for x in labels], float)
    rows = []
    # the most uneven first: what is large or of one label only is hardest to place later
    for kind in sorted(kinds, key=lambda k: (-np.std([parsed[k].get(x, 0) for x in labels]), -sum(parsed[k].values()), k)):
        vector = np.array([parsed[kind].get(x, 0) for x in labels], float)
        n, first = kinds[kind], 0
        shares = [n // folds] * folds if n >= 2 * folds else [0] * folds
        held += np.outer(shares, vector)
        for _ in range(n - sum(shares)):
            spread = [np.std((held + np.outer(np.arange(folds) == f, vector)) / total, axis=0).mean() for f in range(folds)]
            best = min(range(folds), key=lambda f: (round(spread[f], 12), held[f].sum(), f))
            held[best] += vector
            shares[best] += 1
        for fold, share in enumerate(shares):
            rows.append((kind, fold, first, first + share))
            first += share
    spark = samples.sparkSession
    table = spark.createDataFrame(rows, "kind string, fold int, low long, high long")
    place = ranked_within(vectors, ["kind"], [draw(seed, F.col(group)), F.col(group)], "place").withColumn("place", F.col("place") - 1)
    return place.join(F.broadcast(table), "kind").filter("place >= low and place < high").select(group, "fold")


def crossings(samples: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """How many groups have items in several folds."""
    per = samples.groupBy(group).agg(F.countDistinct(fold).alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("n_crossing"), F.count("*").alias("n_groups"))


def shared_groups(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    return left.select(group).intersect(right.select(group)).agg(F.count("*").alias("n_shared"))


def designs(samples: DataFrame, test: Column, keys: dict[str, str | None]) -> DataFrame:
    """(design, role, ...) of every sample in each design: all test samples, and the training samples that share no group with them.

    keys: the design's name and the column of the groups that must not be shared, or None.
    """
    out = None
    for name, group in keys.items():
        held = samples.filter(test).withColumn("role", F.lit("TEST"))
        rest = samples.filter(~test).withColumn("role", F.lit("TRAIN"))
        if group:
            rest = rest.join(held.select(group).distinct(), group, "left_anti").select(*held.columns)
        part = held.unionByName(rest).withColumn("design", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def holdouts(samples: DataFrame, source: str, group: str) -> DataFrame:
    """(held_out, n_test, n_train_naive, n_train_safe) for each source: what is left to train on without its groups.

    One pass: an item is unsafe for a held-out source if its group has items there.
    """
    reach = samples.groupBy(group).agg(F.collect_set(source).alias("_s"))
    marked = samples.join(reach, group, "left").select(source, "_s")
    hit = marked.select(F.col(source).alias("own"), F.explode("_s").alias("held_out")).filter("own <> held_out").groupBy("held_out").agg(F.count("*").alias("n_unsafe"))
    sizes = samples.groupBy(F.col(source).alias("held_out")).agg(F.count("*").alias("n_test"))
    joined = sizes.join(hit, "held_out", "left").withColumn("n", F.sum("n_test").over(Window.partitionBy(F.lit(1))))  # a row for each source
    return joined.select("held_out", "n_test", (F.col("n") - F.col("n_test")).alias("n_train_naive"), (F.col("n") - F.col("n_test") - F.coalesce("n_unsafe", F.lit(0))).alias("n_train_safe"))


def rotated_role(fold: Column, test: Column, folds: int = 5) -> Column:
    """TEST for the test fold, VALIDATION for the next, else TRAIN."""
    return F.when(fold == test, "TEST").when(fold == F.pmod(test + 1, F.lit(folds)), "VALIDATION").otherwise("TRAIN")


def grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """All combinations of a few short lists, with a running index in the order of the axes."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    places = [F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name)) for name, values in axes.items()]
    return out.withColumn("array_index", F.row_number().over(Window.orderBy(*places)))


def round_robin(rows: DataFrame, item: str, strata: Sequence[str], seed: int, count: int) -> DataFrame:
    """`count` rows drawn in turns, one from each stratum in each turn."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(draw(seed, F.col(item)), item))
    return rows.withColumn("turn", place).orderBy("turn", *strata, item).limit(count)


def removal_sets(candidates: DataFrame, unit: str, kind: str, wanted: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, kind, unit): for each replicate as many units of each kind as `wanted` (kind, n) says, without repetition within it."""
    spread = candidates.join(F.broadcast(wanted), kind).select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    place = F.row_number().over(Window.partitionBy("replicate", kind).orderBy(draw(seed, F.concat_ws("|", F.col("replicate").cast("string"), F.col(unit).cast("string"))), unit))
    return spread.withColumn("_n", place).filter(F.col("_n") <= F.col("n")).select("replicate", kind, unit)


def set_hashes(sets: DataFrame, unit: str) -> DataFrame:
    """(replicate, n_units, set_hash, repeated): whether an earlier replicate drew the same set."""
    per = sets.groupBy("replicate").agg(F.count("*").alias("n_units"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(unit).cast("string"))), "|"), 256).alias("set_hash"))
    return per.withColumn("repeated", F.row_number().over(Window.partitionBy("set_hash").orderBy("replicate")) > 1)


def lineage_weights(samples: DataFrame, group: str) -> DataFrame:
    """samples with weight: 1 / size of the group, scaled to a mean of 1."""
    own = samples.withColumn("_w", 1.0 / F.count("*").over(Window.partitionBy(group)))
    mean = own.agg(F.avg("_w")).first()[0]
    return own.withColumn("weight", F.col("_w") / F.lit(mean)).drop("_w")


def matched_plan(kinds: pd.DataFrame, totals: dict[str, int], bins: dict[str, int], blocks: int, strict: int, cost: tuple[float, float, float] = (100.0, 200.0, 20.0)) -> dict:
    """How many blocks of each kind (columns stratum, bin, paths, strict, available) to remove: exactly `totals` paths of each stratum,
    at the least cost of missing the wanted counts by bin, of blocks and of strict units.

    The search runs on the driver over kinds, not blocks. Strata are independent but for
    the shared counts: each gets its exact solutions by dynamic programming, reduced to
    one for each vector of shared counts, and the strata's are combined, keeping for
    each vector one choice.
    """
    names = sorted(bins)
    states: dict[tuple, dict] = {(0,) * (len(names) + 2): {}}
    for stratum, want in sorted(totals.items()):
        own = kinds[kinds["stratum"] == stratum]
        part: dict[tuple, dict] = {(0, *(0,) * (len(names) + 2)): {}}
        for index, row in own.iterrows():
            grown = dict(part)
            for state, chosen in part.items():
                for n in range(1, int(row["available"]) + 1):
                    paths = state[0] + n * int(row["paths"])
                    if paths > want:
                        break
                    shared = list(state[1:])
                    shared[names.index(row["bin"])] += n
                    shared[-2] += n
                    shared[-1] += n * int(row["strict"])
                    grown.setdefault((paths, *shared), {**chosen, index: n})
            part = grown
        exact = {s[1:]: c for s, c in part.items() if s[0] == want}
        if not exact:
            raise ValueError(f"no blocks make exactly {want} paths of {stratum}")
        states = {tuple(a + b for a, b in zip(s, t, strict=True)): {**c, **d} for s, c in states.items() for t, d in exact.items()}

    def missed(state: tuple) -> float:
        return cost[0] * sum(abs(state[i] - bins[x]) for i, x in enumerate(names)) + cost[1] * abs(state[-2] - blocks) + cost[2] * abs(state[-1] - strict)

    best = min(states, key=lambda s: (missed(s), s))
    return {"counts": states[best], "cost": missed(best)}
