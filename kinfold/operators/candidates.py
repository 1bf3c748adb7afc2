"""Candidate pairs: who might be a copy of whom."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.groups import ranked

#: Vectors in a block of the exact top-k join.
BLOCK = 4096


def _bands(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 1 disjoint bands of 64 bits: a pair within the radius agrees on one of them."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def hamming_pairs(table: DataFrame, item: str, bits: str, radius: int = 4) -> DataFrame:
    """(item_a, item_b, distance), item_a < item_b: all pairs whose 64-bit values differ in at most `radius` bits.

    Exact by the pigeonhole principle: an equality join on bands, then a count of
    differing bits. Equal values are one before the join and are spread again after
    it, so copies cost no comparisons.
    """
    values = table.groupBy(F.col(bits).alias("v")).agg(F.collect_set(item).alias("who"))
    parts = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("v", shift).bitwiseAND(F.lit(mask if mask < 2**63 else -1).cast("long")).alias("part")) for i, (shift, mask) in enumerate(_bands(radius))])
    banded = values.select("v", F.explode(parts).alias("b")).select("v", "b.band", "b.part")
    other = banded.select(F.col("v").alias("w"), "band", "part")
    near = banded.join(other, ["band", "part"]).filter("v < w").filter(F.bit_count(F.col("v").bitwiseXOR(F.col("w"))) <= radius).select("v", "w").distinct()
    spread = near.join(values.withColumnRenamed("who", "who_v"), "v").join(values.select(F.col("v").alias("w"), F.col("who").alias("who_w")), "w")
    crossed = spread.select("v", "w", F.explode("who_v").alias("x"), "who_w").select("v", "w", "x", F.explode("who_w").alias("y"))
    same = values.filter(F.size("who") > 1).select(F.col("v"), F.col("v").alias("w"), F.explode("who").alias("x"), "who").select("v", "w", "x", F.explode("who").alias("y")).filter("x < y")
    every = crossed.unionByName(same)
    return every.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), F.bit_count(F.col("v").bitwiseXOR(F.col("w"))).cast("int").alias("distance"))


def hamming_within(table: DataFrame, item: str, bits: str, radius: int, block: int = BLOCK) -> DataFrame:
    """As hamming_pairs, for radii at which bands no longer tell pairs apart: blocks of values against blocks."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, y = left["v"].to_numpy().view(np.uint64), right["v_"].to_numpy().view(np.uint64)
        out = []
        for at in range(0, len(x), 512):
            far = np.bitwise_count(x[at : at + 512, None] ^ y[None, :])
            a, b = np.nonzero(far <= radius)
            out.append(pd.DataFrame({"item_a": left["i"].to_numpy()[at + a], "item_b": right["i_"].to_numpy()[b], "distance": far[a, b].astype("int32")}))
        found = pd.concat(out) if out else pd.DataFrame({"item_a": [], "item_b": [], "distance": []}).astype("int64")
        return found[found["item_a"] < found["item_b"]]

    left, right = _in_blocks(table.select(F.col(item).alias("i"), F.col(bits).alias("v")), block)
    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(meet, "item_a long, item_b long, distance int")


def _in_blocks(table: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The table twice, each row once for every pair (p, q) of blocks that its own block is the first or second of; the second's columns end in _."""
    n = max(1, -(-table.count() // block))
    own = table.withColumn("_b", F.pmod(F.xxhash64("i"), F.lit(n)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(n - 1))
    return own.select(*table.columns, F.col("_b").alias("p"), F.explode(every).alias("q")), own.select(*[F.col(c).alias(f"{c}_") for c in table.columns], F.explode(every).alias("p"), F.col("_b").alias("q"))


def top_cosine(vectors: DataFrame, item: str, vector: str, k: int, apart: str | None = None, least: float = -1.0, block: int = BLOCK) -> DataFrame:
    """(item_a, item_b, similarity, rank): for each vector its k nearest by inner product, ties to the smaller item.

    apart: only items that differ in this column count. least: of the k, those below are
    dropped. Exact: blocks of vectors meet as matrices, each keeps its k best for a
    row, and a window picks the k best of these; no task holds more than two blocks.
    """
    v = vectors.select(F.col(item).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"), (F.col(apart).cast("string") if apart else F.lit("")).alias("g"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"item_a": [], "item_b": [], "similarity": []})
        a, b = (np.stack(c.to_numpy()) for c in (left["v"], right["v_"]))
        ga, gb = left["g"].to_numpy(), right["g_"].to_numpy()
        ia, ib = left["i"].to_numpy(), right["i_"].to_numpy()
        order = np.argsort(ib)
        b, gb, ib = b[order], gb[order], ib[order]
        out = []
        for at in range(0, len(a), 256):
            s = a[at : at + 256] @ b.T
            s[ia[at : at + 256, None] == ib[None, :]] = -np.inf
            if apart:
                s[ga[at : at + 256, None] == gb[None, :]] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(s)), top.shape[1])
            out.append(pd.DataFrame({"item_a": ia[at + rows], "item_b": ib[top.ravel()], "similarity": s[rows, top.ravel()]}))
        found = pd.concat(out)
        return found[np.isfinite(found["similarity"])]

    left, right = _in_blocks(v, block)
    met = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(meet, "item_a long, item_b long, similarity double")
    # ranked by a rounded value, so that the last bits of a sum don't decide ties
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("item_a").orderBy(F.round("similarity", 9).desc(), "item_b")))
    return ranked.filter((F.col("rank") <= k) & (F.col("similarity") >= least))


def origin_pairs(items: DataFrame, item: str, origin: str, most: int = 100) -> DataFrame:
    """(item_a, item_b, origin) of items that share an origin key; keys of more than `most` items make no pairs, as the contract says."""
    rows = items.filter(F.coalesce(F.col(origin), F.lit("")) != "").select(F.col(item).alias("i"), F.col(origin).alias("o")).distinct()
    # counted before anything is gathered: a key in a third of all rows is never one row
    few = rows.groupBy("o").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("n") <= most)).select("o")
    kept = rows.join(few, "o", "left_semi").groupBy("o").agg(F.collect_set("i").alias("who"))
    return kept.select("o", F.explode("who").alias("item_a"), "who").select("o", "item_a", F.explode("who").alias("item_b")).filter("item_a < item_b").select("item_a", "item_b", F.col("o").alias("origin"))


def crowded_origins(items: DataFrame, item: str, origin: str, most: int = 100) -> DataFrame:
    """The origin keys that origin_pairs leaves out, with their sizes: nothing is left out unseen."""
    return items.filter(F.coalesce(F.col(origin), F.lit("")) != "").groupBy(F.col(origin).alias("origin")).agg(F.countDistinct(item).alias("n_items")).filter(F.col("n_items") > most)


def adjacent_pairs(rows: DataFrame, item: str, group: str, moment: Column, gap: float, near: float | None = None) -> DataFrame:
    """(item_a, item_b, group, delta, reason): neighbours of a group's sequence whose moments differ by over 0 and at most `gap`."""
    order = Window.partitionBy(group).orderBy(moment, item)
    step = rows.select(F.col(group), F.col(item).alias("item_a"), F.lead(item).over(order).alias("item_b"), (F.lead(moment).over(order) - moment).alias("delta"))
    reason = F.when(F.col("delta") <= near, "near").otherwise("adjacent") if near is not None else F.lit("adjacent")
    return step.filter((F.col("delta") > 0) & (F.col("delta") <= gap)).withColumn("reason", reason)


def union_reasons(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(item_a, item_b, reasons, similarity, best_rank) of all pairs, unordered: reasons as a sorted set, the largest similarity, the best rank."""
    parts = [
        df.select(F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b"), F.lit(reason).alias("reason"), (F.col("similarity") if "similarity" in df.columns else F.lit(None)).cast("double").alias("similarity"), (F.col("rank") if "rank" in df.columns else F.lit(None)).cast("int").alias("rank"))
        for reason, df in sources
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("item_a", "item_b").agg(F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reasons"), F.max("similarity").alias("similarity"), F.min("rank").alias("best_rank"))


def shortlist(pairs: DataFrame, quotas: Sequence[tuple[str, int]], total: int, degree: int, order: Sequence[Column]) -> DataFrame:
    """Greedy choice: passes that each take up to a quota of the pairs whose boolean column holds, with every item in at most
    2 * degree chosen pairs, then a fill up to `total` with at most `degree`.

    What may be chosen depends on all choices before, so one task walks through the
    order: the input is a list of pairs that gates have already bounded (a reviewers'
    queue), and only its keys and flags are sent.
    """
    placed = ranked(pairs, order, "place")
    names = [name for name, _ in quotas]

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        used: dict = {}
        chosen: dict[int, str] = {}
        for name, quota, most in [*((n, q, 2 * degree) for n, q in quotas), ("", total, degree)]:
            left = min(quota, total - len(chosen)) if name else total - len(chosen)
            able = part[part[name]] if name else part
            for place, a, b in able[["place", "item_a", "item_b"]].itertuples(index=False):
                if left <= 0:
                    break
                if place in chosen or used.get(a, 0) >= most or used.get(b, 0) >= most:
                    continue
                chosen[place] = name or "fill"
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
                left -= 1
        keep = part[part["place"].isin(chosen.keys())]
        return keep[["item_a", "item_b"]].assign(chosen_as=keep["place"].map(chosen), place=range(1, len(keep) + 1))

    kinds = dict(pairs.dtypes)
    return placed.select("item_a", "item_b", *names, "place", F.lit(1).alias("all")).groupBy("all").applyInPandas(choose, f"item_a {kinds['item_a']}, item_b {kinds['item_b']}, chosen_as string, place int")
