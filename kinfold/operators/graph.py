"""Connected components as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.runtime import ROWS_A_FILE, cut_lineage


def _cut_if_many(df: DataFrame, rows: int) -> DataFrame:
    """Both steps cut what they join: beside a plain shuffle of both sides, AQE can split a hub. What one task holds with ease needs no cut."""
    return cut_lineage(df, rows) if rows > ROWS_A_FILE else df


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _cut_if_many(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * rows)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    least = _cut_if_many(edges.groupBy("u").agg(F.min("v").alias("m")), rows)
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 100, at_most: int | None = None) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node it can reach.

    Alternates the large-star and small-star steps (Kiveris et al., 2014), so a
    component of any diameter is done in a logarithmic number of rounds. Every
    round is pre-aggregated by key and cut by reliable checkpoints; the test for
    the end is one aggregate (row count and hash sum) of the last. A hub
    keeps one row for each of its edges, and joins on it can be split by AQE.

    at_most: a bound on the number of edges, if known; small graphs then take few tasks.

    Self links, repeated links and links with a null end are allowed: a null end
    takes no part; a self link alone yields its node as its own component. No
    edges: no rows.
    """
    # cut first: the nodes and the first stars both read it, and the edges may be dear
    pairs = cut_lineage(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null").distinct(), at_most)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    star = pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    mark = None
    for _ in range(max_rounds):
        row = star.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] == 0 or (row["n"], row["h"]) == mark:
            break
        mark = (row["n"], row["h"])
        n = 2 * row["n"]  # a step makes no more than an edge for each edge, and one for each node
        star = cut_lineage(_small_star(_cut_if_many(_large_star(star, n), n), n), n)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(star.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def grouped(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """(node, component) for every node, those without an edge as their own component. Ends of edges that aren't nodes are ignored."""
    inner = edges.join(nodes.select(F.col(node).alias(a)), a, "left_semi").join(nodes.select(F.col(node).alias(b)), b, "left_semi")
    found = connected_components(inner, a, b).withColumnRenamed("node", node)
    return nodes.select(node).distinct().join(found, node, "left").withColumn("component", F.coalesce("component", F.col(node)))


def named_groups(members: DataFrame, node: str, prefix: str) -> DataFrame:
    """members with group_id: a hash of the component's sorted members, so that no partitioning or numbering can change it."""
    from kinfold.functions.exprs import group_id

    names = members.groupBy("component").agg(group_id(prefix, F.collect_set(F.col(node).cast("string"))).alias("group_id"))
    return members.join(names, "component")


def contracted(edges: DataFrame, groups: DataFrame, a: str, b: str, node: str = "node", group: str = "component") -> DataFrame:
    """edges between groups: ends replaced by their groups, links within a group left out."""
    left = groups.select(F.col(node).alias(a), F.col(group).alias("group_a"))
    right = groups.select(F.col(node).alias(b), F.col(group).alias("group_b"))
    return edges.join(left, a).join(right, b).filter("group_a <> group_b")


def merging_edges(edges: DataFrame, a: str, b: str, rank: str, max_rounds: int = 64) -> DataFrame:
    """The edges that join two so far separate components when all are taken in the order of rank (a unique number).

    These are the minimum spanning forest by rank, which Boruvka's rounds find: every
    component takes the least edge that leaves it, and the components so joined
    become one. No order has to be walked through by one task.
    """
    from pyspark.sql import Window

    rest = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(rank).alias("r"), F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y"))
    taken = None
    for _ in range(max_rounds):
        if rest.isEmpty():
            break
        ends = rest.select("x", "y", "r").unionByName(rest.select(F.col("y").alias("x"), F.col("x").alias("y"), "r"))
        least = cut_lineage(ends.groupBy("x").agg(F.min(F.struct("r", "y")).alias("e")).select("x", "e.y", "e.r"))
        taken = least.select("r").distinct() if taken is None else taken.unionByName(least.select("r").distinct())
        groups = cut_lineage(connected_components(least, "x", "y"))
        moved = rest.join(groups.select(F.col("node").alias("x"), F.col("component").alias("gx")), "x").join(groups.select(F.col("node").alias("y"), F.col("component").alias("gy")), "y")
        rest = cut_lineage(moved.filter("gx <> gy").select("a", "b", "r", F.col("gx").alias("x"), F.col("gy").alias("y")))
    if taken is None:
        return edges.limit(0)
    return edges.join(taken.select(F.col("r").alias(rank)).distinct(), rank, "left_semi")


def _bridges(links: list[tuple]) -> list[tuple]:
    """Links whose removal parts their component: a depth-first walk with a stack of its own; parallel links are no bridges."""
    near: dict = {}
    for i, (x, y) in enumerate(links):
        near.setdefault(x, []).append((y, i))
        near.setdefault(y, []).append((x, i))
    order: dict = {}
    low: dict = {}
    found = []
    for root in near:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        walk = [(root, -1, iter(near[root]))]
        while walk:
            node, by, rest = walk[-1]
            for other, link in rest:
                if link == by:
                    continue
                if other in order:
                    low[node] = min(low[node], order[other])
                else:
                    order[other] = low[other] = len(order)
                    walk.append((other, link, iter(near[other])))
                    break
            else:
                walk.pop()
                if walk:
                    parent = walk[-1][0]
                    low[parent] = min(low[parent], low[node])
                    if low[node] > order[parent]:
                        found.append(links[by])
    return found


def bridge_edges(edges: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, a, b) of the distinct links whose removal would part their group; groups of three nodes or more.

    A walk through a group is sequential, so each group is one task's: groups here are
    the split blocks, whose size the block audit bounds.
    """
    import pandas as pd

    kinds = dict(edges.dtypes)
    links = edges.select(group, F.least(a, b).alias(a), F.greatest(a, b).alias(b)).filter(F.col(a) != F.col(b)).distinct()

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(part[a].tolist(), part[b].tolist(), strict=True))
        found = _bridges(pairs) if len({x for p in pairs for x in p}) >= 3 else []
        return pd.DataFrame({group: [part[group].iloc[0]] * len(found), a: [x for x, _ in found], b: [y for _, y in found]})

    return links.groupBy(group).applyInPandas(walk, f"{group} {kinds[group]}, {a} {kinds[a]}, {b} {kinds[b]}")
