"""SimHash near-duplicates by vantage-point trees over fingerprints.

Two fingerprints that differ in at most r of 64 bits differ in at most one bit of one
of r // 2 + 1 blocks of bits (three for 4 bits). On a block the number of differing
bits is a metric of its own, and one in which a radius of 1 prunes: over whole
fingerprints nearly every branch of a vantage-point tree lies within r of the boundary,
since distances crowd around 32. So there is a tree for each block. Its top levels come
from a bounded sample and only route: a fingerprint is stored in one shard, by its
distances to the vantage points, and of two that a boundary parts one queries the
shards on the other side that the triangle inequality doesn't exclude. Within a shard
the tree goes on down to small leaves, where whole fingerprints are compared. Every
pair within r meets in one of the trees, so the links are exact.

Equal fingerprints are one before anything is routed, and a shard returns a spanning
forest of the links it finds, at most one link for each fingerprint in it: a group of
near copies never becomes all its pairs.

near_duplicates() links fingerprints by distance alone. one_of_each() links texts alike
to ALIKE in their sets of five-word shingles, and only these: the trees over PRINTS
independent fingerprints of a set find candidates within a wider radius, which all
fingerprints together confirm, and the sets themselves decide. Texts that chains of
candidates connect are a group; the sets of a group of up to GROUP shingles meet in one
task, which compares them through an index of their common shingles and returns only a
spanning forest of the links. A larger group is split: its candidates are dealt as
pairs, first a spanning forest of them, closest first, then every candidate whose ends
the first has not brought into one class, so that no forest's choice can cost a link.

Defined results: null, empty and blank texts have no words, hence fingerprint zero,
and are linked with each other like any others. Repeated rows are judged row by row.
Null ids take part but are never a component's smallest id, unless it has no other
(then component_id is null). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._tables import column, free_names, frugal, texts_of, two
from kinfold.operators.graph import connected_components
from kinfold.runtime import written_table

RADIUS, SHINGLE, SEED = 4, 4, 42


def blocks(radius: int) -> list[int]:
    """Masks of radius // 2 + 1 blocks of 64 bits: a pair within the radius has a block with at most one differing bit."""
    n = radius // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


#: For one_of_each: the least Jaccard similarity of a link; fingerprints of a set, and the bits that a pair alike to ALIKE may
#: differ in: one at most of a quarter of one of them, QUARTERS (2.4 of 16 on average at 0.8; 28 % do), WIDE of that fingerprint
#: (9.7 of 64 on average, with a standard deviation of 2.9) and TOGETHER of all (58 of 384, 7): strangers differ in half of all
#: bits, so hardly one of them is a candidate, however many there are, and one in 4,000 only differs so little in a quarter.
ALIKE, PRINTS, WIDE, TOGETHER = 0.8, 6, 18, 90
QUARTERS = blocks(6)
#: Shingles of a group whose sets meet in one task.
GROUP = 1 << 20
#: Bits, at most, of the filter that keeps texts without a candidate out of a shuffle (a broadcast of a million rows at most).
BITS = 1 << 26
#: Fingerprints sampled for the routing levels; stored in a shard on average (15 MB); compared at once in a leaf.
SAMPLE, SHARD, LEAF = 8192, 250_000, 1 << 18
_KEYS = np.array([(0xD6E8FEB86659FD93 * (i + 1)) % 2**64 for i in range(PRINTS)], np.uint64)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: str) -> np.ndarray:
    """Hashes of the four-word shingles in their order; of all words if there are fewer; none without words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(SHINGLE, len(words))
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], "<u8")


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    votes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fives(hashes: np.ndarray) -> np.ndarray:
    """The set of five-word shingles, as sorted hashes: two neighbouring four-word shingles make one; a single one stays as it is."""
    five = hashes if len(hashes) < 2 else hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    five = (five ^ (five >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(five ^ (five >> np.uint64(32)))


def prints(five: np.ndarray) -> list[int]:
    """PRINTS fingerprints of a set of shingles, each from hashes of their own."""
    n = len(five)
    if not n:
        return [0] * PRINTS
    mixed = (five[:, None] ^ _KEYS) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(29)
    # eight bits, a byte each, are added at once: 255 of them overflow no byte
    lanes = np.unpackbits(mixed.view(np.uint8).reshape(n, -1), axis=1, bitorder="little").view(np.uint64)
    votes = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > n, bitorder="little").view("<u8").tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of sorted hashes; two empty ones are equal."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 1.0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, k, text -> doc_id, k, fp."""
    for batch in batches:
        found = np.array([fingerprint(shingles(x)) for x in texts_of(batch.column(2))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "k", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, k, text -> doc_id, k, node (a hash of the set of five-word shingles), size of the set, fps."""
    for batch in batches:
        sets = [fives(shingles(x)) for x in texts_of(batch.column(2))]
        nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
        fps = np.array([prints(x) for x in sets], np.uint64).reshape(-1, PRINTS).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), pa.array([len(x) for x in sets], pa.int32()), pa.array(fps.tolist(), pa.list_(pa.int64()))], names=["doc_id", "k", "node", "size", "fps"])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text -> node, the set itself."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fives(shingles(x)).tobytes() for x in texts_of(batch.column(1))], pa.binary())], names=["node", "set"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and both sets -> a, b of the pairs alike to ALIKE."""
    for batch in batches:
        sure = [similarity(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")) >= ALIKE - 1e-9 for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(sure, pa.bool_()))


def _differ(a: np.ndarray, b, mask: int) -> np.ndarray:
    return np.bitwise_count((a ^ b) & np.uint64(mask))


class Router:
    """The top levels of a block's tree. Node i has the children 2i + 1 (distance up to its bound) and 2i + 2."""

    def __init__(self, sample: np.ndarray, mask: int, levels: int):
        self.mask, self.levels = mask, levels
        self.nodes: dict[int, tuple[int, int]] = {}
        self._split(sample, 0, levels)

    def _split(self, sample: np.ndarray, node: int, levels: int) -> None:
        if not levels or len(sample) < 2:
            return
        vantage = sample[0]
        far = _differ(sample, vantage, self.mask)
        bound = int(np.median(far))
        if bound >= far.max():
            bound = int(far.max()) - 1
        if bound < 0:
            return
        self.nodes[node] = (int(vantage), bound)
        self._split(sample[far <= bound], 2 * node + 1, levels - 1)
        self._split(sample[far > bound], 2 * node + 2, levels - 1)

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, rows that are stored there or query it, which of these are stored).

        Of two stored rows that a boundary parts, the one inside queries the outside;
        a row that only queries goes wherever the triangle inequality lets it.
        """
        work = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
        while work:
            node, rows, stored = work.pop()
            if not len(rows):
                continue
            if node not in self.nodes:
                yield node, rows, stored
                continue
            vantage, bound = self.nodes[node]
            far = _differ(fps[rows], np.uint64(vantage), self.mask)
            inside = far <= bound
            for child, near in ((2 * node + 1, inside | ~stored & (far == bound + 1)), (2 * node + 2, ~inside | (far == bound))):
                work.append((child, rows[near], (stored & (inside if child % 2 else ~inside))[near]))


class Forest:
    """Union-find that keeps the links that joined two classes."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def _leaf(stored: np.ndarray, asking: np.ndarray, forest: Forest, radius: int) -> None:
    """Links among the stored and between them and the asking fingerprints; after it, those within the radius of each other are in one class."""
    every = np.concatenate([stored, asking])
    if len(stored) * len(every) <= 4 * LEAF:
        a, b = np.nonzero(np.triu(np.bitwise_count(stored[:, None] ^ every[None, :]) <= radius, 1))
        if len(a) <= 8 * len(every):
            for x, y in zip(stored[a].tolist(), every[b].tolist(), strict=True):
                forest.join(x, y)
            return
    while len(stored):  # a dense leaf: once joined with a class, a fingerprint isn't compared with that class again
        near = np.bitwise_count(stored ^ stored[0]) <= radius
        members, stored = stored[near], stored[~near]
        close = np.bitwise_count(every ^ members[0]) <= radius
        for x in every[close].tolist():
            forest.join(int(members[0]), x)
        rest = every[~close]
        step = max(1, 4 * LEAF // max(1, len(rest)))
        for at in range(1, len(members), step):
            if not len(rest):
                break
            some = members[at : at + step]
            hit = np.bitwise_count(some[:, None] ^ rest[None, :]) <= radius
            linked = hit.any(axis=0)
            for x, y in zip(some[hit[:, linked].argmax(axis=0)].tolist(), rest[linked].tolist(), strict=True):
                forest.join(x, y)
            rest = rest[~linked]


def search(stored: np.ndarray, asking: np.ndarray, mask: int, forest: Forest, radius: int = RADIUS) -> None:
    """A shard's own tree: halves by distance to a vantage point until a leaf is small or has no spread. `asking` only query."""
    work = [(stored, asking)]
    while work:
        stored, asking = work.pop()
        if not len(stored):
            continue
        if len(stored) * (len(stored) + len(asking)) > LEAF and len(stored) > 32:
            vantage = stored[len(stored) // 2]
            far, off = _differ(stored, vantage, mask), _differ(asking, vantage, mask)
            bound = int(np.median(far))
            if bound >= far.max():
                bound = int(far.max()) - 1
            if bound >= 0:
                work.append((stored[far <= bound], asking[off <= bound + 1]))
                work.append((stored[far > bound], np.concatenate([asking[off >= bound], stored[far == bound]])))
                continue
        _leaf(stored, asking, forest, radius)


def leaves(fps: np.ndarray, own: np.ndarray, mask: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(stored, asking): the leaves of the tree that search() walks, as places in fps."""
    work = [(np.flatnonzero(own), np.flatnonzero(~own))]
    while work:
        stored, asking = work.pop()
        if not len(stored):
            continue
        if len(stored) * (len(stored) + len(asking)) > LEAF // 4 and len(stored) > 32:
            vantage = fps[stored[len(stored) // 2]]
            far, off = _differ(fps[stored], vantage, mask), _differ(fps[asking], vantage, mask)
            bound = int(np.median(far))
            if bound >= far.max():
                bound = int(far.max()) - 1
            if bound >= 0:
                work.append((stored[far <= bound], asking[off <= bound + 1]))
                work.append((stored[far > bound], np.concatenate([asking[off >= bound], stored[far == bound]])))
                continue
        yield stored, asking


def candidates(fps: np.ndarray, every_print: np.ndarray, sizes: np.ndarray, classes: np.ndarray, own: np.ndarray, mask: int, radius: int, forest: Forest | None) -> Iterator[np.ndarray]:
    """Pairs of places within the radius, and within TOGETHER in all prints, whose classes differ and whose sizes allow ALIKE: all of
    them, or those that join classes of the forest, the closest of each block of rows first."""
    for stored, asking in leaves(fps, own, mask):
        every = np.concatenate([stored, asking])
        values, step = fps[every], max(1, 4 * LEAF // len(every))
        for at in range(0, len(stored), step):
            some = stored[at : at + step]
            near = np.bitwise_count(values[at : at + len(some), None] ^ values) <= radius
            if np.count_nonzero(near) > 8 * len(every):  # a group of near copies: what is one class already isn't compared again
                near &= classes[some, None] != classes[every]
                if forest is not None:
                    joined = np.array([forest.root(x) for x in every.tolist()])
                    near &= joined[at : at + len(some), None] != joined
            i, j = np.nonzero(near)
            once = i + at < j  # one after another among the stored: each pair once
            i, j = some[i[once]], every[j[once]]
            fit = (classes[i] != classes[j]) & (np.minimum(sizes[i], sizes[j]) >= ALIKE * np.maximum(sizes[i], sizes[j]) - 1e-9)
            i, j = i[fit], j[fit]
            far = np.bitwise_count(every_print[i] ^ every_print[j]).sum(axis=1, dtype=np.int64)
            fit = far <= TOGETHER
            i, j, far = i[fit], j[fit], far[fit]
            if forest is None:
                yield np.c_[i, j]
            elif len(i):
                order, before = np.argsort(far, kind="stable"), len(forest.links)
                for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
                    forest.join(x, y)
                if len(forest.links) > before:
                    yield np.array(forest.links[before:], np.int64)


def alike_in(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places of a spanning forest of the pairs of sets alike to ALIKE. An index of the shingles that several sets have counts what
    each set has in common with all before it."""
    forest, n = Forest(), len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, at, often = np.unique(np.concatenate(sets) if n else np.zeros(0, "<u8"), return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    postings, starts = owner[order], np.cumsum(often) - often
    place = np.empty(len(at), np.int64)  # of each set's shingle among those who have it: those before it are the sets before this one
    place[order] = np.arange(len(at))
    first = np.cumsum(sizes) - sizes
    empty = np.flatnonzero(sizes == 0)
    for x in empty[1:].tolist():
        forest.join(int(empty[0]), x)
    for x in range(n):
        some = slice(first[x], first[x] + sizes[x])
        low, count = starts[at[some]], place[some] - starts[at[some]]
        if not count.any():
            continue
        index = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        common = np.bincount(postings[index], minlength=x)
        y = np.flatnonzero(common)
        y = y[common[y] >= ALIKE * (sizes[x] + sizes[y] - common[y]) - 1e-9]
        for other in y.tolist():
            forest.join(other, x)
    return forest.links


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """group, node, set, in the order of group -> a, b: links within each group."""
    group, nodes, sets = None, [], []

    def solved() -> Iterator[pa.RecordBatch]:
        found = alike_in([np.frombuffer(x, "<u8") for x in sets])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in found], pa.int64()), pa.array([nodes[y] for _, y in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for g, node, held in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if g != group:
                yield from solved()
                group, nodes, sets = g, [], []
            nodes.append(node)
            sets.append(held)
    yield from solved()


def _solver(radius: int, wide: bool, spanning: bool):
    """The worker that turns shards, in their order, into links: shard, fp, stored[, node, size, class, all prints] -> a, b, each
    shard's spanning forest; wide: its candidates, or a spanning forest of them."""
    masks = QUARTERS if wide else blocks(radius)

    def solve(shard: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        fps, own = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        mask = masks[shard % len(masks)]
        if wide:
            nodes, sizes, classes, *every = (np.concatenate([p[i] for p in parts]) for i in range(2, 5 + PRINTS))
            found = (np.sort(nodes[x], axis=1) for x in candidates(fps, np.stack(every, axis=1).view(np.uint64), sizes, classes, own, mask, radius, Forest() if spanning else None))
        else:
            forest = Forest()
            search(fps[own], fps[~own], mask, forest, radius)
            found = [np.array(forest.links, np.uint64).reshape(-1, 2).view(np.int64)]
        for links in found:
            for at in range(0, len(links), 50_000):
                part = links[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            columns = [batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False), *[c.to_numpy() for c in batch.columns[3:]]]
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if current is not None and shards[a] != current:
                    yield from solve(current, parts)
                    parts = []
                current = int(shards[a])
                parts.append(tuple(c[a:b].copy() for c in columns))
        if parts:
            yield from solve(current, parts)

    return run


def links(unique: DataFrame, count: int, radius: int = RADIUS, wide: bool = False, spanning: bool = True) -> DataFrame:
    """(a, b): links that connect what chains of pairs within the radius connect.

    Of fingerprints (column fp, distinct); wide: of nodes (columns fps, node, size, class), pairs of different classes that the
    trees over QUARTERS bring together, within the radius in one of their fingerprints, whose sizes allow ALIKE; if not
    spanning, all of them.
    """
    n = PRINTS if wide else 1
    of = (lambda i: F.col("fps")[i]) if wide else (lambda i: F.col("fp"))
    # about 4 * SAMPLE are left to choose from, so that no task sends more than its share of them
    thin = unique.select(of(0).alias("fp"), *([F.col("fps")] if wide else [])).filter(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(max(1, count // (4 * SAMPLE)))) == 0)
    sample = [r["fps"] if wide else [r["fp"]] for r in thin.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    levels = max(0, int(np.ceil(np.log2(max(1, count) / (2 * SHARD if wide else SHARD)))))
    seen = np.array(sample, np.int64).reshape(-1, n).view(np.uint64)
    masks = QUARTERS if wide else blocks(radius)
    routers = [(i, Router(np.ascontiguousarray(seen[:, i]), mask, min(levels, 40))) for i in range(n) for mask in masks]
    prints = [f"fp{i}" for i in range(n)]
    more = ["node", "size", "class", *prints] if wide else []

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy().view(np.uint64) for i in range(n)]
            for tree, (of_print, router) in enumerate(routers):
                fps = columns[of_print]
                for shard, rows, stored in router.route(fps):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), len(routers) * shard + tree, np.int64)), pa.array(fps[rows].view(np.int64)), pa.array(stored), *[c.take(pa.array(rows)) for c in (batch.columns[n:] + batch.columns[:n] if wide else [])]], names=["shard", "fp", "stored", *more])

    kinds = "shard long, fp long, stored boolean" + (", node long, size int, class long, " + ", ".join(f"{x} long" for x in prints)) * wide
    dealt = unique.select(*[of(i).alias(x) for i, x in enumerate(prints)], *more[:3]).mapInArrow(frugal(route), kinds)
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(frugal(_solver(radius, wide, spanning)), "a long, b long").distinct()


def _unique(found: DataFrame, *more: str) -> DataFrame:
    """(node, least, more) of every node, least its first row as struct(no_id, doc_id, k)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k")).alias("least")
    return written_table(found.groupBy("node").agg(first, *[F.min(c).alias(c) for c in more]), found.count())


def _first_rows(unique: DataFrame, classes: DataFrame, count: int) -> DataFrame:
    """(node, first) of every node: its class's first row."""
    # tables of their own, so that a class that holds a third of all fingerprints is split where it is joined
    named = written_table(unique.select("node", "least").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")), count)
    least = written_table(named.groupBy("component").agg(F.min("least").alias("first")), count)
    return named.join(least, "component").select("node", "first")


def _classes(docs: DataFrame, key: str, text: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k, fp, node) of every row, k a hash of the text and the node its fingerprint; (node, first) of every node."""
    rows = two(docs, key, text).select("doc_id", F.xxhash64("text").alias("k"), "text")
    found = written_table(rows.mapInArrow(frugal(_fingerprints), "doc_id long, k long, fp long").withColumn("node", F.col("fp")))
    unique = _unique(found, "fp")
    count = unique.count()
    return found, _first_rows(unique, connected_components(links(unique, count, radius), "a", "b", at_most=3 * count), count)


def _likely(rows: DataFrame, wanted: DataFrame, on: list[str], count: int) -> DataFrame:
    """The rows that match one of the `count` wanted, and hardly any other, without a shuffle: matches set a bit each."""
    bits = min(BITS, 1 << max(16, (16 * count).bit_length()))
    place, word, marked = free_names(rows, "place", "word", "marked")
    at, bit = F.pmod(F.xxhash64(*on, F.lit(7)), F.lit(bits)), F.expr(f"shiftleft(1L, cast({place} & 63 as int))")
    words = wanted.select(at.alias(place)).groupBy(F.shiftright(place, 6).alias(word)).agg(F.bit_or(bit).alias(marked))
    known = rows.withColumn(place, at).join(F.broadcast(words), F.shiftright(place, 6) == F.col(word))
    return known.filter(F.col(marked).bitwiseAND(bit) != 0).select(rows.columns)


def _alike_classes(docs: DataFrame, key: str, text: str, radius: int) -> DataFrame:
    """(node, first) of every set of five-word shingles, classes being linked by pairs of sets alike to ALIKE."""
    rows = two(docs, key, text).select("doc_id", F.xxhash64("text").alias("k"), "text")
    found = written_table(rows.mapInArrow(frugal(_sets), "doc_id long, k long, node long, size int, fps array<long>"))
    unique = _unique(found, "size", "fps")
    count = unique.count()
    first = written_table(links(unique.withColumn("class", F.col("node")), count, radius, wide=True))
    # only what has a candidate goes on: its set is made again from the text of its first row
    groups = connected_components(first, "a", "b", at_most=3 * count).withColumnRenamed("component", "group")
    close = written_table(unique.join(groups, "node"), count)
    n = close.count()
    wanted = close.select("node", F.coalesce("least.doc_id", F.lit(0)).alias("i"), F.col("least.no_id").alias("no"), F.col("least.k").alias("k"))
    at = ["i", "no", "k"]
    texts = _likely(rows.withColumn("i", F.coalesce("doc_id", F.lit(0))).withColumn("no", F.col("doc_id").isNull()), wanted, at, n).join(wanted, at).select("node", "text")
    sets = written_table(texts.mapInArrow(frugal(_whole_sets), "node long, set binary").dropDuplicates(["node"]))
    large = written_table(close.groupBy("group").agg(F.sum("size").alias("shingles")).filter(F.col("shingles") > GROUP).select("group"), n)
    # groups' sets meet by group, small ones only; tables of their own let a join split what is hot
    met = close.join(large, "group", "left_anti").select("group", "node").join(sets, "node").select("group", "node", "set")
    linked = met.repartition("group").sortWithinPartitions("group").mapInArrow(frugal(_decided), "a long, b long")
    linked = written_table(linked)
    hot = large.count()
    if hot:
        linked = linked.unionByName(_links_of_large(close.join(large, "group", "left_semi"), first, sets, radius))
    return _first_rows(unique, connected_components(linked, "a", "b", at_most=count), count)


def _links_of_large(close: DataFrame, first: DataFrame, sets: DataFrame, radius: int) -> DataFrame:
    """(a, b): the links of groups whose sets are too many for a task, by pairs of candidates."""
    close = written_table(close)
    n = close.count()
    first = written_table(first.join(close.select(F.col("node").alias("a")), "a", "left_semi"))

    def sure(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s")), "a")
        both = with_a.join(sets.select(F.col("node").alias("b"), F.col("set").alias("t")), "b").select("a", "b", "s", "t")
        return written_table(both.mapInArrow(frugal(_alike), "a long, b long"))

    linked = sure(first)
    named = connected_components(linked, "a", "b", at_most=n).withColumnRenamed("component", "class")
    held = written_table(close.join(named, "node", "left").withColumn("class", F.coalesce("class", "node")), n)
    rest = links(held, n, radius, wide=True, spanning=False).join(first, ["a", "b"], "left_anti")
    return linked.unionByName(sure(rest))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    found, classes = _classes(docs, key, text, radius)
    return found.join(classes, "node").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = WIDE) -> DataFrame:
    """One row of docs, with all its columns, for each class of texts alike to ALIKE in their five-word shingles: that with the
    smallest id (null ids last, then by a hash of the text). Candidates are searched within the radius; the sets decide."""
    own, no_id, hashed = names = free_names(docs, "id", "no", "k")
    first = _alike_classes(docs, key, text, radius).select(F.coalesce("first.doc_id", F.lit(0)).alias(own), F.col("first.no_id").alias(no_id), F.col("first.k").alias(hashed)).distinct()
    known = column(key).cast("long")
    marked = docs.withColumns({own: F.coalesce(known, F.lit(0)), no_id: known.isNull(), hashed: F.xxhash64(column(text).cast("string"))})
    # one dealing by these three serves the join and the repeated rows
    return marked.join(first, names, "left_semi").dropDuplicates(names).drop(*names)
