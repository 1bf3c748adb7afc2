"""Suffix-array dedup: every element of a long string that starts anywhere else.

Elements are the bytes of a text, or its words (runs between ASCII white space); a Rule
says which, and how many make a long string. A string of `span` elements that occurs
twice holds the same anchor in both places: of its grams (`gram` elements each) the
leftmost with the least hash. So each document is scanned once for its anchors, two in
span - gram + 2 elements on average, and only grams that are an anchor more than once
go on. Anchors with the same surroundings (all that a string of `span` elements around
the anchor can reach) are counted, not gathered: copies by the thousand become one row
with a count before anything is sent by key. The distinct surroundings of a gram meet
in one group, as the sorted suffixes that start at the anchors. A stack scan over the
common prefixes of neighbours visits every interval of the common-prefix tree; inside
an interval its members are ordered by what stands to their left, which tells whether
their left extensions are diverse and how far each shares its own with another member.
Members that share `span` elements in all are a repeat group with all its occurrences,
and each learns its largest extent.

A gram with over HOT different surroundings is split: two places that share a long string
share the `after` elements that start at the anchor or the `before` ones that end there,
so its members meet by either of these cores, and a core that one place alone has is
done with. A core with over HOT surroundings is split as finely as can be, by each of the
strings of `span` elements that hold the anchor. Places with the same string at the same
distance share a long string whatever else surrounds them, so these are counted by key,
and no task ever holds a hot core's places.

Defined results: a null text is empty; strings are compared as UTF-8 bytes and
never cross documents. A repeated row counts as another place. Null ids are
allowed. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._tables import column, frugal
from kinfold.runtime import drop_table, tidy, written_table


@dataclass(frozen=True)
class Rule:
    """span: elements of a long string; gram: elements of an anchor; words: elements are words, not bytes."""

    span: int
    gram: int
    words: bool = False

    @property
    def reach(self) -> int:
        return self.span - self.gram

    @property
    def after(self) -> int:
        return 2 * self.span // 3

    @property
    def before(self) -> int:
        return self.span - self.after + 1

    @property
    def width(self) -> int:
        """Bytes that stand for an element where surroundings are compared."""
        return 8 if self.words else 1


#: Strings of 400 bytes; passages of 50 words.
BYTES, PASSAGES = Rule(400, 96), Rule(50, 8, words=True)
#: Different surroundings of a gram, or of a core, that meet in one task at most: about 12 MB.
HOT = 1 << 14
#: Bytes that are scanned at a time.
SCAN = 1 << 18
_TABLE = np.random.default_rng(96).integers(0, 2**63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ODD), -1, 2**64))
_LOW = np.uint64((1 << 24) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of each word; a word ends where a document starts."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    fresh = np.zeros(len(data) + 1, bool)
    fresh[starts] = True
    fresh[[0, -1]] = True
    low = np.flatnonzero(solid & (fresh[:-1] | ~np.r_[False, solid[:-1]]))
    high = np.flatnonzero(solid & (fresh[1:] | ~np.r_[solid[1:], False])) + 1
    power = np.cumprod(np.full(len(data), _ODD, np.uint64))
    sums = np.r_[np.uint64(0), np.cumsum(_TABLE[data] * power)]
    back = np.cumprod(np.full(len(data), _BACK, np.uint64))
    return _mixed((sums[high] - sums[low]) * back[low]), low, high


def elements(data: np.ndarray, starts: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """A number for each element, and the first element of each document; starts: first bytes of the documents, and the end."""
    if not rule.words:
        return _TABLE[data], starts
    values, low, _ = words_of(data, starts)
    return values, np.searchsorted(low, starts)


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of `gram` elements, by doubling the run's length."""
    have = {1: values}
    power, width, odd = {1: _ODD}, 1, int(_ODD)
    while 2 * width <= gram:
        h, p = have[width], power[width]
        have[2 * width] = h[:-width] * p + h[width:]
        odd = odd * odd % 2**64
        width *= 2
        power[width] = np.uint64(odd)
    total, done = None, 0
    for width in sorted(have, reverse=True):
        if gram & width:
            h = have[width]
            total = h if total is None else total[: len(h) - done] * power[width] + h[done:]
            done += width
    return _mixed(total)


def anchors(values: np.ndarray, bounds: list[tuple[int, int]], rule: Rule = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all long strings within one of the bounds (start, end of a document)."""
    valid = np.zeros(len(values) + 1, np.int8)
    for a, b in bounds:
        if b - a >= rule.span:
            valid[a] += 1
            valid[b - rule.span + 1] -= 1
    valid = np.cumsum(valid[:-1]).astype(bool)
    none = np.zeros(0, np.int64)
    if not valid.any():
        return none, none.astype(np.uint64)
    hashes, k = gram_hashes(values, rule.gram), rule.reach + 1
    keys = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    padded = np.full(-(-len(keys) // k) * k, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, k)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(keys) - k + 1], ahead[k - 1 : len(keys)])[valid[: len(keys) - k + 1]]
    at = (least[np.r_[True, least[1:] != least[:-1]]] & _LOW).astype(np.int64)
    at = np.unique(at)
    return at, hashes[at]


def every_anchor(values: np.ndarray, starts: np.ndarray, rule: Rule, most: int = 1 << 24) -> tuple[np.ndarray, np.ndarray]:
    """As anchors(), of documents from each start to the next; more elements than the scan's index holds go in pieces that overlap by a long string."""
    bounds = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
    if len(values) < most:
        return anchors(values, bounds, rule)
    found = []
    for low in range(0, len(values), most - 2 * rule.span):
        high = min(low + most - rule.span, len(values))
        inside = [(max(a, low) - low, min(b, high) - low) for a, b in bounds if a < high and b > low]
        at, grams = anchors(values[low:high], inside, rule)
        found.append((at + low, grams))
    at, index = np.unique(np.concatenate([x for x, _ in found]), return_index=True)
    return at, np.concatenate([x for _, x in found])[index]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of strings, nulls as empty."""
    column = column.fill_null("")
    size = np.dtype("<i8") if pa.types.is_large_string(column.type) else np.dtype("<i4")
    offsets = np.frombuffer(column.buffers()[1], size, len(column) + 1, column.offset * size.itemsize).astype(np.int64)
    held = column.buffers()[2]
    return offsets, np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)


#: Keeps the grams of different rules apart.
_APART = 0x5851F42D4C957F2D


def _scanner(rules: Sequence[Rule]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, k, text -> doc_id, k, rule, gram, around, pos: the anchors of each rule with a hash of their surroundings."""
        for batch in batches:
            offsets, data = _bytes_of(batch.column(2))
            ids, keys = batch.column(0), batch.column(1)
            row = 0
            while row < batch.num_rows:
                end = min(max(int(np.searchsorted(offsets, offsets[row] + SCAN)), row + 1), batch.num_rows)
                some = data[int(offsets[row]) : int(offsets[end])]
                for which, rule in enumerate(rules):
                    values, starts = elements(some, offsets[row : end + 1] - offsets[row], rule)
                    at, grams = every_anchor(values, starts, rule)
                    if not len(at):
                        continue
                    own = np.searchsorted(starts, at, side="right") - 1
                    low, high = np.maximum(at - rule.reach, starts[own]), np.minimum(at + rule.span, starts[own + 1])
                    view, w = (values if rule.words else some).tobytes(), rule.width
                    around = [xxhash.xxh64_intdigest(view[a * w : b * w], p - a) for a, b, p in zip(low.tolist(), high.tolist(), at.tolist(), strict=True)]
                    take, grams = pa.array(own + row), grams ^ np.uint64(_APART * which % 2**64)
                    columns = [ids.take(take), keys.take(take), pa.array(np.full(len(at), which, np.int32)), pa.array(grams.view(np.int64)), pa.array(np.array(around, np.uint64).view(np.int64)), pa.array((at - starts[own]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k", "rule", "gram", "around", "pos"])
                row = end

    return scan


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _surroundings(rules: Sequence[Rule]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            offsets, data = _bytes_of(batch.column(2))
            for row, places in enumerate(batch.column(3).to_pylist()):
                text = data[offsets[row] : offsets[row + 1]]
                words = words_of(text, np.zeros(1, np.int64))[0] if any(rules[x["rule"]].words for x in places) else None
                for place in places:
                    rule, p = rules[place["rule"]], place["pos"]
                    of = words if rule.words else text
                    yield place["rule"], place["gram"], place["around"], of[max(0, p - rule.reach) : p][::-1].tobytes(), of[p : p + rule.span].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, k, text, places -> rule, gram, around, left (reversed), right: what stands around each place."""
        return _batches(rows(batches), ["rule", "gram", "around", "left", "right"], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return run


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _cores(rules: Sequence[Rule]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for which, gram, around, left, right in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rule = rules[which]
                for mark, held, size in ((b"r", right, rule.after * rule.width), (b"l", left, rule.before * rule.width)):
                    if len(held) >= size:
                        yield gram, around, _signed(xxhash.xxh64_intdigest(mark + held[:size], gram % 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """rule, gram, around, left, right -> gram, around, core: by what each place can meet those it shares a long string with."""
        return _batches(rows(batches), ["gram", "around", "core"], [pa.int64()] * 3)

    return run


def _windows(rules: Sequence[Rule]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for which, gram, around, left, right in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rule = rules[which]
                kind = np.uint64 if rule.words else np.uint8
                some = np.concatenate([np.frombuffer(left, kind)[::-1], np.frombuffer(right, kind)])
                if len(some) < rule.span:
                    continue
                l = len(left) // rule.width - np.arange(len(some) - rule.span + 1)
                hashes = gram_hashes(some if rule.words else _TABLE[some], rule.span)
                keys = _mixed(hashes + np.uint64(gram % 2**64) * (2 * l.astype(np.uint64) + np.uint64(1)))
                for x, key in zip(l.tolist(), keys.view(np.int64).tolist(), strict=True):
                    yield gram, around, x, rule.span - x, key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """rule, gram, around, left, right -> gram, around, l, r, key: the long strings that hold a place's anchor, from l elements before it to r behind its start."""
        return _batches(rows(batches), ["gram", "around", "l", "r", "key"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()])

    return run


def common(a: bytes, b: bytes) -> int:
    """How many bytes two strings share from their start on."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class _Least:
    """Least values of ranges of an array, by a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.table = [values]
        width = 1
        while 2 * width <= len(values):
            self.table.append(np.minimum(self.table[-1][:-width], self.table[-1][width:]))
            width *= 2

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Over values[low + 1 .. high], for low < high."""
        size = high - low
        level = np.frexp(size)[1] - 1
        out = np.empty(len(low), self.table[0].dtype)
        for step in np.unique(level):
            at = level == step
            row = self.table[step]
            out[at] = np.minimum(row[low[at] + 1], row[high[at] - (1 << int(step)) + 1])
        return out


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals; prefixes[i] is shared by suffixes i - 1 and i of the sorted array."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(prefixes) + 1):
        now, first = prefixes[i] if i < len(prefixes) else -1, i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def extents(left: list[bytes], right: list[bytes], span: int, gram: int, width: int = 1) -> list[list[tuple[int, int, int]]]:
    """All lengths are in bytes, and whole multiples of an element's width. For each place, (repeat, l, r): the l bytes before and r bytes from it on are found at another place, l + r >= span.

    Only extents that no other of the place contains. Places of one repeat group
    have the same repeat: the first of them in the order of the sorted suffixes,
    with the interval's length.
    """
    n = len(right)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]

    def shares(a: bytes, b: bytes) -> int:
        return common(a, b) // width * width

    if n == 2:
        l, r = shares(left[0], left[1]), shares(right[0], right[1])
        return [[(r, l, r)], [(r, l, r)]] if l + r >= span else found
    if n < 2:
        return found
    order = sorted(range(n), key=right.__getitem__)
    prefixes = [0] + [shares(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    by_left = sorted(range(n), key=left.__getitem__)
    suffixes = np.array([0] + [shares(left[a], left[b]) for a, b in zip(by_left, by_left[1:], strict=False)], np.int32)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    rank_in_order, least, members = rank[order], _Least(suffixes), np.array(by_left)
    for length, first, last in intervals(prefixes):
        if length < gram:
            continue
        ranks = np.sort(rank_in_order[first : last + 1])
        shared = least.between(ranks[:-1], ranks[1:])
        if shared.max() + length < span:  # no two members extend far enough together
            continue
        best = np.maximum(np.r_[-1, shared], np.r_[shared, -1])
        # where neighbours share too little, their left extensions are diverse: another repeat group begins
        group = np.cumsum(np.r_[0, shared + length < span])
        heads = ranks[np.r_[0, np.flatnonzero(np.diff(group)) + 1]]
        for i in np.flatnonzero(best + length >= span):
            found[members[ranks[i]]].append((int(heads[group[i]]) << 9 | length, int(best[i]), length))
    for some in found:
        if len(some) > 1:
            some.sort(key=lambda x: (-x[2], -x[1]))
            kept, most = [], -1
            for x in some:
                if x[1] > most:
                    kept.append(x)
                    most = x[1]
            some[:] = kept
    return found


def _meeting(rules: Sequence[Rule]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("repeat", pa.int64()), ("l", pa.int32()), ("r", pa.int32())]))

    def solved(group: int, rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        rule = rules[rows[0][1]]
        width = rule.width
        for row, spans in zip(rows, extents([r[4] for r in rows], [r[5] for r in rows], rule.span * width, rule.gram * width, width), strict=True):
            if spans:
                yield row[2], row[3], [{"repeat": xxhash.xxh64_intdigest(str(x).encode(), group % 2**64) >> 1, "l": l // width, "r": r // width} for x, l, r in spans]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        group, held = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != group:
                    yield from solved(group, held)
                    group, held = row[0], []
                held.append(row)
        yield from solved(group, held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """group, rule, gram, around, left, right in the order of group -> gram, around, found: what each place shares with others of its group."""
        return _batches(found(batches), ["gram", "around", "found"], [pa.int64(), pa.int64(), kind])

    return meet


def occurrences(docs: DataFrame, rules: Sequence[Rule] = (BYTES,)) -> DataFrame:
    """(doc_id, k, rule, pos, found, whole) from doc_id, k, text: anchors whose surroundings hold a repeated long string.

    rule: its place among the rules. found: (repeat, l, r), the l elements before the anchor and the r from it on being
    found elsewhere too; places of one repeat group have the same repeat. whole: the same surroundings occur elsewhere,
    so all of them are a repeat.
    """
    rules = tuple(rules)
    found = written_table(docs.mapInArrow(frugal(_scanner(rules)), "doc_id long, k long, rule int, gram long, around long, pos int"))
    # small sides of joins are tables of their own: beside a plain shuffle of both sides, a hot gram can be split
    n = found.count()
    often = written_table(found.groupBy("gram").agg(F.count("*").alias("_n")).filter("_n > 1").select("gram"), n)
    places = written_table(found.join(often, "gram", "left_semi"), n)
    drop_table(found)
    distinct = written_table(places.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min("rule").alias("rule"), F.min(F.struct("doc_id", "k", "pos")).alias("at")), places.count())
    m = distinct.count()
    several = written_table(distinct.groupBy("gram").agg(F.count("*").alias("others")).filter("others > 1"), m)
    asked = (
        distinct.join(several, "gram")
        .select(F.col("at.doc_id").alias("a_id"), F.col("at.k").alias("a_k"), F.struct(F.col("at.pos").alias("pos"), "rule", "gram", "around").alias("place"))
        .groupBy("a_id", "a_k")
        .agg(F.collect_list("place").alias("places"))
    )
    tidy(docs.sparkSession)
    of = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("k") == F.col("a_k")))
    around = written_table(of.select("doc_id", "k", "text", "places").mapInArrow(frugal(_surroundings(rules)), "rule int, gram long, around long, left binary, right binary"))
    kind = "array<struct<repeat: long, l: int, r: int>>"
    tidy(docs.sparkSession)
    members, covered = _split(around, several, rules, m)
    met = members.repartition("group").sortWithinPartitions("group").mapInArrow(frugal(_meeting(rules)), f"gram long, around long, found {kind}")
    if covered is not None:
        met = met.unionByName(covered.select("gram", "around", F.array(F.struct("repeat", "l", "r")).cast(kind).alias("found")))
    whole = distinct.filter("n > 1").select("gram", "around", F.lit(True).alias("whole"))
    shared = written_table(met.groupBy("gram", "around").agg(F.flatten(F.collect_list("found")).alias("found")).join(whole, ["gram", "around"], "full_outer"), m)
    drop_table(around, distinct, often, several)
    return places.join(shared, ["gram", "around"]).select("doc_id", "k", "rule", "pos", "found", F.coalesce("whole", F.lit(False)).alias("whole"))


def _split(around: DataFrame, several: DataFrame, rules: Sequence[Rule], places: int) -> tuple[DataFrame, DataFrame | None]:
    """(group, rule, gram, around, left, right) of places that meet, in groups of HOT at most by gram or by core, and
    (gram, around, repeat, l, r) of those whose cores are too common; None if there are none."""
    columns = ["group", "rule", "gram", "around", "left", "right"]
    hot = several.filter(F.col("others") > HOT).select("gram")
    if hot.isEmpty():
        return around.withColumn("group", F.col("gram")).select(columns), None
    few = around.join(several.filter(F.col("others") <= HOT).select("gram"), "gram", "left_semi").withColumn("group", F.col("gram"))
    many = around.join(hot, "gram", "left_semi").select(columns[1:])
    cores = written_table(many.mapInArrow(frugal(_cores(rules)), "gram long, around long, core long"))
    sizes = written_table(cores.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1"), places)
    # tables of their own, so that what is hot can be split where it is joined
    by_core = written_table(cores.join(sizes.filter(F.col("n") <= HOT).select("core"), "core").select("gram", "around", F.col("core").alias("group")), places)
    burning = written_table(cores.join(sizes.filter(F.col("n") > HOT).select("core"), "core", "left_semi").select("gram", "around").distinct(), places)
    members = few.select(columns).unionByName(many.join(by_core, ["gram", "around"]).select(columns))
    if burning.isEmpty():
        return members, None
    held = written_table(many.join(burning, ["gram", "around"], "left_semi").select(columns[1:]).mapInArrow(frugal(_windows(rules)), "gram long, around long, l int, r int, key long"))
    twice = written_table(held.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key"))
    # all these strings hold the anchor, so what they cover is one stretch
    return members, held.join(twice, "key", "left_semi").groupBy("gram", "around").agg(F.max("l").alias("l"), F.max("r").alias("r"), F.min("key").alias("repeat"))


def repeated(docs: DataFrame, rules: Sequence[Rule] = (BYTES,)) -> DataFrame:
    """(r_id, r_k, r0, r1, ...) from doc_id, k, text: for each rule the ranges of elements, from a up to b, that long strings cover which start elsewhere too."""
    reach, span = (F.element_at(F.array(*[F.lit(x) for x in of]), F.col("rule") + 1) for of in ([r.reach for r in rules], [r.span for r in rules]))
    extent = F.when(F.col("whole"), F.array(F.struct((F.col("pos") - reach).alias("a"), (F.col("pos") + span).alias("b")))).otherwise(F.transform("found", lambda x: F.struct((F.col("pos") - x["l"]).alias("a"), (F.col("pos") + x["r"]).alias("b"))))
    ranges = occurrences(docs, rules).select(F.col("doc_id").alias("r_id"), F.col("k").alias("r_k"), "rule", extent.alias("ranges"))
    return ranges.groupBy("r_id", "r_k").agg(*[F.flatten(F.collect_list(F.when(F.col("rule") == i, F.col("ranges")))).alias(f"r{i}") for i in range(len(rules))])


def _merged(ranges: list[dict] | None, end: int) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for a, b in sorted((max(0, x["a"]), min(end, x["b"])) for x in ranges or ()):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b))
        else:
            spans.append((a, b))
    return spans


def _keeper(rule: Rule, as_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = (*[pa.int64()] * 4, pa.string() if as_text else pa.binary())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """carried, text, ranges, passages -> carried, n_bytes, n_removed, n_spans, n_passages, kept. A few rows at a time."""
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            offsets, data = _bytes_of(batch.column(1))
            out: list[tuple] = []
            for row, (ranges, passages) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                text = data[offsets[row] : offsets[row + 1]]
                if rule.words and ranges:
                    _, low, high = words_of(text, np.zeros(1, np.int64))
                    spans = [(int(low[a]), int(high[b - 1])) for a, b in _merged(ranges, len(low))]
                else:
                    spans = _merged(ranges, len(text))
                text = text.tobytes()
                edges = [0, *[x for s in spans for x in s], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(spans), len(_merged(passages, 1 << 62)), kept.decode("utf-8", "ignore") if as_text else kept))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names=["carried", "n_bytes", "n_removed", "n_spans", "n_passages", "kept"])

    return keep


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = (), as_text: bool = False, rule: Rule = BYTES, passages: Rule | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes; as_text: text, without a code point that was cut
    apart) for every row; carried: a struct of the columns to carry. What the rule calls a long string is removed wherever
    it starts elsewhere too; words are removed from the first byte of the first to the last of the last.

    passages: a second rule, whose repeats are not removed but counted as n_passages, in maximal runs.
    """
    carried = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(carry)] or [F.lit(None).cast("int").alias("none")])
    rows = docs.select(column(key).cast("long").alias("doc_id"), F.xxhash64(column(text).cast("string")).alias("k"), column(text).cast("string").alias("text"), *([carried.alias("carried")] if carry else []))
    found = repeated(rows.select("doc_id", "k", "text"), [rule, *([passages] if passages else [])])
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("k") == F.col("r_k")), "left")
    none = F.lit(None).cast("array<struct<a: int, b: int>>")
    joined = joined.select("*", F.col("r0").alias("ranges"), (F.col("r1") if passages else none).alias("passages"))
    joined = joined.select(F.struct("doc_id", *(["carried"] if carry else [])).alias("carried"), "text", "ranges", "passages")
    kind = joined.schema["carried"].dataType.simpleString()
    kept = joined.mapInArrow(frugal(_keeper(rule, as_text)), f"carried {kind}, n_bytes long, n_removed long, n_spans long, n_passages long, kept {'string' if as_text else 'binary'}")
    named = F.struct(*[F.col(f"carried.carried.c{i}").alias(c) for i, c in enumerate(carry)]) if carry else None
    return kept.select("carried.doc_id", "n_bytes", "n_removed", "n_spans", *(["n_passages"] if passages else []), "kept", *([named.alias("carried")] if carry else []))
