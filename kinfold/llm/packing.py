"""Packing token sequences into windows by best-fit decreasing.

Documents become ids; overlong ones are cut into full windows and a rest. Best
fit decreasing needs nothing of a piece but its length, so the driver sees one
count for each length (as many as the window has tokens, whatever the input's
size) and works on ranges of equal windows: a segment tree over remaining
capacities gives the tightest capacity that takes the next length, and a whole
range of windows takes its pieces in one step. The plan has one row for each such
step. Pieces get a rank within their length, counted in buckets so that a length
that a third of all rows share is no single group, and find their step by rank.

Defined results: a null or empty text is the end id alone. Repeated rows and null
ids are packed row by row. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from kinfold.llm._tables import byte_of_letter, frugal, once, two
from kinfold.runtime import written_table

WINDOW, END = 2048, 1
PIECES = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]])
STEPS = T.StructType([T.StructField(c, T.LongType()) for c in ("length", "first_rank", "end_rank", "width", "first_sequence", "first_offset")])


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizer in a file gives them.

    A byte-pair merge with word ends is the merge over bytes with a mark byte after
    each word, if the mark joins a word's last byte first. So a file of that kind is
    turned into ranks for the faster merge of tiktoken; its splitting pattern, spelled
    out for the letters of PLAIN texts, marks the words. A text with any other
    character, or one that could hold a special token's string, goes to the tokenizer
    itself, and so does everything if the file is of another kind.
    """

    MARK = "\x01"
    #: Characters of which it is known how the tokenizer normalises and splits them: ASCII, Latin letters, common marks.
    PLAIN = re.compile("[\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u2013\u2014\u2018\u2019\u201c\u201d\u2026]*")
    LETTERS = "a-z\u00df-\u00f6\u00f8-\u017f"
    WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
    #: The splitting pattern that WORDS spells out, a fixed value.
    KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path = path
        self.special = sorted({t["content"] for t in spec["added_tokens"]})
        self.fast = self._fast(spec)

    @functools.cached_property
    def tokenizer(self):
        """Only made where a text needs it."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        return made

    def _fast(self, spec: dict):
        import tiktoken

        model, steps = spec["model"], (spec["normalizer"] or {}).get("normalizers", [])
        split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or model.get("end_of_word_suffix") != "</w>" or split.get("pattern") != {"Regex": self.KNOWN} or model.get("unk_token") or model.get("dropout"):
            return None
        as_byte = byte_of_letter()
        ranks = {}
        for token, i in model["vocab"].items():
            if token not in self.special:
                word = token.removesuffix("</w>")
                ranks[bytes(as_byte[c] for c in word) + (self.MARK.encode() if word != token else b"")] = i
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(bytes([b]) not in ranks for b in range(256)) or merged != sorted(merged):  # ranks must be in the order of merges
            return None
        return tiktoken.Encoding("words", pat_str=f"[^{self.MARK}]*{self.MARK}", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self.fast and self.PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                words = self.WORDS.findall(text.lower())
                out.append(self.fast.encode_to_numpy(self.MARK.join([*words, ""])).astype("<u4").tobytes() if words else b"")
            else:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
        return out


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids as bytes]) of each full window and each rest."""
    schema = T.StructType([*PIECES.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = once(f"words {tokenizer}", lambda: WordEncoder(tokenizer))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encode([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    ids += last
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        own = ids[4 * start : 4 * (start + window)]
                        out.append((doc, start, len(own) // 4, zlib.crc32(own), n, *([own] if with_ids else [])))
                if out:
                    kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    return two(docs, key, text).mapInArrow(frugal(cut), schema)


class OpenWindows:
    """Segment tree over remaining capacities: which of them some open window has."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.held = [False] * (2 * self.size)
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, capacity: int, on: bool) -> None:
        i = capacity + self.size
        self.held[i] = on
        while i > 1:
            i //= 2
            self.held[i] = self.held[2 * i] or self.held[2 * i + 1]

    def put(self, capacity: int, first: int, count: int) -> None:
        if capacity > 0 and count > 0:
            self.ranges.setdefault(capacity, []).append((first, count))
            self._mark(capacity, True)

    def take(self, capacity: int) -> tuple[int, int]:
        found = self.ranges[capacity].pop()
        if not self.ranges[capacity]:
            self._mark(capacity, False)
        return found

    def tightest(self, least: int) -> int | None:
        """The smallest capacity, at least so large, that an open window has."""
        i = least + self.size
        while not self.held[i]:
            while i & 1:  # a right child: up to where there is a right neighbour
                i //= 2
            if i == 0:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.held[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """STEPS rows for so many pieces of each length.

    Step: the pieces of a length with ranks from first_rank up to end_rank go, in
    turns of width, one to each of width windows from first_sequence on; the first
    turn stands at first_offset, each later one a length further.
    """
    tree, steps, sequences = OpenWindows(window), [], 0
    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while rank < count:
            capacity = tree.tightest(length)
            if capacity is None:
                opened = -(-(count - rank) // (window // length))
                tree.put(window, sequences, opened)
                sequences += opened
                continue
            first, windows = tree.take(capacity)
            each = capacity // length
            width = min(windows, (count - rank) // each)
            if width == 0:
                width, each = 1, count - rank
            steps.append((length, rank, rank + width * each, width, first, window - capacity))
            rank += width * each
            tree.put(capacity, first + width, windows - width)
            tree.put(capacity - each * length, first, width)
    return steps


def pack(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces with sequence_id and offset. `found` is read twice, so it should be a written table."""
    spark = found.sparkSession
    totals = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `window` rows at most
    steps = spark.createDataFrame(plan(totals, window), STEPS)
    buckets = max(16, sum(totals.values()) // 200_000)
    dealt = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    cells = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = cells.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.coalesce("_before", F.lit(0)))
    s = F.broadcast(steps.withColumnRenamed("length", "_length"))  # a few rows for each length
    placed = ranked.join(s, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("end_rank")))
    turn = F.col("_rank") - F.col("first_rank")
    return placed.select(*found.columns, (F.col("first_sequence") + turn % F.col("width")).cast("long").alias("sequence_id"), (F.col("first_offset") + F.floor(turn / F.col("width")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """All pieces of all documents, each with its sequence and its place there; encoded once, into a table in the shared folder."""
    return pack(written_table(pieces(docs, tokenizer, key, text, window, end, with_ids)), window)
