"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over WIDTH bytes cuts each text where the hash has CUT zero bits, so
equal passages are cut alike wherever they stand. Chunks that several places share
are counted over all documents; the DICTIONARY of them that save most is encoded
once and sent to all workers, and a worker remembers further chunks that it meets.
Chunks are encoded alone, so the tokens at their ends may be wrong. A join is
repaired: the bytes from the last sure boundary of one chunk to the first of the
next are encoded again, and further chunks are taken in until both sides agree, that
is, have a token boundary at the sure place. Before a blank that stands between two
letters the splitting pattern always ends a piece, whatever else the text holds, so
what lies between two such places is encoded alike alone and in the whole text:
results are exactly those of the tokenizer on the whole text.

The merge is tiktoken's, with ranks read from the tokenizer's file. A text that
holds a special token's string goes to the tokenizer itself.

Defined results: a null text is empty and has no ids. Repeated rows and null ids are
encoded row by row. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._tables import byte_of_letter, frugal, once, two

WIDTH, CUT, LEAST, MOST = 16, 10, 256, 4096
#: Chunks in the dictionary at most (of MOST bytes at most); chunks a worker remembers besides.
DICTIONARY, REMEMBERED = 4096, 10_000
#: The splitting pattern of byte-level vocabularies, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_TABLE = np.random.default_rng(16).integers(0, 2**32, 256, dtype=np.uint32)
_ODD = 0x9E3779B1
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text, the last at its end. Every chunk is whole code points."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    codes = np.frombuffer(data, np.uint8)
    h, odd, width = _TABLE[codes], _ODD, 1
    while width < WIDTH:
        h = h[:-width] * np.uint32(odd) + h[width:]
        odd, width = odd * odd % 2**32, 2 * width
    found, last = [], 0
    for p in (*(np.flatnonzero((h >> np.uint32(32 - CUT)) == 0) + WIDTH).tolist(), n):
        while p - last > MOST:
            last = _whole(codes, last + MOST)
            found.append(last)
        if p == n or p - last >= LEAST:
            p = _whole(codes, p)
            if p > last:
                found.append(p)
                last = p
    return found


def _whole(codes: np.ndarray, p: int) -> int:
    while p < len(codes) and codes[p] & 0xC0 == 0x80:
        p += 1
    return p


def sure(data: bytes) -> tuple[int, int] | None:
    """The first and the last place at which a piece is sure to begin: a blank between two ASCII letters."""
    codes = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(codes[1:-1] == 32) + 1 if len(data) > 2 else codes[:0]
    at = at[_LETTER[codes[at - 1]] & _LETTER[codes[at + 1]]] if len(at) else at
    return (int(at[0]), int(at[-1])) if len(at) else None


class ByteEncoder:
    """Ids of texts by a byte-level BPE file, and texts of ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path = path
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = [s.encode() for s in special]
        as_byte = byte_of_letter()
        ranks = {bytes(as_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        merged = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or merged != sorted(merged):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        self.merge = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        for s, i in special.items():
            self.bytes_of[i] = s.encode()
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.remembered: dict[bytes, tuple] = {}

    @functools.cached_property
    def tokenizer(self):
        """Only made where a text needs it."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        return made

    def alone(self, data: bytes) -> np.ndarray:
        return self.merge.encode_to_numpy(data.decode())

    def chunk(self, data: bytes, dictionary: dict[bytes, np.ndarray]) -> tuple:
        """(first sure place, last one, ids between them, all ids) of a chunk; without sure places on which its ids agree, None four times."""
        if data in self.remembered:
            return self.remembered[data]
        places = sure(data)
        found = (None,) * 4
        if places:
            ids = dictionary.get(data)
            ids = self.alone(data) if ids is None else ids
            ends = np.cumsum(self.sizes[ids])
            a, b = np.searchsorted(ends, places)
            if ends[a] == places[0] and ends[b] == places[1]:
                found = (*places, ids[a + 1 : b + 1], ids)
        if len(self.remembered) >= REMEMBERED:
            self.remembered = {}
        self.remembered[data] = found
        return found

    def encode(self, data: bytes, dictionary: dict[bytes, np.ndarray]) -> np.ndarray:
        if any(s in data for s in self.special):
            return np.array(self.tokenizer.encode(data.decode(), add_special_tokens=False).ids, np.uint32)
        ends = cuts(data)
        if len(ends) < 2:
            ids = dictionary.get(data)
            return self.alone(data) if ids is None else ids
        parts, open_from, start = [], 0, 0  # what lies before open_from is done and agreed upon
        for end in ends:
            first, last, inner, _ = self.chunk(data[start:end], dictionary)
            if first is not None:
                parts += [self.alone(data[open_from : start + first]), inner]
                open_from = start + last
            start = end
        return np.concatenate([*parts, self.alone(data[open_from:])])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, k, text -> chunk, doc_id, k, start, size for each chunk; chunk is a hash."""
    import xxhash

    for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
        out: list[tuple] = []
        for doc, k, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            data, start = (text or "").encode(), 0
            for end in cuts(data):
                h = xxhash.xxh64_intdigest(data[start:end])
                out.append((h - (h >> 63 << 64), doc, k, start, end - start))
                start = end
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 3 + (pa.int32(),) * 2, strict=True)], names=["chunk", "doc_id", "k", "start", "size"])


def shared_chunks(docs: DataFrame, tokenizer: str, most: int = DICTIONARY) -> dict[bytes, np.ndarray]:
    """The chunks of doc_id, k, text that occur in several places and save most, each encoded once; at most so many, however large the input."""
    places = docs.mapInArrow(frugal(_chunks), "chunk long, doc_id long, k long, start int, size int")
    counted = places.groupBy("chunk", "size").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "k", "start")).alias("at")).filter("n > 1")
    chosen = counted.orderBy(F.desc(F.expr("(n - 1) * size")), "chunk").limit(most).select(F.col("at.doc_id").alias("a_id"), F.col("at.k").alias("a_k"), F.struct(F.col("at.start").alias("start"), "size").alias("place"))
    asked = chosen.groupBy("a_id", "a_k").agg(F.collect_list("place").alias("places"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(f"bytes {tokenizer}", lambda: ByteEncoder(tokenizer))
        for batch in batches:
            found = {}
            for text, places in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = text.encode()
                for p in places:
                    piece = data[p["start"] : p["start"] + p["size"]]
                    if not any(s in piece for s in encoder.special):
                        found[piece] = encoder.alone(piece).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["piece", "ids"])

    rows = docs.join(F.broadcast(asked), F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("k") == F.col("a_k"))).select("text", "places").mapInArrow(frugal(encoded), "piece binary, ids binary").collect()
    return {bytes(r["piece"]): np.frombuffer(bytes(r["ids"]), "<u4") for r in rows}


def encode_and_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (the text of these ids) for every row."""
    read = two(docs, key, text).select("doc_id", F.xxhash64("text").alias("k"), "text")
    dictionary = shared_chunks(read, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(f"bytes {tokenizer}", lambda: ByteEncoder(tokenizer))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [encoder.encode((x or "").encode(), dictionary) for x in part.column(1).to_pylist()]
                flat = np.concatenate(ids) if ids else np.zeros(0)
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array([encoder.decode(x.tolist()) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return read.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, ids array<int>, decoded string")
