"""Toxicity of texts whose spelling may be disguised, by a noisy channel.

Trigram counts of characters over all documents give a character language model.
Tokens that could be disguised (digits or signs for letters, single letters with
separators between them, letters drawn out) become lattices: each written character
has the letters it may stand for, or nothing, at a channel cost, and a Viterbi
search finds the likeliest reading under channel and model. A text is scored on its
words and on what its lattices read.

The classifier is fitted on a bounded sample of labelled rows (TRAIN_ROWS, by a hash
of the id): words and word beginnings whose document counts differ between labels by
more than chance allows among so many candidates get a log odds weight, and a
logistic curve maps a text's sum of weights to a probability. Labels only come from
rows that aren't held out (crc32 of the id as text, modulo 5, is not 0); label,
language, source and id are never inputs of a score.

Defined results: a null or empty text has no words and gets the score of a text
without evidence. A null id counts as held out. Repeated rows are scored row by row;
repeated labels of an id count as toxic if any of them is 1, null labels are no
labels. Without labelled rows of both kinds every score is the share of toxic rows,
or 0 if there are none. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._tables import frugal, once, texts_of, two
from kinfold.runtime import written_table

#: Labelled rows that the classifier is fitted on at most; features that it may have.
TRAIN_ROWS, FEATURES = 20_000, 20_000
#: Log odds that a feature needs at least: what is merely a little more common among toxic rows, as words of a group of copies are, is no evidence.
LEAST_ODDS = 4.5
#: Symbols of the character model: 0 anything but letters, 1 to 26 a to z, 27 other letters.
SYMBOLS = 28
#: What a written sign may stand for, fixed values.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t"}
WILD, GAPS = "aeiou", " .-_*"
#: Log costs: a sign read as a letter, a mask as nothing, a sign as nothing, either as a gap; a separator as a gap, dropped; a drawn-out letter dropped. EMIT is added for each letter read, so that readings of different lengths compare.
AS_LETTER, AS_WILD, AS_NOTHING, AS_BREAK, AS_GAP, DROP_GAP, DROP_REPEAT, EMIT = -0.5, -3.0, -3.0, -5.0, -1.0, -0.3, -1.0, 2.2
INNER = re.compile(r"(?<=[a-z])[0134578@$!|+*._-]+(?=[a-z])|(?<![^\s\"'(])[@$0-9](?=[a-z]{2})")
SPACED = re.compile(r"(?<![^\s\"'(])[a-z0134578@$!|+](?:[ .\-_*]{1,2}[a-z0134578@$!|+](?![^\s.\-_*,;:?\"')])){2,}")
DRAWN = re.compile(r"([a-z])\1\1+")
WORD = re.compile(r"[^\W\d_]+")
TAIL = re.compile(r"(?:[.,;:!?%&#*\"')]|\${3,})+$")
EDGE = re.compile(r"[\s\"'(]")


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    out = np.where((codes >= 97) & (codes <= 122), codes - 96, 0).astype(np.int64)
    out[(codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7) & ~((codes >= 0x2000) & (codes < 0x2C00))] = 27
    return out


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> code, n: one row for each trigram of a partition."""
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        held: list[str] = []
        size = 0
        for i, text in enumerate(texts_of(batch.column(0)), 1):
            held.append(text)
            size += len(text)
            if size > 1 << 18 or i == batch.num_rows:
                s = symbols("  ".join(["", *held, ""]))
                if len(s) > 2:
                    total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
                held, size = [], 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])


def character_model(docs: DataFrame) -> list[float]:
    """Log probabilities of a symbol after two others, from the trigrams of every document (SYMBOLS ** 3 numbers)."""
    rows = docs.select("text").mapInArrow(frugal(_trigrams), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for r in rows:
        counts[r["code"]] = r["n"]
    cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two_before = (cube.sum(0) + 0.5) / (cube.sum(0) + 0.5).sum(1, keepdims=True)  # after one symbol
    weight = 5.0
    return np.log((cube + weight * two_before[None]) / (cube.sum(2, keepdims=True) + weight)).ravel().tolist()


class Reader:
    """Finds what may be disguised in a text and reads it."""

    def __init__(self, model: list[float]):
        self.model = model
        self.read: dict[str, str] = {}

    @staticmethod
    def _options(c: str, before: str) -> list[tuple[str, float]]:
        if c in LEET:
            return [*((x, AS_LETTER) for x in LEET[c]), (" ", AS_BREAK), *([("", AS_NOTHING)] if c in "!|+" else [])]
        if c == "*":
            return [("", AS_WILD), (" ", AS_BREAK), *((x, AS_LETTER) for x in WILD)]
        if c in GAPS:
            return [("", DROP_GAP), (" ", AS_GAP)]
        if c.isalpha():
            return [(c, 0.0), ("", DROP_REPEAT)] if c == before else [(c, 0.0)]
        return [(" ", 0.0)]

    def decode(self, span: str) -> str:
        """The likeliest reading of a written span. Runs of over three equal characters read as three."""
        span = re.sub(r"(.)\1{3,}", r"\1\1\1", span)
        if span in self.read:
            return self.read[span]
        model = self.model
        beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        for c in span:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for out, cost in self._options(c, before):
                s = 0 if out == " " else (ord(out) - 96 if "a" <= out <= "z" else 27) if out else -1
                for (a, b), (score, way) in beam.items():
                    if s < 0:
                        state, value, link = (a, b), score + cost, way
                    else:
                        state, value, link = (b, s), score + cost + (EMIT if s else 0.0) + model[a * SYMBOLS**2 + b * SYMBOLS + s], (way, out)
                    if state not in after or value > after[state][0]:
                        after[state] = (value, link)
            beam, before = after, c
        way = max(((score + model[a * SYMBOLS**2 + b * SYMBOLS], str((a, b)), way) for (a, b), (score, way) in beam.items()), key=lambda x: x[:2])[2]
        letters = []
        while way:
            way, c = way
            letters.append(c)
        if len(self.read) > 50_000:
            self.read = {}
        self.read[span] = found = "".join(reversed(letters))
        return found

    def readings(self, text: str) -> list[str]:
        """What the suspicious spans of a lower-cased text read as: whole tokens, and runs of single letters."""
        found, done = [], 0
        for pattern in (INNER, DRAWN):
            done = 0
            for m in pattern.finditer(text):
                if m.start() < done:
                    continue
                start, end = m.start(), m.end()
                while start > done and not EDGE.match(text[start - 1]):
                    start -= 1
                while end < len(text) and not text[end].isspace():
                    end += 1
                done = end
                found.append(self.decode(TAIL.sub("", text[start:end])))
        found += [self.decode(m[0]) for m in SPACED.finditer(text)]
        return found

    def features(self, text: str) -> set[str]:
        """Words of the text and of its readings, and their beginnings of four and five letters."""
        text = text.lower()
        words = set(WORD.findall(text))
        for reading in self.readings(text):
            words.update(WORD.findall(reading))
        return words | {w[:5] + "-" for w in words if len(w) > 5} | {w[:4] + "-" for w in words if len(w) > 4}


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps with a little ridge."""
    w = np.array([0.5, -2.0])
    z = np.c_[x, np.ones(len(x))]
    ridge = np.diag([1e-2, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, model: list[float], label: str = "toxic", train_rows: int = TRAIN_ROWS) -> tuple[dict[str, float], float, float]:
    """(weights, slope, offset) from columns doc_id, text and doc_id, <label>; at most train_rows labelled documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col(label).cast("int").alias("y")).filter("l_id is not null and y is not null").filter(F.crc32(F.col("l_id").cast("string")) % 5 != 0)
    known = known.groupBy("l_id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("l_id"), "l_id").limit(train_rows)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([sorted(reader.features(x or "")) for x in part.column(2).to_pylist()], pa.list_(pa.string()))], names=["l_id", "y", "features"])

    seen = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).select("l_id", "y", "text").mapInArrow(frugal(featured), "l_id long, y int, features array<string>")
    seen = written_table(seen.withColumn("row", F.monotonically_increasing_id()))
    n = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {}, 0.0, math.log((n1 + 1e-9) / (n0 + 1e-9)) if n1 + n0 else -30.0
    counts = seen.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b")).filter("a + b >= 3")
    candidates = counts.count()
    # likelihood ratio of one rate for both labels against two rates; the bound is what the best of so many candidates reaches by chance
    part = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    a, b = F.col("a"), F.col("b")
    share = (a + b) / (n1 + n0)
    rest = part(F.lit(n1) - a, (1 - share) * n1) + part(F.lit(n0) - b, (1 - share) * n0)
    odds = F.log((a + 0.5) / (n1 + 1.0)) - F.log((b + 0.5) / (n0 + 1.0))
    bound = 2 * math.log(max(2, candidates)) + 2
    chosen = counts.withColumn("g", 2 * (part(a, share * n1) + part(b, share * n0) + rest)).withColumn("w", odds).filter((F.col("g") > bound) & (F.col("w") > LEAST_ODDS)).orderBy(F.desc("g"), "f").limit(FEATURES).select("f", "w")
    weights = {r["f"]: r["w"] for r in chosen.collect()}
    table = F.broadcast(chosen.withColumnRenamed("f", "_f"))  # FEATURES rows at most
    sums = seen.select("row", "y", F.explode_outer("features").alias("f")).join(table, F.col("f") == F.col("_f"), "left").groupBy("row", "y").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("x")).select("x", "y").collect()  # train_rows rows at most
    # evidence of unlike strength ends in the same place: only its logarithm goes into the curve
    slope, offset = _curve(np.log1p([r["x"] for r in sums]), np.array([r["y"] for r in sums], float))
    return weights, slope, offset


def scorer(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Callable[[pa.Array], np.ndarray]:
    """A function from an Arrow column of texts to scores: character model from all rows of docs, classifier from their labels."""
    read = two(docs, key, text)
    model = character_model(read)
    weights, slope, offset = fit(read, labels, model, label, train_rows)

    def scored(texts: pa.Array) -> np.ndarray:
        reader = once("reader", lambda: Reader(model))
        if reader.model != model:  # of another corpus
            reader.__init__(model)
        sums = np.array([sum(weights[f] for f in sorted(reader.features(x) & weights.keys())) for x in texts_of(texts)], float)
        return 1 / (1 + np.exp(-np.clip(slope * np.log1p(sums) + offset, -50, 50)))

    return scored


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = scorer(docs, labels, key, text, label, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scored(batch.column(1)))], names=["doc_id", "score"])

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return two(docs, key, text).mapInArrow(frugal(run), "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted toxic."""
    scored, at = scorer(docs, labels, key, text, label, train_rows), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scored(batch.column(at)) < 0.5))

    return docs.mapInArrow(frugal(run), docs.schema)
