"""What the operators share: table reading and plain text expressions."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.runtime import bounded_batches

#: ASCII white space that separates words.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as SQL writes it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def two(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the two columns that an operator reads, so that others can have any name."""
    return df.select(column(key).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))


def count_of(text: Column, piece: str) -> Column:
    """How often the piece, not overlapping itself, is in the text."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece))


def once(name: str, make: Callable[[], object]) -> object:
    """What make() returns, made once in a Python worker: functions travel by value, so a module's own variables don't outlast a task."""
    kept = sys.modules.setdefault("kinfold_kept", types.ModuleType("kinfold_kept")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def byte_of_letter() -> dict[str, int]:
    """The byte for which each letter of a byte-level vocabulary stands: printable Latin-1 for itself, the rest counted on from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def frugal(worker: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The worker function, fed in batches of bounded size and giving freed memory back to the system: workers are kept for later tasks, and their allocators would keep it too."""
    bounded_batches(SparkSession.getActiveSession())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        def fed() -> Iterator[pa.RecordBatch]:
            for i, batch in enumerate(batches):
                yield batch
                del batch
                if i % 8 == 7:
                    pa.default_memory_pool().release_unused()

        yield from worker(fed())
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # only some C libraries have it
            pass

    return run


def texts_of(column: pa.Array, step: int = 500) -> Iterator[str]:
    """The column's strings, nulls as empty ones, made a few at a time."""
    for at in range(0, len(column), step):
        for text in column.slice(at, step).to_pylist():
            yield text or ""
