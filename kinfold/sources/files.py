"""Inventories of files and archives, from Spark's binaryFile source: no path is opened on an executor's own."""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of archive formats, as hex; fixed values.
MAGIC = (("zip", "504b0304", 0), ("zip", "504b0506", 0), ("gzip", "1f8b", 0), ("bzip2", "425a68", 0), ("xz", "fd377a585a00", 0), ("7z", "377abcaf271c", 0), ("rar", "526172211a07", 0), ("tar", "7573746172", 257))
#: Kinds of members by extension; fixed values.
KINDS = {"image": "jpg jpeg png bmp tif tiff webp gif heic".split(), "annotation": "json xml csv tsv txt yaml yml".split(), "archive": "zip tar gz tgz bz2 xz 7z rar".split(), "document": "md pdf doc docx html".split()}


def list_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, relative_path, file_name, extension, bytes, modified of all files under a folder."""
    from kinfold.functions.exprs import extension, file_name

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)
    base = folder.rstrip("/").rpartition(":")[2].lstrip("/")
    relative = F.regexp_replace(F.substring_index("path", f"{base}/", -1), "^/+", "")
    return found.select("path", relative.alias("relative_path"), file_name("path").alias("file_name"), extension("path").alias("extension"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def hash_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, bytes, sha256."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def archive_kind(content: Column) -> Column:
    """The archive format that the first bytes say; null for others."""
    out = F
    for kind, magic, at in MAGIC:
        out = out.when(F.lower(F.hex(F.substring(content, at + 1, len(magic) // 2))) == magic, kind)
    return out.otherwise(None)


def member_class(path: Column) -> tuple[Column, Column, Column, Column]:
    """(extension, kind, first part of the path, first two parts) of an archive member."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kind = F
    for name, extensions in KINDS.items():
        kind = kind.when(ext.isin(*extensions), name)
    parts = F.split(path, "/")
    return ext, kind.otherwise("other"), F.element_at(parts, 1), F.array_join(F.slice(parts, 1, 2), "/")


def safe_member(path: Column) -> Column:
    """Whether a member's path stays below the folder it is unpacked to."""
    clean = F.regexp_replace(path, r"\\", "/")
    return ~(clean.startswith("/") | clean.rlike(r"^[A-Za-z]:") | clean.rlike(r"(^|/)\.\.(/|$)") | (clean == ""))


def _members(content: bytes) -> Iterator[tuple[str, int, bool, bool, bytes | None]]:
    """name, size, is a link, is encrypted, bytes of each regular file of a zip or tar archive."""
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    link = (i.external_attr >> 16) & 0o170000 == 0o120000
                    yield i.filename, i.file_size, link, bool(i.flag_bits & 1), None if link or i.flag_bits & 1 else z.read(i)
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in t:
                if m.isfile() or m.issym() or m.islnk():
                    yield m.name, m.size, not m.isfile(), False, t.extractfile(m).read() if m.isfile() else None
    except tarfile.TarError:
        return


def archive_members(archives: DataFrame, with_bytes: bool = False) -> DataFrame:
    """path, member, bytes, is_link, encrypted[, content] of zip and tar archives (rows of binaryFile); archives of other kinds have no rows.

    One archive is one task's, as it is one row; its members come out in batches.
    """
    kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()] + [pa.binary()] * with_bytes
    names = ["path", "member", "bytes", "is_link", "encrypted"] + ["content"] * with_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                size = 0
                for name, n, link, locked, data in _members(content):
                    held.append((path, name, n, link, locked, *([data] if with_bytes else [])))
                    size += n if with_bytes else 0
                    if len(held) == 5000 or size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return archives.select("path", "content").mapInArrow(run, "path string, member string, bytes long, is_link boolean, encrypted boolean" + ", content binary" * with_bytes)


def extract_members(archives: DataFrame) -> DataFrame:
    """path, member, bytes, content of what may be unpacked: no links, no paths that leave the folder, nothing encrypted."""
    found = archive_members(archives, with_bytes=True)
    return found.filter(safe_member(F.col("member")) & ~F.col("is_link") & ~F.col("encrypted")).select("path", F.regexp_replace(F.regexp_replace("member", r"\\", "/"), r"^(\./)+", "").alias("member"), "bytes", "content")


def archive_summary(members: DataFrame) -> DataFrame:
    """Counts and bytes of each archive by kind, extension and first part of the path."""
    ext, kind, first, _ = member_class(F.col("member"))
    return members.groupBy("path", kind.alias("kind"), ext.alias("extension"), first.alias("prefix")).agg(F.count("*").alias("n_members"), F.sum("bytes").alias("bytes"))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): missing, extra, size or hash unlike the manifest's (columns path, bytes, sha256 in both)."""
    m = manifest.select("path", F.col("bytes").cast("long").alias("_b"), F.col("sha256").alias("_s"))
    joined = m.join(files.select("path", "bytes", "sha256"), "path", "full_outer")
    problems = F.array_compact(F.array(F.when(F.col("sha256").isNull(), "missing"), F.when(F.col("_s").isNull(), "extra"), F.when(F.col("bytes") != F.col("_b"), "size"), F.when(F.col("sha256") != F.col("_s"), "hash")))
    return joined.select("path", F.explode(problems).alias("problem"))


# images

EXIF_TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "modified", 0x9003: "taken"}


def exif(content: bytes) -> dict[str, str]:
    """A few EXIF fields of a JPEG; empty if there are none or they are broken."""
    try:
        at = 2
        while content[at : at + 1] == b"\xff" and content[at + 1] != 0xDA:
            size = struct.unpack(">H", content[at + 2 : at + 4])[0]
            if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                return _tags(content[at + 10 : at + 2 + size])
            at += 2 + size
    except (IndexError, struct.error, UnicodeDecodeError):
        pass
    return {}


def _tags(data: bytes) -> dict[str, str]:
    end = {b"II": "<", b"MM": ">"}[data[:2]]
    found: dict[str, str] = {}
    todo = [struct.unpack(f"{end}I", data[4:8])[0]]
    while todo:
        at = todo.pop()
        for i in range(struct.unpack(f"{end}H", data[at : at + 2])[0]):
            tag, kind, count, raw = struct.unpack(f"{end}HHI4s", data[at + 2 + 12 * i : at + 14 + 12 * i])
            if tag == 0x8769:
                todo.append(struct.unpack(f"{end}I", raw)[0])
            elif tag in EXIF_TAGS and kind == 3:
                found[EXIF_TAGS[tag]] = str(struct.unpack(f"{end}H", raw[:2])[0])
            elif tag in EXIF_TAGS and kind == 2:
                start = struct.unpack(f"{end}I", raw)[0]
                found[EXIF_TAGS[tag]] = (data[start : start + count] if count > 4 else raw[:count]).rstrip(b"\0").decode("ascii", "replace").strip()
    return found


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """origin, width, height, n_channels, pixel_sha256 (of size, mode and RGB bytes) and read_ok of the images that the JVM decodes."""
    raw = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        for batch in batches:
            out = []
            for origin, height, width, channels, data in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                ok = bool(data) and height > 0 and width > 0
                digest = None
                if ok:
                    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                    rgb = np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]
                    digest = hashlib.sha256(f"{width}x{height}|RGB|".encode() + rgb.tobytes()).hexdigest()
                out.append((origin, width, height, channels, digest, ok))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()), strict=True)], names=["origin", "width", "height", "n_channels", "pixel_sha256", "read_ok"])

    return raw.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "origin string, width int, height int, n_channels int, pixel_sha256 string, read_ok boolean")
