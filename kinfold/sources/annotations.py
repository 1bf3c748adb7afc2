"""Annotation files: COCO documents, YOLO label files, lists of split members, records of data repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COCO = "struct<images: array<struct<id: bigint, file_name: string, width: int, height: int>>, annotations: array<struct<id: bigint, image_id: bigint, category_id: bigint>>, categories: array<struct<id: bigint, name: string>>>"
IMAGE_NAME = r"([^\s,;]+\.(?:jpe?g|png|bmp|tiff?|webp))"


def _documents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.from_json(F.decode("content", "UTF-8"), COCO, {"mode": "PERMISSIVE"}).alias("d"))


def read_coco(spark: SparkSession, path: str, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(one row for each document, one for each image): sizes, categories, and each image's annotations counted and named."""
    docs = _documents(spark, path, pattern)
    summary = docs.select("path", F.coalesce(F.size("d.images"), F.lit(0)).alias("n_images"), F.coalesce(F.size("d.annotations"), F.lit(0)).alias("n_annotations"), F.array_join(F.array_sort(F.transform("d.categories", lambda c: c["name"])), "|").alias("category_names"), F.col("d.images").isNotNull().alias("is_coco"))
    images = docs.select("path", F.explode("d.images").alias("i")).select("path", F.col("i.id").alias("image_id"), "i.file_name", F.col("i.width").alias("declared_width"), F.col("i.height").alias("declared_height"))
    names = docs.select("path", F.explode("d.categories").alias("c")).select("path", F.col("c.id").alias("category_id"), F.col("c.name").alias("category_name"))
    marks = docs.select("path", F.explode("d.annotations").alias("a")).select("path", "a.image_id", "a.category_id").join(names, ["path", "category_id"], "left")
    counted = marks.groupBy("path", "image_id").agg(F.count("*").alias("annotation_count"), F.array_sort(F.collect_set("category_id")).alias("category_ids"), F.array_sort(F.collect_set("category_name")).alias("category_names"))
    out = images.join(counted, ["path", "image_id"], "left").withColumn("annotation_count", F.coalesce("annotation_count", F.lit(0)))
    return summary, out.withColumn("basename", F.lower(F.regexp_extract("file_name", r"([^/\\]*)$", 1)))


def read_yolo(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """path, n_objects, class_ids of each label file; blank lines are no objects, a file without objects has an empty set."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"))
    first = F.when(F.col("line").rlike(r"^\d+(\s+[-+.eE\d]+){4,}$"), F.element_at(F.split("line", r"\s+"), 1).cast("int"))
    return lines.withColumn("c", first).groupBy("path").agg(F.count("c").alias("n_objects"), F.array_sort(F.collect_set("c")).alias("class_ids"), F.count_if((F.col("line") != "") & F.col("c").isNull()).alias("n_other_lines"))


def read_split_lists(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(file_name, splits, n_splits): names that lists of split members hold, the split being the list's name; comments are skipped."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path).select(F.lower(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1)).alias("split"), F.trim("value").alias("line"))
    name = F.lower(F.regexp_extract(F.regexp_extract(F.col("line"), f"(?i){IMAGE_NAME}", 1), r"([^/\\]*)$", 1))
    found = lines.filter(~F.col("line").startswith("#")).select("split", name.alias("file_name")).filter("file_name <> ''")
    return found.groupBy("file_name").agg(F.array_join(F.array_sort(F.collect_set("split")), "|").alias("splits"), F.countDistinct("split").alias("n_splits"))


def spellings(name: Column) -> Column:
    """The names under which a label file's image may be listed."""
    base = F.regexp_replace(F.lower(name), r"\.[^.]+$", "")
    return F.array_distinct(F.array(F.concat(base, F.lit(".jpg")), F.concat(base, F.lit(".jpeg")), F.concat(base, F.lit(".png")), base))


def checksum(c: Column) -> Column:
    """md5:abc, MD5=abc or abc as algorithm:abc; the algorithm by length where it isn't named."""
    value = F.lower(F.regexp_extract(c, r"([0-9A-Fa-f]{32,128})\s*$", 1))
    named = F.lower(F.regexp_extract(c, r"^\s*([A-Za-z0-9-]+)\s*[:=]", 1))
    guess = F.when(F.length(value) == 32, "md5").when(F.length(value) == 40, "sha1").when(F.length(value) == 64, "sha256").when(F.length(value) == 128, "sha512")
    return F.when(value != "", F.concat_ws(":", F.coalesce(F.when(named != "", named), guess), value))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, file_name, bytes, checksum, url) from saved JSON answers of data repositories, in either of two forms:
    files with name, size, computed_md5, download_url; or files with key, size, checksum, links.self."""
    kind = "struct<id: string, files: array<struct<name: string, key: string, size: bigint, computed_md5: string, checksum: string, download_url: string, links: struct<self: string>>>>"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.from_json(F.decode("content", "UTF-8"), kind).alias("d"))
    f = files.select(F.col("d.id").alias("record"), F.explode("d.files").alias("f"))
    return f.select("record", F.coalesce("f.name", "f.key").alias("file_name"), F.col("f.size").alias("bytes"), checksum(F.coalesce(F.concat(F.lit("md5:"), "f.computed_md5"), "f.checksum")).alias("checksum"), F.coalesce("f.download_url", "f.links.self").alias("url"))
