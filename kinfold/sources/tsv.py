"""Tab-separated tables with all-string columns: an empty field is an empty string, never a null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tsv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, name: str | None = None) -> DataFrame:
    """A TSV file, folder or list of files, gzip included. columns: their names in order, else the header's.

    name: only files whose names match this pattern. The reader gives null for an empty field; it becomes the empty string again.
    """
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("enforceSchema", False)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    if name:
        reader = reader.option("pathGlobFilter", name)
    return reader.csv(path if isinstance(path, str) else list(path)).na.fill("")


def read_shards(spark: SparkSession, folder: str, prefix: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All shards PREFIX_task_*.tsv of a folder but the status tables."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}_task_*.tsv").load(folder).select("path")  # names only
    found = sorted(r["path"] for r in files.filter(~F.col("path").endswith("_status.tsv")).collect())
    if not found:
        raise ValueError(f"no tables {prefix}_task_*.tsv in {folder}")
    return read_tsv(spark, found, columns)


def read_indexed(spark: SparkSession, index: DataFrame, column: str, expected: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The tables whose paths a status table lists; an error if some path is listed twice or their number isn't the expected one."""
    paths = [r[0] for r in index.select(column).collect()]
    if len(set(paths)) != len(paths) or expected is not None and len(paths) != expected:
        raise ValueError(f"{len(paths)} listed tables, {len(set(paths))} different, {expected} expected")
    return read_tsv(spark, sorted(paths), columns)


def as_strings(df: DataFrame) -> DataFrame:
    """Every column as text: nulls empty, booleans YES or NO, arrays joined by |."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("array"):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
        elif kind == "boolean":
            c = F.when(c, "YES").when(~c, "NO")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return df.select(*out)


def write_tsv(df: DataFrame, path: str, compression: str | None = None, mode: str = "errorifexists") -> None:
    """With a header, empty fields for nulls, by Hadoop's committer: a half-written table is never seen."""
    writer = as_strings(df).write.mode(mode).option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", '"').option("escape", '"')
    (writer.option("compression", compression) if compression else writer).csv(path)


def provenance(spark: SparkSession, inputs: Sequence[str], parameters: dict[str, object]) -> DataFrame:
    """(kind, item, value): a SHA-256 of every input file and every parameter of a run."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(inputs)).select(F.lit("input").alias("kind"), F.col("path").alias("item"), F.sha2("content", 256).alias("value"))
    return files.unionByName(spark.createDataFrame([("parameter", k, str(v)) for k, v in sorted(parameters.items())], "kind string, item string, value string"))


def summary_markdown(title: str, table: DataFrame, limit: int = 200) -> str:
    """A small result table as Markdown; a report, so it is cut at `limit` rows and says so."""
    rows = as_strings(table).limit(limit + 1).collect()
    head = [f"# {title}", "", "| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
    return "\n".join([*head, *("| " + " | ".join(r) + " |" for r in rows[:limit]), *(["", f"Cut at {limit} rows."] if len(rows) > limit else [])]) + "\n"
