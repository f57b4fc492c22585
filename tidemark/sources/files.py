"""Files in and out: JSON lines, JSON documents, CSV, partitioned Parquet, and paths that carry columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from tidemark.functions.text import let


def scratch(spark: SparkSession, name: str) -> str:
    """An unused path in the folder of ``spark.checkpoint.dir``; a local session without one has a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read back: evaluated once, and kept when executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value``: every line of text files with its number in its file, from 1; blank lines count.

    Files are read in splits. A first pass counts the lines of each split; the sums of those before a split, a row for
    each split, are joined to its lines, which are never shuffled or sorted.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select("value", *split, F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = stash(counts.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift")), "splits")
    return lines.join(starts, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def read_jsonl_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a line that is no object is an error with its file, number and text.

    Lines are checked before parsing, as a reader would take an array of objects for several rows.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wanted = StructType([*fields.fields, StructField("_broken", StringType())])
    lines = read_lines(spark, path).where(F.trim("value") != "")
    fault = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" is not a JSON object of the schema: "), F.col("file"), F.lit(": "), F.substring("value", 1, 200))
    parsed = F.when(F.trim("value").rlike(r"(?s)^\{.*\}$"), F.from_json("value", wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    checked = let(parsed, lambda r: F.when(r.isNotNull() & r["_broken"].isNull(), r).otherwise(F.raise_error(fault).cast(wanted)))
    return lines.select(checked.alias("r")).select(*[F.col("r")[f.name].alias(f.name) for f in fields])


def read_jsonl_lax(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and the text of the lines that do not."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    text = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parsed = lines.select("value", F.from_json("value", f"{text}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good = parsed.where("r is not null and r._corrupt_record is null").select("r.*").drop("_corrupt_record")
    return good, parsed.where("r is null or r._corrupt_record is not null").select("value")


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """By suffix: JSON lines, or one document (an array gives rows, an object one row)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=not path.rstrip("/").endswith(".jsonl"))


def read_tagged(spark: SparkSession, pattern: str, schema: StructType | str, columns: Mapping[str, str]) -> DataFrame:
    """JSON lines of all files that match a pattern, with columns taken from their paths by regular expressions."""
    rows = spark.read.schema(schema).json(pattern)
    return rows.select("*", *[F.regexp_extract(F.col("_metadata.file_path"), p, 1).alias(c) for c, p in columns.items()])


def ascii_json(text: Column) -> Column:
    """JSON text with every character beyond ASCII as escapes of its UTF-16 units."""
    runs = F.regexp_extract_all(text, F.lit(r"([\x00-\x7F]+|[^\x00-\x7F]+)"), F.lit(1))
    return F.when(
        text.rlike(r"[^\x00-\x7F]"),
        F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^[\x00-\x7F]"), x).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-16BE"))), "(.{4})", r"\\u$1"))), ""),
    ).otherwise(text)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in ASCII, nulls kept; an existing table at the path is replaced."""
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    df.select(ascii_json(line).alias("value")).write.mode("overwrite").text(path)


#: A summary of more rows is written as several files.
SUMMARY_ROWS = 1_000_000


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header: one file for a small summary, several, each with the header, beyond ``SUMMARY_ROWS``."""
    held = stash(df, "summary")
    small = held.count() <= SUMMARY_ROWS
    (held.coalesce(1) if small else held).write.mode("overwrite").csv(path, header=True)


def write_report(tables: Mapping[str, DataFrame], path: str) -> None:
    """Small summaries, each as one CSV file with a header in a folder of its name."""
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}")


def write_shards(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Parquet partitioned by columns; a reader's filter on them skips the other folders."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_summary(row: DataFrame, path: str) -> None:
    """A table of one row as one indented JSON document."""
    row.select(F.to_json(F.struct(*row.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_object(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object as one row; a document that is no object is an error."""
    text = spark.read.text(path, wholetext=True)
    fault = F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 200))
    checked = text.select(F.when(F.col("value").rlike(r"(?s)^\s*\{.*\}\s*$"), F.col("value")).otherwise(F.raise_error(fault).cast("string")).alias("value"))
    return checked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_shards(spark: SparkSession, path: str, **parts: object) -> DataFrame:
    """Shards of the named parts only; the other folders are not opened."""
    rows = spark.read.parquet(path)
    for name, value in parts.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def write_by_name(df: DataFrame, path: str, name: str) -> None:
    """JSON lines in one folder for each value of a column."""
    df.write.mode("overwrite").partitionBy(name).option("ignoreNullFields", "false").json(path)


def relabel(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], schema: StructType | str, aside: str | None = None) -> str:
    """JSON lines with ``change`` applied, written beside them (``aside``) or in their place; where they are now.

    A path is never written while it is read: the new rows are complete before the old ones give way.
    """
    made = aside or f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    write_jsonl(change(spark.read.schema(schema).json(path)), made)
    if aside:
        return aside
    sc = spark.sparkContext
    old, new = (sc._jvm.org.apache.hadoop.fs.Path(x) for x in (path, made))
    fs = old.getFileSystem(sc._jsc.hadoopConfiguration())
    kept = sc._jvm.org.apache.hadoop.fs.Path(f"{made}-old")
    if not (fs.rename(old, kept) and fs.rename(new, old)):
        raise OSError(f"{path} could not be replaced; the new rows are in {made}, the old ones in {path} or {made}-old")
    fs.delete(kept, True)
    return path


def file_counts(df: DataFrame) -> DataFrame:
    """Rows by input file."""
    return df.groupBy(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
