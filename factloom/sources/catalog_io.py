"""Manifests, snapshots, and the sinks of a release."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a local master alone may do without."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (path or "file://" + tempfile.mkdtemp(prefix="factloom-")).rstrip("/")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256, duplicate_of``: every file under a path; byte duplicates point to the first path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    first = rows.groupBy("sha256").agg(F.min("path").alias("first"))
    return rows.join(first, "sha256").select("path", "bytes", "sha256", F.when(F.col("path") != F.col("first"), F.col("first")).alias("duplicate_of"))


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    joined = old.select("path", F.col("sha256").alias("a")).join(new.select("path", F.col("sha256").alias("b")), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return joined.select("path", change.alias("change"))


def corpus_id(rows: DataFrame) -> DataFrame:
    """An order-insensitive id of a corpus: counts and sums of its file hashes, hashed."""
    part = lambda n: F.conv(F.substring("sha256", 1 + 8 * n, 8), 16, 10).cast("decimal(38,0)")
    sums = [F.sum(part(n)).cast("string") for n in range(8)]
    return rows.agg(F.substring(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *sums), 256), 1, 16).alias("corpus_id"))


def write_release(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, order: list[str] | None = None) -> None:
    """Write once, refuse to overwrite; rows are sorted within files, never globally."""
    rows = df.sortWithinPartitions(*order) if order else df
    writer = rows.write.mode("errorifexists")
    if by:
        writer = writer.partitionBy(*by)
    if kind == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif kind == "csv":
        writer.option("header", "true").option("compression", "gzip").csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        raise ValueError(kind)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def read_questions(spark: SparkSession, path: str, schema: str, key: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """JSON lines in the order of a key, from an offset on."""
    rows = spark.read.schema(schema).json(path).orderBy(key).offset(offset)
    return rows if limit is None else rows.limit(limit)


#: Most columns of a wide table, whose names the driver holds.
WIDE_COLUMNS = 2_000


def wide_table(df: DataFrame, row: str, column: str, value: str, order: str | None = None) -> DataFrame:
    """Wide layout of a long table: one column per header, repeated headers of a row numbered.

    Headers stand in the order of their first appearance by ``order``, or of their names without it.  A table
    with more than ``WIDE_COLUMNS`` of them is refused, as no header may be dropped.
    """
    named = df.withColumn("_n", F.row_number().over(Window.partitionBy(row, column).orderBy(order or value)))
    named = named.withColumn("_name", F.when(F.col("_n") == 1, F.col(column).cast("string")).otherwise(F.concat(F.col(column).cast("string"), F.lit("__"), F.col("_n").cast("string"))))
    first = named.groupBy("_name").agg((F.min(order) if order else F.lit(0)).alias("_first"))
    names = [r[0] for r in first.orderBy("_first", "_name").limit(WIDE_COLUMNS + 1).collect()]
    if len(names) > WIDE_COLUMNS:
        raise ValueError(f"{column} has more than {WIDE_COLUMNS} headers")
    return named.groupBy(row).pivot("_name", names).agg(F.first(value))


def contract_violations(df: DataFrame, contract: dict[str, str], least_rows: int = 0) -> list[str]:
    """Differences between a table's columns and types and its contract."""
    have = dict(df.dtypes)
    out = [f"missing column {c}" for c in contract if c not in have]
    out += [f"{c} is {have[c]}, not {t}" for c, t in contract.items() if c in have and have[c] != t]
    if least_rows and df.limit(least_rows).count() < least_rows:
        out.append(f"fewer than {least_rows} rows")
    return out


def with_columns_or_null(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Optional columns as they are, or null where the table has none."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns])
