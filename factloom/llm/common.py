"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one Arrow batch that are held as Python objects at a time.
SLICE_ROWS = 256

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Maps A-Z to a-z and every ASCII byte that is not a digit or letter to a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def ascii_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes."""
    return text.translate(WORD_BYTES).split()


def blank_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes after lower-casing A-Z."""
    return text.lower().split()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII text takes the byte-wise fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master, which has no other machines, gets a temporary one where the session names none.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Folders of the tables that ``materialize`` wrote and ``release`` has not removed.
_WRITTEN: dict[str, None] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN[path] = None
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def written() -> set[str]:
    """The folders that intermediate tables take up now."""
    return set(_WRITTEN)


def release(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate tables; only those that no result still to be computed reads."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _WRITTEN.pop(path, None)


def settled(df: DataFrame, name: str, before: set[str]) -> DataFrame:
    """``materialize``, then remove all that was written since ``before`` was taken but the result."""
    out = materialize(df, name)
    release(df.sparkSession, *(written() - before - {out._written_path}))
    return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that few rows at a time become Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def field_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column of the struct that is the batch's first column, as bytes."""
    return batch.column(0).field(name).cast(pa.binary()).to_pylist()


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """Apply ``fn`` to slices of a few rows, one Arrow batch in and one out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, rows):
            yield fn(part)

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, body)`` of a table; every other column is left behind, so names cannot clash."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))


def extended(df: DataFrame, columns: list[str], ddl: str) -> StructType:
    """Schema of some columns of ``df`` followed by the fields of ``ddl``; any column name is allowed."""
    return StructType([df.schema[c] for c in columns] + StructType.fromDDL(ddl).fields)
