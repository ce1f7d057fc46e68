"""Intermediate tables: where they go, and when they are removed."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from factloom.llm import common


def test_a_cluster_without_a_shared_folder_is_refused():
    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_settled_keeps_the_result_only(spark):
    before = common.written()
    first = common.materialize(spark.range(5), "first")
    out = common.settled(first.where("id > 2"), "result", before)
    assert common.written() - before == {out._written_path}
    assert out.count() == 2
    with pytest.raises(Exception, match="PATH|exist|File"):
        spark.read.parquet(first._written_path).count()
    common.release(spark, out._written_path)
    assert common.written() == before


def test_texts_inside_a_struct_are_read_as_bytes(spark):
    df = spark.createDataFrame([("é", 1), (None, 2)], "text string, n int").select(F.struct("text", "n").alias("doc"))
    batch = df.coalesce(1).toArrow().combine_chunks().to_batches()[0]
    assert common.field_bytes(batch, "text") == ["é".encode(), None]
    assert common.field_bytes(batch.slice(1), "text") == [None]
