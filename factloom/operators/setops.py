"""Set operations and the no-loss identities built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_relation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, relation``: only in a, only in b, or in both."""
    joined = a.select(key).distinct().withColumn("in_a", F.lit(True)).join(b.select(key).distinct().withColumn("in_b", F.lit(True)), key, "full")
    relation = F.when(F.col("in_b").isNull(), "a_only").when(F.col("in_a").isNull(), "b_only").otherwise("both")
    return joined.select(key, relation.alias("relation"))


def no_loss(universe: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """``check, n``: rows lost by, foreign to and shared between parts that should partition the universe.

    Sizes come from one pass over the tagged union, so no part is compared with every other.
    """
    tagged = [universe.select(key, F.lit("universe").alias("part"))] + [df.select(key, F.lit(name).alias("part")) for name, df in parts.items()]
    union = reduce(DataFrame.unionByName, tagged)
    per_key = union.groupBy(key).agg(F.count_if(F.col("part") == "universe").alias("u"), F.count_if(F.col("part") != "universe").alias("p"))
    counted = per_key.agg(
        F.count_if((F.col("u") > 0) & (F.col("p") == 0)).alias("lost"),
        F.count_if((F.col("u") == 0) & (F.col("p") > 0)).alias("foreign"),
        F.count_if(F.col("p") > 1).alias("shared"),
        F.sum("p").alias("parts_total"),
        F.sum("u").alias("universe_total"),
    )
    names = counted.columns
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).cast("bigint").alias("n")) for n in names])
    return counted.select(F.inline(rows))


def ordered_union(parts: list[DataFrame], by: list[str], key: str, limit: int | None = None) -> DataFrame:
    """Union in priority order, each key once per group at its first place, cut at ``limit``."""
    from pyspark.sql import Window

    tagged = [df.withColumn("priority", F.lit(n)) for n, df in enumerate(parts)]
    union = reduce(DataFrame.unionByName, tagged)
    first = union.groupBy(*by, key).agg(F.min(F.struct("priority", "place")).alias("at"))
    order = Window.partitionBy(*by).orderBy("at", key)
    rows = first.withColumn("place", F.row_number().over(order))
    return (rows if limit is None else rows.where(F.col("place") <= limit)).select(*by, key, "place")


def partition_of(df: DataFrame, flags: dict[str, str]) -> dict[str, DataFrame]:
    return {name: df.where(condition) for name, condition in flags.items()}
