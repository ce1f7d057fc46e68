"""Joins that the engine needs beyond Catalyst's own: as-of lookups, differentials, constrained bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(df: DataFrame, by: list[str], order: list[str], condition: Column, value: Column, name: str) -> DataFrame:
    """Value of the last earlier row that meets a condition (strictly before the row), one sort and no self-join."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(condition, value), ignorenulls=True).over(before))


def previous_row(df: DataFrame, by: list[str], index: str, value: str, name: str) -> DataFrame:
    """Value of the row whose index is one less; null where indices have a gap."""
    order = Window.partitionBy(*by).orderBy(index)
    dense = F.lag(index).over(order) == F.col(index) - 1
    return df.withColumn(name, F.when(dense, F.lag(value).over(order)))


def interval_join(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points inside spans ``[start, end)``: both sides meet in buckets of ``width``, so the join stays an equi-join."""
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    own = points.withColumn("cell", F.floor(F.col(at) / width))
    joined = own.join(cells, [by, "cell"])
    return joined.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("cell")


def orphans(child: DataFrame, parent: DataFrame, child_key: list[str], parent_key: list[str]) -> DataFrame:
    """Child rows without their parent; a null key is no reference."""
    keys = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_key, child_key, strict=True)])
    return child.dropna(subset=child_key).join(keys, child_key, "left_anti")


def differential(old: DataFrame, new: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """``key, change``: added, removed, changed or same between two builds."""
    side = lambda df, name: df.select(F.col(key), F.xxhash64(*compared).alias(f"{name}_hash"))
    joined = side(old, "old").join(side(new, "new"), key, "full")
    change = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
        .otherwise("same")
    )
    return joined.select(key, change.alias("change"))


def discriminative(df: DataFrame, scope: list[str], path: str, row: str) -> DataFrame:
    """Rows whose trimmed path no other row of the scope has: one window instead of a correlated search."""
    trimmed = Window.partitionBy(*scope, F.trim(path))
    distinct = (F.min(row).over(trimmed) == F.max(row).over(trimmed)) & (F.trim(path) != "")
    return df.withColumn("discriminative", F.coalesce(distinct, F.lit(False)))


def overlay(base: DataFrame, extra: DataFrame, key: str, limit: int) -> DataFrame:
    """Base lists in order, extra entries appended if absent until ``limit``; longer base lists stay whole."""
    joined = base.select(key, F.col("entries").alias("base")).join(extra.select(key, F.col("entries").alias("extra")), key, "full")
    matched = F.when(F.col("base").isNull() | F.col("extra").isNull(), F.raise_error(F.concat(F.lit("unmatched key "), F.col(key).cast("string"))).cast("array<string>"))
    merged = F.slice(F.array_union("base", "extra"), 1, F.greatest(F.size("base"), F.lit(limit)))
    return joined.select(key, F.coalesce(matched, merged).alias("entries"))


def best_binding(candidates: DataFrame, scope: list[str], role: str, roles: list[str], uid: str, score: str) -> DataFrame:
    """Best complete binding of roles within one scope: distinct observations, largest total score.

    Constraints such as "same document" are the scope's keys, so the search is a chain of equi-joins; a
    tie for the best total is reported, and the smaller observations win.
    """
    side = lambda r, n: candidates.where(F.col(role) == r).select(
        *scope, F.col(uid).alias(f"uid_{n}"), F.col(score).alias(f"score_{n}")
    )
    joined = side(roles[0], 0)
    for n, name in enumerate(roles[1:], 1):
        joined = joined.join(side(name, n), scope)
        joined = joined.where(~F.col(f"uid_{n}").isin(*[F.col(f"uid_{k}") for k in range(n)]))
    total = sum((F.col(f"score_{n}") for n in range(1, len(roles))), F.col("score_0"))
    uids = [f"uid_{n}" for n in range(len(roles))]
    order = Window.partitionBy(*scope).orderBy(F.desc("total"), *[F.asc(u) for u in uids])
    rows = joined.withColumn("total", total).withColumns({"place": F.row_number().over(order), "second": F.lead("total").over(order)})
    tie = F.coalesce(F.col("second") == F.col("total"), F.lit(False))
    return rows.where("place = 1").select(*scope, *uids, "total", tie.alias("tie"))


def coherent_scope(candidates: DataFrame, scope: list[str], leaf: str, leaves: list[str], uid: str, score: str) -> DataFrame:
    """Scopes that have every leaf metric, each by its best cell, with the sum of scores."""
    order = Window.partitionBy(*scope, leaf).orderBy(F.desc(score), F.asc(uid))
    best = candidates.where(F.col(leaf).isin(leaves)).withColumn("place", F.row_number().over(order)).where("place = 1")
    grouped = best.groupBy(*scope).agg(F.count_distinct(leaf).alias("leaves"), F.count_distinct(uid).alias("cells"), F.sum(score).alias("total"))
    return grouped.where((F.col("leaves") == len(leaves)) & (F.col("cells") == len(leaves))).select(*scope, "total")
