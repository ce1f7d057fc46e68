"""Predicates over series: comparisons, logic with missing scopes, quantifiers and both filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARISONS = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
}


def compare(df: DataFrame, operator: str, threshold: float | Column) -> DataFrame:
    """``flag`` per scope."""
    return df.withColumn("flag", COMPARISONS[operator](F.col("value"), threshold if isinstance(threshold, Column) else F.lit(threshold)))


def compare_series(left: DataFrame, right: DataFrame, operator: str, on: list[str]) -> DataFrame:
    """Elementwise comparison over identical key sets; keys of one side only are reported as null flags."""
    other = right.select(*on, F.col("value").alias("other"))
    joined = left.select(*on, "value").join(other, on, "full")
    return joined.withColumn("flag", COMPARISONS[operator](F.col("value"), F.col("other"))).select(*on, "flag")


def is_zero(df: DataFrame) -> DataFrame:
    return compare(df, "eq", 0.0)


def is_nonzero(df: DataFrame) -> DataFrame:
    return compare(df, "ne", 0.0)


def exists(members: DataFrame, df: DataFrame, on: list[str]) -> DataFrame:
    return members.join(df.select(*on), on, "left_semi")


def not_exists(members: DataFrame, df: DataFrame, on: list[str]) -> DataFrame:
    """Absent scopes against the declared members; a plain interpreter could never find them."""
    return members.join(df.select(*on), on, "left_anti")


def logical(left: DataFrame, right: DataFrame, operator: str, on: list[str]) -> DataFrame:
    """AND or OR over the union of scopes; a missing scope is false."""
    a = left.select(*on, F.col("flag").alias("a"))
    b = right.select(*on, F.col("flag").alias("b"))
    joined = a.join(b, on, "full")
    x, y = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return joined.select(*on, (x & y if operator == "and" else x | y).alias("flag"))


def quantified(df: DataFrame, quantifier: str, axis: str) -> DataFrame:
    """ALL or ANY over an axis: one flag per key of the other."""
    other = "period" if axis == "entity" else "entity"
    return df.groupBy(other).agg((F.bool_and if quantifier == "all" else F.bool_or)("flag").alias("flag"))


def filter_scopes(df: DataFrame, decisions: DataFrame, axis: str | None = None) -> DataFrame:
    """Scopes with a true decision; with an axis, decisions of that axis stand in where the exact scope has none."""
    exact = decisions.select("entity", "period", F.col("flag").alias("exact"))
    if axis is None:
        return df.join(exact.where("exact"), ["entity", "period"], "left_semi")
    projected = decisions.groupBy(axis).agg(F.bool_or("flag").alias("projected"))
    joined = df.join(exact, ["entity", "period"], "left").join(projected, axis, "left")
    return joined.where(F.coalesce("exact", "projected", F.lit(False))).drop("exact", "projected")


def filter_keys(df: DataFrame, decisions: DataFrame, on: list[str]) -> DataFrame:
    """The strict filter: values whose key is decided true; an undecided key abstains."""
    joined = df.join(decisions.select(*on, "flag"), on, "left")
    reason = F.when(F.col("flag").isNull(), "PREDICATE_MISSING_KEY")
    out = joined.withColumns({"status": F.when(reason.isNull(), "OK").otherwise("ABSTAIN"), "reason": reason})
    return out.where(F.coalesce("flag", F.lit(True))).drop("flag")


def count_where(df: DataFrame, condition: Column, by: list[str]) -> DataFrame:
    """Number of scopes that meet a condition per group, with the group's size."""
    return df.groupBy(*by).agg(F.count_if(condition).alias("n"), F.count("*").alias("of"))
