"""Aggregates over series: dimension-checked, exact, partially aggregated by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {"sum": F.sum, "average": F.avg, "minimum": F.min, "maximum": F.max, "median": F.median, "count": F.count}


def aggregate(df: DataFrame, function: str, by: list[str] | None = None) -> DataFrame:
    """One aggregate of ``value`` per group; mixed dimensions and empty inputs abstain."""
    value = FUNCTIONS[function]("value").cast("double").alias("value")
    out = df.groupBy(*(by or [])).agg(
        value, F.count("value").alias("n"), F.min("dimension").alias("low"), F.max("dimension").alias("high")
    )
    reason = F.when(F.col("n") == 0, "AGGREGATE_EMPTY").when(F.col("low") != F.col("high"), "MIXED_DIMENSIONS")
    dimension = F.lit("count") if function == "count" else F.col("low")
    return out.select(
        *(by or []),
        F.when(reason.isNull(), F.col("value")).alias("value"),
        dimension.alias("dimension"),
        F.when(reason.isNull(), "OK").otherwise("ABSTAIN").alias("status"),
        reason.alias("reason"),
    )


def aggregate_all(df: DataFrame, functions: dict[str, str], by: list[str]) -> DataFrame:
    """Several aggregates of ``value`` per group in one pass, each under its own name; mixed dimensions give nulls."""
    found = [FUNCTIONS[f]("value").cast("double").alias(name) for name, f in functions.items()]
    out = df.groupBy(*by).agg(*found, (F.min("dimension") == F.max("dimension")).alias("_one"))
    return out.select(*by, *[F.when(F.col("_one"), F.col(name)).alias(name) for name in functions])


def ends_by_entity(df: DataFrame) -> DataFrame:
    """``entity, first, last``: the values of the first and the last period in one pass."""
    return _ends(df).select("entity", "first", "last")


def sum_by_scope(df: DataFrame, axis: str) -> DataFrame:
    """Sum over components to ``entity``, ``period`` or ``entity_period``."""
    keys = ["entity", "period"] if axis == "entity_period" else [axis]
    return df.groupBy(*keys).agg(F.sum("value").alias("value"), F.first("dimension").alias("dimension"))


def average_by_entity(df: DataFrame) -> DataFrame:
    return df.groupBy("entity").agg(F.avg("value").alias("value"))


def sum_by_entity(df: DataFrame) -> DataFrame:
    return sum_by_scope(df, "entity").select("entity", "value")


def _at(value: str, chooser) -> Column:
    """Value at the first or last period that has one; a null value never wins."""
    return chooser(value, F.when(F.col(value).isNotNull(), F.col("period")))


def earliest_by_entity(df: DataFrame) -> DataFrame:
    return df.groupBy("entity").agg(_at("value", F.min_by).alias("value"))


def latest_by_entity(df: DataFrame) -> DataFrame:
    return df.groupBy("entity").agg(_at("value", F.max_by).alias("value"))


def _ends(df: DataFrame) -> DataFrame:
    known = F.when(F.col("value").isNotNull(), F.col("period"))
    return df.groupBy("entity").agg(
        F.min_by("value", known).alias("first"),
        F.max_by("value", known).alias("last"),
        F.min(known).alias("first_period"),
        F.max(known).alias("last_period"),
    )


def _judged(df: DataFrame, value: Column, reason: Column) -> DataFrame:
    return df.select(
        "entity",
        F.when(reason.isNull(), value).alias("value"),
        F.when(reason.isNull(), "OK").otherwise("ABSTAIN").alias("status"),
        reason.alias("reason"),
    )


def change_by_entity(df: DataFrame) -> DataFrame:
    """Last minus first; a single period abstains."""
    ends = _ends(df)
    short = F.when(F.col("first_period") == F.col("last_period"), "TOO_FEW_PERIODS")
    return _judged(ends, F.col("last") - F.col("first"), short)


def growth_by_entity(df: DataFrame) -> DataFrame:
    """Per cent from first to last over the absolute first value."""
    ends = _ends(df)
    reason = F.when(F.col("first_period") == F.col("last_period"), "TOO_FEW_PERIODS").when(F.col("first") == 0, "ZERO_DENOMINATOR")
    return _judged(ends, F.try_divide(F.col("last") - F.col("first"), F.abs("first")) * 100, reason)


def cagr_by_entity(df: DataFrame) -> DataFrame:
    """Compound annual growth in per cent; the interval is the difference of years, not the number of rows."""
    ends = _ends(df)
    years = F.col("last_period") - F.col("first_period")
    reason = (
        F.when(years == 0, "TOO_FEW_PERIODS")
        .when(F.col("first") == 0, "ZERO_DENOMINATOR")
        .when(F.signum("first") != F.signum("last"), "SIGN_CHANGE")
    )
    rate = F.pow(F.try_divide(F.col("last"), F.col("first")), F.try_divide(F.lit(1.0), years)) - 1
    return _judged(ends, rate * 100, reason)


def all_by_entity(df: DataFrame) -> DataFrame:
    return df.groupBy("entity").agg(F.bool_and("flag").alias("flag"))


def any_by_entity(df: DataFrame) -> DataFrame:
    return df.groupBy("entity").agg(F.bool_or("flag").alias("flag"))


def count_true(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("flag").alias("n"))


def average_complete(df: DataFrame, expected: int, absolute: bool = False) -> DataFrame:
    """Average over entities per period, abstaining unless every expected entity has exactly one value."""
    value = F.abs("value") if absolute else F.col("value")
    out = df.groupBy("period").agg(F.avg(value).alias("value"), F.count("value").alias("n"), F.count_distinct("entity").alias("entities"))
    reason = F.when((F.col("entities") != expected) | (F.col("n") != expected), "INCOMPLETE")
    return out.select(
        "period", F.when(reason.isNull(), F.col("value")).alias("value"), F.when(reason.isNull(), "OK").otherwise("ABSTAIN").alias("status")
    )


def entity_difference(df: DataFrame, first: str, second: str, absolute: bool = False) -> DataFrame:
    """``first - second`` per period, both of them needed."""
    pick = lambda name: F.max(F.when(F.col("entity") == name, F.col("value")))
    out = df.where(F.col("entity").isin(first, second)).groupBy("period").agg(pick(first).alias("a"), pick(second).alias("b"))
    value = F.abs(F.col("a") - F.col("b")) if absolute else F.col("a") - F.col("b")
    return out.select("period", value.alias("value")).where("value IS NOT NULL")


def group_concat(df: DataFrame, by: list[str], column: str, order: str, separator: str = " | ") -> DataFrame:
    """Values of a group joined in the order of another column."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(column).cast("string").alias("text"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(rows, lambda x: x.text), separator).alias("joined"))


def group_concat_distinct(df: DataFrame, by: list[str], column: str, separator: str = ",") -> DataFrame:
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), separator).alias("joined"))


def reason_histogram(df: DataFrame, by: list[str], reasons: str) -> DataFrame:
    """Counts of each reason per group as sorted ``reason=n`` text."""
    counted = df.select(*by, F.explode(reasons).alias("reason")).groupBy(*by, "reason").count()
    rows = F.array_sort(F.collect_list(F.struct("reason", "count")))
    return counted.groupBy(*by).agg(F.array_join(F.transform(rows, lambda x: F.concat(x["reason"], F.lit("="), x["count"].cast("string"))), ",").alias("histogram"))


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and an order-insensitive hash of a table."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(row).alias("row_hash"), F.sum(F.pmod(row, F.lit(1_000_003))).alias("row_sum"))


def upper_middle(values: Column) -> Column:
    """The upper middle of a sorted array: element n // 2 from 0."""
    return F.element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)
