"""Series algebra: aligned, unit-aware arithmetic over ``entity, period, value, dimension``.

A series holds one value per scope ``(entity, period)``; a scalar has null keys.  Nothing is dropped
silently: results carry ``status`` (``OK`` or ``ABSTAIN``) and ``reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("entity", "period")

DIMENSIONS = ("money", "percent", "percent_point", "ratio", "count", "shares", "period", "entity", "unknown")
OPERATIONS = ("add", "subtract", "multiply", "divide", "growth")


class AlignmentError(ValueError):
    """The key sets of two series do not fit the rule they are joined under."""


def ok(df: DataFrame) -> DataFrame:
    """Give a plain series its status columns."""
    missing = {}
    if "status" not in df.columns:
        missing["status"] = F.lit("OK")
    if "reason" not in df.columns:
        missing["reason"] = F.lit(None).cast("string")
    return df.withColumns(missing) if missing else df


def abstain(df: DataFrame, reason: Column) -> DataFrame:
    """Keep rows with a null reason; the others abstain and lose their value."""
    failed = reason.isNotNull()
    return df.withColumns(
        {
            "value": F.when(failed, None).otherwise(F.col("value")),
            "status": F.when(failed, "ABSTAIN").otherwise(F.col("status")),
            "reason": F.coalesce(F.col("reason"), reason),
        }
    )


def comparable(df: DataFrame) -> DataFrame:
    """Bring values to scale 0; money without a scale abstains as ``UNKNOWN_SCALE``."""
    unknown = (F.col("dimension") == "money") & F.col("scale").isNull()
    factor = F.pow(F.lit(10.0), F.coalesce(F.col("scale"), F.lit(0)))
    out = ok(df).withColumn("value", F.col("value") * factor)
    return abstain(out, F.when(unknown, "UNKNOWN_SCALE")).withColumn("scale", F.lit(0))


def convert(value: Column, source: str, target: str, source_scale: Column | int = 0, target_scale: Column | int = 0) -> Column:
    """Value in another unit: a power of ten between scales, a hundred between ratio and percent, else null."""
    scale = F.pow(F.lit(10.0), (F.lit(source_scale) if isinstance(source_scale, int) else source_scale) - (F.lit(target_scale) if isinstance(target_scale, int) else target_scale))
    if source == target:
        return value * scale
    if (source, target) == ("ratio", "percent"):
        return value * 100
    if (source, target) == ("percent", "ratio"):
        return value / 100
    return F.lit(None).cast("double")


def result_dimension(operation: str, left: Column, right: Column) -> Column:
    """Dimension of a result, null where the operation is not defined for these dimensions."""
    same = left == right
    if operation == "subtract":
        return F.when(same & (left == "percent"), "percent_point").when(same, left)
    if operation == "add":
        return F.when(same, left)
    if operation == "multiply":
        return F.when(left == "ratio", right).when(right == "ratio", left)
    if operation == "divide":
        return F.when(same, "ratio").when(right == "ratio", left).when(right == "count", left)
    return F.when(same, "ratio")  # growth


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    name = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("value", "dimension", "currency")]
    left = left if "currency" in left.columns else left.withColumn("currency", F.lit(None).cast("string"))
    right = right if "currency" in right.columns else right.withColumn("currency", F.lit(None).cast("string"))
    return left.select(*KEYS, *name("left")), right.select(*KEYS, *name("right"))


def align(left: DataFrame, right: DataFrame, how: str = "common") -> DataFrame:
    """Join two series: ``common`` keys, ``equal`` key sets (other scopes abstain), the shared ``entity`` or ``period``
    axis, or a one-row ``scalar`` on the right."""
    left, right = _sides(left, right)
    if how == "common":
        return ok(left.join(right, list(KEYS)))
    if how == "equal":
        joined = left.withColumn("in_left", F.lit(True)).join(right.withColumn("in_right", F.lit(True)), list(KEYS), "full")
        reason = F.when(F.col("in_left").isNull() | F.col("in_right").isNull(), "KEY_SETS_DIFFER")
        status = F.when(reason.isNull(), "OK").otherwise("ABSTAIN")
        return joined.withColumns({"reason": reason, "status": status}).drop("in_left", "in_right")
    if how in KEYS:
        return ok(left.join(right.drop(*[k for k in KEYS if k != how]), how))
    if how == "scalar":
        # One row by contract: the guard fails the job instead of multiplying rows.
        one = right.drop(*KEYS).agg(*[F.first(c).alias(c) for c in ("right_value", "right_dimension", "right_currency")], F.count("*").alias("n"))
        one = one.withColumn("right_value", F.when(F.col("n") == 1, F.col("right_value")).otherwise(F.raise_error(F.lit("not a scalar")).cast("double"))).drop("n")
        return ok(left.withColumn("one", F.lit(1)).join(F.broadcast(one.withColumn("one", F.lit(1))), "one").drop("one"))
    raise AlignmentError(how)


def arithmetic(left: DataFrame, right: DataFrame, operation: str, how: str = "common", percent: bool = False) -> DataFrame:
    """``left operation right`` per scope.  GROWTH takes the new value on the left and the old one on the right.

    With ``percent`` a growth is in per cent (times 100), else a ratio.
    """
    if operation not in OPERATIONS:
        raise ValueError(operation)
    joined = align(left, right, how)
    a, b = F.col("left_value"), F.col("right_value")
    dimension = result_dimension(operation, F.col("left_dimension"), F.col("right_dimension"))
    zero = F.lit(operation in ("divide", "growth")) & (b == 0)
    currencies = (F.col("left_currency") != F.col("right_currency")) & F.lit(operation != "multiply")
    value = {
        "add": a + b,
        "subtract": a - b,
        "multiply": a * b,
        "divide": F.try_divide(a, b),
        "growth": F.try_divide(a - b, F.abs(b)) * (100 if percent else 1),
    }[operation]
    out = joined.withColumns({"value": value, "dimension": F.when(F.lit(operation == "growth" and percent), "percent").otherwise(dimension)})
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(dimension.isNull(), "DIMENSION_MISMATCH")
        .when(currencies, "CURRENCY_MISMATCH")
        .when(zero, "ZERO_DENOMINATOR")
    )
    return abstain(out, reason).select(*KEYS, "value", "dimension", "status", "reason")


def at_period(df: DataFrame, period: Column | int) -> DataFrame:
    return df.where(F.col("period") == period)


def growth_between(df: DataFrame, new: int, old: int, percent: bool = False) -> DataFrame:
    """Growth of every entity from one period to another (the ratio convention, or per cent)."""
    new_side = at_period(df, new).withColumn("period", F.lit(None).cast("int"))
    old_side = at_period(df, old).withColumn("period", F.lit(None).cast("int"))
    return arithmetic(new_side, old_side, "growth", how="entity", percent=percent)


def growth_guarded(df: DataFrame, new: int, old: int) -> DataFrame:
    """The guarded convention: a zero or negative base abstains."""
    out = growth_between(df, new, old)
    base = at_period(df, old).select("entity", F.col("value").alias("base"))
    out = out.join(base, "entity")
    reason = F.when(F.col("base") == 0, "ZERO_BASE").when(F.col("base") < 0, "NEGATIVE_BASE")
    cleared = out.withColumn("reason", F.when(reason.isNotNull(), reason).otherwise(F.col("reason")))
    return abstain(cleared, reason).drop("base")


def negate(df: DataFrame) -> DataFrame:
    return df.withColumn("value", -F.col("value"))


def absolute(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.abs("value"))


def to_percent(df: DataFrame) -> DataFrame:
    return df.withColumns({"value": F.col("value") * 100, "dimension": F.lit("percent")})


def literal(df: DataFrame, value: float, dimension: str) -> DataFrame:
    """A constant over the scopes of a series."""
    return df.select(*KEYS, F.lit(float(value)).alias("value"), F.lit(dimension).alias("dimension"))


def scale_reconciled(value: Column, scale: Column, limit: float = 1e16) -> Column:
    """The declared scale, or null where it would carry the value beyond any real amount."""
    return F.when(F.abs(value) * F.pow(F.lit(10.0), scale) <= limit, scale)


def storage_ratio(raw: Column, value: Column) -> Column:
    """Raw over stored value, snapped to the nearest power of ten."""
    ratio = F.try_divide(F.abs(raw), F.abs(value))
    return F.when(ratio > 0, F.pow(F.lit(10.0), F.round(F.log10(ratio))))


def answers_match(a: Column, b: Column) -> Column:
    """Equal up to a relative tolerance of 1e-9 of the larger of 1 and the value."""
    return F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a))


def close_enough(a: Column, b: Column, tolerance: float = 0.005) -> Column:
    return F.when(b == 0, F.abs(a) <= tolerance).otherwise(F.abs(a - b) <= tolerance * F.abs(b))
