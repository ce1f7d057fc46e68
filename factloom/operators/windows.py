"""Window-like operators: rolling values, masks, ranks, arg-extrema and keys of truth.

Tie rules differ by family and are kept apart: member ranks put the smallest member first, key
extrema take the largest key for a maximum and the smallest for a minimum, and exact-k masks prefer
larger keys on top and smaller ones at the bottom.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by_entity():
    return Window.partitionBy("entity").orderBy("period")


def _rolling(df: DataFrame, value: Column) -> DataFrame:
    """Keep periods that have an earlier available one; the previous available period counts, not the calendar's."""
    rows = df.withColumn("previous", F.lag("value").over(_by_entity()))
    return rows.where("previous IS NOT NULL").select("entity", "period", value.alias("value"))


def rolling_average(df: DataFrame, window: int = 2) -> DataFrame:
    if window != 2:
        raise ValueError("only windows of two periods are reviewed")
    return _rolling(df, (F.col("value") + F.col("previous")) / 2)


def rolling_growth(df: DataFrame, percent: bool = False) -> DataFrame:
    return _rolling(df, F.try_divide(F.col("value") - F.col("previous"), F.abs("previous")) * (100 if percent else 1))


def rolling_change(df: DataFrame) -> DataFrame:
    return _rolling(df, F.col("value") - F.col("previous"))


def drop_first_by_entity(df: DataFrame) -> DataFrame:
    rows = df.withColumn("at", F.row_number().over(_by_entity()))
    return rows.where("at > 1").drop("at")


def _k_keys(df: DataFrame, keys: list[str], k: int, top: bool) -> DataFrame:
    order = [F.desc(c) if top else F.asc(c) for c in ("value", *keys)]
    return df.where("value IS NOT NULL").orderBy(*order).limit(k).select(*keys, F.lit(True).alias("chosen"))


def k_mask(df: DataFrame, k: int, top: bool = True, keys: tuple[str, ...] = ("entity", "period")) -> DataFrame:
    """True for exactly ``k`` keys; fewer keys than ``k`` fail the job.  A top-k runs as ordered take, not as a global window."""
    keys = list(keys)
    chosen = _k_keys(df, keys, k, top)
    size = chosen.agg(F.count("*").alias("n")).select(F.when(F.col("n") == k, True).otherwise(F.raise_error(F.lit("k exceeds the series")).cast("boolean")).alias("enough"))
    chosen = chosen.withColumn("one", F.lit(True)).join(F.broadcast(size), F.col("one") == F.col("enough")).drop("one", "enough")
    return df.join(F.broadcast(chosen), keys, "left").select(*keys, "value", F.coalesce("chosen", F.lit(False)).alias("flag"))


#: Ranges of values that are ranked apart where all members get a place.
RANGES = 64


def rank_members(df: DataFrame, member: str, limit: int | None = None, descending: bool = True) -> DataFrame:
    """Members by value, ties by the smaller member; ``place`` counts from 1.

    With a limit the members are an ordered take.  Without one they are dealt by ranges of values, ranked
    within their range, and moved on by the number of members in the ranges before.
    """
    value = F.desc("value") if descending else F.asc("value")
    rows = df.where("value IS NOT NULL")
    if limit is not None:
        order = Window.orderBy(value, F.asc(member))
        return rows.orderBy(value, F.asc(member)).limit(limit).select(member, "value", F.row_number().over(order).alias("place"))
    cuts = rows.agg(F.percentile_approx("value", [n / RANGES for n in range(1, RANGES)]).alias("cuts"))
    own = F.size(F.filter("cuts", lambda c: c <= F.col("value")))
    dealt = rows.crossJoin(F.broadcast(cuts)).withColumn("_range", -own if descending else own)
    within = Window.partitionBy("_range").orderBy(value, F.asc(member))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n"))  # one row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    placed = dealt.withColumn("_at", F.row_number().over(within)).join(F.broadcast(bases), "_range")
    return placed.select(member, "value", (F.col("_at") + F.col("_base")).cast("int").alias("place"))


def argmax_key(df: DataFrame, key: str) -> DataFrame:
    """Key of the largest value, the largest key on ties."""
    rows = df.where("value IS NOT NULL")
    return rows.agg(F.max_by(key, F.struct("value", key)).alias("key"))


def argmin_key(df: DataFrame, key: str) -> DataFrame:
    """Key of the smallest value, the smallest key on ties."""
    rows = df.where("value IS NOT NULL")
    return rows.agg(F.min_by(key, F.struct("value", key)).alias("key"))


def argmax_period_flat(df: DataFrame) -> DataFrame:
    """The flat plan's rule: the earliest period on ties."""
    return df.where("value IS NOT NULL").agg(F.max_by("period", F.struct("value", -F.col("period"))).alias("key"))


def argmin_period_flat(df: DataFrame) -> DataFrame:
    """The flat plan's rule: the latest period on ties."""
    return df.where("value IS NOT NULL").agg(F.min_by("period", F.struct("value", -F.col("period"))).alias("key"))


def select_at_key(df: DataFrame, key: DataFrame, on: str) -> DataFrame:
    """Rows of a series at a key found elsewhere; the planner sees by size whether to broadcast it."""
    return df.join(key.select(F.col("key").alias(on)), on)


def select_at_arg(ranked: DataFrame, other: DataFrame, member: str, descending: bool = True) -> DataFrame:
    """Value of ``other`` at the member where ``ranked`` is extreme."""
    best = rank_members(ranked, member, 1, descending).select(member)
    return other.join(F.broadcast(best), member)


def rank_key_tie(df: DataFrame, member: str, descending: bool = True) -> DataFrame:
    """Whether the first place is shared (the gated rank abstains then)."""
    best = F.max("value") if descending else F.min("value")
    top = df.agg(best.alias("best"))
    return df.join(F.broadcast(top), F.col("value") == F.col("best")).agg((F.count("*") > 1).alias("tie"))


def shift_key(df: DataFrame, years: int) -> DataFrame:
    return df.withColumn("period", F.col("period") + years)


def key_to_number(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("period").cast("double"))


def first_true_key(df: DataFrame) -> DataFrame:
    return df.groupBy("entity").agg(F.min(F.when(F.col("flag"), F.col("period"))).alias("key"))


def last_true_key(df: DataFrame) -> DataFrame:
    return df.groupBy("entity").agg(F.max(F.when(F.col("flag"), F.col("period"))).alias("key"))


def share_of_place(df: DataFrame, by: list[str]) -> DataFrame:
    """Place of each row within a group, ties averaged."""
    order = Window.partitionBy(*by).orderBy(F.desc("value"))
    same = Window.partitionBy(*by, "value")
    return df.withColumn("place", F.rank().over(order) + (F.count("*").over(same) - 1) / 2)


def winner_and_margin(df: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """Best row per group, its margin to the second and whether that is a tie."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    rows = df.withColumns({"place": F.row_number().over(order), "second": F.lead(score).over(order)})
    return rows.where("place = 1").withColumns({"margin": F.col(score) - F.col("second"), "tie": F.coalesce(F.col(score) == F.col("second"), F.lit(False))}).drop("place")


#: Places whose running totals one task adds up.
PLACE_BLOCK = 4096


def round_robin(df: DataFrame, by: str, score: str, uid: str, quota: int) -> DataFrame:
    """Rows within each group's quota first, interleaved by their rank; then the rest, interleaved too.

    Both parts run by place, then score, so a row's slot is its rank among its place's rows, of which each
    group has one, after the rows of all places before; their totals are added up in blocks of places.
    """
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.asc(uid)))
    rows = df.withColumn("place", place)
    sizes = rows.groupBy("place").agg(F.count("*").alias("n")).withColumn("_block", F.floor(F.col("place") / PLACE_BLOCK))
    blocks = sizes.groupBy("_block").agg(F.sum("n").alias("total"))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("total").over(earlier().orderBy("_block")), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("n").over(earlier("_block").orderBy("place")), F.lit(0))
    bases = sizes.withColumn("_within", within).join(blocks, "_block").select("place", (F.col("_within") + F.col("_before")).alias("_base"))
    own = F.row_number().over(Window.partitionBy("place").orderBy(F.desc(score), F.asc(uid)))
    return rows.withColumn("_at", own).join(bases, "place").withColumn("slot", F.col("_at") + F.col("_base")).drop("_at", "_base")


def first_per_key_with_quota(df: DataFrame, key: list[str], group: list[str], score: str, uid: str, quota: int) -> DataFrame:
    """Best row per key, then at most ``quota`` per group."""
    once = df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), F.asc(uid)))).where("place = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), F.asc(uid)))).where(F.col("place") <= quota)
