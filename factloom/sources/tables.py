"""The driver tables and the canonical ``facts`` view over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY, COUNT = "money", "count"

#: metric -> (dimension, scale of the stored number, currency, exact aggregate over one order's lines)
METRICS = {
    "revenue": (MONEY, 0, "USD", "sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4)))"),
    "gross": (MONEY, 0, "USD", "sum(cast(l_extendedprice as decimal(18,4)))"),
    "returned": (MONEY, 0, "USD", "sum(case when l_returnflag = 'R' then cast(l_extendedprice as decimal(18,4)) else 0 end)"),
    "margin": (MONEY, 0, "USD", "sum(cast(l_extendedprice * (0.05 - l_discount) as decimal(18,4)))"),
    "quantity": (COUNT, 0, None, "sum(cast(l_quantity as decimal(18,4)))"),
    "orders": (COUNT, 0, None, "count(distinct l_orderkey)"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_facts(spark: SparkSession, sf_dir: str, metrics: list[str], entity: str = "nation") -> DataFrame:
    """``entity, period`` and one decimal column per metric; entity is a nation or a market segment.

    Lines are added up per order first, so the join to orders meets one row an order on the key they are
    already partitioned by.
    """
    lines = table(spark, sf_dir, "lineitem")
    own = lambda m: "max(1)" if m == "orders" else METRICS[m][3]  # noqa: E731  # an order counts as one
    per_order = lines.groupBy("l_orderkey").agg(*[F.expr(own(m)).alias(m) for m in metrics])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("period"))
    customers = table(spark, sf_dir, "customer")
    if entity == "nation":
        nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("entity"))
        customers = customers.join(nations, customers.c_nationkey == nations.n_nationkey).select("c_custkey", "entity")
    else:
        customers = customers.select("c_custkey", F.col("c_mktsegment").alias("entity"))
    joined = per_order.join(orders, per_order.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    return joined.groupBy("entity", "period").agg(*[F.sum(m).alias(m) for m in metrics])


#: Rows of facts that one task may hold.
HELD_ROWS = 200_000


def held(facts: DataFrame) -> DataFrame:
    """Facts that are computed once for several uses; few enough of them, by count, stay in one partition and need no more exchanges."""
    kept = facts.persist()
    return kept.coalesce(1) if kept.count() <= HELD_ROWS else kept


def facts(spark: SparkSession, sf_dir: str, metrics: list[str], entity: str = "nation") -> DataFrame:
    """The long form: ``entity, period, metric_id, value, dimension, scale, currency``."""
    wide = wide_facts(spark, sf_dir, metrics, entity)
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric_id"),
                F.col(m).cast("double").alias("value"),
                F.lit(METRICS[m][0]).alias("dimension"),
                F.lit(METRICS[m][1]).alias("scale"),
                F.lit(METRICS[m][2]).cast("string").alias("currency"),
            )
            for m in metrics
        ]
    )
    return wide.select("entity", "period", F.inline(rows))


def series(spark: SparkSession, sf_dir: str, metric: str, entity: str = "nation") -> DataFrame:
    """One metric as ``entity, period, value, dimension, scale, currency``; only its columns are read."""
    return _as_series(wide_facts(spark, sf_dir, [metric], entity), metric)


def several(spark: SparkSession, sf_dir: str, *metrics: str, entity: str = "nation") -> list[DataFrame]:
    """Several metrics as series of one scan, whose result is held."""
    wide = held(wide_facts(spark, sf_dir, sorted(set(metrics)), entity))
    return [_as_series(wide, m) for m in metrics]


def _as_series(wide: DataFrame, metric: str) -> DataFrame:
    dimension, scale, currency, _ = METRICS[metric]
    return wide.select(
        "entity",
        "period",
        F.col(metric).cast("double").alias("value"),
        F.lit(dimension).alias("dimension"),
        F.lit(scale).alias("scale"),
        F.lit(currency).cast("string").alias("currency"),
    )


def wide_sql(entity: str = "nation") -> str:
    """The same wide view ``w`` as a list of common table expressions for oracles."""
    key = "n.n_name" if entity == "nation" else "c.c_mktsegment"
    exact = {m: v[3].replace("l_", "l.l_") for m, v in METRICS.items()}
    columns = ", ".join(f"cast({e} as double) as {m}" for m, e in exact.items())
    return (
        f"w as (select {key} as entity, cast(year(o.o_orderdate) as integer) as period, {columns} "
        "from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey "
        "join nation n on c.c_nationkey = n.n_nationkey group by 1, 2)"
    )
