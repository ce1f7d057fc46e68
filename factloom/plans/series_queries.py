"""Queries over the facts view: arithmetic, aggregates, windows, predicates; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import aggregates as ag
from factloom.operators import predicates as pr
from factloom.operators import series as se
from factloom.operators import windows as wi
from factloom.plans.registry import Registry
from factloom.sources import tables as tb

registry = Registry()
query = registry.query

W = "with " + tb.wide_sql()
M = "with " + tb.wide_sql("segment")
SPAN = "(select min(period) as y0, max(period) as y1 from w)"


def spanned(df: DataFrame) -> tuple[DataFrame, int, int]:
    """A series, held so that it is computed once, with its first and last period (two numbers)."""
    held = tb.held(df)
    return held, *held.agg(F.min("period"), F.max("period")).first()


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns or ("value",)})


@query(f"{W} select entity, period, round(revenue, 2) as value from w where entity = 'NATION_3' or period = (select max(period) from w)")
def scope_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tb.series(spark, sf_dir, "revenue")
    last = df.agg(F.max("period").alias("last"))
    hit = df.join(F.broadcast(last)).where((F.col("entity") == "NATION_3") | (F.col("period") == F.col("last")))
    return rounded(hit.select("entity", "period", "value"), digits=2)


@query(
    f"{W} select entity, period, round(revenue, 2) as value from w, {SPAN} "
    "where period between y0 + 1 and y0 + 2 + 1 and (entity is null or entity <> 'NATION_1')"
)
def scope_hard_filter(spark, sf_dir):
    df, low, _ = spanned(tb.series(spark, sf_dir, "revenue"))
    kept = df.where(F.col("period").between(low + 1, low + 2 + 1) & (F.col("entity").isNull() | (F.col("entity") != "NATION_1")))
    return rounded(kept.select("entity", "period", "value"), digits=2)


def _arithmetic(operation, left, right, sql, dimension, name):
    @query(f"{W} select entity, period, round({sql}, 6) as value, '{dimension}' as dimension, 'OK' as status from w", name=name)
    def run(spark, sf_dir):
        a, b = tb.several(spark, sf_dir, left, right)
        return rounded(se.arithmetic(a, b, operation).drop("reason"), digits=6)


_arithmetic("add", "revenue", "returned", "revenue + returned", "money", "arith_add")
_arithmetic("subtract", "gross", "revenue", "gross - revenue", "money", "arith_subtract")
_arithmetic("divide", "revenue", "gross", "revenue / gross", "ratio", "arith_divide")
_arithmetic("divide", "revenue", "orders", "revenue / orders", "money", "arith_divide_by_count")


@query(f"{W} select entity, period, round((revenue / gross) * returned, 4) as value, 'money' as dimension, 'OK' as status from w")
def arith_multiply(spark, sf_dir):
    share = se.arithmetic(*tb.several(spark, sf_dir, "revenue", "gross"), "divide")
    return rounded(se.arithmetic(share, tb.series(spark, sf_dir, "returned"), "multiply").drop("reason"))


@query(f"{W} select entity, period, cast(null as double) as value, 'ABSTAIN' as status, 'DIMENSION_MISMATCH' as reason from w")
def arith_dimension_mismatch(spark, sf_dir):
    out = se.arithmetic(*tb.several(spark, sf_dir, "revenue", "orders"), "add")
    return out.select("entity", "period", "value", "status", "reason")


GROWTH = f"{W}, p as (select entity, max(case when period = y0 then {{m}} end) as a, max(case when period = y1 then {{m}} end) as b from w, {SPAN} group by entity)"


@query(GROWTH.format(m="revenue") + " select entity, round((b - a) / abs(a), 6) as value, 'OK' as status from p where a is not null and b is not null")
def growth_ratio_v3(spark, sf_dir):
    df, old, new = spanned(tb.series(spark, sf_dir, "revenue"))
    return rounded(se.growth_between(df, new, old).select("entity", "value", "status"), digits=6)


@query(GROWTH.format(m="revenue") + " select entity, round((b - a) / abs(a) * 100, 6) as value, 'percent' as dimension from p where a is not null and b is not null")
def growth_percent_v5(spark, sf_dir):
    df, old, new = spanned(tb.series(spark, sf_dir, "revenue"))
    return rounded(se.growth_between(df, new, old, percent=True).select("entity", "value", "dimension"), digits=6)


@query(
    GROWTH.format(m="margin") + " select entity, case when a > 0 then round((b - a) / abs(a), 6) end as value, "
    "case when a > 0 then 'OK' else 'ABSTAIN' end as status, "
    "case when a = 0 then 'ZERO_BASE' when a < 0 then 'NEGATIVE_BASE' end as reason from p where a is not null and b is not null"
)
def growth_guarded_v2(spark, sf_dir):
    df, old, new = spanned(tb.series(spark, sf_dir, "margin"))
    return rounded(se.growth_guarded(df, new, old).select("entity", "value", "status", "reason"), digits=6)


@query(f"{W}, p as (select entity, max(case when period = y0 then revenue end) as a, max(case when period = y1 then revenue end) as b from w, {SPAN} group by entity) select entity, round(b - a, 2) as value from p where a is not null and b is not null")
def align_shared_axis(spark, sf_dir):
    df, old, new = spanned(tb.series(spark, sf_dir, "revenue"))
    return rounded(se.arithmetic(se.at_period(df, new), se.at_period(df, old), "subtract", how="entity").select("entity", "value"), digits=2)


@query(f"{W} select entity, period, round(revenue / (select sum(revenue) from w), 8) as value from w")
def align_scalar(spark, sf_dir):
    df = tb.series(spark, sf_dir, "revenue")
    total = df.agg(F.sum("value").alias("value"), F.first("dimension").alias("dimension")).selectExpr(
        "cast(null as string) entity", "cast(null as int) period", "value", "dimension"
    )
    return rounded(se.arithmetic(df, total, "divide", how="scalar").select("entity", "period", "value"), digits=8)


@query(
    f"{W}, a as (select * from w where period > (select min(period) from w)), b as (select * from w where entity <> 'NATION_2') "
    "select coalesce(a.entity, b.entity) as entity, coalesce(a.period, b.period) as period, "
    "round(case when a.entity is not null and b.entity is not null then a.revenue - b.returned end, 2) as value, "
    "case when a.entity is not null and b.entity is not null then 'OK' else 'ABSTAIN' end as status, "
    "case when a.entity is null or b.entity is null then 'KEY_SETS_DIFFER' end as reason "
    "from a full join b on a.entity = b.entity and a.period = b.period"
)
def align_equal_keys(spark, sf_dir):
    df, low, _ = spanned(tb.series(spark, sf_dir, "revenue"))
    left, right = df.where(F.col("period") > low), tb.series(spark, sf_dir, "returned").where("entity <> 'NATION_2'")
    return rounded(se.arithmetic(left, right, "subtract", how="equal").drop("dimension"), digits=2)


@query(
    f"{W}, s as (select entity, period, revenue / case mod(period, 3) when 0 then 1 when 1 then 1000 else 1000000 end as value, "
    "case mod(period, 3) when 0 then 0 when 1 then 3 else 6 end as scale from w) "
    "select entity, period, round(value * power(10, scale), 2) as value, 'OK' as status from s"
)
def unit_convert_scale(spark, sf_dir):
    scale = F.element_at(F.array(F.lit(0), F.lit(3), F.lit(6)), F.col("period") % 3 + 1)
    df = tb.series(spark, sf_dir, "revenue").withColumn("scale", scale)
    df = df.withColumn("value", F.col("value") / F.pow(F.lit(10.0), "scale"))
    return rounded(se.comparable(df).select("entity", "period", "value", "status"), digits=2)


@query(f"{W} select entity, period, round(revenue / gross * 100, 6) as as_percent, round(revenue / 1000, 4) as in_thousands from w")
def unit_convert_kind(spark, sf_dir):
    df = tb.wide_facts(spark, sf_dir, ["revenue", "gross"])
    df = df.select("entity", "period", F.col("revenue").cast("double").alias("revenue"), F.col("gross").cast("double").alias("gross"))
    return df.select(
        "entity", "period", F.round(se.convert(F.col("revenue") / F.col("gross"), "ratio", "percent"), 6).alias("as_percent"),
        F.round(se.convert(F.col("revenue"), "money", "money", 0, 3), 4).alias("in_thousands"),
    )


@query(
    f"{W} select period, round(sum(revenue), 2) as v_sum, round(avg(revenue), 4) as v_avg, round(min(revenue), 2) as v_min, "
    "round(max(revenue), 2) as v_max, round(median(revenue), 4) as v_median, count(revenue) as v_count from w group by period"
)
def agg_by_period(spark, sf_dir):
    names = {"v_sum": "sum", "v_avg": "average", "v_min": "minimum", "v_max": "maximum", "v_median": "median", "v_count": "count"}
    out = ag.aggregate_all(tb.series(spark, sf_dir, "revenue"), names, ["period"])
    digits = {"v_sum": 2, "v_avg": 4, "v_min": 2, "v_max": 2, "v_median": 4}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()}).withColumn("v_count", F.col("v_count").cast("bigint"))


@query(f"{W} select entity, round(avg(revenue), 4) as value from w group by entity")
def avg_by_entity(spark, sf_dir):
    return rounded(ag.average_by_entity(tb.series(spark, sf_dir, "revenue")))


@query(f"{W} select entity, round(sum(quantity), 2) as value from w group by entity")
def sum_by_entity(spark, sf_dir):
    return rounded(ag.sum_by_entity(tb.series(spark, sf_dir, "quantity")), digits=2)


@query(f"{M} select period, round(sum(gross), 2) as value, 'money' as dimension from w group by period")
def sum_by_scope(spark, sf_dir):
    return rounded(ag.sum_by_scope(tb.series(spark, sf_dir, "gross", "segment"), "period"), digits=2)


@query(f"{W} select entity, round(arg_min(revenue, period), 2) as first_value, round(arg_max(revenue, period), 2) as last_value from w group by entity")
def earliest_latest_by_entity(spark, sf_dir):
    ends = ag.ends_by_entity(tb.series(spark, sf_dir, "revenue"))
    return rounded(ends.withColumnsRenamed({"first": "first_value", "last": "last_value"}), "first_value", "last_value", digits=2)


ENDS = f"{W}, e as (select entity, arg_min(revenue, period) as a, arg_max(revenue, period) as b, min(period) as p0, max(period) as p1 from w group by entity)"


@query(ENDS + " select entity, round(b - a, 2) as value, 'OK' as status from e")
def change_by_entity(spark, sf_dir):
    return rounded(ag.change_by_entity(tb.series(spark, sf_dir, "revenue")).drop("reason"), digits=2)


@query(ENDS + " select entity, round((b - a) / abs(a) * 100, 6) as value, 'OK' as status from e")
def growth_by_entity(spark, sf_dir):
    return rounded(ag.growth_by_entity(tb.series(spark, sf_dir, "revenue")).drop("reason"), digits=6)


@query(ENDS + " select entity, round((power(b / a, 1.0 / (p1 - p0)) - 1) * 100, 6) as value, 'OK' as status from e")
def cagr_by_entity(spark, sf_dir):
    return rounded(ag.cagr_by_entity(tb.series(spark, sf_dir, "revenue")).drop("reason"), digits=6)


@query(
    f"{W}, e as (select entity, arg_min(margin, period) as a, arg_max(margin, period) as b, min(period) as p0, max(period) as p1 from w group by entity) "
    "select entity, case when sign(a) = sign(b) and a <> 0 then round((power(b / a, 1.0 / (p1 - p0)) - 1) * 100, 4) end as value, "
    "case when a = 0 then 'ZERO_DENOMINATOR' when sign(a) <> sign(b) then 'SIGN_CHANGE' end as reason from e"
)
def cagr_sign_change(spark, sf_dir):
    return rounded(ag.cagr_by_entity(tb.series(spark, sf_dir, "margin")).drop("status"))


@query(
    f"{W}, f as (select entity, period, revenue > (select median(revenue) from w) as flag from w) "
    "select entity, bool_and(flag) as all_flag, bool_or(flag) as any_flag from f group by entity"
)
def all_any_by_entity(spark, sf_dir):
    df = tb.series(spark, sf_dir, "revenue")
    middle = df.agg(F.median("value").alias("middle"))
    flags = pr.compare(df.join(F.broadcast(middle)), "gt", F.col("middle"))
    a = ag.all_by_entity(flags).withColumnRenamed("flag", "all_flag")
    return a.join(ag.any_by_entity(flags).withColumnRenamed("flag", "any_flag"), "entity")


@query(f"{W} select count(*) filter (where margin > 0) as n from w")
def count_true(spark, sf_dir):
    return ag.count_true(pr.compare(tb.series(spark, sf_dir, "margin"), "gt", 0.0))


@query(f"{W} select entity, count(*) filter (where margin < 0) as n, count(*) as \"of\" from w group by entity")
def count_periods_by_sign(spark, sf_dir):
    return pr.count_where(tb.series(spark, sf_dir, "margin"), F.col("value") < 0, ["entity"])


@query(
    f"{W} select period, case when count(distinct entity) = 25 and count(*) = 25 then round(avg(abs(margin)), 4) end as value, "
    "case when count(distinct entity) = 25 and count(*) = 25 then 'OK' else 'ABSTAIN' end as status from w group by period"
)
def entity_average_complete(spark, sf_dir):
    return rounded(ag.average_complete(tb.series(spark, sf_dir, "margin"), 25, absolute=True))


@query(f"{W} select period, round(max(case when entity = 'NATION_5' then revenue end) - max(case when entity = 'NATION_7' then revenue end), 2) as value from w group by period having value is not null")
def entity_difference(spark, sf_dir):
    return rounded(ag.entity_difference(tb.series(spark, sf_dir, "revenue"), "NATION_5", "NATION_7"), digits=2)


@query(
    f"{W} select entity, case when count(distinct dimension) = 1 then round(sum(value), 2) end as value, "
    "case when count(distinct dimension) = 1 then null else 'MIXED_DIMENSIONS' end as reason from "
    "(select entity, revenue as value, 'money' as dimension from w union all select entity, quantity, 'count' from w where entity < 'NATION_2') group by entity"
)
def agg_mixed_dimensions(spark, sf_dir):
    revenue, quantity = tb.several(spark, sf_dir, "revenue", "quantity")
    df = revenue.unionByName(quantity.where("entity < 'NATION_2'"))
    return rounded(ag.aggregate(df, "sum", ["entity"]).select("entity", "value", "reason"), digits=2)


LAG = f"{W}, r as (select entity, period, revenue as value, lag(revenue) over (partition by entity order by period) as before from w where mod(period, 4) <> 0)"


def _gapped(spark, sf_dir):
    return tb.series(spark, sf_dir, "revenue").where("period % 4 <> 0")


@query(LAG + " select entity, period, round((value + before) / 2, 6) as value from r where before is not null")
def rolling_average_2(spark, sf_dir):
    return rounded(wi.rolling_average(_gapped(spark, sf_dir)), digits=6)


@query(LAG + " select entity, period, round((value - before) / abs(before), 6) as value from r where before is not null")
def rolling_growth(spark, sf_dir):
    return rounded(wi.rolling_growth(_gapped(spark, sf_dir)), digits=6)


@query(LAG + " select entity, period, round(value - before, 2) as value from r where before is not null")
def rolling_change(spark, sf_dir):
    return rounded(wi.rolling_change(_gapped(spark, sf_dir)), digits=2)


@query(f"{W} select entity, period, round(revenue, 2) as value from (select *, row_number() over (partition by entity order by period) as n from w) where n > 1")
def drop_first_by_entity(spark, sf_dir):
    return rounded(wi.drop_first_by_entity(tb.series(spark, sf_dir, "revenue").select("entity", "period", "value")), digits=2)


COARSE = "round(quantity / 1000, 0)"


@query(f"{W} select entity, period, {COARSE} as value, row_number() over (order by {COARSE} desc, entity desc, period desc) <= 5 as flag from w")
def top_k_mask(spark, sf_dir):
    return wi.k_mask(_coarse(spark, sf_dir), 5)


@query(f"{W} select entity, period, {COARSE} as value, row_number() over (order by {COARSE}, entity, period) <= 5 as flag from w")
def bottom_k_mask(spark, sf_dir):
    return wi.k_mask(_coarse(spark, sf_dir), 5, top=False)


def _coarse(spark, sf_dir):
    """Values with many ties."""
    return tb.series(spark, sf_dir, "quantity").select("entity", "period", F.round(F.col("value") / 1000, 0).alias("value"))


TOTALS = f"{W}, t as (select entity, round(sum(quantity) / 10000, 0) as value from w group by entity)"


def _totals(spark, sf_dir):
    return ag.sum_by_entity(tb.series(spark, sf_dir, "quantity")).withColumn("value", F.round(F.col("value") / 10000, 0))


@query(TOTALS + " select entity, value, row_number() over (order by value desc, entity) as place from t qualify place <= 7")
def rank_members_v3(spark, sf_dir):
    return wi.rank_members(_totals(spark, sf_dir), "entity", 7)


@query(TOTALS + " select entity as key from t order by value desc, entity desc limit 1")
def argmax_key_v5(spark, sf_dir):
    return wi.argmax_key(_totals(spark, sf_dir), "entity")


@query(TOTALS + " select entity as key from t order by value, entity limit 1")
def argmin_key_v5(spark, sf_dir):
    return wi.argmin_key(_totals(spark, sf_dir), "entity")


YEARLY = f"{W}, t as (select period, round(sum(quantity) / 100000, 0) as value from w group by period)"


def _yearly(spark, sf_dir):
    return ag.sum_by_scope(tb.series(spark, sf_dir, "quantity"), "period").withColumn("value", F.round(F.col("value") / 100000, 0))


@query(YEARLY + " select (select period from t order by value desc, period limit 1) as top, (select period from t order by value, period desc limit 1) as bottom")
def arg_period_flat(spark, sf_dir):
    df = _yearly(spark, sf_dir)
    top = wi.argmax_period_flat(df).withColumnRenamed("key", "top")
    return top.join(F.broadcast(wi.argmin_period_flat(df).withColumnRenamed("key", "bottom")))


@query(TOTALS + " select count(*) > 1 as tie from t where value = (select max(value) from t)")
def rank_key_tie(spark, sf_dir):
    return wi.rank_key_tie(_totals(spark, sf_dir), "entity")


@query(
    f"{W}, a as (select entity, sum(returned) / sum(gross) as value from w group by entity) "
    "select w.entity, w.period, round(w.revenue, 2) as value from w join (select entity from a order by value desc, entity limit 1) b on w.entity = b.entity"
)
def select_at_arg(spark, sf_dir):
    wide = tb.wide_facts(spark, sf_dir, ["returned", "gross"]).groupBy("entity")
    share = wide.agg((F.sum("returned").cast("double") / F.sum("gross").cast("double")).alias("value"))
    other = tb.series(spark, sf_dir, "revenue").select("entity", "period", "value")
    return rounded(wi.select_at_arg(share, other, "entity"), digits=2)


@query(
    f"{W}, t as (select period, sum(revenue) as value from w group by period) "
    "select entity, period, round(quantity, 2) as value from w where period = (select period from t order by value desc, period desc limit 1)"
)
def select_at_key(spark, sf_dir):
    key = wi.argmax_key(ag.sum_by_scope(tb.series(spark, sf_dir, "revenue"), "period"), "period")
    other = tb.series(spark, sf_dir, "quantity").select("entity", "period", "value")
    return rounded(wi.select_at_key(other, key, "period"), digits=2)


@query(f"{W} select entity, min(case when margin < 0 then period end) as first_key, max(case when margin < 0 then period end) as last_key from w group by entity")
def first_last_true_key(spark, sf_dir):
    flags = pr.compare(tb.series(spark, sf_dir, "margin"), "lt", 0.0)
    first = wi.first_true_key(flags).withColumnRenamed("key", "first_key")
    return first.join(wi.last_true_key(flags).withColumnRenamed("key", "last_key"), "entity")


@query(f"{W} select entity, period + 1 as period, round(revenue, 2) as value, cast(period + 1 as double) as number from w")
def shift_key(spark, sf_dir):
    df = wi.shift_key(tb.series(spark, sf_dir, "revenue").select("entity", "period", "value"), 1)
    number = wi.key_to_number(df).withColumnRenamed("value", "number")
    return rounded(df.join(number, ["entity", "period"]), digits=2)


@query(f"{W} select entity, period, round(abs(margin), 4) as absolute, round(-margin, 4) as negated, round(margin * 100, 4) as percent from w")
def unary_operators(spark, sf_dir):
    df = tb.series(spark, sf_dir, "margin")
    out = se.absolute(df).select("entity", "period", F.col("value").alias("absolute"))
    out = out.join(se.negate(df).select("entity", "period", F.col("value").alias("negated")), ["entity", "period"])
    out = out.join(se.to_percent(df).select("entity", "period", F.col("value").alias("percent")), ["entity", "period"])
    return rounded(out, "absolute", "negated", "percent")


@query(f"{W} select entity, period, round(revenue, 2) as value from w where revenue >= (select avg(revenue) from w)")
def filter_compare(spark, sf_dir):
    df = tb.series(spark, sf_dir, "revenue")
    mean = df.agg(F.avg("value").alias("mean"))
    flags = pr.compare(df.join(F.broadcast(mean)), "ge", F.col("mean"))
    return rounded(pr.filter_scopes(df, flags).select("entity", "period", "value"), digits=2)


@query(
    f"{W}, d as (select period, bool_or(margin > 0) as p from w where entity in ('NATION_1', 'NATION_2') group by period) "
    "select w.entity, w.period, round(revenue, 2) as value from w left join d on w.period = d.period "
    "where case when entity in ('NATION_1', 'NATION_2') then margin > 0 else coalesce(p, false) end"
)
def filter_project_axis(spark, sf_dir):
    flags = pr.compare(tb.series(spark, sf_dir, "margin").where("entity IN ('NATION_1', 'NATION_2')"), "gt", 0.0)
    kept = pr.filter_scopes(tb.series(spark, sf_dir, "revenue"), flags, "period")
    return rounded(kept.select("entity", "period", "value"), digits=2)


@query(
    f"{W}, {{0}} select entity, period, round(revenue, 2) as value, case when margin is null then 'ABSTAIN' else 'OK' end as status from j where margin is null or margin > 0".replace(
        "{0}", "j as (select w.entity, w.period, w.revenue, x.margin from w left join (select * from w where entity <> 'NATION_4') x on w.entity = x.entity and w.period = x.period)"
    )
)
def filter_strict_keys(spark, sf_dir):
    flags = pr.compare(tb.series(spark, sf_dir, "margin").where("entity <> 'NATION_4'"), "gt", 0.0)
    kept = pr.filter_keys(tb.series(spark, sf_dir, "revenue"), flags, ["entity", "period"])
    return rounded(kept.select("entity", "period", "value", "status"), digits=2)


@query(
    f"{W}, a as (select entity, period, margin > 0 as flag from w where entity < 'NATION_3'), b as (select entity, period, returned > 0 as flag from w where entity > 'NATION_2') "
    "select coalesce(a.entity, b.entity) as entity, coalesce(a.period, b.period) as period, "
    "coalesce(a.flag, false) or coalesce(b.flag, false) as either, coalesce(a.flag, false) and coalesce(b.flag, false) as both "
    "from a full join b on a.entity = b.entity and a.period = b.period"
)
def logical_missing_false(spark, sf_dir):
    a = pr.compare(tb.series(spark, sf_dir, "margin").where("entity < 'NATION_3'"), "gt", 0.0)
    b = pr.compare(tb.series(spark, sf_dir, "returned").where("entity > 'NATION_2'"), "gt", 0.0)
    keys = ["entity", "period"]
    either = pr.logical(a, b, "or", keys).withColumnRenamed("flag", "either")
    return either.join(pr.logical(a, b, "and", keys).withColumnRenamed("flag", "both"), keys)


@query(f"{W} select period, bool_and(margin > 0) as all_flag, bool_or(margin > 0) as any_flag from w group by period")
def quantified_all_any(spark, sf_dir):
    flags = pr.compare(tb.series(spark, sf_dir, "margin"), "gt", 0.0)
    a = pr.quantified(flags, "all", "entity").withColumnRenamed("flag", "all_flag")
    return a.join(pr.quantified(flags, "any", "entity").withColumnRenamed("flag", "any_flag"), "period")


@query(f"{W} select entity, period, margin > returned - gross / 4 as flag from w")
def compare_elementwise(spark, sf_dir):
    gross, returned, margin = tb.several(spark, sf_dir, "gross", "returned", "margin")
    right = se.arithmetic(returned, se.negate(gross).withColumn("value", F.col("value") / 4), "add")
    return pr.compare_series(margin, right, "gt", ["entity", "period"])


@query(f"{W} select entity, period, margin = 0 as zero, margin <> 0 as nonzero from w")
def zero_checks(spark, sf_dir):
    df = tb.series(spark, sf_dir, "margin")
    zero = pr.is_zero(df).select("entity", "period", F.col("flag").alias("zero"))
    return zero.join(pr.is_nonzero(df).select("entity", "period", F.col("flag").alias("nonzero")), ["entity", "period"])


@query(f"{W} select n_name as entity, exists (select 1 from w where w.entity = n_name and margin < 0) as present from nation")
def exists_not_exists(spark, sf_dir):
    members = tb.table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"))
    found = tb.series(spark, sf_dir, "margin").where("value < 0")
    yes = pr.exists(members, found, ["entity"]).withColumn("present", F.lit(True))
    return yes.unionByName(pr.not_exists(members, found, ["entity"]).withColumn("present", F.lit(False)))


@query(
    f"{W}, p as (select entity, max(case when period = y1 - 1 then revenue end) as new, max(case when period = y1 - 2 then revenue end) as old from w, {SPAN} group by entity) "
    "select entity, round((new - old) / abs(old), 6) as growth from p where old is not null and new is not null order by growth desc, entity limit 1"
)
def flagship_growth(spark, sf_dir):
    """Which entity grew most between the last two complete periods."""
    df, _, last = spanned(tb.series(spark, sf_dir, "revenue"))
    growth = se.growth_between(df, last - 1, last - 2).where("status = 'OK'")
    best = wi.rank_members(growth, "entity", 1)
    return best.select("entity", F.round("value", 6).alias("growth"))
