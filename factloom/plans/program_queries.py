"""Composite questions as programs, formulas, retrieval and evaluation; each with its SQL."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import evaluation as ev
from factloom.operators import formulas as fo
from factloom.operators import retrieval as re_
from factloom.operators import windows as wi
from factloom.plans.program import Program, keys_of
from factloom.plans.registry import Registry
from factloom.sources import tables as tb

registry = Registry()
query = registry.query

W = "with " + tb.wide_sql()
ENDS = (
    W + ", e as (select entity, arg_min(revenue, period) as r0, arg_max(revenue, period) as r1, arg_min(margin / gross, period) as f0, "
    "arg_max(margin / gross, period) as f1, arg_max(returned, period) as t1, bool_and(margin > 0) as pos, bool_and(returned > 0) as ret, sum(revenue) as total, "
    "min(period) as p0, max(period) as p1 from w group by entity)"
)


def program(name: str, text: str, sql: str, digits: int = 4) -> None:
    """Register a program as a query."""
    parsed = Program.parse(text)

    @query(sql, name=name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = parsed.run(lambda metrics: tb.wide_facts(spark, sf_dir, metrics))
        column = next((c for c in ("value", "flag", "key") if c in out.columns), None)
        kept = out.select(*keys_of(out), *([column] if column else []))
        return kept.withColumn("value", F.round("value", digits)) if column == "value" else kept


program(
    "median_filtered_average",
    """
    ratio = formula(text="margin / gross * 100")
    level = median(ratio)
    above = compare(ratio, level, operator="gt")
    revenue = facts(metric="revenue")
    kept = filter(revenue, above)
    result = average(kept)
    """,
    W + " select round(avg(revenue), 4) as value from w where margin / gross * 100 > (select median(margin / gross * 100) from w)",
)
program(
    "median_group_average_difference",
    """
    ratio = formula(text="margin / gross * 100")
    level = median(ratio)
    above = compare(ratio, level, operator="gt")
    below = compare(ratio, level, operator="le")
    revenue = facts(metric="revenue")
    high = filter(revenue, above)
    low = filter(revenue, below)
    a = average(high)
    b = average(low)
    result = subtract(a, b)
    """,
    W + ", m as (select median(margin / gross * 100) as level from w) select round((select avg(revenue) from w, m where margin / gross * 100 > level) - (select avg(revenue) from w, m where margin / gross * 100 <= level), 4) as value",
)
program(
    "continuous_positive_latest_sum",
    """
    margin = facts(metric="margin")
    positive = compare(margin, operator="gt", value=0)
    always = all_by_entity(positive)
    revenue = facts(metric="revenue")
    last = latest_by_entity(revenue)
    kept = filter(last, always)
    result = sum(kept)
    """,
    ENDS + " select round(sum(r1), 4) as value from e where pos",
)
program(
    "continuous_positive_growth_average",
    """
    margin = facts(metric="margin")
    positive = compare(margin, operator="gt", value=0)
    one = all_by_entity(positive)
    returned = facts(metric="returned")
    some = compare(returned, operator="gt", value=0)
    two = all_by_entity(some)
    both = logical_or(one, two)
    revenue = facts(metric="revenue")
    growth = growth_by_entity(revenue)
    kept = filter(growth, both)
    result = average(kept)
    """,
    ENDS + " select round(avg((r1 - r0) / abs(r0) * 100), 4) as value from e where pos or ret",
)
program(
    "continuous_positive_formula_gap_average",
    """
    returned = facts(metric="returned")
    some = compare(returned, operator="gt", value=0)
    always = all_by_entity(some)
    ratio = formula(text="margin / gross * 100")
    first = earliest_by_entity(ratio)
    last = latest_by_entity(ratio)
    up = compare(last, first, operator="gt")
    both = logical_and(always, up)
    gap = subtract(last, first)
    kept = filter(gap, both)
    result = average(kept)
    """,
    ENDS + " select round(avg(f1 * 100 - f0 * 100), 4) as value from e where ret and f1 * 100 > f0 * 100",
)
program(
    "continuous_cagr_rank",
    """
    returned = facts(metric="returned")
    some = compare(returned, operator="gt", value=0)
    always = all_by_entity(some)
    revenue = facts(metric="revenue")
    cagr = cagr_by_entity(revenue)
    kept = filter(cagr, always)
    best = argmax_key(kept)
    ratio = formula(text="margin / gross * 100")
    last = latest_by_entity(ratio)
    result = select_at_key(last, best)
    """,
    ENDS + ", c as (select *, (power(r1 / r0, 1.0 / (p1 - p0)) - 1) * 100 as cagr from e where ret) select entity, round(f1 * 100, 4) as value from c order by cagr desc, entity desc limit 1",
)
program(
    "growth_filtered_change_rank",
    """
    revenue = facts(metric="revenue")
    growth = growth_by_entity(revenue)
    falling = compare(growth, operator="lt", value=0)
    ratio = formula(text="margin / gross * 100")
    change = change_by_entity(ratio)
    kept = filter(change, falling)
    worst = argmin_key(kept)
    last = latest_by_entity(ratio)
    result = select_at_key(last, worst)
    """,
    ENDS + " select entity, round(f1 * 100, 4) as value from e where r1 < r0 order by f1 * 100 - f0 * 100, entity limit 1",
)
program(
    "rolling_formula_count",
    """
    ratio = formula(text="margin / gross * 100")
    change = rolling_change_by_entity(ratio)
    up = compare(change, operator="gt", value=0)
    level = median(change)
    strong = compare(change, level, operator="gt")
    both = logical_and(up, strong)
    result = count_true(both)
    """,
    W + ", r as (select margin / gross * 100 - lag(margin / gross * 100) over (partition by entity order by period) as d from w), m as (select median(d) as level from r) "
    "select cast(count(*) as double) as value from r, m where d > 0 and d > level",
)
program(
    "top_k_formula_count",
    """
    revenue = facts(metric="revenue")
    best = top_k_mask(revenue, k=20)
    ratio = formula(text="margin / gross * 100")
    good = compare(ratio, operator="gt", value=0)
    both = logical_and(best, good)
    result = count_true(both)
    """,
    W + ", t as (select * from w order by revenue desc, entity desc, period desc limit 20) select cast(count(*) filter (where margin / gross * 100 > 0) as double) as value from t",
)
program(
    "rolling_rank_select",
    """
    revenue = facts(metric="revenue", entities=["NATION_6"])
    yearly = sum_by_scope(revenue, axis="period")
    growth = rolling_growth(yearly)
    best = argmax_key(growth)
    ratio = formula(text="margin / gross * 100", entities=["NATION_6"])
    result = select_at_key(ratio, best)
    """,
    W + ", r as (select *, (revenue - lag(revenue) over (order by period)) / abs(lag(revenue) over (order by period)) as g from w where entity = 'NATION_6') "
    "select entity, period, round(margin / gross * 100, 4) as value from r where g is not null order by g desc, period desc limit 1",
)
program(
    "after_first_negative_period",
    """
    margin = facts(metric="margin")
    negative = compare(margin, operator="lt", value=0)
    first = first_true_key(negative)
    next = shift_key(first, years=1)
    ratio = formula(text="revenue / gross * 100")
    result = select_at_key(ratio, next)
    """,
    W + ", f as (select entity, min(period) + 1 as period from w where margin < 0 group by entity) select w.entity, w.period, round(revenue / gross * 100, 4) as value from w join f on w.entity = f.entity and w.period = f.period",
)
program(
    "filtered_profit_share",
    """
    revenue = facts(metric="revenue")
    total = sum(revenue)
    ratio = formula(text="margin / gross")
    level = median(ratio)
    above = compare(ratio, level, operator="gt")
    kept = filter(revenue, above)
    part = sum(kept)
    share = divide(part, total)
    result = to_percent(share)
    """,
    W + " select round(sum(revenue) filter (where margin / gross > (select median(margin / gross) from w)) / sum(revenue) * 100, 4) as value from w",
)
program(
    "filtered_rank",
    """
    ratio = formula(text="margin / gross * 100")
    last = latest_by_entity(ratio)
    level = median(last)
    above = compare(last, level, operator="ge")
    change = change_by_entity(ratio)
    kept = filter(change, above)
    best = argmax_key(kept)
    revenue = facts(metric="revenue")
    latest = latest_by_entity(revenue)
    result = select_at_key(latest, best)
    """,
    ENDS + " select entity, round(r1, 4) as value from e where f1 * 100 >= (select median(f1 * 100) from e) order by f1 * 100 - f0 * 100 desc, entity desc limit 1",
)
program(
    "two_period_entity_rank",
    """
    ratio = formula(text="margin / gross * 100")
    change = change_by_entity(ratio)
    size = absolute(change)
    least = argmin_key(size)
    last = latest_by_entity(ratio)
    result = select_at_key(last, least)
    """,
    ENDS + " select entity, round(f1 * 100, 4) as value from e order by abs(f1 * 100 - f0 * 100), entity limit 1",
)
program(
    "inventory_days_rank",
    """
    returned = facts(metric="returned")
    stock = rolling_average_by_entity(returned)
    days = literal(stock, value=365)
    scaled = multiply(stock, days)
    gross = facts(metric="gross")
    turnover = divide(scaled, gross)
    last = latest_by_entity(turnover)
    longest = argmax_key(last)
    result = select_at_key(last, longest)
    """,
    W + ", r as (select *, (returned + lag(returned) over (partition by entity order by period)) / 2 * 365 / gross as days from w), "
    "l as (select entity, arg_max(days, period) as d from r where days is not null group by entity) select entity, round(d, 4) as value from l order by d desc, entity desc limit 1",
)
program(
    "positive_period_formula_rank_select",
    """
    margin = facts(metric="margin", entities=["NATION_2"])
    yearly = sum_by_scope(margin, axis="period")
    positive = compare(yearly, operator="gt", value=0)
    rate = formula(text="returned / gross * 100", entities=["NATION_2"])
    rates = sum_by_scope(rate, axis="period")
    kept = filter(rates, positive)
    best = argmin_key(kept)
    share = formula(text="revenue / gross * 100", entities=["NATION_2"])
    shares = sum_by_scope(share, axis="period")
    result = select_at_key(shares, best)
    """,
    W + " select period, round(revenue / gross * 100, 4) as value from w where entity = 'NATION_2' and margin > 0 order by returned / gross, period limit 1",
)
program(
    "positive_conditioned_rank_select",
    """
    margin = facts(metric="margin")
    latest = latest_by_entity(margin)
    zero = literal(latest, value=0)
    positive = compare(latest, zero, operator="gt")
    rate = formula(text="returned / gross * 100")
    rates = latest_by_entity(rate)
    kept = filter(rates, positive)
    best = argmax_key(kept)
    share = formula(text="revenue / gross * 100")
    shares = latest_by_entity(share)
    result = select_at_key(shares, best)
    """,
    W + ", e as (select entity, arg_max(margin, period) as m, arg_max(returned / gross, period) as r, arg_max(revenue / gross, period) as s from w group by entity) "
    "select entity, round(s * 100, 4) as value from e where m > 0 order by r desc, entity desc limit 1",
)
program(
    "inventory_days_filtered_margin_average",
    """
    stock = facts(metric="returned")
    mean = rolling_average_by_entity(stock)
    size = absolute(mean)
    year = literal(size, value=365)
    scaled = multiply(size, year)
    cost = facts(metric="gross")
    days = divide(scaled, cost)
    first = earliest_by_entity(days)
    level = median(first)
    slow = compare(first, level, operator="gt")
    margin = formula(text="margin / gross * 100")
    later = drop_first_by_entity(margin)
    change = change_by_entity(later)
    kept = filter(change, slow)
    result = average(kept)
    """,
    W + ", r as (select *, abs((returned + lag(returned) over (partition by entity order by period)) / 2) * 365 / gross as days, margin / gross * 100 as m, "
    "row_number() over (partition by entity order by period) as at_ from w), f as (select entity, arg_min(days, period) as d from r where days is not null group by entity), "
    "c as (select entity, arg_max(m, period) - arg_min(m, period) as change, count(*) as n from r where at_ > 1 group by entity) "
    "select round(avg(change), 4) as value from c join f using (entity) where n > 1 and d > (select median(d) from f)",
)
program(
    "current_rank_select",
    """
    rate = formula(text="returned / gross * 100")
    now = latest_by_entity(rate)
    least = argmin_key(now)
    share = formula(text="margin / revenue * 100")
    shares = latest_by_entity(share)
    result = select_at_key(shares, least)
    """,
    W + ", e as (select entity, arg_max(returned / gross, period) as r, arg_max(margin / revenue, period) as s from w group by entity) "
    "select entity, round(s * 100, 4) as value from e order by r, entity limit 1",
)
program(
    "formula_output_direct_rank",
    """
    revenue = facts(metric="revenue", entities=["NATION_9"])
    yearly = sum_by_scope(revenue, axis="period")
    best = argmax_key(yearly)
    rate = formula(text="(gross - returned) / gross * 100", entities=["NATION_9"])
    result = select_at_key(rate, best)
    """,
    W + " select entity, period, round((gross - returned) / gross * 100, 4) as value from w where entity = 'NATION_9' order by revenue desc, period desc limit 1",
)
program(
    "filtered_period_rank",
    """
    revenue = facts(metric="revenue", entities=["NATION_5"])
    rate = formula(text="returned / gross * 100", entities=["NATION_5"])
    limit = literal(rate, value=20)
    above = compare(rate, limit, operator="gt")
    kept = filter(revenue, above)
    yearly = sum_by_scope(kept, axis="period")
    least = argmin_key(yearly)
    share = formula(text="margin / gross * 100", entities=["NATION_5"])
    result = select_at_key(share, least)
    """,
    W + " select entity, period, round(margin / gross * 100, 4) as value from w where entity = 'NATION_5' and returned / gross * 100 > 20 order by revenue, period limit 1",
)
program(
    "median_filtered_share",
    """
    rate = formula(text="returned / gross * 100")
    revenue = facts(metric="revenue")
    orders = facts(metric="orders")
    size = divide(revenue, orders)
    level = median(size)
    large = compare(size, level, operator="gt")
    part = filter(revenue, large)
    high = compare(rate, operator="gt", value=20)
    both = filter(part, high)
    above = sum(both)
    total = sum(revenue)
    share = divide(above, total)
    result = to_percent(share)
    """,
    W + ", m as (select median(revenue / orders) as level from w) select round(sum(revenue) filter (where revenue / orders > level and returned / gross * 100 > 20) / sum(revenue) * 100, 4) as value from w, m",
)
program(
    "simple",
    """
    revenue = facts(metric="revenue", entities=["NATION_1", "NATION_4"])
    result = average(revenue)
    """,
    W + " select round(avg(revenue), 4) as value from w where entity in ('NATION_1', 'NATION_4')",
)
for _word, _call, _sql in (
    ("sum", "sum(a)", "sum(revenue)"),
    ("average", "average(a)", "avg(revenue)"),
    ("minimum", "minimum(a)", "min(revenue)"),
    ("maximum", "maximum(a)", "max(revenue)"),
):
    program(
        f"lexical_direct_{_word}",
        f"""
        a = facts(metric="revenue", entities=["NATION_7"])
        result = {_call}
        """,
        W + f" select round({_sql}, 4) as value from w where entity = 'NATION_7'",
    )
program(
    "lexical_direct_growth",
    """
    a = facts(metric="revenue", entities=["NATION_7", "NATION_8"])
    first = earliest_by_entity(a)
    last = latest_by_entity(a)
    old = sum(first)
    new = sum(last)
    result = growth(old, new)
    """,
    ENDS + " select round((sum(r1) - sum(r0)) / abs(sum(r0)) * 100, 4) as value from e where entity in ('NATION_7', 'NATION_8')",
)
program(
    "lexical_direct_subtract",
    """
    a = facts(metric="revenue", entities=["NATION_7"])
    b = facts(metric="revenue", entities=["NATION_8"])
    one = sum(a)
    two = sum(b)
    result = subtract(one, two)
    """,
    W + " select round(sum(case entity when 'NATION_7' then revenue end) - sum(case entity when 'NATION_8' then revenue end), 4) as value from w",
)
program(
    "direct_rank_select",
    """
    revenue = facts(metric="revenue")
    total = sum_by_entity(revenue)
    best = argmax_key(total)
    orders = facts(metric="orders")
    count = sum_by_entity(orders)
    result = select_at_key(count, best)
    """,
    W + " select entity, cast(sum(orders) as double) as value from w group by entity order by sum(revenue) desc, entity desc limit 1",
)
program(
    "bottom_k_any_period",
    """
    revenue = facts(metric="revenue")
    least = bottom_k_mask(revenue, k=15)
    result = any_by_entity(least)
    """,
    W + ", b as (select entity, period from w order by revenue, entity, period limit 15) select entity, bool_or((entity, period) in (select (entity, period) from b)) as flag from w group by entity",
)
program(
    "period_extremes_gap",
    """
    revenue = facts(metric="revenue")
    yearly = sum_by_scope(revenue, axis="period")
    high = maximum(yearly)
    low = minimum(yearly)
    result = growth(low, high)
    """,
    W + ", y as (select sum(revenue) as v from w group by period) select round((max(v) - min(v)) / abs(min(v)) * 100, 4) as value from y",
)
program(
    "last_positive_year_number",
    """
    margin = facts(metric="margin")
    yearly = sum_by_scope(margin, axis="period")
    positive = compare(yearly, operator="gt", value=0)
    last = last_true_key(positive)
    result = key_to_number(last)
    """,
    W + ", y as (select period, sum(margin) as v from w group by period) select cast(max(period) as double) as value from y where v > 0",
)


# ---- formulas

OURS = """
margin_share = margin / gross * 100
return_rate = returned / gross * 100
net_to_gross = (revenue - returned) / gross
average_order = revenue / orders
average_order_rolling = revenue / rolling_average(orders)
undefined = revenue / (gross - gross)
"""


@query(
    W + ", r as (select *, (orders + lag(orders) over (partition by entity order by period)) / 2 as mean_orders from w), "
    "v as (select entity, period, unnest(['margin_share', 'return_rate', 'net_to_gross', 'average_order', 'average_order_rolling', 'undefined']) as formula, "
    "unnest([margin / gross * 100, returned / gross * 100, (revenue - returned) / gross, revenue / orders, revenue / mean_orders, null]) as value from r) "
    "select entity, period, formula, round(value, 8) as value, case when value is null then 'ABSTAIN' else 'OK' end as status, "
    "case when formula = 'undefined' then 'ZERO_DENOMINATOR' when value is null then 'TOO_FEW_PERIODS' end as reason from v"
)
def formula_registry_pivot(spark, sf_dir):
    wide = tb.wide_facts(spark, sf_dir, ["margin", "gross", "returned", "revenue", "orders"])
    out = fo.evaluate(wide, list(fo.registry(OURS).values()))
    return out.withColumn("value", F.round("value", 8))


#: Columns that play the statements' metrics, in turn: every leaf of the reviewed formulas gets one of them.
ROLES = ["revenue", "gross", "returned", "margin", "orders"]
LEAVES = sorted({leaf for f in fo.registry().values() for leaf in f.leaves})
PLAYS = {leaf: ROLES[n % len(ROLES)] for n, leaf in enumerate(LEAVES)}


def _formula_sql(node: ast.expr) -> str:
    """A formula's text as SQL over the columns that play its leaves; a zero denominator gives null."""
    if isinstance(node, ast.Constant):
        return f"{float(node.value)!r}"
    if isinstance(node, ast.Name):
        return PLAYS[node.id]
    if isinstance(node, ast.UnaryOp):
        return f"(-{_formula_sql(node.operand)})"
    if isinstance(node, ast.Call):
        inner = _formula_sql(node.args[0])
        before = f"(lag({inner}) over (partition by entity order by period))"
        return {"abs": f"abs({inner})", "rolling_average": f"(({inner} + {before}) / 2)", "rolling_growth": f"(({inner} - {before}) / nullif(abs({before}), 0))"}[node.func.id]
    left, right = _formula_sql(node.left), _formula_sql(node.right)
    return f"({left} / nullif({right}, 0))" if isinstance(node.op, ast.Div) else f"({left} {fo.OPERATORS[type(node.op)]} {right})"


@query(
    W + ", v as ("
    + " union all ".join(f"select entity, period, '{n}' as formula, cast({_formula_sql(f.tree)} as double) as value from w" for n, f in fo.registry().items())
    + ") select entity, period, formula, round(value, 6) as value, case when value is null then 'ABSTAIN' else 'OK' end as status from v"
)
def formula_reviewed(spark, sf_dir):
    """All reviewed formulas by name over columns that play the statements' metrics."""
    wide = tb.wide_facts(spark, sf_dir, ROLES)
    wide = wide.select("entity", "period", *[F.col(c).cast("double").alias(leaf) for leaf, c in PLAYS.items()])
    return fo.evaluate(wide, list(fo.registry().values())).select("entity", "period", "formula", F.round("value", 6).alias("value"), "status")


# ---- retrieval

TERMS = [("q1", "thtion"), ("q1", "ander"), ("q2", "heit"), ("q2", "keit"), ("q2", "und"), ("q3", "nowhere")]
TERMS_SQL = "q as (select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in TERMS) + ") as v(query_id, term))"
TOKENS_SQL = "list_filter(string_split_regex(trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
BM25_SQL = (
    f"with {TERMS_SQL}, d as (select doc_id as uid, source, lang, {TOKENS_SQL} as t from documents), sz as (select uid, len(t) as length from d), "
    "c as (select count(*) as total, avg(length) as mean from sz), p as (select uid, unnest(t) as term from d), tf as (select uid, term, count(*) as wtf from p where term in (select term from q) group by 1, 2), "
    "n as (select term, count(distinct uid) as n from tf group by 1), "
    "s as (select q.query_id, tf.uid, sum(greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * length / mean))) as score "
    "from q join tf on q.term = tf.term join n on n.term = tf.term join sz on sz.uid = tf.uid, c group by 1, 2)"
)


def _scores(spark, sf_dir):
    docs = tb.table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = spark.createDataFrame(TERMS, "query_id string, term string")
    tokens = re_.tokenized(docs, "doc_id", ["text"], queries).persist()  # every text is tokenised once
    return re_.bm25(re_.postings(tokens, ["text"]), re_.corpus_size(tokens), queries, {"text": 1.0})


@query(BM25_SQL + " select query_id, uid, round(score, 6) as score from s")
def bm25_search(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(
    BM25_SQL + ", r as (select *, round(score, 4) as sc from s), x as (select *, rank() over (partition by query_id, sc > 0 order by sc desc) - 1 + (count(*) over (partition by query_id, sc) - 1) / 2.0 as place, "
    "count(*) over (partition by query_id, sc > 0) as cnt, min(sc) over (partition by query_id) as lo, max(sc) over (partition by query_id) as hi from r) "
    "select query_id, uid, round(case when hi - lo < 1e-9 then 0.5 else (sc - lo) / (hi - lo) end, 6) as minmax, round(case when sc > 0 then 1 - place / cnt else 0 end, 6) as ranked, "
    "round(case when sc > 0 then sc / hi else 0 end, 6) as maxed from x"
)
def score_normalize(spark, sf_dir):
    scores = _scores(spark, sf_dir).withColumn("score", F.round("score", 4))
    out = scores
    for kind, name in (("minmax", "minmax"), ("rank", "ranked"), ("max", "maxed")):
        out = re_.normalized(out, "query_id", kind).withColumn(name, F.round("normal", 6)).drop("normal")
    return out.select("query_id", "uid", "minmax", "ranked", "maxed")


@query(
    BM25_SQL + ", x as (select s.query_id, s.uid, score, max(score) over (partition by query_id) as hi, source, lang, n_chars from s join documents on doc_id = uid), "
    "y as (select query_id, uid, (score / hi + case when lang = 'en' then 0.35 else 0 end + case when source = 'src3' then 0.15 else 0 end) * (0.7 + 0.3 * least(n_chars, 1000) / 1000.0) as ranked, "
    "concat_ws(',', case when lang = 'en' then 'period' end, case when source = 'src3' then 'unit' end) as reasons from x), "
    "z as (select *, row_number() over (partition by query_id order by ranked desc, uid) as place from y) select query_id, uid, round(ranked, 6) as ranked, reasons, place from z where place <= 10"
)
def structural_rank(spark, sf_dir):
    docs = tb.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "source", "lang", "n_chars")
    scores = re_.normalized(_scores(spark, sf_dir), "query_id", "max").join(docs, "uid")
    hits = {"period": F.col("lang") == "en", "unit": F.col("source") == "src3"}
    ranked = re_.structural(scores, "normal", hits, F.least("n_chars", F.lit(1000)) / 1000.0)
    top = re_.top_k(ranked, "query_id", "ranked", "uid", 10)
    return top.select("query_id", "uid", F.round("ranked", 6).alias("ranked"), F.array_join("reasons", ",").alias("reasons"), "place")


@query(
    "with r as (select doc_id as uid, source, n_chars as score, row_number() over (partition by source order by n_chars desc, doc_id) as place from documents) "
    "select uid, source, place, row_number() over (order by place <= 3 desc, place, score desc, uid) as slot from r"
)
def per_source_round_robin(spark, sf_dir):
    docs = tb.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "source", F.col("n_chars").alias("score"))
    return wi.round_robin(docs, "source", "score", "uid", 3).select("uid", "source", "place", "slot")


@query(
    "with a as (select doc_id, source, lang, n_chars, row_number() over (partition by text order by n_chars desc, doc_id) as p from documents), "
    "b as (select *, row_number() over (partition by source, lang order by n_chars desc, doc_id) as place from a where p = 1) select doc_id, place from b where place <= 2"
)
def dedupe_quota_topk(spark, sf_dir):
    docs = tb.table(spark, sf_dir, "documents").withColumn("fact", F.sha2("text", 256))
    return wi.first_per_key_with_quota(docs, ["fact"], ["source", "lang"], "n_chars", "doc_id", 2).select("doc_id", "place")


@query(
    "with r as (select source, doc_id as uid, n_chars as score, row_number() over (partition by source order by n_chars desc, doc_id) as place, max(n_chars) over (partition by source) as best from documents), "
    "m as (select *, min(case when place <= 2 or score >= best - 4000 then 1 else 0 end) over (partition by source order by score desc, uid) as open from r) select source, uid, place from m where open = 1 and place <= 10"
)
def adaptive_cut(spark, sf_dir):
    docs = tb.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("uid"), F.col("n_chars").alias("score"))
    return re_.adaptive_cut(docs, "source", "score", "uid", 2, 4000, 10).select("source", "uid", "place")


@query(
    "with r as (select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id) as p, lead(value) over (partition by user_id order by value desc, event_id) as second from events) "
    "select user_id, event_id, value, second, value - second as margin, coalesce(value = second, false) as tie from r where p = 1"
)
def winner_and_margin(spark, sf_dir):
    events = tb.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return wi.winner_and_margin(events, ["user_id"], "value", "event_id")


@query(
    "select doc_id as uid, source as entity from documents where source in ('src1', 'src2', 'src3') and n_chars between 1000 and 2000 + 500 and (lang is null or lang = 'en')"
)
def retrieval_scope_filter(spark, sf_dir):
    cards = tb.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), F.col("source").alias("entity"), F.col("n_chars").alias("year"), F.col("lang").alias("basis"))
    return re_.scope_filter(cards, ["src1", "src2", "src3"], (1000, 2000), "en", 500).select("uid", "entity")


#: Labels as a report may print them, from parts: as the alias stands, in capitals, with a word behind, with marks.
LABELS = {0: "p_name", 1: "upper(p_name)", 2: "concat(p_name, ' ', lower(p_type))", 3: "concat(replace(p_name, 'e', 'é'), case when p_size > 25 then ' Ñ' else '' end)"}
LABEL_CASE = "case p_size % 4 " + " ".join(f"when {n} then {e}" for n, e in LABELS.items()) + " end"
ALIAS_SQL = (
    "select distinct p_name as alias, replace(p_name, ' ', '_') as metric from part where p_brand <> 'Brand#3' and p_name not like 'hot %' "
    "union all select distinct split_part(p_name, ' ', 1), concat('any_', split_part(p_name, ' ', 1)) from part where p_name like 'r%'"
)


@query(
    f"with l as (select distinct {LABEL_CASE} as label from part), a as ({ALIAS_SQL}), f as (select label, lower(label) as raw, lower(strip_accents(label)) as folded from l), "
    "m as (select label, metric, alias, case when raw = alias then 4 when folded = alias then 3 else 2 end as strength from f join a on starts_with(folded || ' ', alias || ' ')), "
    "r as (select *, row_number() over (partition by label order by strength desc, length(alias) desc, metric) as place from m) select label, metric, strength from r where place = 1"
)
def metric_match_cascade(spark, sf_dir):
    part = tb.table(spark, sf_dir, "part")
    labels = part.select(F.expr(LABEL_CASE).alias("label")).distinct()
    whole = part.where("p_brand <> 'Brand#3' AND p_name NOT LIKE 'hot %'").select(F.col("p_name").alias("alias"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("metric"))
    word = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    first = part.where("p_name LIKE 'r%'").select(word.alias("alias"), F.concat(F.lit("any_"), word).alias("metric"))
    return re_.match_metric(labels, whole.distinct().unionByName(first.distinct()))


# ---- evaluation

EVAL_SQL = (
    "with l as (select d.source as query_id, d.doc_id as uid, row_number() over (partition by d.source order by d.n_chars desc, d.doc_id) as place from documents d), "
    "g as (select l.query_id, l.uid from l join labels b on b.doc_id = l.uid where b.quality = 1), sz as (select query_id, count(*) as g from g group by 1), "
    "t as (select * from l where place <= 10), rn as (select query_id, count(*) as n from t group by 1), "
    "h as (select t.query_id, count(*) as h, min(place) as first, sum(1 / log2(place + 1)) as dcg from t join g on g.query_id = t.query_id and g.uid = t.uid group by 1), "
    "x as (select sz.query_id, g, coalesce(n, 0) as n, coalesce(h, 0) as h, first, coalesce(dcg, 0) as dcg, (select sum(1 / log2(i + 1)) from range(1, 11) r(i) where i <= g) as ideal from sz left join rn using (query_id) left join h using (query_id)), "
    "m as (select query_id, h / g as recall, case when n = 0 then 0.0 else h / n end as precision, h / least(g, 10) as capped_precision, 5 * h / (4 * g + n) as f2, case when h > 0 then 1.0 else 0.0 end as hit, coalesce(1.0 / first, 0) as mrr, dcg / ideal as ndcg from x) "
)


def _eval_input(spark, sf_dir):
    docs = tb.table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("uid"), "n_chars")
    ranked = re_.top_k(docs, "query_id", "n_chars", "uid", 1_000_000).select("query_id", "uid", "place")
    good = tb.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("uid"))
    return docs.join(good, "uid").select("query_id", "uid"), ranked


@query(EVAL_SQL + "select query_id, " + ", ".join(f"round({m}, 6)::double as {m}" for m in ev.METRICS) + " from m")
def evalmetrics_per_query(spark, sf_dir):
    gold, ranked = _eval_input(spark, sf_dir)
    out = ev.per_query(gold, ranked, 10)
    return out.select("query_id", *[F.round(m, 6).cast("double").alias(m) for m in ev.METRICS])


@query(EVAL_SQL + "select count(*) as n_queries, " + ", ".join(f"round(avg({m}), 6)::double as {m}" for m in ev.METRICS) + " from m")
def evalmetrics_macro(spark, sf_dir):
    gold, ranked = _eval_input(spark, sf_dir)
    out = ev.macro(ev.per_query(gold, ranked, 10))
    return out.select("n_queries", *[F.round(m, 6).alias(m) for m in ev.METRICS])


@query(EVAL_SQL + "select round(avg(case when exists (select 1 from t join g on g.query_id = t.query_id and g.uid = t.uid where t.query_id = sz.query_id) then 1.0 else 0.0 end), 6)::double as hit_rate from sz")
def candidate_hit_rate(spark, sf_dir):
    gold, ranked = _eval_input(spark, sf_dir)
    return ev.candidate_hit_rate(gold, ranked.where("place <= 10")).select(F.round("hit_rate", 6).alias("hit_rate"))


@query(
    EVAL_SQL + ", s1 as (select * from l where place <= 40), s2 as (select * from l where place <= 20) select g.query_id, g.uid, case when s1.uid is null then 'filter' when s2.uid is null then 'rank' "
    "when t.uid is null then 'cut' else 'kept' end as lost_at from g left join s1 on s1.uid = g.uid left join s2 on s2.uid = g.uid left join t on t.uid = g.uid"
)
def stage_loss(spark, sf_dir):
    gold, ranked = _eval_input(spark, sf_dir)
    stages = {"filter": ranked.where("place <= 40"), "rank": ranked.where("place <= 20"), "cut": ranked.where("place <= 10")}
    return ev.stage_loss(gold, stages)


@query(
    EVAL_SQL + ", o as (select m.query_id, m.f2 as a, case when m.query_id < 'src3' then m.f2 else m.recall end as b from m) "
    "select query_id, round(a, 6)::double as a, round(b, 6)::double as b, case when b > a then 'better' when b < a then 'worse' else 'same' end as outcome from o"
)
def paired_runs(spark, sf_dir):
    gold, ranked = _eval_input(spark, sf_dir)
    one = ev.per_query(gold, ranked, 10)
    two = one.withColumn("f2", F.when(F.col("query_id") < "src3", F.col("f2")).otherwise(F.col("recall")))
    out = ev.paired(one, two, "f2")
    return out.select("query_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "outcome")


@query(
    "select count(*) as n, count(*) filter (where o_orderstatus <> 'P') as answered, round(avg(case when o_orderstatus <> 'P' and abs(o_totalprice - round(o_totalprice, -3)) <= 0.005 * abs(round(o_totalprice, -3)) then 1.0 else 0.0 end), 6)::double as accuracy, "
    "round(avg(case when o_orderstatus <> 'P' then case when abs(o_totalprice - round(o_totalprice, -3)) <= 0.005 * abs(round(o_totalprice, -3)) then 1.0 else 0.0 end end), 6)::double as accuracy_answered from orders where o_totalprice > 1000"
)
def competition_score(spark, sf_dir):
    from factloom.operators.series import close_enough

    orders = tb.table(spark, sf_dir, "orders").where("o_totalprice > 1000")
    status = F.when(F.col("o_orderstatus") != "P", "OK").otherwise("ABSTAIN")
    answers = orders.select(status.alias("status"), F.col("o_totalprice").alias("answer"), F.round("o_totalprice", -3).alias("gold"))
    out = ev.execution_score(answers, close_enough(F.col("answer"), F.col("gold")))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "accuracy_answered")})


@query(f"select doc_id, len(list_filter(list_distinct({TOKENS_SQL}), lambda x: x not in ({', '.join(repr(w) for w in tx.STOPWORDS)}))) as n from documents")
def content_terms(spark, sf_dir):
    return tb.table(spark, sf_dir, "documents").select("doc_id", F.size(tx.content_terms("text")).cast("bigint").alias("n"))
