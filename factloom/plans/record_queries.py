"""Classes of documents and cells, answer checks, operand plans, reranking and coverage; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import formulas as fo
from factloom.operators import quality as qu
from factloom.operators import records as rc
from factloom.plans.registry import Registry
from factloom.sources import tables as tb

registry = Registry()
query = registry.query


@query(
    "with x as (select o_orderkey, cast(o_orderkey % 3 as integer) as t, cast(o_orderkey % 5 as integer) - 1 as m, cast(o_orderkey % 120 as integer) - 1 as n from orders) select o_orderkey, "
    "case when t > 0 then 'tabular' when m < 0 then 'unknown' when m > 0 then 'tabular_parse_failed' else 'non_tabular' end as kind, "
    "case when t > 0 then null when m < 0 then 'raw_markup_not_measured' when m > 0 then 'markup_present_but_no_table_parsed' else 'no_table_markup' end as exclusion, "
    "case when t > 0 then 'table' when m < 0 then 'unknown' when m > 0 then 'blocked_defect' else 'explicit_out_of_scope' end as route, "
    "case when n < 0 then 'unknown' when n = 0 then 'none' when n < 50 then 'sparse' else 'dense' end as content from x"
)
def document_kinds(spark, sf_dir):
    made = rc.document_class(F.expr("o_orderkey % 3"), F.expr("o_orderkey % 5 - 1"), F.expr("o_orderkey % 120 - 1"))
    return tb.table(spark, sf_dir, "orders").select("o_orderkey", made.alias("c")).select("o_orderkey", "c.*")


@query(
    "with x as (select *, row_number() over () as rn from lineitem), k as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_suppkey % 7 = 0 as section, l_quantity * case l_linenumber % 3 when 0 then 1 when 1 then 1000 else 10 end as money, "
    "case l_partkey % 5 when 0 then 'note_reference' when 1 then 'metric_code' when 2 then 'ordinal' end as header, l_tax > 0.05 as per_share, l_linenumber as own, l_partkey % 9 as peer from lineitem), "
    "c as (select case when section then 'note_reference_false_value' when money >= 1000 then 'legitimate_small_money' when header = 'note_reference' then 'note_reference_false_value' when header = 'metric_code' then 'metric_code_false_value' "
    "when header = 'ordinal' then 'ordinal_false_value' when per_share then 'legitimate_per_share_or_rate_value' when own <= 3 and peer >= 6 then 'metric_code_false_value' else 'parse_or_column_role_unresolved' end as class from k) select class, count(*) as n from c group by 1"
)
def tiny_money_classes(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem")
    raw = F.when(F.col("l_suppkey") % 7 == 0, F.concat_ws(".", F.col("l_linenumber"), F.lit("1"))).otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    scale = F.expr("case l_linenumber % 3 when 0 then 0 when 1 then 3 else 1 end")
    header = F.expr("case l_partkey % 5 when 0 then 'note_reference' when 1 then 'metric_code' when 2 then 'ordinal' end")
    made = rc.tiny_money_class(raw, F.col("l_quantity"), scale, header, F.col("l_tax") > 0.05, F.col("l_linenumber"), F.col("l_partkey") % 9)
    return lines.groupBy(made.alias("class")).agg(F.count("*").alias("n"))


@query(
    "select count(*) filter (where l_returnflag = 'R' and abs(l_extendedprice) >= 50000) as percents, "
    "count(*) filter (where l_linestatus = 'O' and l_discount - 0.05 < 0 and l_partkey < 1000 and l_tax <= 0.04) as shares from lineitem"
)
def decision_quality(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "percent").otherwise("money")
    header = F.when(F.col("l_linestatus") == "O", "Số Cổ phiếu").otherwise("Amount")
    digits = F.when(F.col("l_partkey") < 1000, 9).otherwise(13)
    return lines.agg(
        F.count_if(rc.implausible_percent(kind, F.col("l_extendedprice"), 50000.0)).alias("percents"),
        F.count_if(rc.ambiguous_shares(header, F.col("l_discount") - 0.05, digits, F.col("l_tax") > 0.04)).alias("shares"),
    )


@query(
    "select l_orderkey as table_uid, l_partkey as cell_uid, l_suppkey as observation_uid, o_orderstatus as statement, p_name as source, s_name as collision_class from lineitem join orders on l_orderkey = o_orderkey "
    "left join (select * from part where p_size > 10) on l_partkey = p_partkey left join (select * from supplier where s_acctbal > 0) on l_suppkey = s_suppkey where l_quantity > 45"
)
def denormalized_observations(spark, sf_dir):
    """Observations with their table's features, and with source cells and collisions where they have some."""
    rows = tb.table(spark, sf_dir, "lineitem").where("l_quantity > 45").selectExpr("l_orderkey as table_uid", "l_partkey as cell_uid", "l_suppkey as observation_uid")
    features = tb.table(spark, sf_dir, "orders").selectExpr("o_orderkey as table_uid", "o_orderstatus as statement")
    cells = tb.table(spark, sf_dir, "part").where("p_size > 10").selectExpr("p_partkey as cell_uid", "p_name as source")
    collisions = tb.table(spark, sf_dir, "supplier").where("s_acctbal > 0").selectExpr("s_suppkey as observation_uid", "s_name as collision_class")
    return rc.denormalized(rows, features, cells, collisions).select("table_uid", "cell_uid", "observation_uid", "statement", "source", "collision_class")


@query(
    "with c as (select l_orderkey, l_linenumber, min(l_returnflag) as flag, max(l_linestatus) as status from lineitem group by 1, 2), "
    "j as (select l.l_orderkey, l.l_linenumber, l.l_partkey as observation_uid, concat_ws(',', case when l.l_returnflag <> c.flag then 'flag' end, case when l.l_linestatus <> c.status then 'status' end) as differs "
    "from lineitem l join c on l.l_orderkey = c.l_orderkey and l.l_linenumber = c.l_linenumber) select * from j where differs <> ''"
)
def column_consistency(spark, sf_dir):
    """Observations that differ from what their column says of all of them."""
    rows = tb.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey as observation_uid", "l_returnflag as flag", "l_linestatus as status")
    columns = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min("flag").alias("flag"), F.max("status").alias("status"))
    return rc.inconsistent_columns(columns, rows, ["l_orderkey", "l_linenumber"], ["flag", "status"])


@query(
    "with e as (select l_orderkey * 10 + l_linenumber as k, l_orderkey as t, l_returnflag, l_tax from lineitem), m as (select distinct k from e where l_returnflag = 'A'), d as (select distinct k from e where l_tax > 0.05), b as (select o_orderkey as t from orders where o_orderstatus = 'P'), "
    "s as (select case when m.k is not null then 'mapped' when d.k is not null then 'dropped' when b.t is not null then 'bad_table' else 'unaccounted' end as state from e left join m on m.k = e.k left join d on d.k = e.k left join b on b.t = e.t) select state, count(*) as n from s group by 1"
)
def accounted_cells(spark, sf_dir):
    """Every eligible cell is mapped, dropped, in a bad table, or nobody knows."""
    cells = tb.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as k", "l_orderkey as t", "l_returnflag", "l_tax")
    bad = tb.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").selectExpr("o_orderkey as t")
    return rc.accounted(cells.select("k", "t"), cells.where("l_returnflag = 'A'"), cells.where("l_tax > 0.05"), bad, "k", "t")


@query(
    "with g as (select l_partkey, count(distinct l_quantity) as n_values from lineitem group by 1 having count(distinct l_quantity) > 1), a as (select l_partkey, count(distinct l_suppkey) as n_anchors from lineitem where l_tax > 0.06 group by 1) "
    "select g.l_partkey, n_values, coalesce(n_anchors, 0) as n_anchors from g left join a using (l_partkey)"
)
def collision_anchors(spark, sf_dir):
    """Collision groups with their anchors, two aggregates of one table."""
    lines = tb.table(spark, sf_dir, "lineitem")
    several = lines.groupBy("l_partkey").agg(F.count_distinct("l_quantity").alias("n_values")).where("n_values > 1")
    anchors = lines.where("l_tax > 0.06").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n_anchors"))
    return several.join(anchors, "l_partkey", "left").select("l_partkey", "n_values", F.coalesce("n_anchors", F.lit(0)).cast("bigint").alias("n_anchors"))


@query(
    "select n_name as entity, count(distinct o_orderkey) as n_tables, count(*) as n_observations, count(*) filter (where l_returnflag <> 'N') as n_ready, round(avg(case when l_returnflag <> 'N' then 1.0 else 0.0 end), 6)::double as support "
    "from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1"
)
def table_support(spark, sf_dir):
    """How many tables and ready observations stand behind each entity."""
    table = lambda n: tb.table(spark, sf_dir, n)
    per_table = table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "N").alias("ready"))
    joined = per_table.join(table("orders"), "o_orderkey").join(table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = joined.groupBy(F.col("n_name").alias("entity")).agg(F.count("*").alias("n_tables"), F.sum("n").alias("n_observations"), F.sum("ready").alias("n_ready"))
    return out.withColumn("support", F.round(F.col("n_ready") / F.col("n_observations"), 6))


VERDICT_SQL = (
    "with x as (select o_orderkey as k, case o_orderkey % 3 when 0 then 'money' when 1 then 'percent' else 'ratio' end as wanted, case o_orderkey % 4 when 0 then 'money' when 1 then 'percent' when 2 then 'ratio' else 'unknown' end as got, "
    "case when o_orderkey % 13 = 0 then null when o_orderkey % 10 = 0 then 1997.0 else o_totalprice end as v, o_orderkey % 7 as bound, o_orderkey % 11 as d from orders), "
    "r as (select k, concat_ws(',', case when bound = 6 then 'OPERAND_COUNT_MISMATCH' end, case when d = 5 then 'DUPLICATE_OPERAND_CELLS' end, "
    "case when got <> 'unknown' and got <> wanted and not (got in ('ratio', 'percent') and wanted in ('ratio', 'percent')) then 'OUTPUT_DIMENSION_MISMATCH' end, case when v is null then 'NON_FINITE' end) as h, "
    "concat_ws(',', case when got = 'unknown' then 'UNDERIVABLE_RESULT_DIMENSION' end, case when wanted = 'percent' and abs(v) > 10000 then 'PERCENT_OUT_OF_PLAUSIBLE_RANGE' end, case when wanted = 'money' and v = 1997 then 'VALUE_IS_A_YEAR' end) as s from x) "
    "select k, case when h <> '' then 'REJECT' when s <> '' then 'ABSTAIN' else 'PASS' end as verdict, case when h <> '' and s <> '' then h || ',' || s else h || s end as reasons from r"
)


@query(VERDICT_SQL)
def answer_verdicts(spark, sf_dir):
    orders = tb.table(spark, sf_dir, "orders")
    wanted = F.expr("case o_orderkey % 3 when 0 then 'money' when 1 then 'percent' else 'ratio' end")
    got = F.expr("case o_orderkey % 4 when 0 then 'money' when 1 then 'percent' when 2 then 'ratio' else 'unknown' end")
    value = F.expr("case when o_orderkey % 13 = 0 then cast(null as double) when o_orderkey % 10 = 0 then cast(1997 as double) else o_totalprice end")
    bound = F.expr("case when o_orderkey % 7 = 6 then 1 else 2 end")
    distinct = F.when(F.col("o_orderkey") % 11 == 5, bound - 1).otherwise(bound)
    made = rc.answer_verdict(F.lit(2), bound, wanted, got, value, distinct, F.array(F.lit(1996), F.lit(1997)))
    return orders.select(F.col("o_orderkey").alias("k"), made.alias("m")).select("k", "m.verdict", F.array_join("m.reasons", ",").alias("reasons"))


@query(
    "select l_orderkey, l_linenumber, l_partkey, case l_partkey % 4 when 0 then round(l_extendedprice * 1000 / 1000000, 6) when 1 then round(l_discount * 100, 6) when 2 then round(l_discount * 100 / 100, 6) end as value from lineitem"
)
def requested_units(spark, sf_dir):
    """Thousands asked for in millions, ratios asked for in per cent and the other way round, and kinds that don't agree."""
    lines = tb.table(spark, sf_dir, "lineitem")
    kind = F.expr("case l_partkey % 4 when 0 then 'money' when 1 then 'ratio' when 2 then 'percent' else 'shares' end")
    wanted = F.expr("case l_partkey % 4 when 0 then 'money' when 1 then 'percent' when 2 then 'ratio' else 'money' end")
    value = F.expr("case l_partkey % 4 when 0 then l_extendedprice when 1 then l_discount when 2 then l_discount * 100 else l_quantity end")
    made = rc.in_requested_unit(value, F.lit(3), kind, F.lit(6), wanted)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.round(made, 6).alias("value"))


@query(
    "with m as (select o_custkey as question, o_orderstatus as metric from orders), e as (select o_custkey as question, o_orderpriority as entity from orders where o_totalprice > 300000), p as (select distinct o_custkey as question, cast(year(o_orderdate) as integer) as period from orders) "
    "select question, metric, entity, period, count(*) as uses from m join e using (question) join p using (question) group by 1, 2, 3, 4"
)
def operand_plan(spark, sf_dir):
    """Metrics, entities and periods of each question, their product per question, each operand once."""
    orders = tb.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "question")
    metrics = orders.selectExpr("question", "o_orderstatus as metric")
    entities = orders.where("o_totalprice > 300000").selectExpr("question", "o_orderpriority as entity")
    periods = orders.select("question", F.year("o_orderdate").alias("period")).distinct()
    return rc.operand_requests(metrics, entities, periods, "question")


ASKED_METRICS = ["current_ratio", "revenue", "quick_ratio", "net_margin", "gross"]
LEAVES = {n: f.leaves for n, f in fo.registry().items() if n in ASKED_METRICS}


def _pick(index: str) -> str:
    return f"case {index} " + " ".join(f"when {n} then '{m}'" for n, m in enumerate(ASKED_METRICS)) + " end"


@query(
    f"with a as (select o_custkey as question, {_pick('o_orderkey % 5')} as metric from orders), l as (select * from (values "
    + ", ".join(f"('{n}', '{leaf}')" for n, leaves in LEAVES.items() for leaf in leaves)
    + ") as v(name, leaf)) select distinct question, coalesce(leaf, metric) as metric, name as via from a left join l on name = metric"
)
def query_expansion(spark, sf_dir):
    asked = tb.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question"), F.expr(_pick("o_orderkey % 5")).alias("metric"))
    return rc.expanded_metrics(asked, LEAVES)


#: A policy of adjustments, as a deployment would set it.
POLICY = {"exact": 1.5, "code": 2.0, "hierarchy": 0.25, "statement": 1.0, "period": 0.75, "component": 0.8, "recoverable": 0.6, "collision": 0.4}


@query(
    "select l_orderkey, l_linenumber, l_partkey, round(case when l_returnflag = 'A' then 1.5 else 0 end + case when l_linestatus = 'F' then 2 else 0 end + case when l_linenumber > 1 then least(4, l_linenumber - 1) * 0.25 else 0 end "
    "+ case when l_quantity > 25 then 1 else 0 end + case when l_discount > 0.05 then 0.75 else 0 end - case when l_tax > 0.06 then 0.8 else 0 end - case when l_tax < 0.02 then 0.6 else 0 end - case when l_suppkey % 5 = 0 then 0.4 else 0 end "
    "+ greatest(-0.5, least(0.5, l_quantity / 40 - 0.5)), 6) + 0.0 as adjustment from lineitem"
)
def hierarchy_adjustments(spark, sf_dir):
    c = F.col
    made = rc.hierarchy_adjustment(
        POLICY, c("l_returnflag") == "A", c("l_linestatus") == "F", c("l_linenumber"), c("l_quantity") > 25, c("l_discount") > 0.05, c("l_tax") > 0.06, c("l_tax") < 0.02, c("l_suppkey") % 5 == 0, c("l_quantity") / 40
    )
    return tb.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.round(made, 6) + F.lit(0.0)).alias("adjustment"))


FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@query(
    "with q as (select l_orderkey, " + ", ".join(f"avg(case when l_returnflag = 'R' then {f} end) - avg(case when l_returnflag <> 'R' then {f} end) as {f}" for f in FEATURES) + " from lineitem group by 1), "
    "g as (select " + ", ".join(f"avg({f}) as {f}" for f in FEATURES) + " from q), s as (select " + ", ".join(f"stddev_pop({f}) as s_{f}" for f in FEATURES) + " from lineitem) "
    + " union all ".join(f"select '{f}' as feature, round({f} / s_{f}, 6) as weight from g, s" for f in FEATURES)
)
def reranker_training(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem").withColumn("good", (F.col("l_returnflag") == "R").cast("int"))
    return rc.train_reranker(lines, "l_orderkey", "good", FEATURES).withColumn("weight", F.round("weight", 6))


@query(
    "with h as (select distinct l_orderkey, l_partkey from lineitem where l_extendedprice > 30000), f as (select l_orderkey from h group by 1 having count(*) <= 2) select l_orderkey, l_partkey from h where l_orderkey in (select l_orderkey from f)"
)
def proxy_gold(spark, sf_dir):
    return rc.proxy_gold(tb.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", F.col("l_extendedprice") > 30000, 2)


@query(
    "select o_orderpriority, count(*) as n, count(*) filter (where o_orderstatus <> 'P') as parsed, count(*) filter (where o_orderstatus <> 'P' and o_totalprice > 100000) as bound, "
    "count(*) filter (where o_orderstatus <> 'P' and o_totalprice > 100000 and o_orderdate < timestamp '1998-01-01') as answered from orders group by 1"
)
def coverage_report(spark, sf_dir):
    stages = {"parsed": F.col("o_orderstatus") != "P", "bound": F.col("o_totalprice") > 100000, "answered": F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")}
    return rc.coverage(tb.table(spark, sf_dir, "orders"), "o_orderpriority", stages)


RETIRED = [
    qu.Rule("R-OLD-NULL-KEY", "critical", "l_orderkey IS NULL"),
    qu.Rule("R-OLD-NEGATIVE", "critical", "l_quantity < 0"),
    qu.Rule("R-OLD-FLAG", "error", "l_returnflag = 'A'"),
]


@query(" union all ".join(f"select '{r.rule_id}' as rule_id, count(*) = 0 as retired from lineitem where {r.condition}" for r in RETIRED))
def retired_rules(spark, sf_dir):
    """A retired rule must find nothing any more."""
    return qu.rule_counts(tb.table(spark, sf_dir, "lineitem"), RETIRED, "lineitem").select("rule_id", (F.col("n") == 0).alias("retired"))


@query(
    "select o_orderkey, o_orderstatus <> 'P' and n_obs > 0 and n_ready >= 1 and not (n_ready * 4 < n_obs) as retrieval_ready from (select o_orderkey, o_orderstatus, count(l_orderkey) as n_obs, count(*) filter (where l_returnflag <> 'N') as n_ready "
    "from orders left join lineitem on o_orderkey = l_orderkey group by 1, 2)"
)
def retrieval_ready(spark, sf_dir):
    """Tables that retrieval may offer: parsed, with observations, a quarter of them ready at least."""
    lines = tb.table(spark, sf_dir, "lineitem")
    counts = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_obs"), F.count_if(F.col("l_returnflag") != "N").alias("n_ready"))
    joined = tb.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(counts, "o_orderkey", "left").na.fill(0, ["n_obs", "n_ready"])
    ready = (F.col("o_orderstatus") != "P") & (F.col("n_obs") > 0) & (F.col("n_ready") >= 1) & ~(F.col("n_ready") * 4 < F.col("n_obs"))
    return joined.select("o_orderkey", ready.alias("retrieval_ready"))
