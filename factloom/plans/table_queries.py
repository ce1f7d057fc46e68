"""Queries on joins, sets, quality, text and numbers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import numbers as nu
from factloom.functions import text as tx
from factloom.operators import aggregates as ag
from factloom.operators import joins as jo
from factloom.operators import quality as qu
from factloom.operators import setops as so
from factloom.plans.registry import Registry
from factloom.sources import tables as tb

registry = Registry()
query = registry.query


# ---- joins


@query(
    "select event_id, user_id, (select max(s.event_id) from events s where s.user_id = e.user_id and s.event_type = 'signup' "
    "and (s.ts < e.ts or (s.ts = e.ts and s.event_id < e.event_id)) and not exists (select 1 from events t where t.user_id = e.user_id and t.event_type = 'signup' "
    "and (t.ts < e.ts or (t.ts = e.ts and t.event_id < e.event_id)) and (t.ts > s.ts or (t.ts = s.ts and t.event_id > s.event_id)))) as last_signup from events e"
)
def asof_section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tb.table(spark, sf_dir, "events")
    found = jo.asof_backward(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "last_signup")
    return found.select("event_id", "user_id", "last_signup")


@query(
    "with u as (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from lineitem group by 1, 2) "
    "select a.l_orderkey, a.l_linenumber, b.l_partkey as previous_part from u a "
    "left join u b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber + 1"
)
def previous_row_lookup(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return jo.previous_row(lines, ["l_orderkey"], "l_linenumber", "l_partkey", "previous_part").select("l_orderkey", "l_linenumber", "previous_part")


@query(
    "with s as (select user_id, event_id as span_id, epoch(ts)::bigint as a, epoch(ts)::bigint + 7200 as b from events where event_type = 'signup') "
    "select e.event_id, s.span_id from events e join s on e.user_id = s.user_id and epoch(e.ts)::bigint >= s.a and epoch(e.ts)::bigint < s.b"
)
def interval_join(spark, sf_dir):
    # Seconds are rounded as the SQL's cast does, half to even, on the wall clock of no time zone.
    since = "cast(ts as timestamp_ntz) - timestamp_ntz'1970-01-01'"
    parts = " + ".join(f"extract({unit} from {since}) * {n}" for unit, n in (("day", 86400), ("hour", 3600), ("minute", 60), ("second", 1)))
    seconds = F.rint(F.expr(parts).cast("double")).cast("bigint")
    events = tb.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", seconds.alias("at"))
    spans = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), F.col("at").alias("a"), (F.col("at") + 7200).alias("b"))
    return jo.interval_join(events.select("event_id", "user_id", "at"), spans, "user_id", "at", "a", "b", 7200).select("event_id", "span_id")


@query(
    "select 'customer' as parent, count(*) as n from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer where c_acctbal > 0) "
    "union all select 'part', count(*) from lineitem where l_partkey not in (select p_partkey from part where p_size < 40) "
    "union all select 'supplier', count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier)"
)
def fk_anti_joins(spark, sf_dir):
    table = lambda n: tb.table(spark, sf_dir, n)
    checks = {
        "customer": jo.orphans(table("orders"), table("customer").where("c_acctbal > 0"), ["o_custkey"], ["c_custkey"]),
        "part": jo.orphans(table("lineitem"), table("part").where("p_size < 40"), ["l_partkey"], ["p_partkey"]),
        "supplier": jo.orphans(table("lineitem"), table("supplier"), ["l_suppkey"], ["s_suppkey"]),
    }
    out = None
    for name, found in checks.items():
        one = found.agg(F.count("*").alias("n")).select(F.lit(name).alias("parent"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("select o_orderkey, o_custkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def semi_join(spark, sf_dir):
    returned = tb.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return tb.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(returned, "o_orderkey", "left_semi")


@query(
    "with a as (select * from orders where o_orderstatus <> 'P'), b as (select o_orderkey, o_orderstatus, case when o_orderkey % 5 = 0 then 'X' else o_orderpriority end as o_orderpriority from orders where o_orderstatus <> 'F') "
    "select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'removed' "
    "when a.o_orderpriority <> b.o_orderpriority then 'changed' else 'same' end as change from a full join b on a.o_orderkey = b.o_orderkey"
)
def full_outer_differential(spark, sf_dir):
    orders = tb.table(spark, sf_dir, "orders")
    old = orders.where("o_orderstatus <> 'P'")
    new = orders.where("o_orderstatus <> 'F'").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderpriority")))
    return jo.differential(old, new, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query(
    "with c as (select l_orderkey, l_linenumber, l_returnflag from lineitem) select l_orderkey, l_linenumber, "
    "not exists (select 1 from c d where d.l_orderkey = c.l_orderkey and d.l_returnflag = c.l_returnflag and d.l_linenumber <> c.l_linenumber) as discriminative from c"
)
def discriminative_path(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return jo.discriminative(lines, ["l_orderkey"], "l_returnflag", "l_linenumber").select("l_orderkey", "l_linenumber", "discriminative")


@query(
    "with c as (select l_orderkey as scope, l_linenumber as uid, l_returnflag as role, l_quantity as score from lineitem), "
    "j as (select a.scope, a.uid as uid_0, b.uid as uid_1, a.score + b.score as total from c a join c b on a.scope = b.scope where a.role = 'A' and b.role = 'R' and a.uid <> b.uid), "
    "r as (select *, row_number() over (partition by scope order by total desc, uid_0, uid_1) as place, count(*) over (partition by scope, total) as same from j) "
    "select scope, uid_0, uid_1, total, same > 1 as tie from r where place = 1"
)
def joint_binding_best(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem")
    c = lines.selectExpr("l_orderkey scope", "l_linenumber uid", "l_returnflag role", "l_quantity score")
    return jo.best_binding(c, ["scope"], "role", ["A", "R"], "uid", "score")


@query(
    "with b as (select l_orderkey as scope, l_returnflag as leaf, max(l_quantity) as score, arg_max(l_partkey, (l_quantity, -l_partkey)) as uid from lineitem where l_returnflag in ('A', 'N', 'R') group by 1, 2) "
    "select scope, sum(score) as total from b group by scope having count(*) = 3 and count(distinct uid) = 3"
)
def coherent_formula_scope(spark, sf_dir):
    c = tb.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey scope", "l_partkey uid", "l_returnflag leaf", "l_quantity score")
    return jo.coherent_scope(c, ["scope"], "leaf", ["A", "N", "R"], "uid", "score")


@query(
    "with a as (select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as joined from orders where o_orderstatus <> 'F' group by 1), "
    "r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by case when o_orderstatus <> 'F' then 0 else 1 end, o_orderkey) as place, "
    "count(*) filter (where o_orderstatus <> 'F') over (partition by o_custkey) as base from orders where o_custkey in (select o_custkey from orders where o_orderstatus <> 'F') "
    "and o_custkey in (select o_custkey from orders where o_orderstatus = 'F')) "
    "select o_custkey, string_agg(o_orderkey::varchar, ',' order by place) as entries from r where place <= greatest(base, 6) group by 1"
)
def baseline_overlay(spark, sf_dir):
    orders = tb.table(spark, sf_dir, "orders")
    entries = lambda df: df.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("entries"))
    base, extra = entries(orders.where("o_orderstatus <> 'F'")), entries(orders.where("o_orderstatus = 'F'"))
    both = base.join(extra.select("o_custkey"), "o_custkey", "left_semi")
    merged = jo.overlay(both, extra.join(both.select("o_custkey"), "o_custkey", "left_semi"), "o_custkey", 6)
    return merged.select("o_custkey", F.array_join("entries", ",").alias("entries"))


# ---- sets


@query(
    "with u as (select event_id from events where value < 200), p as (select event_id from events where event_type = 'purchase' or value > 50), q as (select event_id from events where event_type <> 'purchase' and value <= 40) "
    "select 'lost' as \"check\", (select count(*) from (select * from u except select * from p except select * from q)) as n "
    "union all select 'foreign', (select count(*) from ((select * from p union select * from q) except select * from u)) "
    "union all select 'shared', (select count(*) from (select * from p intersect select * from q)) "
    "union all select 'parts_total', (select count(*) from p) + (select count(*) from q) union all select 'universe_total', (select count(*) from u)"
)
def setops_no_loss(spark, sf_dir):
    events = tb.table(spark, sf_dir, "events")
    parts = so.partition_of(events, {"p": "event_type = 'purchase' OR value > 50", "q": "event_type <> 'purchase' AND value <= 40"})
    return so.no_loss(events.where("value < 200"), parts, "event_id")


@query(
    "with a as (select distinct user_id from events where event_type = 'purchase'), b as (select distinct user_id from events where event_type = 'error') "
    "select coalesce(a.user_id, b.user_id) as user_id, case when b.user_id is null then 'a_only' when a.user_id is null then 'b_only' else 'both' end as relation from a full join b on a.user_id = b.user_id"
)
def set_relations(spark, sf_dir):
    events = tb.table(spark, sf_dir, "events")
    return so.set_relation(events.where("event_type = 'purchase'"), events.where("event_type = 'error'"), "user_id")


@query(
    "(select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O') "
    "except select o_custkey from orders where o_orderstatus = 'P'"
)
def setops_intersect_except(spark, sf_dir):
    orders = tb.table(spark, sf_dir, "orders")
    customers = lambda status: orders.where(F.col("o_orderstatus") == status).select("o_custkey")
    return customers("F").intersect(customers("O")).subtract(customers("P"))


@query(
    "with r as (select user_id, event_type, min(case event_type when 'purchase' then 0 when 'click' then 1 else 2 end) as p from events group by 1, 2) "
    "select user_id, event_type as key, row_number() over (partition by user_id order by p, event_type) as place from r qualify place <= 3"
)
def ordered_union(spark, sf_dir):
    events = tb.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), F.lit(0).alias("place"))
    parts = [events.where("key = 'purchase'"), events.where("key = 'click'"), events.where("key NOT IN ('purchase', 'click')")]
    return so.ordered_union(parts, ["user_id"], "key", 3)


# ---- quality

RULES = [
    qu.Rule("Q-EVT-NEGATIVE", "error", "value < 0"),
    qu.Rule("Q-EVT-LARGE", "warning", "value > 150"),
    qu.Rule("Q-EVT-ERROR", "info", "event_type = 'error'"),
    qu.Rule("Q-EVT-PROPS", "error", "props IS NULL OR NOT props LIKE '{%}'"),
]
RULES_SQL = " union all ".join(
    f"select 'events' as \"table\", cast(event_id as varchar) as uid, '{r.rule_id}' as rule_id, '{r.severity}' as severity from events where {r.condition}" for r in RULES
)


@query(RULES_SQL)
def quality_rules_union(spark, sf_dir):
    return qu.findings(tb.table(spark, sf_dir, "events"), RULES, "event_id", "events")


@query(" union all ".join(f"select 'events' as \"table\", '{r.rule_id}' as rule_id, '{r.severity}' as severity, count(*) as n from events where {r.condition}" for r in RULES))
def quality_rule_counts(spark, sf_dir):
    return qu.rule_counts(tb.table(spark, sf_dir, "events"), RULES, "events")


@query(f"select * exclude (place) from (select *, row_number() over (partition by rule_id order by uid) as place from ({RULES_SQL})) where place <= 20")
def quality_samples(spark, sf_dir):
    return qu.sampled(qu.findings(tb.table(spark, sf_dir, "events"), RULES, "event_id", "events"), 20)


@query(
    " union all ".join(
        f"select 'documents' as \"table\", '{c}' as \"column\", avg(case when {c} is null then 1.0 else 0.0 end)::double as null_share, avg(case when {c} is null then 1.0 else 0.0 end) <= {b} as within from documents"
        for c, b in (("doc_id", 0.0), ("lang", 0.1), ("text", 0.0))
    )
)
def null_budget(spark, sf_dir):
    return qu.null_budget(tb.table(spark, sf_dir, "documents"), {"doc_id": 0.0, "lang": 0.1, "text": 0.0}, "documents")


@query("select user_id, event_type, count(*) as n from events group by 1, 2 having count(*) > 1")
def dup_keys(spark, sf_dir):
    return qu.duplicate_keys(tb.table(spark, sf_dir, "events"), ["user_id", "event_type"])


REQUIRED = [qu.Requirement("l_returnflag", "not_in", "flag_unknown", ("N",)), qu.Requirement("l_partkey", "is_not_null", "part_missing")]
BLOCKING = [qu.Requirement("l_linestatus", "in", "status_open", ("F",)), qu.Requirement("l_discount_class", "not_in", "discount_high", ("high",))]
WARNING = [qu.Requirement("l_shipdate", "is_not_null", "ship_missing"), qu.Requirement("l_tax_class", "not_blank", "untaxed")]


def _readiness_input(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem")
    return lines.withColumns(
        {
            "l_discount_class": F.when(F.col("l_discount") > 0.08, "high").otherwise("low"),
            "l_tax_class": F.when(F.col("l_tax") > 0, "taxed").otherwise(""),
        }
    )


@query(
    "select l_orderkey, l_linenumber, l_returnflag <> 'N' as execution_candidate, l_returnflag <> 'N' and l_linestatus = 'F' and not l_discount > 0.08 as execution_ready, "
    "case when l_returnflag = 'N' then 'flag_unknown' else '' end as non_candidate, "
    "case when l_returnflag = 'N' then '' else concat_ws(',', case when l_discount > 0.08 then 'discount_high' end, case when l_linestatus <> 'F' then 'status_open' end) end as blocking, "
    "case when l_tax > 0 then '' else 'untaxed' end as warning from lineitem"
)
def readiness_flags(spark, sf_dir):
    out = qu.readiness(_readiness_input(spark, sf_dir), REQUIRED, BLOCKING, WARNING)
    joined = {k: F.array_join(f"{v}_reasons", ",") for k, v in (("non_candidate", "non_candidate"), ("blocking", "blocking"), ("warning", "warning"))}
    return out.withColumns(joined).select("l_orderkey", "l_linenumber", "execution_candidate", "execution_ready", *joined)


@query(
    "with r as (select l_linestatus, unnest(list_filter([case when l_discount > 0.08 then 'discount_high' end, case when l_linestatus <> 'F' then 'status_open' end], lambda x: x is not null)) as reason from lineitem where l_returnflag <> 'N'), "
    "c as (select l_linestatus, reason, count(*) as n from r group by 1, 2) select l_linestatus, string_agg(reason || '=' || n, ',' order by reason) as histogram from c group by 1"
)
def reason_histogram(spark, sf_dir):
    out = qu.readiness(_readiness_input(spark, sf_dir), REQUIRED, BLOCKING, WARNING)
    return ag.reason_histogram(out, ["l_linestatus"], "blocking_reasons")


COLLISION_KEYS = ["l_partkey", "l_returnflag"]


@query(
    "with g as (select l_partkey, l_returnflag, coalesce(case when l_quantity > 10 then cast(year(l_shipdate) as varchar) end, '') as period_key, count(*) as n_obs, count(distinct l_quantity) as n_values, "
    "count(distinct l_orderkey) as n_rows, count(distinct l_linenumber) as n_columns, count(distinct l_suppkey) as n_cells, count(distinct case when l_tax > 0.04 then l_suppkey end) as n_anchors from lineitem group by 1, 2, 3) "
    "select *, case when n_cells < n_obs then 'physical_duplicate' when n_rows = 1 and n_columns > 1 then 'missing_column_group' when n_anchors > 1 then 'missing_row_parent' "
    "when n_anchors = 1 then 'missing_dimension' else 'missing_label_or_split' end as collision_class from g where n_values > 1"
)
def collision_groups(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem").withColumns(
        {
            "period": F.when(F.col("l_quantity") > 10, F.year("l_shipdate")),
            "anchor": F.when(F.col("l_tax") > 0.04, F.col("l_suppkey")),
        }
    )
    return qu.collision_groups(lines, COLLISION_KEYS, "period", "l_quantity", "l_orderkey", "l_linenumber", "l_suppkey", "anchor")


IDENTITIES = [
    qu.Identity("gross", "gross", ("kept",), ("returned",)),
    qu.Identity("all_returned", "gross", ("returned",)),
    qu.Identity("net", "gross", ("net", "discount")),
    qu.Identity("whole_units", "gross", ("whole",)),
    qu.Identity("order_price", "price", ("gross",)),
    qu.Identity("quantity", "quantity", ("small",), ("large",)),
]
CODES = {
    "gross": "sum(cast(l_extendedprice as decimal(18,4)))",
    "kept": "sum(case when l_returnflag <> 'R' then cast(l_extendedprice as decimal(18,4)) end)",
    "returned": "sum(case when l_returnflag = 'R' then cast(l_extendedprice as decimal(18,4)) end)",
    "net": "sum(cast(round(l_extendedprice * (1 - l_discount), 0) as decimal(18,4)))",
    "discount": "sum(cast(round(l_extendedprice * l_discount, 0) as decimal(18,4)))",
    "whole": "sum(cast(floor(l_extendedprice) as decimal(18,4)))",
    "quantity": "sum(cast(l_quantity as decimal(18,4)))",
    "small": "sum(case when l_quantity <= 25 then cast(l_quantity as decimal(18,4)) end)",
    "large": "sum(case when l_quantity > 25 then cast(l_quantity as decimal(18,4)) end)",
}
IDENTITY_SQL = (
    "with c as (select l_orderkey, " + ", ".join(f"cast({e} as double) as {c}" for c, e in CODES.items()) + " from lineitem group by 1), "
    "w as (select o_orderkey as scope, c.*, o_totalprice as price from orders left join c on l_orderkey = o_orderkey), g as ("
    "select scope, 'gross' as identity, gross - (kept + coalesce(returned, 0)) as gap from w union all select scope, 'all_returned', gross - returned from w "
    "union all select scope, 'net', gross - (net + discount) from w union all select scope, 'whole_units', gross - whole from w "
    "union all select scope, 'order_price', price - gross from w union all select scope, 'quantity', quantity - (small + coalesce(large, 0)) from w) "
    "select scope, identity, round(gap, 2) + 0.0 as gap, case when gap is null then 'UNTESTABLE' when abs(gap) <= 2 then 'OK' else 'BROKEN' end as status from g"
)


@query(IDENTITY_SQL)
def arithmetic_identities(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem")
    sums = lines.groupBy(F.col("l_orderkey").alias("scope")).agg(*[F.expr(e).cast("double").alias(c) for c, e in CODES.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("value")) for c in CODES])
    price = tb.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scope"), F.lit("price").alias("code"), F.col("o_totalprice").alias("value"))
    found = qu.reconcile(price.unionByName(sums.select("scope", F.inline(rows))), ["scope"], "code", "value", IDENTITIES)
    return found.withColumn("gap", F.round("gap", 2) + F.lit(0.0))


@query("select c_mktsegment, string_agg(distinct cast(c_nationkey as varchar), ',' order by cast(c_nationkey as varchar)) as joined from customer group by 1")
def group_concat_distinct(spark, sf_dir):
    return ag.group_concat_distinct(tb.table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_nationkey")


@query("select l_orderkey, string_agg(l_returnflag, ' | ' order by l_linenumber, l_returnflag) as joined from lineitem group by 1")
def group_concat_ordered(spark, sf_dir):
    return ag.group_concat(tb.table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber")


@query(
    "select p_type as scope, list_sort(list(length(regexp_replace(cast(p_retailprice as varchar), '[^0-9]', '', 'g'))))[count(*) // 2 + 1]::integer as median_digits, "
    "avg(case when length(regexp_replace(cast(p_size as varchar), '[^0-9]', '', 'g')) <= 2 then 1.0 else 0.0 end)::double as share_short from part group by 1"
)
def digit_profile(spark, sf_dir):
    part = tb.table(spark, sf_dir, "part")
    text = part.select(F.col("p_type").alias("scope"), F.col("p_retailprice").cast("string").alias("text"), F.col("p_size").cast("string").alias("size"))
    first = qu.column_profile(text, ["scope"], "text").select("scope", F.col("median_digits").cast("int").alias("median_digits"))
    return first.join(qu.column_profile(text, ["scope"], "size").select("scope", "share_short"), "scope")


GATE_LIMITS = {"lost": 0, "foreign": 0, "shared": 0, "parts_total": 10**12}


@query(
    "with u as (select o_orderkey as k from orders where o_orderstatus <> 'P'), a as (select distinct l_orderkey as k from lineitem where l_returnflag = 'R'), "
    "b as (select distinct l_orderkey as k from lineitem where l_quantity > 40), p as (select * from a union all select * from b), n as ("
    "select 'lost' as gate, (select count(*) from (select k from u except select k from p)) as n, 0 as most union all select 'foreign', (select count(*) from (select k from p except select k from u)), 0 "
    "union all select 'shared', (select count(*) from (select k from a intersect select k from b)), 0 union all select 'parts_total', (select count(*) from p), 1000000000000 "
    "union all select 'universe_total', (select count(*) from u), 0) select gate, n, n <= most as passed from n"
)
def release_gates(spark, sf_dir):
    orders, lines = (tb.table(spark, sf_dir, n) for n in ("orders", "lineitem"))
    part = lambda condition: lines.where(condition).select(F.col("l_orderkey").alias("key")).distinct()
    universe = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"))
    return qu.gates(so.no_loss(universe, {"returned": part("l_returnflag = 'R'"), "large": part("l_quantity > 40")}, "key"), GATE_LIMITS)


# ---- text

FOLD_SQL = "lower(strip_accents(text))"
NORM_SQL = f"trim(regexp_replace({FOLD_SQL}, '\\s+', ' ', 'g'))"


@query(f"select doc_id, md5({NORM_SQL}) as digest from documents")
def text_normalize(spark, sf_dir):
    return tb.table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalize_search("text").cast("binary")).alias("digest"))


@query(
    f"select doc_id, len(t) as n_terms, len(list_distinct(t)) as n_distinct from (select doc_id, list_filter(string_split_regex({NORM_SQL}, '[^a-z0-9]+'), lambda x: x <> '') as t from documents)"
)
def tokenize_terms(spark, sf_dir):
    docs = tb.table(spark, sf_dir, "documents").select("doc_id", tx.words("text").alias("t"))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n_terms"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@query(
    f"select doc_id from (select doc_id, ' ' || array_to_string(list_filter(string_split_regex({NORM_SQL}, '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' ' as t from documents) where contains(t, ' of the ')"
)
def phrase_mentioned(spark, sf_dir):
    return tb.table(spark, sf_dir, "documents").where(tx.phrase_mentioned(F.col("text"), "of the")).select("doc_id")


@query(
    "with t as (select doc_id, lead(doc_id) over (partition by source order by doc_id) as b, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) as s from documents), "
    "p as (select t.doc_id as a, t.b, len(list_intersect(t.s, o.s)) as i, len(list_distinct(list_concat(t.s, o.s))) as u from t join t o on o.doc_id = t.b) "
    "select a, b, case when u = 0 then null else round(i / u, 6) end as jaccard from p"
)
def token_jaccard(spark, sf_dir):
    """Token overlap of every whole text with the next document of its source; only ids go through the window."""
    docs = tb.table(spark, sf_dir, "documents")
    tokens = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))
    after = F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    pairs = docs.select(F.col("doc_id").alias("a"), after.alias("b")).where("b IS NOT NULL")
    one = docs.select(F.col("doc_id").alias("a"), tokens.alias("s"))
    two = docs.select(F.col("doc_id").alias("b"), tokens.alias("t"))
    joined = pairs.join(one, "a").join(two, "b")
    return joined.select("a", "b", F.round(tx.token_jaccard(F.col("s"), F.col("t")), 6).alias("jaccard"))


@query(
    "select c_custkey, substring(sha256(concat_ws(chr(31), c_name, coalesce(cast(case when c_nationkey % 3 > 0 then c_nationkey end as varchar), 'None'))), 1, 16) as uid from customer"
)
def deterministic_uid(spark, sf_dir):
    customers = tb.table(spark, sf_dir, "customer")
    return customers.select("c_custkey", tx.uid(F.col("c_name"), F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey"))).alias("uid"))


@query("select event_id, cast(json_extract_string(props, '$.k') as integer) as k, coalesce(cast(json_extract_string(props, '$.k') as integer) > 50, false) as high from events")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k int").getField("k")
    return tb.table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(k > 50, F.lit(False)).alias("high"))


# ---- numbers, units, periods: printed from the tables' own values, so that the SQL knows them without parsing

NUMBER_FORMS = """case o_orderkey % 10
  when 0 then replace(format_number(n, 0), ',', '.')
  when 1 then format_number(n, 0)
  when 2 then concat('(', replace(format_number(n, 0), ',', '.'), ')')
  when 3 then '-'
  when 4 then concat(cast(n % 100 as string), ',', cast(n % 10 as string), '%')
  when 5 then replace(format_number(n, 0), ',', ' ')
  when 6 then concat(replace(format_number(n, 0), ',', '.'), ',25')
  when 7 then concat('-', cast(n as string))
  when 8 then concat(cast(n % 9 + 1 as string), '.', lpad(cast(n % 1000 as string), 3, '0'))
  else 'n/a' end"""
NUMBER_CONVENTION = "case when o_orderkey % 10 in (0, 2) then 'dot_thousands' else 'unknown' end"


@query(
    "with t as (select o_orderkey, o_custkey, o_orderkey % 10 as k, o_orderkey * 7919 + 1 as n from orders), "
    "s as (select *, case when k in (3, 9) then 'missing' when k = 8 or (k = 1 and n between 1000 and 999999) then 'ambiguous' else 'ok' end as status from t) "
    "select o_orderkey, status, case when status = 'ok' then cast(case k when 2 then -n when 4 then n % 100 + (n % 10) / 10 when 6 then n + 0.25 when 7 then -n else n end as double) end as value from s"
)
def number_parse(spark, sf_dir):
    """Numbers of every printed form; the form follows the key."""
    orders = tb.table(spark, sf_dir, "orders").withColumn("n", F.expr("o_orderkey * 7919 + 1"))
    parsed = nu.parse_number(F.expr(NUMBER_FORMS), F.expr(NUMBER_CONVENTION))
    return orders.select("o_orderkey", parsed.getField("status").alias("status"), parsed.getField("value").alias("value"))


PERIOD_FORMS = """case o_orderkey % 9
  when 0 then date_format(o_orderdate, "dd/MM/yyyy")
  when 1 then concat('01/01/', year(o_orderdate))
  when 2 then concat('Quý ', quarter(o_orderdate), '/', year(o_orderdate))
  when 3 then concat(month(o_orderdate), '/', year(o_orderdate))
  when 4 then concat('Year ', year(o_orderdate))
  when 5 then 'cuối năm'
  when 6 then 'beginning of the year'
  when 7 then concat('31/02/', year(o_orderdate))
  else concat('Decree ', o_orderkey, '/', year(o_orderdate), '/TT') end"""


@query(
    "with t as (select o_orderkey, o_orderkey % 9 as k, cast(o_orderdate as date) as d, cast(1990 + o_orderkey % 30 as integer) as a from orders) select o_orderkey, "
    "case k when 0 then case when month(d) = 1 and day(d) = 1 then 'opening' else 'date' end when 1 then 'opening' when 2 then 'quarter' when 3 then 'month' when 4 then 'year' "
    "when 5 then 'relative_end' when 6 then 'relative_start' when 7 then 'invalid' else 'none' end as kind, "
    "cast(case k when 0 then case when month(d) = 1 and day(d) = 1 then d - interval 1 day else d end when 1 then make_date(year(d) - 1, 12, 31) when 2 then last_day(make_date(year(d), 3 * quarter(d), 1)) "
    "when 3 then last_day(d) when 4 then make_date(year(d), 12, 31) when 5 then make_date(a, 12, 31) when 6 then make_date(a - 1, 12, 31) end as date) as period_end from t"
)
def period_parse(spark, sf_dir):
    orders = tb.table(spark, sf_dir, "orders").withColumn("text", F.expr(PERIOD_FORMS)).withColumn("anchor", F.expr("cast(1990 + o_orderkey % 30 as int)"))
    parsed = nu.parse_period(F.col("text"), F.col("anchor"))
    return orders.select("o_orderkey", parsed.getField("kind").alias("kind"), parsed.getField("period_end").alias("period_end"))


@query(
    "with t as (select o_orderkey, o_orderkey % 4 as k, cast(o_orderdate as date) as d from orders) select o_orderkey, "
    "case k when 0 then 'date' when 1 then 'none' when 2 then 'opening' else 'none' end as row_kind, "
    "case k when 0 then d when 2 then make_date(year(d) - 1, 12, 31) end as row_end, "
    "case k when 3 then 'quarter' else 'document_year' end as table_kind, case k when 3 then last_day(make_date(year(d), 3 * quarter(d), 1)) else make_date(2000 + cast(k as integer), 12, 31) end as table_end, "
    "k in (0, 2) as matches_year from t where not (k = 0 and month(d) = 1 and day(d) = 1)"
)
def period_axes(spark, sf_dir):
    """Periods of rows, by full dates only, and of tables, which fall back to the document's year."""
    orders = tb.table(spark, sf_dir, "orders").where("NOT (o_orderkey % 4 = 0 AND month(o_orderdate) = 1 AND day(o_orderdate) = 1)")
    label = F.expr("case o_orderkey % 4 when 0 then concat('Balance › 01/02/1980 › at ', date_format(o_orderdate, 'dd/MM/yyyy')) when 1 then concat('Note ', year(o_orderdate)) when 2 then concat('at 01/01/', year(o_orderdate)) else 'cuối năm' end")
    caption = F.expr("case when o_orderkey % 4 = 3 then concat('Q', quarter(o_orderdate), ' ', year(o_orderdate)) else 'Table of balances' end")
    row = nu.resolve_row_period(label)
    table = nu.resolve_table_period(caption, F.expr("cast(2000 + o_orderkey % 4 as int)"))
    wanted = F.expr("cast(case when o_orderkey % 4 = 2 then year(o_orderdate) - 1 else year(o_orderdate) end as string)")
    return orders.select(
        "o_orderkey", row.getField("kind").alias("row_kind"), row.getField("period_end").alias("row_end"), table.getField("kind").alias("table_kind"),
        table.getField("period_end").alias("table_end"), nu.period_matches(row.getField("period_end"), wanted).alias("matches_year"),
    )


UNIT_SCALES = [("", None), ("thousand", 3), ("million", 6), ("tỷ", 9), ("nghìn tỷ", 12), ("triệu", 6), ("thousand billion", 12)]
UNIT_MONEY = [("VND", "VND"), ("đồng", "VND"), ("USD", "USD"), ("EUR", "EUR")]
UNIT_OTHER = [("in %", "percent"), ("thousand shares", "shares"), ("số ngày", "days"), ("tỷ lệ", "unknown"), ("percentage points", "percent_point"), ("lần", "ratio")]


def _pick(values: list, index: str) -> str:
    show = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v + "'"
    return f"case {index} " + " ".join(f"when {n} then {show(v)}" for n, v in enumerate(values)) + " end"


UNIT_TEXT = (
    f"case when p_partkey % 5 = 0 then {_pick([t for t, _ in UNIT_OTHER], 'p_size % 6')} else concat(case when p_partkey % 2 = 0 then 'Unit: ' else '31/12/2018' end, "
    f"{_pick([t for t, _ in UNIT_SCALES], 'p_size % 7')}, ' ', {_pick([t for t, _ in UNIT_MONEY], 'p_partkey % 4')}) end"
)


@query(
    f"select p_partkey, case when p_partkey % 5 = 0 then {_pick([k for _, k in UNIT_OTHER], 'p_size % 6')} else 'money' end as kind, "
    f"cast(case when p_partkey % 5 = 0 then case p_size % 6 when 1 then 3 end else {_pick([v for _, v in UNIT_SCALES], 'p_size % 7')} end as integer) as scale, "
    f"case when p_partkey % 5 > 0 then {_pick([c for _, c in UNIT_MONEY], 'p_partkey % 4')} end as currency from part"
)
def unit_parse(spark, sf_dir):
    unit = nu.parse_unit(F.expr(UNIT_TEXT))
    return tb.table(spark, sf_dir, "part").select("p_partkey", *[unit.getField(f).alias(f) for f in ("kind", "scale", "currency")])


@query(
    "with t as (select p_partkey, p_partkey % 3 = 0 as c, p_partkey % 5 = 0 as col, p_partkey % 7 = 0 as r, p_partkey % 11 = 0 as tab, p_partkey % 13 = 0 as ctx from part), "
    "u as (select *, case when c then 3 when col then 6 when r then 9 when tab then 6 when ctx then 12 end as s, "
    "case when c then 'cell' when col then 'column' when r then 'row' when tab then 'table' when ctx then 'context' end as src, "
    "case when c then 'USD' when col then 'VND' when r then 'EUR' when tab then 'VND' else 'JPY' end as cur from t) "
    "select p_partkey, 'money' as kind, cur as currency, cast(coalesce(s, 0) as integer) as scale, coalesce(src, 'currency') as scale_source, false as assumed from u"
)
def unit_layers(spark, sf_dir):
    """Seven layers; the prose around a table names a credit line in another scale, which must not count."""
    part = tb.table(spark, sf_dir, "part")
    own = lambda n, text: F.when(F.col("p_partkey") % n == 0, text).otherwise("")
    unit = nu.resolve_unit(
        own(3, "5 thousand USD"), own(5, "31/12/2024Triệu VND"), own(7, "in billion EUR"),
        F.concat(own(11, "Đơn vị tính: triệu đồng. "), F.lit("loans under a limit in yên")), F.concat(own(13, "Đơn vị: nghìn tỷ đồng. "), F.lit("of the company")),
    )
    return part.select("p_partkey", *[unit.getField(f).alias(f) for f in ("kind", "currency", "scale", "scale_source", "assumed")])


@query(
    "with t as (select o_orderkey, cast(year(o_orderdate) as integer) as y, o_orderkey % 4 as k from orders), "
    "e as (select o_orderkey, unnest(case k when 0 then range(y - 2, y + 1) || [y + 3] when 1 then range(y - 1, y + 1) || range(y + 2, y + 4) when 2 then [y - 5, y] else [] end) as y from t), "
    "a as (select o_orderkey, string_agg(y::varchar, ',' order by y) as years from (select distinct * from e) group by 1) select o_orderkey, coalesce(years, '') as years from t left join a using (o_orderkey)"
)
def year_ranges(spark, sf_dir):
    text = F.expr(
        "case o_orderkey % 4 when 0 then concat(y - 2, '-', y, ' and ', y + 3) when 1 then concat(y - 1, '-', y, ', ', y + 2, '–', y + 3, ', ', y) when 2 then concat(y, ' - ', y - 5) else 'never 12345' end"
    )
    orders = tb.table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return orders.select("o_orderkey", F.array_join(nu.year_range(text), ",").alias("years"))


KIND_CELLS = {
    "date": ("date_format(o_orderdate, 'd/M/yyyy')", "''"),
    "percent": ("concat(o_orderkey % 90, ',5%')", "'Amount'"),
    "rate": ("cast(o_orderkey % 9 as string)", "'Lãi suất'"),
    "per_share": ("cast(o_orderkey as string)", "'Lãi trên cổ phiếu'"),
    "shares": ("cast(o_orderkey as string)", "'Number of shares'"),
    "days": ("cast(o_orderkey % 365 as string)", "'Overdue days'"),
    "note_ref": ("concat(o_orderkey % 50, '.', o_orderkey % 9)", "'Note'"),
    "code": ("cast(100 + o_orderkey % 800 as string)", "'Mã số'"),
    "money": ("cast(o_totalprice as string)", "'Amount'"),
    "text": ("'Total'", "'Amount'"),
}


@query(f"select o_orderkey, {_pick(list(KIND_CELLS), 'o_orderkey % 10')} as kind from orders")
def value_kinds(spark, sf_dir):
    case = lambda at: "case o_orderkey % 10 " + " ".join(f"when {n} then {v[at]}" for n, v in enumerate(KIND_CELLS.values())) + " end"
    return tb.table(spark, sf_dir, "orders").select("o_orderkey", nu.value_kind(F.expr(case(0)), F.expr(case(1))).alias("kind"))


@query("select p_brand, case when d = 0 and c = 0 then 'unknown' when d >= c then 'dot_thousands' else 'comma_thousands' end as convention from (select p_brand, count(*) filter (where p_size % 3 = 0) as d, count(*) filter (where p_size % 2 = 0) as c from part group by 1)")
def detect_convention(spark, sf_dir):
    cells = tb.table(spark, sf_dir, "part").select(
        "p_brand", F.explode(F.array(F.when(F.col("p_size") % 3 == 0, "1.234.567"), F.when(F.col("p_size") % 2 == 0, "1,234,567"))).alias("raw")
    )
    counts = cells.groupBy("p_brand").agg(F.count_if(nu.grouped_by(F.col("raw"), ".")).alias("d"), F.count_if(nu.grouped_by(F.col("raw"), ",")).alias("c"))
    return counts.select("p_brand", nu.convention(F.col("d"), F.col("c")).alias("convention"))


@query("select sha256(text) as sha, count(*) as n, min(doc_id) as first_doc from documents group by text having count(*) > 1")
def manifest_duplicates(spark, sf_dir):
    docs = tb.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return docs.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")
