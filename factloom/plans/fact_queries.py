"""Facts in a star of tables, their scores, roles, resolution and bindings, governance and text repair; each with its SQL.

Lines play observations, their orders tables, the orders' customers documents; cards, readiness and roles
are computed from their columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import governance as go
from factloom.operators import quality as qu
from factloom.operators import selection as sl
from factloom.operators import setops as so
from factloom.plans.registry import Registry
from factloom.sources import tables as tb

registry = Registry()
query = registry.query

UID = "l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey"
OBSERVATIONS = {
    "observation_uid": UID,
    "table_uid": "l_orderkey",
    "value": "case when l_quantity > 1 then l_extendedprice end",
    "period_end": "date_format(l_shipdate, 'yyyy-MM-dd')",
    "row_uid": "l_partkey",
    "column_uid": "case when l_linenumber > 1 then l_suppkey end",
    "collision_class": "case when l_tax > 0.06 then 'physical_duplicate' when l_tax > 0.04 then 'missing_dimension' end",
}
READY = "l_returnflag <> 'N' and l_linestatus = 'F'"
STAR_SQL = (
    f"obs as (select {UID} as observation_uid, l_orderkey as table_uid, case when l_quantity > 1 then l_extendedprice end as value, strftime(l_shipdate, '%Y-%m-%d') as period_end, l_partkey as row_uid, "
    "case when l_linenumber > 1 then l_suppkey end as column_uid, case when l_tax > 0.06 then 'physical_duplicate' when l_tax > 0.04 then 'missing_dimension' end as collision_class, "
    f"bool_and({READY}) over (partition by {UID}) as execution_ready from lineitem), tab as (select o_orderkey as table_uid, o_custkey as document_uid, o_orderpriority as section from orders), "
    "doc as (select c_custkey as document_uid, n_name as entity, case when c_mktsegment <> 'BUILDING' then c_mktsegment end as basis from customer join nation on c_nationkey = n_nationkey), "
    "card as (select o_orderkey as table_uid, o_totalprice > 200000 as retrieval_ready, o_orderstatus from orders), "
    "star as (select * from obs join tab using (table_uid) join doc using (document_uid) join card using (table_uid))"
)


def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tables; readiness is a table of its own, one row an observation."""
    lines = tb.table(spark, sf_dir, "lineitem")
    observations = lines.select(*[F.expr(e).alias(n) for n, e in OBSERVATIONS.items()])
    readiness = lines.groupBy(F.expr(UID).alias("observation_uid")).agg(F.bool_and(F.expr(READY)).alias("execution_ready"))
    orders = tb.table(spark, sf_dir, "orders")
    tables = orders.selectExpr("o_orderkey as table_uid", "o_custkey as document_uid", "o_orderpriority as section")
    nations = tb.table(spark, sf_dir, "nation").selectExpr("n_nationkey as c_nationkey", "n_name as entity")
    customers = tb.table(spark, sf_dir, "customer").join(nations, "c_nationkey")
    documents = customers.selectExpr("c_custkey as document_uid", "entity", "case when c_mktsegment <> 'BUILDING' then c_mktsegment end as basis")
    cards = orders.selectExpr("o_orderkey as table_uid", "o_totalprice > 200000 as retrieval_ready", "o_orderstatus")
    return sl.star(observations, readiness, tables, documents, cards)


@query(
    f"with {STAR_SQL} select observation_uid, document_uid, section, entity, retrieval_ready from star where execution_ready and retrieval_ready and entity in ('NATION_1', 'NATION_2')"
)
def star_five_tables(spark, sf_dir):
    rows = _star(spark, sf_dir).where("execution_ready AND retrieval_ready AND entity IN ('NATION_1', 'NATION_2')")
    return rows.select("observation_uid", "document_uid", "section", "entity", "retrieval_ready")


@query(
    f"with {STAR_SQL}, allowed as (select table_uid from card where o_orderstatus <> 'P') select observation_uid, value, period_end from star "
    "where (execution_ready or (collision_class in ('physical_duplicate') and row_uid is not null and column_uid is not null)) and value is not null "
    "and entity = 'NATION_3' and substr(period_end, 1, 4) = '1997' and basis = 'MACHINERY' and table_uid in (select table_uid from allowed)"
)
def operand_filter(spark, sf_dir):
    allowed = tb.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").selectExpr("o_orderkey as table_uid")
    found = sl.operand_filter(_star(spark, sf_dir), "NATION_3", "1997", "MACHINERY", allowed, ("physical_duplicate",))
    return found.select("observation_uid", "value", "period_end")


@query(
    f"with {STAR_SQL}, own as (select * from star where entity in ('NATION_1', 'NATION_3', 'NATION_5') and substr(period_end, 1, 4) in ('1996', '1998') and (entity <> 'NATION_5' or basis is null)), "
    "b as (select distinct entity from own where basis = 'FURNITURE') select observation_uid, entity, basis from own where basis = 'FURNITURE' or (basis is null and entity not in (select entity from b))"
)
def grounded_fact_filter(spark, sf_dir):
    """NATION_5 has no facts in the asked basis, so its facts of no stated basis stand in."""
    rows = _star(spark, sf_dir).where("entity <> 'NATION_5' OR basis IS NULL")
    return sl.grounded_filter(rows, ["NATION_1", "NATION_3", "NATION_5"], ["1996", "1998"], "FURNITURE").select("observation_uid", "entity", "basis")


@query(
    f"with {STAR_SQL}, r as (select observation_uid, o_orderstatus, case when value is null then 'VALUE_MISSING' when section not in ('1-URGENT', '2-HIGH') then 'SECTION_MISMATCH' "
    "when period_end < '1996-01-01' then 'PERIOD_ROLE_MISMATCH' end as reason from star) select o_orderstatus, coalesce(reason, 'KEPT') as reason, count(*) as n from r group by 1, 2"
)
def role_rejection_counts(spark, sf_dir):
    checks = [
        ("VALUE_MISSING", F.col("value").isNotNull()),
        ("SECTION_MISMATCH", F.col("section").isin("1-URGENT", "2-HIGH")),
        ("PERIOD_ROLE_MISMATCH", F.col("period_end") >= "1996-01-01"),
    ]
    reason = F.coalesce(sl.rejection(checks), F.lit("KEPT"))
    return _star(spark, sf_dir).groupBy("o_orderstatus", reason.alias("reason")).agg(F.count("*").alias("n"))


ROLES = [("total", ("plate", "bolt")), ("component", ("red", "blue")), ("adjustment", ("hot",))]


@query(
    "with w as (select p_partkey, string_split(p_name, ' ') as t from part) select p_partkey, case when list_has_any(t, ['plate', 'bolt']) then 'total' when list_has_any(t, ['red', 'blue']) then 'component' "
    "when list_has_any(t, ['hot']) then 'adjustment' else 'unknown' end as role from w"
)
def observation_roles(spark, sf_dir):
    return tb.table(spark, sf_dir, "part").select("p_partkey", sl.role_of(F.col("p_name"), ROLES, F.lit("unknown")).alias("role"))


SCORE_SQL = (
    "(case l_linenumber % 4 when 0 then 22.25 when 3 then 22.0 when 2 then 20.0 else 10.0 end + (l_partkey % 30) / 100.0 + case when l_returnflag = 'A' then 3 else 0 end "
    "+ case when l_linestatus = 'F' then 1 else 0 end - case when l_discount > 0.05 then 0.5 else 0 end + case when l_suppkey % 3 > 0 then greatest(0, 1 - (l_suppkey % 8) / 6.0) else 0 end "
    "+ case when l_tax > 0.04 then 1.5 else 0 end)"
)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tb.table(spark, sf_dir, "lineitem")
    quality = F.expr("case l_linenumber % 4 when 0 then 4 when 3 then 3 when 2 then 2 else 1 end")
    rank = F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 8)
    score = sl.candidate_score(
        quality, F.col("l_partkey") % 30, F.col("l_returnflag") == "A", F.col("l_linestatus") == "F", F.col("l_discount") > 0.05, [F.when(F.col("l_tax") > 0.04, 1.5).otherwise(0.0)], rank, F.lit(6)
    )
    return lines.withColumn("score", F.round(score, 4)).withColumn("uid", F.expr(UID))


@query(f"select {UID} as uid, round({SCORE_SQL}, 4)::double as score from lineitem")
def candidate_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("uid", "score")


@query(
    f"with c as (select {UID} as uid, l_orderkey, l_linestatus, l_returnflag, l_quantity, l_discount, l_tax, round({SCORE_SQL}, 4) as score from lineitem where l_quantity > 5), "
    "r as (select *, row_number() over (partition by l_orderkey order by case when l_returnflag = 'R' then 1 else 0 end desc, l_linestatus desc, l_quantity desc, l_discount desc, l_tax desc, score desc, uid) as p from c) select l_orderkey, uid from r where p = 1"
)
def cell_selector(spark, sf_dir):
    """One cell a table: past the gate, by six components in order."""
    components = [(F.col("l_returnflag") == "R").cast("int"), *[F.col(c) for c in ("l_linestatus", "l_quantity", "l_discount", "l_tax", "score")]]
    return sl.select_cells(_scored(spark, sf_dir), ["l_orderkey"], F.col("l_quantity") > 5, components, "uid").select("l_orderkey", "uid")


@query(
    f"with c as (select l_partkey % 500 as fact, l_returnflag as role, l_quantity as value, l_orderkey as tab, {UID} as uid, round({SCORE_SQL}, 4)::double as score from lineitem), "
    "o as (select fact, role, value, tab, max(score) as s, arg_min(uid, (-score, uid)) as u from c group by 1, 2, 3, 4), "
    "v as (select fact, role, value, max(s) as score, arg_min(u, (-s, u)) as uid, count(*) as corroboration from o group by 1, 2, 3), "
    "r as (select *, row_number() over (partition by fact, role order by score desc, corroboration desc, uid) as p, lead(score) over (partition by fact, role order by score desc, corroboration desc, uid) as nxt from v) "
    "select fact, role, value, uid, score, corroboration, case when score - nxt < 0.25 then 'CONFLICT' when corroboration > 1 then 'CORROBORATED' else 'SINGLE' end as status from r where p = 1"
)
def logical_facts(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("fact", F.col("l_partkey") % 500).withColumnRenamed("l_returnflag", "role")
    return sl.resolve_facts(rows, ["fact", "role"], "l_quantity", "l_orderkey", "score", "uid", 0.25)


@query()
def fair_selection(spark, sf_dir):
    """Six facts an order, fair over its flags and suppliers' groups; tested against the plain greedy choice."""
    rows = _scored(spark, sf_dir).select("l_orderkey", "l_returnflag", (F.col("l_suppkey") % 3).alias("scope"), "score", "uid")
    return sl.fair_selection(rows, "l_orderkey", "l_returnflag", ["scope"], "score", "uid", 3)


BINDINGS_SQL = (
    f"c as (select l_orderkey as question, l_returnflag as role, {UID} as uid, l_linestatus as basis, year(l_shipdate) as period, l_quantity as score from lineitem where l_tax < 0.07)"
)


def _bindable(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem").where("l_tax < 0.07")
    return lines.selectExpr("l_orderkey as question", "l_returnflag as role", f"{UID} as uid", "l_linestatus as basis", "year(l_shipdate) as period", "l_quantity as score")


@query(
    f"with {BINDINGS_SQL}, j as (select a.question, a.uid as uid_0, b.uid as uid_1, d.uid as uid_2, a.score + b.score + d.score as total from c a join c b on a.question = b.question and a.uid <> b.uid "
    "join c d on a.question = d.question and d.uid <> a.uid and d.uid <> b.uid where a.role = 'A' and b.role = 'R' and d.role = 'N' and a.period = b.period and a.basis = d.basis), "
    "r as (select *, row_number() over (partition by question order by total desc, uid_0, uid_1, uid_2) as p, lead(total) over (partition by question order by total desc, uid_0, uid_1, uid_2) as nxt from j) "
    "select question, uid_0, uid_1, uid_2, total, coalesce(nxt = total, false) as tie from r where p = 1"
)
def binding_beam(spark, sf_dir):
    """Three roles, two of which must share a period and two a basis."""
    constraints = [sl.Same("period", ("A", "R")), sl.Same("basis", ("A", "N"))]
    return sl.bind(_bindable(spark, sf_dir), "question", ["A", "R", "N"], constraints)


@query(
    f"with {BINDINGS_SQL}, t as (select *, row_number() over (partition by question, role order by score desc, uid) - 1 as rk from c where role in ('A', 'R')), "
    "j as (select a.question, a.uid as uid_0, b.uid as uid_1, a.rk as ra, b.rk as rb from t a join t b on a.question = b.question and a.uid <> b.uid where a.role = 'A' and b.role = 'R' and a.rk < 3 and b.rk < 3), "
    "r as (select *, row_number() over (partition by question order by ra + rb, ra, rb) as place from j) select question, uid_0, uid_1, cast(place as integer) as place from r where place <= 3"
)
def bindings_ranked(spark, sf_dir):
    return sl.ranked_bindings(_bindable(spark, sf_dir), "question", ["A", "R"])


@query(
    f"with {BINDINGS_SQL}, a as (select question, arg_min(uid, (-score, uid)) as uid_0 from c where role = 'A' group by 1), "
    "b as (select a.question, uid_0, arg_min(uid, (-score, uid)) as uid_1 from c join a using (question) where role = 'R' and uid <> uid_0 group by 1, 2) select * from b"
)
def binding_greedy(spark, sf_dir):
    return sl.greedy_binding(_bindable(spark, sf_dir), "question", ["A", "R"])


@query(
    "select o_orderkey, case when o_orderstatus = 'F' and o_totalprice > 300000 then 'new_engine' when o_orderstatus = 'F' then 'new_engine_low' when o_orderstatus = 'O' and o_orderpriority is not null and o_orderpriority <> '5-LOW' then 'old_engine' else 'abstain' end as route from orders"
)
def hybrid_routing(spark, sf_dir):
    steps = [
        ("new_engine", (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000)),
        ("new_engine_low", F.col("o_orderstatus") == "F"),
        ("old_engine", (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") != "5-LOW")),
    ]
    return sl.route(tb.table(spark, sf_dir, "orders"), "o_orderkey", steps, "abstain")


@query(
    "with e as (select l_orderkey, l_partkey as key, min(l_linenumber) as place from lineitem where l_returnflag = 'R' group by 1, 2), c as (select l_orderkey, l_partkey as key, min(l_linenumber) as place from lineitem where l_returnflag <> 'R' group by 1, 2), "
    "u as (select l_orderkey, key, min((pr, place)) as at_ from (select *, 0 as pr from e union all select *, 1 from c) group by 1, 2), "
    "r as (select l_orderkey, key, cast(row_number() over (partition by l_orderkey order by at_, key) as integer) as place from u) select * from r where place <= 3"
)
def relevant_tables(spark, sf_dir):
    """Evidence first, candidates behind, each once, three at most."""
    lines = tb.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("place"), "l_returnflag")
    parts = [lines.where(c).drop("l_returnflag") for c in ("l_returnflag = 'R'", "l_returnflag <> 'R'")]
    return so.ordered_union(parts, ["l_orderkey"], "key", 3)


# ---- governance

HASHED = {"orders": ["o_orderkey", "o_orderstatus", "o_orderpriority"], "nation": ["n_nationkey", "n_name"], "customer": ["c_custkey", "c_mktsegment"]}


def _hash_sql(name: str, columns: list[str]) -> str:
    text = "concat_ws(chr(31), " + ", ".join(f"coalesce({c}::varchar, chr(30))" for c in columns) + ")"
    sums = ", ".join(f"sum(('0x' || substr(m, {1 + 8 * n}, 8))::BIGINT)::varchar as p{n}" for n in range(4))
    return f"select '{name}' as part, n, md5(concat_ws(',', p0, p1, p2, p3)) as digest from (select count(*) as n, {sums} from (select md5({text}) as m from {name}))"


@query(" union all ".join(_hash_sql(n, c) for n, c in HASHED.items()))
def run_manifest(spark, sf_dir):
    return go.run_manifest({n: tb.table(spark, sf_dir, n) for n in HASHED}, HASHED)


@query("select true as same_rows_shuffled, false as same_with_a_row_twice, false as same_with_a_changed_row")
def rebuild_determinism(spark, sf_dir):
    """A table's hash doesn't depend on its order, and sees a row too many and a changed one."""
    orders = tb.table(spark, sf_dir, "orders").select(*HASHED["orders"])
    first = F.col("o_orderkey") == F.lit(orders.agg(F.min("o_orderkey")).first()[0])
    builds = {
        "same_rows_shuffled": orders.repartition(7, "o_orderstatus"),
        "same_with_a_row_twice": orders.unionByName(orders.where(first)),
        "same_with_a_changed_row": orders.withColumn("o_orderpriority", F.when(first, "0-NONE").otherwise(F.col("o_orderpriority"))),
    }
    own = go.table_hash(orders, HASHED["orders"]).withColumnsRenamed({"n": "_n", "digest": "_digest"})
    out = None
    for name, df in builds.items():
        one = go.table_hash(df, HASHED["orders"]).crossJoin(own).select(((F.col("n") == F.col("_n")) & (F.col("digest") == F.col("_digest"))).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


@query(
    "with now as (select distinct l_orderkey, l_returnflag as reason from lineitem where l_tax > 0.06), thn as (select distinct l_orderkey, l_returnflag as reason from lineitem where l_tax > 0.06 and l_orderkey % 3 > 0 union select distinct l_orderkey, 'Z' from lineitem where l_orderkey % 50 = 0) "
    "select coalesce(now.l_orderkey, thn.l_orderkey) as l_orderkey, coalesce(now.reason, thn.reason) as reason, case when thn.reason is null then 'new' when now.reason is null then 'closed' else 'open' end as state from now full join thn on now.l_orderkey = thn.l_orderkey and now.reason = thn.reason"
)
def open_case_registry(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "reason")
    found = lines.where("l_tax > 0.06").select("l_orderkey", "reason")
    known = found.where("l_orderkey % 3 > 0").unionByName(lines.where("l_orderkey % 50 = 0").select("l_orderkey", F.lit("Z").alias("reason")))
    return go.open_cases(found, known, "l_orderkey", "reason")


@query(
    "with r as (select o_orderkey as k, case when o_orderkey % 11 = 0 then 'n/a' when o_orderstatus = 'P' and o_orderkey % 2 = 0 then null else o_totalprice::varchar end as answer, case when o_orderstatus = 'P' then 'ABSTAIN' else 'OK' end as status from orders where o_orderkey % 17 > 0), "
    "e as (select l_orderkey as k, l_partkey as t from lineitem where l_orderkey % 17 > 0), c as (select k, count(*) as n, count(distinct t) as d from e group by 1), p as (select p_partkey as t from part where p_size <> 7) "
    "select o_orderkey as k, 'MISSING_ID' as problem from orders where o_orderkey % 17 = 0 union all select k, 'DUPLICATE_ID' from r where k % 23 = 0 union all select k, 'ANSWER_NOT_A_NUMBER' from r, (values (1), (2)) v(i) where status = 'OK' and answer = 'n/a' and (i = 1 or k % 23 = 0) "
    "union all select k, 'ANSWER_WITHOUT_OK' from r, (values (1), (2)) v(i) where status <> 'OK' and answer is not null and (i = 1 or k % 23 = 0) "
    "union all select r.k, 'NO_EVIDENCE' from r left join c on c.k = r.k, (values (1), (2)) v(i) where status = 'OK' and c.k is null and (i = 1 or r.k % 23 = 0) "
    "union all select r.k, 'TOO_MUCH_EVIDENCE' from r join c on c.k = r.k, (values (1), (2)) v(i) where n > 5 and (i = 1 or r.k % 23 = 0) "
    "union all select r.k, 'REPEATED_EVIDENCE' from r join c on c.k = r.k, (values (1), (2)) v(i) where d < n and (i = 1 or r.k % 23 = 0) "
    "union all select distinct r.k, 'UNKNOWN_TABLE' from r join e on e.k = r.k where t not in (select t from p)"
)
def submission_check(spark, sf_dir):
    """Answers of all orders: some are missing, some stand twice, some are no numbers or name unknown tables."""
    orders, lines = tb.table(spark, sf_dir, "orders"), tb.table(spark, sf_dir, "lineitem")
    evidence = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list("l_partkey")).alias("evidence"))
    answer = F.expr("case when o_orderkey % 11 = 0 then 'n/a' when o_orderstatus = 'P' and o_orderkey % 2 = 0 then null else cast(o_totalprice as string) end")
    own = orders.where("o_orderkey % 17 > 0").select(F.col("o_orderkey").alias("k"), answer.alias("answer"), F.when(F.col("o_orderstatus") == "P", "ABSTAIN").otherwise("OK").alias("status"))
    records = own.unionByName(own.where("k % 23 = 0")).join(evidence, "k", "left")
    tables = tb.table(spark, sf_dir, "part").where("p_size <> 7").selectExpr("p_partkey as table_uid")
    return go.submission_problems(records, "k", "answer", "status", "evidence", orders.selectExpr("o_orderkey as k"), tables, 5)


FLAGS = "concat('[', case when l_tax > 0.05 then '\"scale_rejected\",' else '' end, case when l_discount > 0.05 then '\"tiny\"' else '\"none\"' end, ']')"


@query(f"select {UID} as uid, l_tax > 0.05 as rejected, l_discount > 0.05 as tiny from lineitem")
def json_flags(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem")
    return lines.select(F.expr(UID).alias("uid"), go.flagged(F.expr(FLAGS), "scale_rejected").alias("rejected"), go.flagged(F.expr(FLAGS), "tiny").alias("tiny"))


def _rules(prefix: str, conditions: dict[str, tuple[str, str]]) -> list[qu.Rule]:
    return [qu.Rule(f"{prefix}-{name}", severity, condition) for name, (severity, condition) in conditions.items()]


#: Rules by table, 26 in all: rows without a source, impossible values, missing attributes and dates out of bounds.
RULEBOOK: dict[str, tuple[str, list[qu.Rule]]] = {
    "lineitem": (
        "l_orderkey",
        _rules(
            "Q-OBS",
            {
                "NO-VALUE": ("critical", "l_extendedprice IS NULL"),
                "NOT-POSITIVE": ("critical", "l_extendedprice <= 0"),
                "IMPLAUSIBLE": ("error", "abs(l_extendedprice) > 90000"),
                "TINY-MONEY": ("warning", "abs(l_extendedprice) < 1000"),
                "DISCOUNT-RANGE": ("error", "l_discount < 0 OR l_discount > 0.09"),
                "TAX-RANGE": ("error", "l_tax < 0 OR l_tax > 0.07"),
                "NO-PERIOD": ("warning", "l_shipdate IS NULL"),
                "PERIOD-EARLY": ("warning", "l_shipdate < TIMESTAMP '1995-02-01 00:00:00'"),
                "FLAG-UNKNOWN": ("error", "l_returnflag NOT IN ('A', 'R', 'N')"),
                "STATUS-MISMATCH": ("warning", "l_returnflag = 'R' AND l_linestatus = 'O'"),
                "QUANTITY-RANGE": ("error", "l_quantity < 1 OR l_quantity > 49"),
                "LINE-RANGE": ("error", "l_linenumber < 1 OR l_linenumber > 6"),
            },
        ),
    ),
    "orders": (
        "o_orderkey",
        _rules(
            "Q-TAB",
            {
                "NO-STATUS": ("critical", "o_orderstatus IS NULL OR o_orderstatus = ''"),
                "STATUS-OPEN": ("info", "o_orderstatus = 'P'"),
                "NO-PRIORITY": ("warning", "o_orderpriority IS NULL"),
                "PRICE-RANGE": ("error", "o_totalprice <= 0 OR o_totalprice > 450000"),
                "PERIOD-EARLY": ("warning", "o_orderdate < TIMESTAMP '1995-02-01 00:00:00'"),
            },
        ),
    ),
    "customer": (
        "c_custkey",
        _rules("Q-DOC", {"NEGATIVE-BALANCE": ("warning", "c_acctbal < 0"), "NO-BASIS": ("error", "c_mktsegment IS NULL"), "NO-NAME": ("critical", "c_name IS NULL OR c_name = ''")}),
    ),
    "part": (
        "p_partkey",
        _rules("Q-COL", {"SIZE-RANGE": ("error", "p_size < 1 OR p_size > 45"), "NO-LABEL": ("critical", "p_name IS NULL OR p_name = ''"), "PRICE-LOW": ("info", "p_retailprice < 950")}),
    ),
    "documents": (
        "doc_id",
        _rules("Q-TXT", {"CONTROL": ("error", "text LIKE concat('%', chr(7), '%')"), "EMPTY": ("warning", "length(text) = 0"), "NO-LANG": ("info", "lang IS NULL")}),
    ),
}


@query(
    " union all ".join(
        f"select '{t}' as \"table\", '{r.rule_id}' as rule_id, '{r.severity}' as severity, count(*) as n from {t} where {r.condition}" for t, (_, rules) in RULEBOOK.items() for r in rules
    )
)
def quality_rulebook(spark, sf_dir):
    """All rules of all tables, one pass a table."""
    out = None
    for table, (_, rules) in RULEBOOK.items():
        one = qu.rule_counts(tb.table(spark, sf_dir, table), rules, table)
        out = one if out is None else out.unionByName(one)
    return out


# ---- texts


@query("select doc_id, md5(text) as digest from documents where text is not null")
def mojibake_repair(spark, sf_dir):
    """Texts read with the wrong code page, one layer or two, come back as they were."""

    page = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 256)}

    @F.pandas_udf("string")
    def garbled(texts: pd.Series) -> pd.Series:
        wrong = lambda t: t.encode().decode("latin-1").translate(page)
        return texts.map(lambda t: wrong(t) if len(t) % 2 else wrong(wrong(t)))

    docs = tb.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(tx.repair_mojibake(garbled("text")).cast("binary")).alias("digest"))


@query(
    "select p_partkey, p_name as label, cast(case when p_size % 3 = 0 then 2 else 1 end as integer) as n_segments, case when p_size % 3 = 0 then lower(p_type) else p_name end as first from part"
)
def fact_labels(spark, sf_dir):
    """Labels with numbers in front and formulas behind, alone and in paths."""
    part = tb.table(spark, sf_dir, "part")
    printed = F.expr("concat(case p_size % 4 when 0 then '1.2) ' when 1 then 'IV. ' when 2 then 'a) ' else '' end, upper(p_name), case when p_size % 5 = 0 then ' (100 = 110 + 120)' else '' end)")
    path = F.when(F.col("p_size") % 3 == 0, F.concat("p_type", F.lit(" ›  › "), printed)).otherwise(printed)
    segments = tx.fact_label_segments(path)
    return part.select("p_partkey", tx.fact_label(printed).alias("label"), F.size(segments).alias("n_segments"), F.get(segments, F.lit(0)).alias("first"))


@query(
    "with t as (select p_partkey, string_split(p_name, ' ') as w from part), d as (select p_partkey, list_filter(w, lambda x: x not in ('red', 'plate')) as w from t) "
    "select p_partkey, case when len(w) > 0 then array_to_string(list_transform(w, lambda x: '\"' || x || '\"'), ' OR ') end as match from d"
)
def match_expressions(spark, sf_dir):
    part = tb.table(spark, sf_dir, "part")
    terms = tx.without_terms(tx.content_terms("p_name"), F.array(F.lit("red"), F.lit("plate")))
    return part.select("p_partkey", tx.match_expression(terms).alias("match"))


@query(
    "with t as (select p_partkey, string_split(p_name, ' ') || [lower(p_type), p_name[1:3]] as a, string_split(p_name, ' ') as n, lower(p_type) as y, p_size from part), "
    "q as (select p_partkey, a, case p_size % 4 when 0 then n || [y] when 1 then ['the'] || n when 2 then [n[2], n[1]] else [y] end as b from t), "
    "g as (select p_partkey, k, list_transform(range(1, len(a) - k + 2), lambda i: array_to_string(a[i:i + k - 1], ' ')) as x, list_transform(range(1, len(b) - k + 2), lambda i: array_to_string(b[i:i + k - 1], ' ')) as y from q, (values (1), (2), (3), (4)) v(k) where k <= len(a) and k <= len(b)) "
    "select p_partkey, cast(max(case when list_has_any(x, y) then k else 0 end) as integer) as run from g group by 1"
)
def longest_common_runs(spark, sf_dir):
    part = tb.table(spark, sf_dir, "part")
    name = F.split("p_name", " ")
    kind = F.array(F.lower("p_type"))
    one = F.concat(name, kind, F.array(F.substring("p_name", 1, 3)))
    two = F.expr("case p_size % 4 when 0 then concat(split(p_name, ' '), array(lower(p_type))) when 1 then concat(array('the'), split(p_name, ' ')) when 2 then reverse(slice(split(p_name, ' '), 1, 2)) else array(lower(p_type)) end")
    return part.select("p_partkey", sl.longest_run(one, two, 4).alias("run"))


@query(
    "select c_custkey, '{\"basis\":\"' || c_mktsegment || '\",\"entity\":' || case when c_nationkey % 2 = 0 then 'null' else '\"N' || c_nationkey || '\"' end || ',\"id\":' || c_custkey || '}' as body from customer"
)
def canonical_records(spark, sf_dir):
    fields = {"id": F.col("c_custkey"), "entity": F.when(F.col("c_nationkey") % 2 == 1, F.concat(F.lit("N"), F.col("c_nationkey"))), "basis": F.col("c_mktsegment")}
    return tb.table(spark, sf_dir, "customer").select("c_custkey", tx.canonical_json(fields).alias("body"))


STATEMENTS = [("balance_sheet", ("red plate", "plate", "gear")), ("income_statement", ("red", "bolt", "hot")), ("cash_flow", ("blue", "ring"))]


@query(
    "with s as (select p_partkey, (contains(' ' || p_name || ' ', ' red plate '))::int + (contains(' ' || p_name || ' ', ' plate '))::int + (contains(' ' || p_name || ' ', ' gear '))::int as a, "
    "(contains(' ' || p_name || ' ', ' red '))::int + (contains(' ' || p_name || ' ', ' bolt '))::int + (contains(' ' || p_name || ' ', ' hot '))::int as b, "
    "(contains(' ' || p_name || ' ', ' blue '))::int + (contains(' ' || p_name || ' ', ' ring '))::int as c from part) "
    "select p_partkey, case when greatest(a, b, c) < 1 then 'other' when a = greatest(a, b, c) then 'balance_sheet' when b = greatest(a, b, c) then 'income_statement' else 'cash_flow' end as statement from s"
)
def statement_classes(spark, sf_dir):
    return tb.table(spark, sf_dir, "part").select("p_partkey", tx.classify("p_name", STATEMENTS, "other").alias("statement"))
