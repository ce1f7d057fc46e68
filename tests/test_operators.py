"""Rules that plain results don't show: ties, gaps, empty inputs, abstentions."""

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import aggregates as ag
from factloom.operators import evaluation as ev
from factloom.operators import formulas as fo
from factloom.operators import predicates as pr
from factloom.operators import quality as qu
from factloom.operators import series as se
from factloom.operators import setops as so
from factloom.operators import windows as wi
from factloom.plans import catalog
from factloom.plans import questions as qs
from factloom.plans.program import Program, ProgramError
from factloom.sources import catalog_io as io
from factloom.streaming import events as st

SERIES = "entity string, period int, value double, dimension string"


@pytest.fixture(scope="module")
def small(spark):
    rows = [("a", 2000, 10.0), ("a", 2001, 20.0), ("a", 2004, 5.0), ("b", 2000, 10.0), ("b", 2001, -2.0), ("c", 2001, 0.0), ("c", 2002, 7.0)]
    return spark.createDataFrame([(*r, "money") for r in rows], SERIES)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_rolling_takes_the_previous_available_period(small):
    assert rows(wi.rolling_change(small).where("entity = 'a'"), "period", "value") == [(2001, 10.0), (2004, -15.0)]
    with pytest.raises(ValueError):
        wi.rolling_average(small, 3)


def test_ties_follow_their_family(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 1.0), ("d", 1.0), ("e", None)], "entity string, value double")
    assert wi.argmax_key(df, "entity").first().key == "b"
    assert wi.argmin_key(df, "entity").first().key == "c"
    assert [r.entity for r in wi.rank_members(df, "entity", 1).collect()] == ["a"]
    assert [r.entity for r in wi.rank_members(df, "entity", 1, descending=False).collect()] == ["c"]
    years = spark.createDataFrame([(2000, 5.0), (2001, 5.0), (2002, 1.0), (2003, 1.0)], "period int, value double")
    assert wi.argmax_period_flat(years).first().key == 2000 and wi.argmin_period_flat(years).first().key == 2003
    assert wi.rank_key_tie(df, "entity").first().tie


def test_masks_hold_exactly_k(spark, small):
    top = wi.k_mask(small, 3)
    assert rows(top.where("flag"), "entity", "period") == [("a", 2000), ("a", 2001), ("b", 2000)]
    bottom = wi.k_mask(small, 2, top=False)
    assert rows(bottom.where("flag"), "entity", "period") == [("b", 2001), ("c", 2001)]
    with pytest.raises(SparkRuntimeException):
        wi.k_mask(small, 99).collect()


def test_growth_conventions(small):
    ratio = {r.entity: (r.value, r.reason) for r in se.growth_between(small, 2001, 2000).collect()}
    assert ratio == {"a": (1.0, None), "b": (-1.2, None)}
    back = {r.entity: (r.value, r.reason) for r in se.growth_guarded(small, 2002, 2001).collect()}
    assert back == {"c": (None, "ZERO_BASE")}
    guarded = {r.entity: r.reason for r in se.growth_guarded(small.withColumn("value", -F.col("value")), 2001, 2000).collect()}
    assert guarded == {"a": "NEGATIVE_BASE", "b": "NEGATIVE_BASE"}


def test_units(spark, small):
    percent = small.withColumn("dimension", F.lit("percent"))
    assert {r.dimension for r in se.arithmetic(percent, percent, "subtract").collect()} == {"percent_point"}
    assert {r.dimension for r in se.arithmetic(small, small, "divide").where("status = 'OK'").collect()} == {"ratio"}
    assert {r.reason for r in se.arithmetic(small, percent, "add").collect()} == {"DIMENSION_MISMATCH"}
    mixed = small.withColumn("currency", F.when(F.col("entity") == "a", "USD").otherwise("EUR"))
    assert {r.reason for r in se.arithmetic(mixed, small.withColumn("currency", F.lit("USD")), "add").collect()} == {None, "CURRENCY_MISMATCH"}
    unknown = small.withColumn("scale", F.lit(None).cast("int"))
    assert {r.reason for r in se.comparable(unknown).collect()} == {"UNKNOWN_SCALE"}
    assert {r.reason for r in se.arithmetic(small, small, "divide").where("entity = 'c' AND period = 2001").collect()} == {"ZERO_DENOMINATOR"}


def test_aggregates_abstain(spark, small):
    empty = ag.aggregate(small.where("false"), "count").first()
    assert (empty.value, empty.reason) == (None, "AGGREGATE_EMPTY")
    assert ag.aggregate(small, "median").first().value == 7.0
    assert {r.entity: r.reason for r in ag.cagr_by_entity(small).collect()} == {"a": None, "b": "SIGN_CHANGE", "c": "ZERO_DENOMINATOR"}
    one = ag.change_by_entity(small.where("period = 2000")).first()
    assert one.reason == "TOO_FEW_PERIODS"


def test_logic_treats_missing_as_false(spark):
    a = spark.createDataFrame([("a", True), ("b", True)], "entity string, flag boolean")
    b = spark.createDataFrame([("b", True), ("c", True)], "entity string, flag boolean")
    assert rows(pr.logical(a, b, "and", ["entity"])) == [("a", False), ("b", True), ("c", False)]
    assert rows(pr.logical(a, b, "or", ["entity"])) == [("a", True), ("b", True), ("c", True)]


def test_absent_scopes_are_found_against_members(spark, small):
    members = spark.createDataFrame([("a",), ("z",)], "entity string")
    assert rows(pr.not_exists(members, small, ["entity"])) == [("z",)]


def test_f2_is_averaged_over_queries(spark):
    gold = spark.createDataFrame([("q1", 1), ("q1", 2), ("q2", 9)], "query_id string, uid int")
    ranked = spark.createDataFrame([("q1", 1, 1), ("q1", 5, 2)], "query_id string, uid int, place int")
    got = {r.query_id: r for r in ev.per_query(gold, ranked, 10).collect()}
    assert got["q1"].f2 == pytest.approx(5 / 10) and got["q2"].f2 == 0 and got["q2"].mrr == 0
    assert ev.macro(ev.per_query(gold, ranked, 10)).first().f2 == pytest.approx(0.25)


def test_readiness_reasons_are_canonical(spark):
    df = spark.createDataFrame([(None, "x"), ("v", None), ("v", "x")], "a string, b string")
    need = [qu.Requirement("a", "is_not_null", "z"), qu.Requirement("a", "not_blank", "m")]
    out = qu.readiness(df, need, [qu.Requirement("b", "is_not_null", "blocked")], []).collect()
    assert [r.non_candidate_reasons for r in out] == [["m", "z"], [], []]
    assert [r.blocking_reasons for r in out] == [[], ["blocked"], []]
    assert [r.execution_ready for r in out] == [False, False, True]


def test_a_null_period_does_not_split_a_collision(spark):
    df = spark.createDataFrame([("t", None, 1.0, 1, 1, 1), ("t", None, 2.0, 2, 1, 2)], "k string, p string, v double, r int, c int, s int")
    assert qu.collision_groups(df, ["k"], "p", "v", "r", "c", "s").first().collision_class == "missing_label_or_split"


def test_formulas(spark):
    known = fo.registry()
    assert len(known) == 39 and known["quick_ratio"].leaves == ["current_assets", "current_liabilities", "inventory"]
    wide = spark.createDataFrame([("a", 2000, 1.0, 2.0), ("a", 2003, 3.0, 0.0)], "entity string, period int, x double, y double")
    out = fo.evaluate(wide, [fo.parse("f", "x / y"), fo.parse("g", "rolling_average(x)"), fo.parse("h", "rolling_growth(x) * 100")]).collect()
    got = {(r.formula, r.period): (r.value, r.reason) for r in out}
    assert got["f", 2003] == (None, "ZERO_DENOMINATOR") and got["g", 2003] == (2.0, None)
    assert got["g", 2000] == (None, "TOO_FEW_PERIODS") and got["h", 2003] == (200.0, None)
    for bad in ("x ** y", "__import__('os')", "x if y else 1", "x.y", "f(x, y)"):
        with pytest.raises(fo.FormulaError):
            fo.parse("bad", bad)


def test_programs_are_verified(spark, small):
    good = Program.parse('a = facts(metric="x", entities=["a", "b"])\nt = sum(a)')
    assert Program.from_json(good.to_json()).nodes == good.nodes
    for bad in ("a = nothing(b)", 'a = facts(metric="x")\na = facts(metric="y")', 'b = sum(a)\na = facts(metric="x")', 'a = facts(metric="x")\nb = facts(metric="y")'):
        with pytest.raises(ProgramError):
            Program.parse(bad)
    wide = small.withColumnRenamed("value", "x").drop("dimension")
    assert good.run(lambda m: wide).first().value == 43.0


def test_every_operation_is_known():
    from factloom.plans.program import OPERATIONS

    assert len(OPERATIONS) == 46


@pytest.mark.parametrize(
    ("text", "kind", "reason"),
    [
        ("What was the revenue of Alpha in 2001?", "lookup", None),
        ("Which firm had the lowest revenue?", "extremum", None),
        ("How many firms had revenue above 1.5 million in 2001?", "count", None),
        ("How many firms are there with revenue?", "count", "COUNT_NEEDS_A_PREDICATE"),
        ("Ratio of revenue?", "divide", "RATIO_NEEDS_TWO_METRICS"),
        ("Tell me a story", "unsupported", "UNSUPPORTED_SHAPE"),
        ("What was the profit?", "lookup", "METRIC_UNRESOLVED"),
        ("How did revenue grow?", "growth", "GROWTH_NEEDS_TWO_PERIODS"),
    ],
)
def test_questions(text, kind, reason):
    q = qs.parse(text, {"revenue": "revenue", "costs": "costs"}, {"Alpha": "A", "Alpha Two": "B"})
    assert (q.kind, q.reason) == (kind, reason)
    if kind == "count" and not reason:
        assert q.threshold == ("gt", 1.5e6)


def test_longer_aliases_shadow_shorter_ones():
    q = qs.parse("What was the revenue of Alpha Two from 2001 to 2003?", {"revenue": "r"}, {"Alpha": "A", "Alpha Two": "B"})
    assert q.entities == ("B",) and q.years == (2001, 2002, 2003)


def test_text(spark):
    df = spark.createDataFrame([("  Đường   TÀU "), ("é"), ("x&nbsp;<img src=a>y\x07")], "string").toDF("t")
    assert [r[0] for r in df.select(tx.normalize_search("t")).collect()][:2] == ["duong tau", "e"]
    assert df.select(tx.clean("t")).collect()[2][0] == "x y"


def test_no_loss_counts(spark):
    u = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    parts = {"a": u.where("k < 3"), "b": spark.createDataFrame([(2,), (9,)], "k int")}
    assert {r.check: r.n for r in so.no_loss(u, parts, "k").collect()} == {"lost": 1, "foreign": 1, "shared": 1, "parts_total": 4, "universe_total": 3}


def test_manifest_and_release(spark, tmp_path):
    for name, body in (("a", "x"), ("b", "x"), ("c", "y")):
        (tmp_path / name).write_text(body)
    rows_ = {r.path.rsplit("/", 1)[1]: r for r in io.manifest(spark, str(tmp_path)).collect()}
    assert rows_["b"].duplicate_of.endswith("/a") and rows_["a"].duplicate_of is None
    one, two = io.corpus_id(io.manifest(spark, str(tmp_path))).first(), io.corpus_id(io.manifest(spark, str(tmp_path)).orderBy(F.desc("path"))).first()
    assert one == two
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    for kind in ("csv", "json", "parquet"):
        path = str(tmp_path / f"out-{kind}")
        io.write_release(df, path, kind)
        back = {"csv": lambda p: io.read_csv(spark, p, "id int, t string"), "json": lambda p: io.read_questions(spark, p, "id int, t string", "id", 1), "parquet": spark.read.parquet}[kind](path)
        assert back.count() == (1 if kind == "json" else 2)
        with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
            io.write_release(df, path, kind)
    assert io.contract_violations(df, {"id": "int", "t": "int", "u": "string"}, 5) == ["missing column u", "t is string, not int", "fewer than 5 rows"]
    assert io.with_columns_or_null(df, {"u": "double"}).first().u is None


def test_stream_matches_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = str(tmp_path / "in")
    batch.orderBy("ts").repartitionByRange(3, "ts").write.parquet(source)
    stream = st.windowed(st.read_events(spark, source), late="40 days")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    try:
        run.processAllAvailable()
        assert rows(spark.table("windows"), "start", "event_type", "n") == rows(st.windowed(batch), "start", "event_type", "n")
    finally:
        run.stop()


def test_token_jaccard_reads_whole_texts_of_all_documents(spark, tmp_path):
    head = "x" * 200
    rows = [(1, f"{head} a b", "en", "s"), (3, f"{head} b c", None, "s"), (4, "q", "de", "t"), (9, None, "fr", "s"), (10, "", "fr", "s"), (12, "Q r", "fr", "t"), (13, "b", "en", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {i: set((t or "").lower().split()) for i, t, *_ in rows}
    want = {}
    for source in {r[3] for r in rows}:
        own = sorted(r[0] for r in rows if r[3] == source)
        for a, b in zip(own, own[1:], strict=False):
            both = words[a] | words[b]
            want[a, b] = round(len(words[a] & words[b]) / len(both), 6) if both else None
    assert len(want) == 4
    assert {(r.a, r.b): r.jaccard for r in catalog.queries()["token_jaccard"](spark, str(tmp_path)).collect()} == want


def test_wide_table_refuses_to_drop_headers(spark, monkeypatch):
    rows = spark.createDataFrame([("a", f"h{n}", n) for n in range(4)], "r string, c string, v int")
    monkeypatch.setattr(io, "WIDE_COLUMNS", 4)
    assert len(io.wide_table(rows, "r", "c", "v").columns) == 5
    monkeypatch.setattr(io, "WIDE_COLUMNS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        io.wide_table(rows, "r", "c", "v")


def test_fair_selection_is_the_greedy_choice(spark):
    import random

    from factloom.operators import selection as sl

    rng = random.Random(3)
    rows = [(q, rng.choice("abc"), rng.randrange(3), float(rng.randrange(20)), n) for n, q in enumerate(rng.choice([1, 2, 3]) for _ in range(90))]
    rows += [(9, "a", 0, 1.0, 1000)]
    df = spark.createDataFrame(rows, "question int, metric string, scope int, score double, uid int")
    got = {}
    for r in sl.fair_selection(df, "question", "metric", ["scope"], "score", "uid", 7).collect():
        got.setdefault(r.question, set()).add(r.uid)
    for question in {r[0] for r in rows}:
        left, metrics, scopes, chosen = [r for r in rows if r[0] == question], {}, {}, set()
        while left and len(chosen) < 7:
            r = min(left, key=lambda r: (metrics.get(r[1], 0), scopes.get(r[2], 0), -r[3], r[4]))
            least = min(metrics.get(x[1], 0) for x in left)
            own = [x for x in left if metrics.get(x[1], 0) == least]
            few = min(scopes.get(x[2], 0) for x in own)
            assert r == min((x for x in own if scopes.get(x[2], 0) == few), key=lambda x: (-x[3], x[4]))
            left.remove(r)
            chosen.add(r[4])
            metrics[r[1]] = metrics.get(r[1], 0) + 1
            scopes[r[2]] = scopes.get(r[2], 0) + 1
        assert got[question] == chosen


def test_fair_selection_serves_all_questions_of_a_task_together(spark, monkeypatch):
    """Thousands of questions need no call each; nulls are values, ids break ties, steps cut no question."""
    import random

    import pyarrow as pa

    from factloom.operators import selection as sl

    rng = random.Random(4)
    rows = [(rng.randrange(6000), rng.choice(["a", "b", None]), rng.choice([0, 1, None]), rng.choice([None, 1.0, 2.0]), n) for n in range(15000)]
    rows += [(None, rng.choice("ab"), rng.randrange(40), float(rng.randrange(50)), 20000 + n) for n in range(3000)]
    df = spark.createDataFrame(rows, "question int, metric string, scope int, score double, uid int")
    made = sl.fair_selection(df, "question", "metric", ["scope"], "score", "uid", 3)
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    got = {tuple(r) for r in made.collect()}
    groups, want = {}, set()
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for left in groups.values():
        metrics, scopes = {}, {}
        for _ in range(min(3, len(left))):
            r = min(left, key=lambda r: (metrics.get(r[1], 0), scopes.get(r[2], 0), r[3] is None, -(r[3] or 0), r[4]))
            left.remove(r)
            want.add(r)
            metrics[r[1]] = metrics.get(r[1], 0) + 1
            scopes[r[2]] = scopes.get(r[2], 0) + 1
    assert got == want
    monkeypatch.setattr(sl, "STEP_ROWS", 10)
    keys = [None] * 3 + [1] * 45 + [2] + [3] * 12 + [4] * 4
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[n : n + 7], pa.int32())}) for n in range(0, len(keys), 7)]
    steps = [t["k"].to_pylist() for t in sl._whole_groups(iter(batches), "k")]
    assert sum(steps, []) == keys and len(steps) > 1
    assert all(one[-1] != two[0] for one, two in zip(steps, steps[1:], strict=False))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a / b * 100", {"a", "b"}),
        ("0 * a + b", {"b"}),
        ("a - a + 5", set()),
        ("b / b", set()),
        ("pow(a, 0) + c", {"c"}),
        ("max(a, 3) - min(b, c)", {"a", "b", "c"}),
        ("(2 - 2) * a", set()),
        ("0 / a", set()),
        ("-(a)", {"a"}),
        ("abs(3 - 5) * c", {"c"}),
    ],
)
def test_effective_inputs(text, want):
    from factloom.operators import governance as go

    assert go.effective_inputs(text, "abc") == want


@pytest.mark.parametrize("text", ["a.b", "__import__('os')", "a if b else c", "lambda: a", "x + 1", "a[0]", "'s'", "abs(x=a)", "a ="])
def test_unsafe_expressions_fail(text):
    from factloom.operators import formulas as fo
    from factloom.operators import governance as go

    with pytest.raises(fo.FormulaError):
        go.effective_inputs(text, "abc")


def test_wide_table_keeps_the_order_of_appearance(spark):
    from factloom.sources import catalog_io as io

    df = spark.createDataFrame([(1, "r", "B", 1.0), (2, "r", "A", 2.0), (3, "r", "B", 3.0), (4, "s", "C", 4.0)], "at int, row string, head string, v double")
    wide = io.wide_table(df, "row", "head", "v", "at")
    assert wide.columns == ["row", "B", "A", "B__2", "C"]
    assert {tuple(r) for r in wide.collect()} == {("r", 1.0, 2.0, 3.0, None), ("s", None, None, None, 4.0)}


def test_deep_hierarchies_keep_every_ancestor(spark):
    from factloom.sources import html_tables as ht

    df = spark.createDataFrame([(1, n, n, f"L{n}") for n in range(12)], "t int, id int, level int, label string")
    got = {r.id: r.path for r in ht.row_hierarchy(df, ["t"], "id", "level", "label").collect()}
    assert got[11] == " › ".join(f"L{n}" for n in range(12))
