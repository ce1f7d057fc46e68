"""Classes of documents and cells, answers and their checks, operand plans, rerank adjustments and training, gold and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers from which a document's content counts as dense, and money from which a value isn't tiny.
DENSE_NUMBERS = 50
TINY_MONEY = 1_000.0
SHORT_DIGITS, LONG_DIGITS = 3, 6
PERCENT_LIMIT = 1e4


def document_class(tables: Column, markup: Column, numbers: Column) -> Column:
    """``struct(kind, exclusion, route, content)`` of a document from its parsed tables, table marks and grouped numbers; a negative count was not measured."""
    parsed, unknown, marked = tables > 0, markup < 0, markup > 0
    case = lambda a, b, c, d: F.when(parsed, a).when(unknown, b).when(marked, c).otherwise(d)
    content = F.when(numbers < 0, "unknown").when(numbers == 0, "none").when(numbers < DENSE_NUMBERS, "sparse").otherwise("dense")
    return F.struct(
        case("tabular", "unknown", "tabular_parse_failed", "non_tabular").alias("kind"),
        case(F.lit(None).cast("string"), "raw_markup_not_measured", "markup_present_but_no_table_parsed", "no_table_markup").alias("exclusion"),
        case("table", "unknown", "blocked_defect", "explicit_out_of_scope").alias("route"),
        content.alias("content"),
    )


def tiny_money_class(raw: Column, value: Column, scale: Column, header: Column, per_share: Column, own_digits: Column, peer_digits: Column) -> Column:
    """What a small amount really is: the first signal that speaks decides, and without one it stays unresolved."""
    parts = F.split(F.trim(raw), r"\.")
    section = F.size(parts).between(2, 4) & F.forall(parts, lambda p: F.length(p).between(1, 2) & p.try_cast("int").isNotNull())
    return (
        F.when(section, "note_reference_false_value")
        .when(F.abs(value) * F.pow(F.lit(10.0), F.coalesce(scale, F.lit(0))) >= TINY_MONEY, "legitimate_small_money")
        .when(header == "note_reference", "note_reference_false_value")
        .when(header == "metric_code", "metric_code_false_value")
        .when(header == "ordinal", "ordinal_false_value")
        .when(per_share, "legitimate_per_share_or_rate_value")
        .when((own_digits <= SHORT_DIGITS) & (peer_digits >= LONG_DIGITS), "metric_code_false_value")
        .otherwise("parse_or_column_role_unresolved")
    )


def implausible_percent(kind: Column, value: Column, limit: float) -> Column:
    return F.coalesce((kind == "percent") & (F.abs(value) >= limit), F.lit(False))


def ambiguous_shares(header: Column, value: Column, digits: Column, counted: Column) -> Column:
    """A cell under a shares header whose unit can't be told: negative, short, and nothing says that it is a count."""
    return F.coalesce(F.lower(header).contains("cổ phi") & (value < 0) & (digits <= 12) & ~counted, F.lit(False))


def denormalized(observations: DataFrame, features: DataFrame, cells: DataFrame, collisions: DataFrame) -> DataFrame:
    """Observations with their table's features, and with their source cell and collision where they have one."""
    return observations.join(features, "table_uid").join(cells, "cell_uid", "left").join(collisions, "observation_uid", "left")


def inconsistent_columns(columns: DataFrame, observations: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """``keys.., observation_uid, differs``: observations that differ from their column in an attribute both state."""
    named = columns.select(*keys, *[F.col(c).alias(f"_{c}") for c in compared])
    differs = F.array_compact(F.array(*[F.when(F.col(c) != F.col(f"_{c}"), F.lit(c)) for c in compared]))
    joined = observations.join(named, keys).withColumn("differs", F.array_join(differs, ","))
    return joined.where("differs <> ''").select(*keys, "observation_uid", "differs")


def accounted(eligible: DataFrame, mapped: DataFrame, dropped: DataFrame, bad_tables: DataFrame, key: str, table: str) -> DataFrame:
    """``state, n``: every eligible cell is mapped, dropped, of a bad table, or unaccounted for; in this order."""
    flag = lambda df, k, name: df.select(k).distinct().withColumn(name, F.lit(True))
    joined = eligible.join(flag(mapped, key, "_m"), key, "left").join(flag(dropped, key, "_d"), key, "left").join(flag(bad_tables, table, "_b"), table, "left")
    state = F.when(F.col("_m"), "mapped").when(F.col("_d"), "dropped").when(F.col("_b"), "bad_table").otherwise("unaccounted")
    return joined.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


# ---- answers


def answer_verdict(arity: Column, bound: Column, wanted: Column, got: Column, value: Column, distinct: Column, years: Column) -> Column:
    """``struct(verdict, reasons)``: an answer passes, abstains or is rejected; a number that is one of the asked years is no value."""
    pair = F.array(F.lit("ratio"), F.lit("percent"))
    mismatch = (got != "unknown") & (got != wanted) & ~(F.array_contains(pair, got) & F.array_contains(pair, wanted))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    hard = {
        "OPERAND_COUNT_MISMATCH": arity != bound,
        "DUPLICATE_OPERAND_CELLS": distinct < bound,
        "OUTPUT_DIMENSION_MISMATCH": mismatch,
        "NON_FINITE": ~finite,
    }
    soft = {
        "UNDERIVABLE_RESULT_DIMENSION": got == "unknown",
        "PERCENT_OUT_OF_PLAUSIBLE_RANGE": (wanted == "percent") & finite & (F.abs(value) > PERCENT_LIMIT),
        "VALUE_IS_A_YEAR": (wanted == "money") & F.array_contains(years, F.when(finite, value).cast("int")) & (value == F.floor(value)),
    }
    said = lambda rules: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    verdict = F.when(F.size(said(hard)) > 0, "REJECT").when(F.size(said(soft)) > 0, "ABSTAIN").otherwise("PASS")
    return F.struct(verdict.alias("verdict"), F.concat(said(hard), said(soft)).alias("reasons"))


def in_requested_unit(value: Column, scale: Column, kind: Column, wanted_scale: Column, wanted_kind: Column) -> Column:
    """A value in the unit a question asks for; null where the kinds don't agree, ratios and per cent apart."""
    moved = value * F.pow(F.lit(10.0), F.coalesce(scale, F.lit(0)) - F.coalesce(wanted_scale, F.lit(0)))
    return (
        F.when((kind == "ratio") & (wanted_kind == "percent"), value * 100)
        .when((kind == "percent") & (wanted_kind == "ratio"), value / 100)
        .when(kind == wanted_kind, F.when(kind == "money", moved).otherwise(value))
    )


# ---- plans


def operand_requests(metrics: DataFrame, entities: DataFrame, periods: DataFrame, question: str) -> DataFrame:
    """``question, metric, entity, period, uses``: the operands of every question, each once, with how many nodes use it.

    The three lists are a question's own, so their product is taken per question, on its key.
    """
    product = metrics.join(entities, question).join(periods, question)
    return product.groupBy(question, "metric", "entity", "period").agg(F.count("*").alias("uses"))


def expanded_metrics(asked: DataFrame, leaves: dict[str, list[str]]) -> DataFrame:
    """``question, metric, via``: asked metrics, and for a formula the metrics it is made of."""
    made = F.coalesce(*[F.when(F.col("metric") == name, F.array(*[F.lit(x) for x in own])) for name, own in leaves.items()], F.array("metric"))
    via = F.when(F.col("metric").isin(*leaves), F.col("metric"))
    return asked.select("question", F.explode(made).alias("metric"), via.alias("via")).distinct()


# ---- reranking


def hierarchy_adjustment(weights: dict[str, float], exact: Column, code: Column, depth: Column, statement: Column, period: Column, component: Column, recoverable: Column, collision: Column, confidence: Column) -> Column:
    """What a candidate's place in its table adds to its score: bonuses and penalties by policy."""
    yes = lambda c, name, sign=1.0: F.when(F.coalesce(c, F.lit(False)), sign * weights[name]).otherwise(0.0)
    deep = F.when(depth > 1, F.least(F.lit(4), depth - 1) * weights["hierarchy"]).otherwise(0.0)
    sure = F.coalesce(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), confidence - 0.5)), F.lit(0.0))
    bonuses = yes(exact, "exact") + yes(code, "code") + deep + yes(statement, "statement") + yes(period, "period")
    return bonuses + yes(component, "component", -1.0) + yes(recoverable, "recoverable", -1.0) + yes(collision, "collision", -1.0) + sure


def train_reranker(df: DataFrame, query: str, label: str, features: list[str]) -> DataFrame:
    """``feature, weight``: a linear ranker from the pairs of good and bad candidates of each query.

    The mean difference over all pairs of a query is the difference of its two means, so pairs are never
    formed; a feature's weight is its mean difference over queries, in units of its spread.
    """
    means = [F.avg(F.when(F.col(label) == side, F.col(f))).alias(f"{f}_{side}") for f in features for side in (1, 0)]
    per_query = df.groupBy(query).agg(*means)
    gaps = per_query.agg(*[F.avg(F.col(f"{f}_1") - F.col(f"{f}_0")).alias(f) for f in features])
    spread = df.agg(*[F.stddev_pop(f).alias(f"_{f}") for f in features])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.try_divide(F.col(f), F.col(f"_{f}")), F.lit(0.0)).alias("weight")) for f in features])
    return gaps.crossJoin(spread).select(F.inline(rows))


def proxy_gold(candidates: DataFrame, query: str, uid: str, hit: Column, most: int) -> DataFrame:
    """``query, uid``: a query's gold by proxy, its candidates that hold the answer; queries with more than ``most`` of them say too little."""
    found = candidates.where(hit).select(query, uid).distinct()
    few = found.groupBy(query).agg(F.count("*").alias("n")).where(F.col("n") <= most).select(query)
    return found.join(few, query, "left_semi")


def coverage(rows: DataFrame, by: str, stages: dict[str, Column]) -> DataFrame:
    """``by, n, <stage>..``: how many questions of each kind get through each stage and all before it."""
    through = F.lit(True)
    counts = []
    for name, ok in stages.items():
        through = through & F.coalesce(ok, F.lit(False))
        counts.append(F.count_if(through).alias(name))
    return rows.groupBy(by).agg(F.count("*").alias("n"), *counts)
