"""Evaluation of rankings and answers: per-query metrics first, macro averages after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_query(gold: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Metrics of each query with gold: ``gold (query_id, uid)``, ``ranked (query_id, uid, place)``.

    Queries without a ranking score 0.  F2 is ``5h / (4g + n)`` of the query's own hits, gold size and
    returned size, and is averaged over queries, never derived from macro precision and recall.
    """
    wanted = gold.select("query_id", "uid").distinct()
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("g"))
    top = ranked.where(F.col("place") <= k)
    returned = top.groupBy("query_id").agg(F.count("*").alias("n"))
    gain = F.lit(1.0) / F.log2(F.col("place") + 1)
    hits = top.join(wanted, ["query_id", "uid"]).groupBy("query_id").agg(
        F.count("*").alias("h"), F.min("place").alias("first"), F.sum(gain).alias("dcg")
    )
    rows = sizes.join(returned, "query_id", "left").join(hits, "query_id", "left").fillna(0, ["n", "h", "dcg"])
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("g"), F.lit(k)).cast("int")), F.lit(0.0), lambda total, i: total + F.lit(1.0) / F.log2(i + 1)
    )
    return rows.select(
        "query_id",
        (F.col("h") / F.col("g")).alias("recall"),
        F.coalesce(F.try_divide(F.col("h"), F.col("n")), F.lit(0.0)).alias("precision"),
        (F.col("h") / F.least(F.col("g"), F.lit(k))).alias("capped_precision"),
        (5 * F.col("h") / (4 * F.col("g") + F.col("n"))).alias("f2"),
        (F.col("h") > 0).cast("double").alias("hit"),
        F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), F.lit(0.0)).alias("mrr"),
        (F.col("dcg") / ideal).alias("ndcg"),
    )


METRICS = ("recall", "precision", "capped_precision", "f2", "hit", "mrr", "ndcg")


def macro(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scores.groupBy(*(by or [])).agg(F.count("*").alias("n_queries"), *[F.avg(m).alias(m) for m in METRICS])


def candidate_hit_rate(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """Share of queries with any gold item among their candidates."""
    queries = gold.select("query_id").distinct()
    hit = gold.join(candidates.select("query_id", "uid").distinct(), ["query_id", "uid"]).select("query_id").distinct().withColumn("hit", F.lit(1.0))
    return queries.join(hit, "query_id", "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("hit_rate"))


def paired(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """``query_id, a, b, outcome`` of two runs."""
    joined = a.select("query_id", F.col(metric).alias("a")).join(b.select("query_id", F.col(metric).alias("b")), "query_id", "full")
    x, y = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return joined.select("query_id", x.alias("a"), y.alias("b"), F.when(y > x, "better").when(y < x, "worse").otherwise("same").alias("outcome"))


def stage_loss(gold: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """``query_id, uid, lost_at``: the first stage whose output no longer holds a gold item."""
    out = gold.select("query_id", "uid").distinct()
    lost = F.lit(None).cast("string")
    for name, df in reversed(list(stages.items())):
        out = out.join(df.select("query_id", "uid", F.lit(True).alias(f"in_{name}")).distinct(), ["query_id", "uid"], "left")
        lost = F.when(F.col(f"in_{name}").isNull(), name).otherwise(lost)
    return out.select("query_id", "uid", F.coalesce(lost, F.lit("kept")).alias("lost_at"))


def execution_score(answers: DataFrame, close: Column) -> DataFrame:
    """Accuracy over all questions: an abstention counts as wrong, and is reported."""
    answered = F.col("status") == "OK"
    return answers.agg(
        F.count("*").alias("n"),
        F.count_if(answered).alias("answered"),
        F.avg((answered & F.coalesce(close, F.lit(False))).cast("double")).alias("accuracy"),
        F.avg(F.when(answered, F.coalesce(close, F.lit(False)).cast("double"))).alias("accuracy_answered"),
    )


def failure_kind(status: Column, reason: Column, close: Column) -> Column:
    return (
        F.when((status == "OK") & F.coalesce(close, F.lit(False)), "correct")
        .when(status == "OK", "wrong_value")
        .when(reason.rlike("ZERO|NEGATIVE|SIGN"), "undefined")
        .when(reason.rlike("DIMENSION|CURRENCY|SCALE"), "unit")
        .when(reason.rlike("KEY|EMPTY|INCOMPLETE|PERIODS"), "evidence")
        .otherwise("other")
    )
