"""Selection of facts: star joins, filters, scores, roles, resolution of logical facts, fair cuts and bindings.

Observations are joined to their readiness, table, document and card on keys; what a caller asks for
reaches the scans as filters.  Choices are made by windows or by chains of equi-joins, never by
comparing every candidate with every other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def star(observations: DataFrame, readiness: DataFrame, tables: DataFrame, documents: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """Observations with all that is known of their readiness, table, document and, where given, card."""
    joined = observations.join(readiness, "observation_uid").join(tables, "table_uid").join(documents, "document_uid")
    return joined if cards is None else joined.join(cards, "table_uid")


def operand_filter(
    rows: DataFrame,
    entity: str | None = None,
    period: str | None = None,
    basis: str | None = None,
    tables: DataFrame | None = None,
    recoverable: tuple[str, ...] = (),
) -> DataFrame:
    """Rows that may be operands: ready, or of a collision class that can be recovered, with a value; a year or an exact date."""
    ready = F.col("execution_ready")
    if recoverable:
        ready = ready | (F.col("collision_class").isin(*recoverable) & F.col("row_uid").isNotNull() & F.col("column_uid").isNotNull())
    out = rows.where(ready & F.col("value").isNotNull())
    if entity:
        out = out.where(F.col("entity") == entity)
    if period:
        out = out.where((F.substring("period_end", 1, 4) if len(period) == 4 else F.col("period_end")) == period)
    if basis:
        out = out.where(F.col("basis") == basis)
    return out if tables is None else out.join(tables.select("table_uid").distinct(), "table_uid", "left_semi")


def grounded_filter(rows: DataFrame, entities: list[str], years: list[str], basis: str) -> DataFrame:
    """Facts of some entities and years in a basis; an entity without any in that basis gives its facts of no stated basis."""
    own = rows.where(F.col("entity").isin(entities) & F.substring("period_end", 1, 4).isin(years))
    in_basis = own.where(F.col("basis") == basis)
    rest = own.where(F.col("basis").isNull()).join(in_basis.select("entity").distinct(), "entity", "left_anti")
    return in_basis.unionByName(rest)


# ---- scores and roles

#: What a match of a metric is worth by its strength, and the other parts of a candidate's score.
METRIC_SCORES = {4: 22.25, 3: 22.0, 2: 20.0, 1: 10.0}
STATEMENT_SCORE, BASIS_SCORE, RESTATED_PENALTY = 3.0, 1.0, 0.5


def candidate_score(
    quality: Column, alias_length: Column, statement: Column, preferred_basis: Column, restated: Column, extras: list[Column], rank: Column, ranked: Column
) -> Column:
    """Score of a candidate: its metric match, then statement, basis, extras (period role, section, qualifier, document), restatement and table rank."""
    metric = F.coalesce(*[F.when(quality == k, v) for k, v in METRIC_SCORES.items()], F.lit(0.0))
    yes = lambda condition, worth: F.when(F.coalesce(condition, F.lit(False)), worth).otherwise(0.0)
    place = F.coalesce(F.greatest(F.lit(0.0), 1.0 - rank / F.greatest(F.lit(1), ranked)), F.lit(0.0))
    total = metric + alias_length / 100.0 + yes(statement, STATEMENT_SCORE) + yes(preferred_basis, BASIS_SCORE) - yes(restated, RESTATED_PENALTY) + place
    return sum(extras, total)


def role_of(text: Column, roles: list[tuple[str, tuple[str, ...]]], otherwise: Column) -> Column:
    """The first role, in order of priority, one of whose words a text holds as whole words."""
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    names = [(role, [F.contains(padded, F.lit(f" {w} ")) for w in words]) for role, words in roles]
    return F.coalesce(*[F.when(_any(hits), F.lit(role)) for role, hits in names], otherwise)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def rejection(checks: list[tuple[str, Column]]) -> Column:
    """The reason of the first check that fails, in order, or null."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in checks])


def longest_run(one: Column, two: Column, most: int) -> Column:
    """Length of the longest run of tokens that two lists share, up to ``most`` (the length of the shorter question)."""
    joined = lambda tokens, n: F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " ")
    )
    long_enough = lambda n: (F.size(one) >= n) & (F.size(two) >= n)
    shared = [F.when(long_enough(n) & F.arrays_overlap(joined(one, n), joined(two, n)), n) for n in range(most, 0, -1)]
    return F.coalesce(*shared, F.lit(0))


def select_cells(df: DataFrame, slot: list[str], gate: Column, components: list[Column], uid: str) -> DataFrame:
    """The best cell of every slot: those past the gate, by their components in order, the smallest id on ties."""
    order = Window.partitionBy(*slot).orderBy(*[F.desc(c) for c in components], F.asc(uid))
    return df.where(gate).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


# ---- logical facts


def resolve_facts(df: DataFrame, key: list[str], value: str, table: str, score: str, uid: str, margin: float) -> DataFrame:
    """``key.., value, uid, score, corroboration, status`` of every logical fact.

    Copies of a value in one table count once, with their best score.  The best scored value wins; it is
    corroborated by every table that has it, and in conflict where another value comes within ``margin``.
    """
    once = df.groupBy(*key, value, table).agg(F.max(score).alias("s"), F.min_by(uid, F.struct(-F.col(score), F.col(uid))).alias("u"))
    values = once.groupBy(*key, value).agg(F.max("s").alias("score"), F.min_by("u", F.struct(-F.col("s"), F.col("u"))).alias("uid"), F.count("*").alias("corroboration"))
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.desc("corroboration"), F.asc("uid"))
    ranked = values.withColumns({"place": F.row_number().over(order), "next": F.lead("score").over(order)})
    conflict = F.coalesce(F.col("score") - F.col("next") < margin, F.lit(False))
    status = F.when(conflict, "CONFLICT").when(F.col("corroboration") > 1, "CORROBORATED").otherwise("SINGLE")
    return ranked.where("place = 1").select(*key, F.col(value).alias("value"), "uid", "score", "corroboration", status.alias("status"))


def fair_selection(df: DataFrame, question: str, metric: str, scope: list[str], score: str, uid: str, limit: int) -> DataFrame:
    """At most ``limit`` facts of every question, max-min fair over metrics, then over scopes, then by score.

    The next fact is always one of a metric served least so far, of these one of a scope served least, of
    these the best, the smallest id on ties; a question's candidates meet in one task, as each choice depends
    on all before, and the questions of a task take their turns together.
    """

    columns = df.columns
    number = isinstance(df.schema[score].dataType, (T.FloatType, T.DoubleType))
    best = F.when(~F.isnan(score), F.col(score)) if number else F.col(score)  # neither null nor NaN is a score
    order = [F.col(question), F.desc_nulls_last("_best"), F.asc_nulls_last(uid), *[F.asc(c) for c in (metric, *scope)]]
    rows = df.withColumn("_best", best).repartition(question).sortWithinPartitions(*order).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches, question):
            group = np.cumsum(_changes(part.column(question))) - 1
            kept = fair_rows(group, _codes(part, [metric]), _codes(part, scope), limit)
            yield from part.take(pa.array(kept)).to_batches()

    return rows.mapInArrow(run, df.schema)


#: Rows of whole questions that one step of the fair choice takes together, if there are as many.
STEP_ROWS = 1 << 18


def fair_rows(group: np.ndarray, metric: np.ndarray, scope: np.ndarray, limit: int) -> np.ndarray:
    """The rows chosen of each group (numbered from 0, in order), whose rows stand best first; all groups take their n-th turn at once."""
    n = len(group)
    # Cells of one group, metric and scope: in each the first row that is left stands for all that follow.
    order = np.lexsort((np.arange(n), scope, metric, group))
    new = np.ones(n, bool)
    new[1:] = (np.diff(group[order]) != 0) | (np.diff(metric[order]) != 0) | (np.diff(scope[order]) != 0)
    head = np.flatnonzero(new)
    end = np.append(head[1:], n)
    owner = group[order[head]]
    by_metric = np.unique(np.stack([owner, metric[order[head]]], axis=1), axis=0, return_inverse=True)[1].ravel()
    by_scope = np.unique(np.stack([owner, scope[order[head]]], axis=1), axis=0, return_inverse=True)[1].ravel()
    metrics, scopes, chosen = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64), [np.zeros(0, np.int64)]
    for _ in range(limit):
        if not len(head):
            break
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes = np.diff(np.append(first, len(head)))
        open_cells = np.ones(len(head), bool)
        for key in (metrics[by_metric], scopes[by_scope], order[head]):
            key = np.where(open_cells, key, np.iinfo(np.int64).max)
            open_cells &= key == np.repeat(np.minimum.reduceat(key, first), sizes)
        taken = np.flatnonzero(open_cells)
        chosen.append(order[head[taken]])
        metrics[by_metric[taken]] += 1
        scopes[by_scope[taken]] += 1
        head[taken] += 1
        left = head < end
        head, end, owner, by_metric, by_scope = head[left], end[left], owner[left], by_metric[left], by_scope[left]
    return np.sort(np.concatenate(chosen))


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """True where a row's value differs from that of the row before, null being a value."""
    new = np.ones(len(column), bool)
    codes = _codes(pa.table({"_": column}), ["_"])
    new[1:] = codes[1:] != codes[:-1]
    return new


def _codes(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """One number for each different tuple of values, null being a value."""
    out = np.zeros(rows.num_rows, np.int64)
    for c in columns:
        encoded = pc.dictionary_encode(rows.column(c).combine_chunks(), null_encoding="encode")
        encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
        out = out * len(encoded.dictionary) + encoded.indices.to_numpy()
        out = np.unique(out, return_inverse=True)[1].ravel() if len(columns) > 1 else out
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups of rows sorted by a key; only the last group of what has come is held back."""
    held, count, enough = [], 0, STEP_ROWS
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < enough:
            continue
        rows = pa.Table.from_batches(held)
        last = int(np.flatnonzero(_changes(rows.column(key)))[-1])
        if last:
            yield rows.slice(0, last)
        held = rows.slice(last).to_batches()
        count = rows.num_rows - last
        enough = max(STEP_ROWS, 2 * count)  # a group of many steps is not searched at each of them
    if count:
        yield pa.Table.from_batches(held)


# ---- bindings


@dataclass(frozen=True)
class Same:
    """Roles whose candidates must agree on a column; a null agrees with nothing."""

    column: str
    roles: tuple[str, ...]


def bind(candidates: DataFrame, question: str, roles: list[str], constraints: list[Same], uid: str = "uid", score: str = "score", beam: int = 64) -> DataFrame:
    """``question, uid_0.., total, tie``: the coherent assignment of distinct candidates to roles with the largest score.

    ``candidates`` has ``question, role, uid, score`` and the constraints' columns.  Roles are joined one by one
    on what they must agree on, and after each the best ``beam`` partial assignments of a question go on.
    """
    columns = sorted({c.column for c in constraints})

    def side(n: int) -> DataFrame:
        own = candidates.where(F.col("role") == roles[n])
        return own.select(question, F.col(uid).alias(f"uid_{n}"), F.col(score).alias(f"score_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in columns])

    states = side(0).withColumn("total", F.col("score_0"))
    states = _best(states, question, 1, beam)
    for n in range(1, len(roles)):
        other = side(n).withColumnRenamed(question, "_question")
        condition = F.col(question) == F.col("_question")
        for c in constraints:
            if roles[n] in c.roles:
                condition = condition & _all_equal(c, roles, n)
        for k in range(n):
            condition = condition & (F.col(f"uid_{k}") != F.col(f"uid_{n}"))
        states = states.join(other, condition).drop("_question").withColumn("total", F.col("total") + F.col(f"score_{n}"))
        states = _best(states, question, n + 1, beam)
    uids = [f"uid_{n}" for n in range(len(roles))]
    order = Window.partitionBy(question).orderBy(F.desc("total"), *[F.asc(u) for u in uids])
    ranked = states.withColumns({"place": F.row_number().over(order), "next": F.lead("total").over(order)})
    return ranked.where("place = 1").select(question, *uids, "total", F.coalesce(F.col("next") == F.col("total"), F.lit(False)).alias("tie"))


def _all_equal(constraint: Same, roles: list[str], n: int) -> Column:
    earlier = [k for k in range(n) if roles[k] in constraint.roles]
    out = F.lit(True)
    for k in earlier:
        out = out & (F.col(f"{constraint.column}_{k}") == F.col(f"{constraint.column}_{n}"))
    return out


def _best(states: DataFrame, question: str, width: int, beam: int) -> DataFrame:
    order = Window.partitionBy(question).orderBy(F.desc("total"), *[F.asc(f"uid_{n}") for n in range(width)])
    return states.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= beam).drop("_place")


def ranked_bindings(candidates: DataFrame, question: str, roles: list[str], uid: str = "uid", score: str = "score", most: int = 3) -> DataFrame:
    """``question, uid_0.., place``: up to ``most`` assignments of distinct cells, from each role's best ``most``, by the sum of their ranks."""
    order = Window.partitionBy(question, "role").orderBy(F.desc(score), F.asc(uid))
    top = candidates.where(F.col("role").isin(roles)).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < most)
    side = lambda n: top.where(F.col("role") == roles[n]).select(question, F.col(uid).alias(f"uid_{n}"), F.col("rank").alias(f"rank_{n}"))
    joined = side(0)
    for n in range(1, len(roles)):
        joined = joined.join(side(n), question)
        for k in range(n):
            joined = joined.where(F.col(f"uid_{k}") != F.col(f"uid_{n}"))
    ranks = [F.col(f"rank_{n}") for n in range(len(roles))]
    by = Window.partitionBy(question).orderBy(sum(ranks[1:], ranks[0]), *ranks)
    return joined.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).select(question, *[f"uid_{n}" for n in range(len(roles))], "place")


def greedy_binding(candidates: DataFrame, question: str, roles: list[str], uid: str = "uid", score: str = "score") -> DataFrame:
    """``question, uid_0..``: role by role the best cell that no earlier role took; questions with a role unbound are left out."""
    order = Window.partitionBy(question).orderBy(F.desc(score), F.asc(uid))
    taken = None
    for n, role in enumerate(roles):
        own = candidates.where(F.col("role") == role).select(question, F.col(uid).alias(f"uid_{n}"), F.col(score))
        if taken is not None:
            own = own.join(taken, question)
            for k in range(n):
                own = own.where(F.col(f"uid_{k}") != F.col(f"uid_{n}"))
        by = Window.partitionBy(question).orderBy(F.desc(score), F.asc(f"uid_{n}")) if n or uid != "uid_0" else order
        taken = own.withColumn("_place", F.row_number().over(by)).where("_place = 1").select(question, *[f"uid_{k}" for k in range(n + 1)])
    return taken


def route(records: DataFrame, key: str, steps: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """``key, route``: the first route of a cascade whose condition a record meets."""
    chosen = F.coalesce(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in steps], F.lit(otherwise))
    return records.select(key, chosen.alias("route"))
