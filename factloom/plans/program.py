"""Programs: a DAG of named operations, each node a DataFrame.

A node is ``(id, operation, inputs, parameters)``.  Nodes run in the order given and may only read earlier
ones; the last is the result.  Series are keyed by ``entity``, ``period``, both or nothing (a scalar), and
carry ``value``, ``flag`` or ``key``; nothing is computed before the result is asked for, so Catalyst sees
the whole program as one plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import aggregates as ag
from factloom.operators import formulas as fo
from factloom.operators import predicates as pr
from factloom.operators import windows as wi

AXES = ("entity", "period")


class ProgramError(ValueError):
    """A program that is no valid DAG of known operations."""


@dataclass(frozen=True)
class Node:
    id: str
    operation: str
    inputs: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)


def keys_of(df: DataFrame) -> list[str]:
    return [a for a in AXES if a in df.columns]


def _joined(a: DataFrame, b: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """Both sides' column as ``a`` and ``b`` on their common keys; a side without keys is one row for all."""
    ka, kb = keys_of(a), keys_of(b)
    left, right = a.select(*ka, F.col(column).alias("a")), b.select(*kb, F.col(column).alias("b"))
    shared = [k for k in ka if k in kb]
    if shared:
        return left.join(right, shared), [k for k in AXES if k in ka or k in kb]
    if ka and kb:
        raise ProgramError(f"no common axis: {ka} and {kb}")
    return (left.join(F.broadcast(right)) if ka else F.broadcast(left).join(right)), ka or kb


def _binary(function: Callable[[Column, Column], Column], column: str = "value", out: str = "value"):
    def run(inputs: list[DataFrame], _: dict) -> DataFrame:
        joined, keys = _joined(inputs[0], inputs[1], column)
        return joined.select(*keys, function(F.col("a"), F.col("b")).alias(out))

    return run


def _fold(function: Callable[[Column, Column], Column]):
    def run(inputs: list[DataFrame], p: dict) -> DataFrame:
        out = inputs[0]
        for other in inputs[1:]:
            out = _binary(function, "flag", "flag")([out, other], p)
        return out

    return run


def _unary(function: Callable[[Column], Column]):
    return lambda inputs, _: inputs[0].select(*keys_of(inputs[0]), function(F.col("value")).alias("value"))


def _scalar(function):
    def run(inputs: list[DataFrame], _: dict) -> DataFrame:
        values = [df.select("value") for df in inputs]
        union = values[0]
        for df in values[1:]:
            union = union.unionByName(df)
        return union.agg(function("value").alias("value"))

    return run


def _by_entity(function, *, judged: bool = False):
    def run(inputs: list[DataFrame], _: dict) -> DataFrame:
        out = function(inputs[0])
        return (out.where("status = 'OK'") if judged else out).select("entity", "value")

    return run


def _flags_by_entity(function):
    return lambda inputs, _: function(inputs[0]).select("entity", "flag")


def _rolling(function):
    def run(inputs: list[DataFrame], _: dict) -> DataFrame:
        df = inputs[0]
        if "entity" in df.columns:
            return function(df).select("entity", "period", "value")
        return function(df.withColumn("entity", F.lit(""))).select("period", "value")

    return run


def _mask(top: bool):
    return lambda inputs, p: wi.k_mask(inputs[0], p["k"], top, tuple(keys_of(inputs[0]))).drop("value")


def _compare(inputs: list[DataFrame], p: dict) -> DataFrame:
    if len(inputs) == 1:
        inputs = [*inputs, inputs[0].sparkSession.range(1).select(F.lit(float(p["value"])).alias("value"))]
    return _binary(pr.COMPARISONS[p["operator"]], "value", "flag")(inputs, p)


def _filter(inputs: list[DataFrame], _: dict) -> DataFrame:
    values, flags = inputs
    shared = [k for k in keys_of(values) if k in keys_of(flags)]
    return values.join(flags.where("flag").select(*shared).distinct(), shared, "left_semi")


def _arg(largest: bool):
    def run(inputs: list[DataFrame], _: dict) -> DataFrame:
        keys = keys_of(inputs[0])
        if len(keys) != 1:
            raise ProgramError("an arg-extremum needs one axis")
        return (wi.argmax_key if largest else wi.argmin_key)(inputs[0], keys[0]).select(F.col("key").alias(keys[0]))

    return run


def _select_at_key(inputs: list[DataFrame], _: dict) -> DataFrame:
    values, key = inputs
    on = [k for k in keys_of(key) if k in keys_of(values)]
    return values.join(key.select(*on), on)


def _true_key(function):
    def run(inputs: list[DataFrame], _: dict) -> DataFrame:
        df = inputs[0]
        keyed = df if "entity" in df.columns else df.withColumn("entity", F.lit(""))
        out = function(keyed).where("key IS NOT NULL").withColumnRenamed("key", "period")
        return out if "entity" in df.columns else out.drop("entity")

    return run


def _literal(inputs: list[DataFrame], p: dict) -> DataFrame:
    df = inputs[0]
    return df.select(*keys_of(df), F.lit(float(p["value"])).alias("value"))


def _sum_by_scope(inputs: list[DataFrame], p: dict) -> DataFrame:
    keys = list(AXES) if p["axis"] == "entity_period" else [p["axis"]]
    return inputs[0].groupBy(*keys).agg(F.sum("value").alias("value"))


def _drop_first(inputs: list[DataFrame], _: dict) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("entity").orderBy("period"))
    return inputs[0].withColumn("at", at).where("at > 1").drop("at")


def _growth(old: Column, new: Column) -> Column:
    """Programs take the old value first and give per cent."""
    return F.try_divide(new - old, F.abs(old)) * 100


OPERATIONS: dict[str, Callable[[list[DataFrame], dict], DataFrame]] = {
    "literal": _literal,
    "add": _binary(lambda a, b: a + b),
    "subtract": _binary(lambda a, b: a - b),
    "multiply": _binary(lambda a, b: a * b),
    "divide": _binary(F.try_divide),
    "growth": _binary(_growth),
    "growth_by_entity": _by_entity(ag.growth_by_entity, judged=True),
    "change_by_entity": _by_entity(ag.change_by_entity, judged=True),
    "cagr_by_entity": _by_entity(ag.cagr_by_entity, judged=True),
    "earliest_by_entity": _by_entity(ag.earliest_by_entity),
    "latest_by_entity": _by_entity(ag.latest_by_entity),
    "average_by_entity": _by_entity(ag.average_by_entity),
    "sum_by_entity": _by_entity(lambda df: df.groupBy("entity").agg(F.sum("value").alias("value"))),
    "sum_by_scope": _sum_by_scope,
    "all_by_entity": _flags_by_entity(ag.all_by_entity),
    "any_by_entity": _flags_by_entity(ag.any_by_entity),
    "rolling_growth": _rolling(lambda df: wi.rolling_growth(df, percent=True)),
    "rolling_growth_by_entity": _rolling(lambda df: wi.rolling_growth(df, percent=True)),
    "rolling_average": _rolling(wi.rolling_average),
    "rolling_average_by_entity": _rolling(wi.rolling_average),
    "rolling_change": _rolling(wi.rolling_change),
    "rolling_change_by_entity": _rolling(wi.rolling_change),
    "drop_first_by_entity": _drop_first,
    "top_k_mask": _mask(True),
    "bottom_k_mask": _mask(False),
    "shift_key": lambda inputs, p: inputs[0].withColumn("period", F.col("period") + p["years"]),
    "key_to_number": lambda inputs, _: inputs[0].select(F.col(keys_of(inputs[0])[0]).cast("double").alias("value")),
    "first_true_key": _true_key(wi.first_true_key),
    "last_true_key": _true_key(wi.last_true_key),
    "to_percent": _unary(lambda v: v * 100),
    "absolute": _unary(F.abs),
    "sum": _scalar(F.sum),
    "average": _scalar(F.avg),
    "median": _scalar(F.median),
    "minimum": _scalar(F.min),
    "maximum": _scalar(F.max),
    "compare": _compare,
    "is_zero": lambda inputs, _: inputs[0].select(*keys_of(inputs[0]), (F.col("value") == 0).alias("flag")),
    "is_nonzero": lambda inputs, _: inputs[0].select(*keys_of(inputs[0]), (F.col("value") != 0).alias("flag")),
    "logical_and": _fold(lambda a, b: a & b),
    "logical_or": _fold(lambda a, b: a | b),
    "filter": _filter,
    "argmax_key": _arg(True),
    "argmin_key": _arg(False),
    "select_at_key": _select_at_key,
    "count_true": lambda inputs, _: inputs[0].agg(F.count_if("flag").cast("double").alias("value")),
}


class Program:
    def __init__(self, nodes: list[Node]) -> None:
        self.nodes = nodes
        self.verify()

    def verify(self) -> None:
        """Known operations, unique ids, inputs before use, and no node that the result does not need."""
        seen: set[str] = set()
        used: set[str] = set()
        for node in self.nodes:
            if node.id in seen:
                raise ProgramError(f"{node.id} is defined twice")
            if node.operation not in ("facts", "formula", *OPERATIONS):
                raise ProgramError(f"unknown operation {node.operation}")
            if missing := [i for i in node.inputs if i not in seen]:
                raise ProgramError(f"{node.id} reads {missing} before they are defined")
            seen.add(node.id)
            used.update(node.inputs)
        if loose := seen - used - {self.nodes[-1].id}:
            raise ProgramError(f"{sorted(loose)} do not contribute to the result")

    def run(self, facts: Callable[[list[str]], DataFrame]) -> DataFrame:
        """Result of the last node; ``facts(metrics)`` gives ``entity, period`` and a column per metric."""
        metrics = {m for n in self.nodes if n.operation == "facts" for m in [n.parameters["metric"]]}
        texts = {n.id: fo.parse(n.id, n.parameters["text"]) for n in self.nodes if n.operation == "formula"}
        metrics |= {leaf for f in texts.values() for leaf in f.leaves}
        wide = facts(sorted(metrics))
        done: dict[str, DataFrame] = {}
        for node in self.nodes:
            if node.operation == "facts":
                made = wide.select(*AXES, F.col(node.parameters["metric"]).cast("double").alias("value")).where("value IS NOT NULL")
            elif node.operation == "formula":
                made = fo.formula_series(wide, node.parameters["text"], node.id)
            else:
                made = OPERATIONS[node.operation]([done[i] for i in node.inputs], node.parameters)
            if node.operation in ("facts", "formula") and (entities := node.parameters.get("entities")):
                made = made.where(F.col("entity").isin(entities))
            if node.operation in ("facts", "formula") and (years := node.parameters.get("years")):
                made = made.where(F.col("period").isin(years))
            done[node.id] = made
        return done[self.nodes[-1].id]

    def to_json(self) -> str:
        return json.dumps([{"id": n.id, "op": n.operation, "in": list(n.inputs), "with": n.parameters} for n in self.nodes], sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Program:
        return Program([Node(n["id"], n["op"], tuple(n.get("in", ())), n.get("with", {})) for n in json.loads(text)])

    @staticmethod
    def parse(text: str) -> Program:
        """Lines ``id = operation(input, .., name=value, ..)``; values are JSON."""
        nodes = []
        for line in filter(None, (x.strip() for x in text.strip().splitlines())):
            name, _, call = line.partition("=")
            operation, _, rest = call.strip().partition("(")
            inputs, parameters = [], {}
            for part in _arguments(rest.rsplit(")", 1)[0]):
                key, mark, value = part.partition("=")
                if mark and key.strip().isidentifier():
                    parameters[key.strip()] = json.loads(value)
                else:
                    inputs.append(part.strip())
            nodes.append(Node(name.strip(), operation.strip(), tuple(inputs), parameters))
        return Program(nodes)


def _arguments(text: str) -> list[str]:
    """Split at commas outside quotes and brackets."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "[{(":
            depth += 1
        elif not quoted and c in "]})":
            depth -= 1
        elif c == "," and not depth and not quoted:
            out.append(text[start:i])
            start = i + 1
    return [p for p in [*out, text[start:]] if p.strip()]
