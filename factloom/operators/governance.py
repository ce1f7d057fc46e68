"""Governance of releases and answers: ordered table hashes, open cases, submissions, manifests and safe expressions."""

from __future__ import annotations

import ast
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.formulas import FormulaError


def table_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """``n, digest``: a table's fingerprint, whatever the order of its rows; two builds are equal if both agree.

    The sums of four parts of each row's digest are digested again, so repeated rows count as often as they stand.
    """
    text = F.concat_ws(chr(31), *[F.coalesce(F.col(c).cast("string"), F.lit(chr(30))) for c in columns])
    part = lambda n: F.conv(F.substring(F.md5(text.cast("binary")), 1 + 8 * n, 8), 16, 10).cast("decimal(38,0)")
    sums = df.select(*[part(n).alias(f"p{n}") for n in range(4)]).agg(F.count("*").alias("n"), *[F.sum(f"p{n}").cast("string").alias(f"p{n}") for n in range(4)])
    return sums.select("n", F.md5(F.concat_ws(",", "p0", "p1", "p2", "p3").cast("binary")).alias("digest"))


def open_cases(found: DataFrame, known: DataFrame, uid: str, reason: str) -> DataFrame:
    """``uid, reason, state``: findings that are new, still open, or closed since the registry was written."""
    joined = found.select(uid, reason).distinct().withColumn("_now", F.lit(True)).join(known.select(uid, reason).distinct().withColumn("_then", F.lit(True)), [uid, reason], "full")
    state = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "closed").otherwise("open")
    return joined.select(uid, reason, state.alias("state"))


def submission_problems(records: DataFrame, key: str, answer: str, status: str, evidence: str, questions: DataFrame, tables: DataFrame, most: int = 10) -> DataFrame:
    """``key, problem``: what keeps a submission from being published; each record is judged by every rule.

    Ids must be those of the questions, once each; an answer is a finite number where the status is OK and
    absent elsewhere; evidence is a list of known tables, distinct, one at least and ``most`` at the most.
    """
    counted = records.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("DUPLICATE_ID").alias("problem"))
    missing = questions.select(key).join(records.select(key), key, "left_anti").select(key, F.lit("MISSING_ID").alias("problem"))
    unknown = records.join(questions.select(key), key, "left_anti").select(key, F.lit("UNKNOWN_ID").alias("problem"))
    number = F.col(answer).try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    ok = F.col(status) == "OK"
    rules = {
        "ANSWER_NOT_A_NUMBER": ok & ~F.coalesce(finite, F.lit(False)),
        "ANSWER_WITHOUT_OK": ~ok & F.col(answer).isNotNull(),
        "NO_EVIDENCE": ok & (F.coalesce(F.size(evidence), F.lit(0)) == 0),
        "TOO_MUCH_EVIDENCE": F.size(evidence) > most,
        "REPEATED_EVIDENCE": F.size(F.array_distinct(evidence)) < F.size(evidence),
    }
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    judged = records.select(key, F.explode(hits).alias("problem"))
    named = records.select(key, F.explode(evidence).alias("table_uid"))
    foreign = named.join(tables.select("table_uid"), "table_uid", "left_anti").select(key, F.lit("UNKNOWN_TABLE").alias("problem")).distinct()
    return counted.unionByName(missing).unionByName(unknown.distinct()).unionByName(judged).unionByName(foreign)


def run_manifest(parts: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """``part, n, digest`` of all tables of a run."""
    out = None
    for name, df in parts.items():
        one = table_hash(df, columns[name]).select(F.lit(name).alias("part"), "n", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def flagged(flags: Column, name: str) -> Column:
    """Whether a JSON list of flags holds a name."""
    return F.coalesce(F.array_contains(F.from_json(flags, "array<string>"), name), F.lit(False))


# ---- safe expressions: which data can change the value

_ALLOWED = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.Call, ast.Name, ast.Load, ast.Constant, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.USub, ast.UAdd)
FUNCTIONS = {"abs": abs, "min": min, "max": max, "round": round, "pow": pow, "float": float}


def effective_inputs(text: str, names: Iterable[str]) -> frozenset[str]:
    """The names whose data can change an expression's value; an expression outside the allowed grammar fails.

    A name below a factor of zero, in a difference or quotient of equal expressions, or to the power of zero
    changes nothing and does not count.
    """
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as error:
        raise FormulaError(text) from error
    for node in ast.walk(tree):
        if not isinstance(node, _ALLOWED):
            raise FormulaError(f"{type(node).__name__} in {text}")
        if isinstance(node, ast.Call) and (not isinstance(node.func, ast.Name) or node.func.id not in FUNCTIONS or node.keywords):
            raise FormulaError(f"call in {text}")
    called = {n.func for n in ast.walk(tree) if isinstance(n, ast.Call)}
    known = frozenset(names)
    if unknown := {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and n not in called} - known:
        raise FormulaError(f"{sorted(unknown)} in {text}")
    return _moves(tree.body)[0]


def _moves(node: ast.expr) -> tuple[frozenset[str], float | None]:
    """The names that move a node's value, and the value where nothing does."""
    if isinstance(node, ast.Constant):
        if isinstance(node.value, bool) or not isinstance(node.value, int | float):
            raise FormulaError(ast.dump(node))
        return frozenset(), float(node.value)
    if isinstance(node, ast.Name):
        return frozenset([node.id]), None
    if isinstance(node, ast.UnaryOp):
        names, value = _moves(node.operand)
        return names, None if value is None else -value if isinstance(node.op, ast.USub) else value
    parts = [_moves(a) for a in (node.args if isinstance(node, ast.Call) else (node.left, node.right))]
    values = [v for _, v in parts]
    fixed = _settled(node, values)
    if fixed is not None:
        return frozenset(), fixed
    return frozenset().union(*(n for n, _ in parts)), None


def _settled(node: ast.expr, values: list[float | None]) -> float | None:
    """The value of a node that its inputs can't change, or None."""
    try:
        if isinstance(node, ast.Call):
            if node.func.id == "pow" and len(values) == 2 and values[1] == 0:
                return 1.0
            return float(FUNCTIONS[node.func.id](*values)) if values and None not in values else None
        if isinstance(node.op, ast.Mult) and 0 in values:
            return 0.0
        if isinstance(node.op, ast.Div) and values[0] == 0:
            return 0.0
        if isinstance(node.op, ast.Sub | ast.Div) and ast.dump(node.left) == ast.dump(node.right):
            return 0.0 if isinstance(node.op, ast.Sub) else 1.0
        if None in values:
            return None
        a, b = values
        return {ast.Add: a + b, ast.Sub: a - b, ast.Mult: a * b}[type(node.op)] if not isinstance(node.op, ast.Div) else a / b
    except (ArithmeticError, ValueError, TypeError):
        return None
