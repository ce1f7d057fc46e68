"""Data quality: rule tables, readiness, collisions, identities, budgets and gates.

Rules are data.  A rule is a condition over one table; all rules of a table are evaluated in one pass,
and their findings are the union of the rules that hold per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    condition: str


def findings(df: DataFrame, rules: list[Rule], uid: str, table: str) -> DataFrame:
    """``table, uid, rule_id, severity`` of every row and rule that holds on it."""
    hits = F.array_compact(
        F.array(*[F.when(F.expr(r.condition), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for r in rules])
    )
    return df.select(F.lit(table).alias("table"), F.col(uid).cast("string").alias("uid"), F.inline(hits))


def rule_counts(df: DataFrame, rules: list[Rule], table: str) -> DataFrame:
    """Totals of every rule, those without findings too."""
    counts = [F.count_if(F.expr(r.condition)).alias(r.rule_id) for r in rules]
    rows = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.col(r.rule_id).alias("n")) for r in rules])
    return df.agg(*counts).select(F.lit(table).alias("table"), F.inline(rows))


def sampled(found: DataFrame, per_rule: int) -> DataFrame:
    """At most ``per_rule`` stored findings a rule (a report; totals are kept apart)."""
    order = Window.partitionBy("rule_id").orderBy("uid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_rule).drop("place")


def null_budget(df: DataFrame, budgets: dict[str, float], table: str) -> DataFrame:
    """Share of nulls per column against its budget."""
    shares = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in budgets]
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_share"), (F.col(c) <= b).alias("within")) for c, b in budgets.items()]
    )
    return df.agg(*shares).select(F.lit(table).alias("table"), F.inline(rows))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


# ---- readiness: candidate -> blocking -> ready, with canonical reason arrays

OPERATORS = {
    "is_null": lambda c, v: c.isNull(),
    "is_not_null": lambda c, v: c.isNotNull(),
    "not_blank": lambda c, v: c.isNotNull() & (F.trim(c) != ""),
    "not_in": lambda c, v: c.isNotNull() & ~c.isin(*v),
    "in": lambda c, v: c.isNotNull() & c.isin(*v),
}


@dataclass(frozen=True)
class Requirement:
    """A row lacks ``reason`` if the operator holds on the field."""

    field: str
    operator: str
    reason: str
    values: tuple = ()


def _reasons(requirements: list[Requirement]) -> Column:
    missing = [F.when(~F.coalesce(OPERATORS[r.operator](F.col(r.field), r.values), F.lit(False)), F.lit(r.reason)) for r in requirements]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*missing)))) if missing else F.array().cast("array<string>")


def readiness(df: DataFrame, required: list[Requirement], blocking: list[Requirement], warning: list[Requirement]) -> DataFrame:
    """Adds ``execution_candidate, execution_ready`` and three sorted reason arrays.

    A row without a required field is no candidate and its blocking reasons are not looked at; ready implies
    candidate; warnings never lower readiness.
    """
    out = df.withColumn("non_candidate_reasons", _reasons(required))
    candidate = F.size("non_candidate_reasons") == 0
    out = out.withColumn("blocking_reasons", F.when(candidate, _reasons(blocking)).otherwise(F.array().cast("array<string>")))
    return out.withColumns(
        {
            "warning_reasons": _reasons(warning),
            "execution_candidate": candidate,
            "execution_ready": candidate & (F.size("blocking_reasons") == 0),
        }
    )


# ---- collisions: several values under one semantic key


def collision_groups(df: DataFrame, keys: list[str], nullable_key: str, value: str, row: str, column: str, cell: str, anchor: str | None = None) -> DataFrame:
    """Groups with more than one value and their class; a null period joins the empty one instead of splitting."""
    key = F.coalesce(F.col(nullable_key).cast("string"), F.lit(""))
    rows = df.where(F.col(value).isNotNull()).withColumn("period_key", key)
    # Distinct counts multiply the rows, so only keys with different values reach them.
    several = rows.groupBy(*keys, "period_key").agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low < high")
    rows = rows.join(several.select(*keys, "period_key"), [*keys, "period_key"], "left_semi")
    grouped = rows.groupBy(*keys, "period_key").agg(
        F.count("*").alias("n_obs"),
        F.count_distinct(value).alias("n_values"),
        F.count_distinct(row).alias("n_rows"),
        F.count_distinct(column).alias("n_columns"),
        F.count_distinct(cell).alias("n_cells"),
        (F.count_distinct(anchor) if anchor else F.lit(0)).alias("n_anchors"),
    )
    kind = (
        F.when(F.col("n_cells") < F.col("n_obs"), "physical_duplicate")
        .when((F.col("n_rows") == 1) & (F.col("n_columns") > 1), "missing_column_group")
        .when(F.col("n_anchors") > 1, "missing_row_parent")
        .when(F.col("n_anchors") == 1, "missing_dimension")
        .when(F.col("n_anchors") == 0, "missing_label_or_split")
        .otherwise("unknown")
    )
    return grouped.where("n_values > 1").withColumn("collision_class", kind)


def collided(df: DataFrame, groups: DataFrame, keys: list[str], nullable_key: str) -> DataFrame:
    """Rows of the groups, with their class."""
    key = F.coalesce(F.col(nullable_key).cast("string"), F.lit(""))
    return df.withColumn("period_key", key).join(groups.select(*keys, "period_key", "collision_class"), [*keys, "period_key"])


#: Fixed value: the gap that rounding may leave between a total and its parts.
IDENTITY_TOLERANCE = 2.0


@dataclass(frozen=True)
class Identity:
    """``total = sum of parts``; a missing optional part counts as 0, any other makes the identity untestable."""

    name: str
    total: str
    parts: tuple[str, ...]
    optional: tuple[str, ...] = ()


def reconcile(df: DataFrame, by: list[str], code: str, value: str, identities: list[Identity], tolerance: float = IDENTITY_TOLERANCE) -> DataFrame:
    """``by.., identity, gap, status`` of every identity in every group, all from one pivot."""
    codes = sorted({c for i in identities for c in (i.total, *i.parts, *i.optional)})
    wide = df.groupBy(*by).agg(*[F.max(F.when(F.col(code) == c, F.col(value))).alias(f"_{n}") for n, c in enumerate(codes)])
    at = {c: F.col(f"_{n}") for n, c in enumerate(codes)}
    rows = []
    for i in identities:
        terms = [at[p] for p in i.parts] + [F.coalesce(at[p], F.lit(0.0)) for p in i.optional]
        gap = at[i.total] - sum(terms[1:], terms[0])
        status = F.when(gap.isNull(), "UNTESTABLE").when(F.abs(gap) <= tolerance, "OK").otherwise("BROKEN")
        rows.append(F.struct(F.lit(i.name).alias("identity"), gap.alias("gap"), status.alias("status")))
    return wide.select(*by, F.inline(F.array(*rows)))


def identity_check(df: DataFrame, by: list[str], code: str, value: str, total: str, parts: list[str], optional: list[str] = (), tolerance: float = IDENTITY_TOLERANCE) -> DataFrame:
    """One identity per group."""
    found = reconcile(df, by, code, value, [Identity("", total, tuple(parts), tuple(optional))], tolerance)
    return found.drop("identity")


def column_profile(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Upper-middle number of digits, the share of cells with two at most, and the share of numeric cells."""
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    rows = df.withColumn("digits", digits)
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY digits DESC)").cast("int")  # counts per length, not all rows
    return rows.groupBy(*by).agg(
        middle.alias("median_digits"),
        F.avg((F.col("digits") <= 2).cast("double")).alias("share_short"),
        F.avg(F.col(text).rlike(r"^[\d.,\s()-]*\d[\d.,\s()-]*$").cast("double")).alias("share_numeric"),
    )


def gates(counts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``gate, n, passed`` of named counts against their limits."""
    names = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    return counts.select(F.col("check").alias("gate"), "n", (F.col("n") <= F.coalesce(F.element_at(names, F.col("check")), F.lit(0))).alias("passed"))
