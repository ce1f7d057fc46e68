"""Reviewed ratio formulas as data, evaluated over pivoted metrics.

A formula is an expression over metric names with ``+ - * /``, ``abs``, number literals and
``rolling_average``/``rolling_growth`` of a metric over two available periods.  A zero denominator or a
missing leaf abstains with its reason.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The reviewed formulas.
REVIEWED = """
debt_to_equity = total_liabilities / equity
debt_to_assets = total_liabilities / total_assets * 100
current_ratio = current_assets / current_liabilities
quick_ratio = (current_assets - inventory) / current_liabilities
gross_margin = gross_profit / net_revenue * 100
net_margin = profit_after_tax / net_revenue * 100
inventory_to_assets = inventory / total_assets * 100
sga_intensity = (abs(selling_expense) + abs(admin_expense)) / net_revenue * 100
admin_expense_intensity = abs(admin_expense) / net_revenue * 100
selling_expense_intensity = abs(selling_expense) / net_revenue * 100
cogs_intensity = abs(cogs) / net_revenue * 100
return_on_ending_assets = profit_after_tax / total_assets * 100
current_liabilities_to_equity = current_liabilities / equity * 100
financial_expense_intensity = abs(financial_expense) / net_revenue * 100
financial_income_to_financial_expense = financial_income / abs(financial_expense) * 100
tangible_fixed_assets_share_of_total_fixed_assets = tangible_fixed_assets / total_fixed_assets * 100
intangible_fixed_assets_share_of_component_total = intangible_fixed_assets / (tangible_fixed_assets + intangible_fixed_assets) * 100
short_term_borrowings_to_equity = short_term_borrowings / equity * 100
short_term_other_receivables_share = short_term_other_receivables / (short_term_other_receivables + long_term_other_receivables) * 100
interest_expense_to_short_term_borrowings = abs(interest_expense) / short_term_borrowings * 100
interest_expense_to_long_term_borrowings = abs(interest_expense) / long_term_borrowings * 100
cfo_to_profit_before_tax = cash_flow_from_operations / profit_before_tax * 100
intangible_fixed_assets_to_assets = intangible_fixed_assets / total_assets * 100
tangible_fixed_assets_to_assets = tangible_fixed_assets / total_assets * 100
short_to_long_prepaid_expenses = short_term_prepaid_expenses / long_term_prepaid_expenses
current_liabilities_to_equity_ratio = current_liabilities / equity
common_loan_loss_provision_share = abs(common_loan_loss_provision) / abs(total_loan_loss_provision) * 100
roe_average_equity = profit_after_tax / rolling_average(equity) * 100
roe_end_equity = profit_after_tax / equity * 100
roa_end_assets = profit_after_tax / total_assets * 100
asset_turnover_average_assets = net_revenue / rolling_average(total_assets)
fixed_asset_turnover_average = net_revenue / rolling_average(total_fixed_assets)
cash_flow_from_operations_to_net_revenue = cash_flow_from_operations / net_revenue * 100
cash_flow_from_operations_to_profit_after_tax = cash_flow_from_operations / profit_after_tax
long_term_assets_to_total_assets = long_term_assets / total_assets * 100
interest_coverage = (profit_before_tax + abs(interest_expense)) / abs(interest_expense)
working_capital = current_assets - current_liabilities
inventory_to_current_liabilities = inventory / current_liabilities
cfo_to_current_liabilities = cash_flow_from_operations / current_liabilities
"""

OPERATORS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}
CALLS = ("abs", "rolling_average", "rolling_growth")


class FormulaError(ValueError):
    """A formula outside the reviewed grammar."""


@dataclass(frozen=True)
class Formula:
    name: str
    tree: ast.expr

    @property
    def leaves(self) -> list[str]:
        called = {n.func for n in ast.walk(self.tree) if isinstance(n, ast.Call)}
        return sorted({n.id for n in ast.walk(self.tree) if isinstance(n, ast.Name) and n not in called})


def parse(name: str, text: str) -> Formula:
    tree = ast.parse(text.strip(), mode="eval").body
    for node in ast.walk(tree):
        fine = isinstance(node, (ast.Name, ast.BinOp, ast.Load, ast.UnaryOp, ast.USub, *OPERATORS))
        fine |= isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool)
        fine |= isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in CALLS and len(node.args) == 1 and not node.keywords
        if not fine:
            raise FormulaError(f"{name}: {ast.dump(node)}")
    return Formula(name, tree)


def registry(text: str = REVIEWED) -> dict[str, Formula]:
    lines = [line.split("=", 1) for line in text.strip().splitlines() if line.strip()]
    return {name.strip(): parse(name.strip(), body) for name, body in lines}


def _build(node: ast.expr, zero: list[Column]) -> Column:
    if isinstance(node, ast.Constant):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name):
        return F.col(node.id).cast("double")
    if isinstance(node, ast.UnaryOp):
        return -_build(node.operand, zero)
    if isinstance(node, ast.Call):
        inner = _build(node.args[0], zero)
        if node.func.id == "abs":
            return F.abs(inner)
        before = F.lag(inner).over(Window.partitionBy("entity").orderBy("period"))
        return (inner + before) / 2 if node.func.id == "rolling_average" else F.try_divide(inner - before, F.abs(before))
    left, right = _build(node.left, zero), _build(node.right, zero)
    if isinstance(node.op, ast.Div):
        zero.append(right == 0)
        return F.try_divide(left, right)
    return {"+": left + right, "-": left - right, "*": left * right}[OPERATORS[type(node.op)]]


def evaluate(wide: DataFrame, formulas: list[Formula]) -> DataFrame:
    """``entity, period, formula, value, status, reason`` of every formula on every scope."""
    made = []
    for f in formulas:
        zero: list[Column] = []
        value = _build(f.tree, zero)
        missing = F.lit(False)
        for leaf in f.leaves:
            missing = missing | F.col(leaf).isNull()
        divides_by_zero = F.lit(False)
        for z in zero:
            divides_by_zero = divides_by_zero | F.coalesce(z, F.lit(False))
        reason = F.when(missing, "MISSING_OPERAND").when(divides_by_zero, "ZERO_DENOMINATOR").when(value.isNull(), "TOO_FEW_PERIODS")
        made.append((f.name, value, reason))
    out = wide.select(
        "entity", "period", *[v.alias(f"v_{n}") for n, v, _ in made], *[r.alias(f"r_{n}") for n, _, r in made]
    )
    rows = F.array(*[F.struct(F.lit(n).alias("formula"), F.col(f"v_{n}").alias("value"), F.col(f"r_{n}").alias("reason")) for n, _, _ in made])
    out = out.select("entity", "period", F.inline(rows))
    good = F.col("reason").isNull()
    return out.select(
        "entity", "period", "formula", F.when(good, F.col("value")).alias("value"), F.when(good, "OK").otherwise("ABSTAIN").alias("status"), "reason"
    )


def formula_series(wide: DataFrame, text: str, name: str = "formula") -> DataFrame:
    """One formula as a series of its defined values."""
    return evaluate(wide, [parse(name, text)]).where("status = 'OK'").select("entity", "period", "value")
