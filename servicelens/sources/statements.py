"""Statements from outside: one read-only query over allow-listed views, checked before it runs.

Spark's own parser reads the statement; nothing is run to judge it. Every node of the parsed plan, subqueries and
expressions included, must be of a kind on the list, every relation an allowed view and every function a known one.
What passes runs with a limit.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from .store import MAX_VIEW_ROWS

# Plan nodes of a query that only reads.
NODES = frozenset(
    """Aggregate Distinct Except Filter GlobalLimit Intersect Join LocalLimit LocalRelation Offset
    OneRowRelation Project Sort SubqueryAlias Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases WithWindowDefinition Window""".split()
)
# Plan nodes that Spark keeps among the expressions that are not resolved yet.
_UNRESOLVED_PLANS = frozenset(
    """UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases
    UnresolvedTableValuedFunction UnresolvedWith""".split()
)

# Functions that depend on their arguments alone.
FUNCTIONS = frozenset(
    """abs any_value array_agg avg bool_and bool_or cast ceil ceiling coalesce concat concat_ws contains corr count
    count_if cume_dist date date_add date_format date_sub date_trunc datediff day dayofmonth dense_rank endswith every
    extract first first_value float floor greatest grouping if ifnull int initcap instr isnan isnotnull isnull lag last
    last_day last_value lead least length like lower lpad ltrim make_date max max_by mean median min min_by mod month
    months_between ntile nullif nvl percent_rank percentile quarter rank regr_slope replace round row_number rpad rtrim
    sign sqrt startswith stddev stddev_samp string substr substring sum to_date trim trunc try_divide upper var_samp
    weekofyear when year + - * / % = == <=> < <= > >= <> != ! not and or in between""".split()
)


class Verdict(NamedTuple):
    allowed: bool
    reason: str  # empty, syntax, command, node, relation or function; nothing if allowed
    detail: str


def _name(value) -> str:
    """A name of several parts, which the parser shows as `[a, b]`."""
    parts = value if isinstance(value, list) else str(value).strip("[]").split(", ")
    return ".".join(parts).lower()


def _refusal(plan: list[dict], views: frozenset[str]) -> Verdict | None:
    """What is wrong with a plan, its nodes listed from the root down; None if nothing is."""
    if plan[0]["class"].endswith(".UnresolvedWith"):
        for cte in plan[0]["cteRelations"]:
            # a name counts from the next definition on, as it does for Spark
            if refused := _refusal(cte["_2"], views):
                return refused
            views |= {cte["_1"].lower()}
        return _refusal(plan[1:], views)
    for place, node in enumerate(plan):
        name = node["class"].rsplit(".", 1)[-1]
        if name not in NODES:
            return Verdict(False, "node" if place else "command", name)
        if name == "UnresolvedRelation" and _name(node["multipartIdentifier"]) not in views:
            return Verdict(False, "relation", _name(node["multipartIdentifier"]))
        for value in node.values():
            if refused := _refused_part(value, views):
                return refused
    return None


def _refused_part(value, views: frozenset[str]) -> Verdict | None:
    """The same for what a node holds: expressions, and the plans inside of them."""
    if isinstance(value, list) and value and isinstance(value[0], dict) and _is_plan(value[0]):
        return _refusal(value, views)
    if isinstance(value, dict):
        if value.get("class", "").endswith(".UnresolvedFunction") and _name(value["nameParts"]) not in FUNCTIONS:
            return Verdict(False, "function", _name(value["nameParts"]))
        value = list(value.values())
    if isinstance(value, list):
        for inner in value:
            if refused := _refused_part(inner, views):
                return refused
    return None


def _is_plan(node: dict) -> bool:
    kind = node.get("class", "")
    return ".plans.logical." in kind or ".execution." in kind or kind.rsplit(".", 1)[-1] in _UNRESOLVED_PLANS


def check_statement(spark: SparkSession, statement: str | None, allowed: Sequence[str]) -> Verdict:
    """Whether a statement may run. A second statement, a command, a table function, a file as a relation, a view
    that is not allowed and a function that is not known are refused, also inside subqueries and CTEs. Names compare
    without regard to case, as Spark's do; views are named without a database.
    """
    if not (statement or "").strip():
        return Verdict(False, "empty", "")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except ParseException as error:
        return Verdict(False, "syntax", error.getCondition() or "")
    views = frozenset(v.lower() for v in allowed)
    return _refusal(json.loads(plan.toJSON()), views) or Verdict(True, "", "")


def run_statement(
    spark: SparkSession, statement: str, allowed: Sequence[str], limit: int = MAX_VIEW_ROWS
) -> DataFrame:
    """The rows of an allowed statement, at most `limit` of them; a refused one is an error that says why."""
    verdict = check_statement(spark, statement, allowed)
    if not verdict.allowed:
        raise ValueError(f"statement refused: {verdict.reason} {verdict.detail}".rstrip())
    return spark.sql(statement).limit(limit)
