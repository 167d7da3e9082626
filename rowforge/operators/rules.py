"""Row filters by a list of rules on cells, joined by and / or.

A rule is {"column", "op", "value"} with "value2" for between and "case_sensitive" for text operators. The
type of the rule's value decides how cells are compared: a number compares numerically, a string as text.
"""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions.text import cell, is_blank, number
from rowforge.operators.result import OpResult

MAX_PATTERN = 200
_ORDER = {"lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}


def _numeric(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _pattern(text: str, case_sensitive: bool) -> str:
    """A Java pattern for a search; checked on the driver before any job."""
    if len(text) > MAX_PATTERN:
        raise ValueError(f"The search pattern is longer ({len(text)}) than the {MAX_PATTERN} characters that are allowed.")
    try:
        re.compile(text)
    except re.error as problem:
        raise ValueError(f"The search pattern cannot be read: {problem}.") from problem
    if "(?P" in text:
        raise ValueError("Named groups are written (?<name>...) here.")
    return ("(?U)" if case_sensitive else "(?iU)") + text


def _textual(text: Column, op: str, wanted: str, case_sensitive: bool) -> Column:
    if op == "regex":
        return text.rlike(_pattern(wanted, case_sensitive))
    if not case_sensitive:
        text, wanted = F.lower(text), wanted.lower()
    return {"contains": text.contains, "starts_with": text.startswith, "ends_with": text.endswith}[op](wanted)


def predicate(rule: dict, columns: list[str]) -> Column:
    """One rule as a boolean expression without nulls."""
    column, op, value = rule.get("column"), rule.get("op"), rule.get("value")
    if column not in columns:
        raise ValueError(f"Unknown column {column!r}; there are {', '.join(columns)}.")
    text = cell(column)
    if op in ("is_empty", "not_empty"):
        return is_blank(text) if op == "is_empty" else ~is_blank(text)
    if op in ("eq", "ne"):
        hit = F.coalesce(number(text) == F.lit(float(value)), F.lit(False)) if _numeric(value) else text == F.lit(str(value))
        return hit if op == "eq" else ~hit
    if op in ("in", "not_in"):
        if not isinstance(value, (list, tuple, set)):
            raise ValueError(f"A rule with {op!r} compares with several values: give a list.")
        hit = text.isin([str(v) for v in value])
        return hit if op == "in" else ~hit
    if op == "between":
        high = rule.get("value2")
        if high is None:
            raise ValueError("A rule with 'between' has its upper end in value2, which is missing.")
        if _numeric(value) and _numeric(high):
            return F.coalesce(number(text).between(float(value), float(high)), F.lit(False))
        return text.between(str(value), str(high))
    if op in _ORDER:
        if _numeric(value):
            return F.coalesce(_ORDER[op](number(text), F.lit(float(value))), F.lit(False))
        return _ORDER[op](text, F.lit(str(value)))
    if op in ("contains", "starts_with", "ends_with", "regex"):
        return _textual(text, op, str(value), bool(rule.get("case_sensitive", False)))
    raise ValueError(f"Unknown operator {op!r}.")


def condition(rules: list[dict], columns: list[str], combine: str = "and") -> Column:
    """All rules as one expression."""
    if combine not in ("and", "or"):
        raise ValueError(f"Rules are joined by 'and' or by 'or', not by {combine!r}.")
    if not rules:
        raise ValueError("Give at least one rule.")
    return reduce(operator.and_ if combine == "and" else operator.or_, [predicate(r, columns) for r in rules])


def unreadable(rules: list[dict]) -> Column:
    """Whether some ordered numeric rule meets a cell that is no number."""
    columns = {r["column"] for r in rules if r.get("op") in (*_ORDER, "between") and _numeric(r.get("value"))}
    return reduce(operator.or_, [number(cell(c)).isNull() for c in sorted(columns)], F.lit(False))


def filter_rows(df: DataFrame, rules: list[dict], combine: str = "and") -> OpResult:
    """The rows that the rules keep; stats: before, after, removed, not_comparable."""
    keep = condition(rules, df.columns, combine)
    stats = df.agg(
        F.count("*").alias("before"),
        F.count_if(keep).alias("after"),
        F.count_if(~keep).alias("removed"),
        F.count_if(unreadable(rules)).alias("not_comparable"),
    )
    return OpResult(df.where(keep), stats)
