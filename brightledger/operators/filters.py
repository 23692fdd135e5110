"""Typed row filters, empty-result checks and drill-down."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightledger.functions.exprs import c, is_number, is_time, to_number_lenient, type_of

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "in")


class UnknownColumn(ValueError):
    """The request names a column the table does not have."""


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: Any


def require_columns(df: DataFrame, names: Iterable[str | None], dataset: str) -> None:
    """fail before planning, naming the column and the dataset."""
    for name in names:
        if name is not None and name not in df.columns:
            raise UnknownColumn(f"no column '{name}' in dataset '{dataset}'")


def apply_filters(df: DataFrame, conditions: Iterable[Condition], dataset: str = "table") -> DataFrame:
    """All conditions AND-combined into one predicate Catalyst can push down."""
    conditions = list(conditions)
    require_columns(df, [cond.column for cond in conditions], dataset)
    for cond in conditions:
        df = df.filter(predicate(df, cond))
    return df


def predicate(df: DataFrame, cond: Condition) -> Column:
    if cond.operator not in OPERATORS:
        raise ValueError(f"unknown filter operator '{cond.operator}'")
    if cond.operator == "eq":
        same = typed_literal(df, cond.column, cond.value)
        return F.lit(False) if same is None else c(cond.column) == same
    if cond.operator == "ne":
        same = typed_literal(df, cond.column, cond.value)
        return F.lit(True) if same is None else ~c(cond.column).eqNullSafe(same)
    if cond.operator == "in":
        values = cond.value if isinstance(cond.value, (list, tuple, set)) else [cond.value]
        literals = [typed_literal(df, cond.column, v) for v in values]
        literals = [v for v in literals if v is not None]
        return c(cond.column).isin(*literals) if literals else F.lit(False)
    if cond.operator == "contains":
        return F.coalesce(c(cond.column).cast("string").rlike(f"(?i){cond.value}"), F.lit(False))
    return _compare(df, cond)


def typed_literal(df: DataFrame, column: str, value: Any) -> Column | None:
    """The value in the column's own type, or None where the types never match."""
    dtype = type_of(df, column)
    if value is None:
        return None
    if isinstance(dtype, T.BooleanType):
        return F.lit(value) if isinstance(value, bool) else None
    if is_number(dtype):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return None
        if isinstance(dtype, T.IntegralType):
            if float(value) != math.floor(value) or not -(2**63) <= value < 2**63:
                return None
            return F.lit(int(value)).cast("bigint")
        return F.lit(value).cast(dtype)
    if is_time(dtype):
        if not isinstance(value, (str, date, datetime)):
            return None
        return F.lit(value if isinstance(value, str) else value.isoformat()).try_cast(dtype)
    if isinstance(dtype, T.StringType):
        return F.lit(value) if isinstance(value, str) else None
    return None


def _compare(df: DataFrame, cond: Condition) -> Column:
    """Order comparisons on numbers; whole-number columns get whole bounds."""
    bound = float(cond.value)
    dtype = type_of(df, cond.column)
    number = to_number_lenient(df, cond.column)
    guard = None
    if isinstance(dtype, T.IntegralType):
        number = c(cond.column)
        if cond.operator in ("gt", "lte"):
            bound = math.floor(bound)
        else:
            bound = math.ceil(bound)
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        number, guard = c(cond.column), ~F.isnan(c(cond.column))
    test = {
        "gt": number > F.lit(bound),
        "gte": number >= F.lit(bound),
        "lt": number < F.lit(bound),
        "lte": number <= F.lit(bound),
    }[cond.operator]
    return test if guard is None else test & guard


def result_status(df: DataFrame) -> DataFrame:
    """one row saying whether anything is left to analyse."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.when(F.col("row_count") == 0, "insufficient_data").otherwise("ok").alias("status"),
    )


@dataclass(frozen=True)
class DrillStep:
    column: str
    label: Any


def drill_filters(path: Iterable[DrillStep]) -> list[Condition]:
    """one equality filter per step taken."""
    return [Condition(step.column, "eq", step.label) for step in path]


def next_dimension(candidates: Iterable[str], path: Iterable[DrillStep], current: str | None = None) -> str | None:
    """the first dimension not yet used on the path."""
    used = {step.column for step in path} | {current}
    return next((name for name in candidates if name not in used), None)
