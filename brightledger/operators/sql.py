"""Q1-Q3: read-only SQL over named tables."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from brightledger.operators.aggregate import capped

MAX_ROWS = 500
# Functions that run code outside SQL from inside a SELECT, and the
# expressions they become.
FOREIGN_FUNCTIONS = {"reflect", "java_method", "try_reflect"}
FOREIGN_EXPRESSIONS = {"CallMethodViaReflection", "TryReflect"}


class SqlRefused(ValueError):
    """The text is not one read-only statement over the given tables, or Spark
    rejects it."""


@dataclass
class SqlResult:
    columns: list[str]
    rows: list
    truncated: bool
    table_columns: dict[str, list[str]]


def view_names(names: list[str]) -> dict[str, str]:
    """Q2: a valid name per dataset name; where two read alike, both carry a
    checksum of the dataset's name."""
    words = {name: "_".join(re.findall("[A-Za-z0-9]+", name)) or "dataset" for name in names}
    plain = {name: f"t_{text}" if text[0].isdigit() else text for name, text in words.items()}
    alike = Counter(text.lower() for text in plain.values())
    mark = {name: hashlib.sha256(name.encode()).hexdigest()[:8] for name in names}
    return {name: text if alike[text.lower()] == 1 else f"{text}_{mark[name]}" for name, text in plain.items()}


def _items(seq: Any) -> Iterator[Any]:
    each = seq.iterator()
    while each.hasNext():
        yield each.next()


def _asked(node: Any, member: str) -> Any:
    """A member of a JVM node, or None if its class has no such member."""
    try:
        return getattr(node, member)()
    except Py4JError:
        return None


def _nodes(plan: Any) -> Iterator[Any]:
    """Plans and expressions of a query plan, subqueries and WITH parts included."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        todo += _items(node.children())
        inner = _asked(node, "expressions")
        if inner is not None:  # a plan
            todo += _items(inner)
            todo += (r._2() for r in _items(_asked(node, "cteRelations") or _EMPTY))
            todo += _items(_asked(node, "cteDefs") or _EMPTY)
        elif "Subquery" in (kind := node.getClass().getSimpleName()) or kind in ("Exists", "InSubquery", "ListQuery"):
            todo += [x for x in (_asked(node, "plan"), _asked(node, "query")) if x is not None]


class _Empty:
    """A sequence without items."""

    def iterator(self) -> _Empty:
        return self

    def hasNext(self) -> bool:  # noqa: N802
        return False


_EMPTY = _Empty()


def refuse_unsafe(spark: SparkSession, query: str, allowed: set[str]) -> None:
    """Q3: refuses what is not one query over the allowed names. The parsed
    plan is searched, so comments, quotes and nesting hide nothing."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(f"SELECT * FROM (\n{query}\n) AS result")
    except PySparkException as error:
        raise SqlRefused(f"not one SELECT or WITH statement: {error}") from error
    names = {n.lower() for n in allowed}
    relations = []
    for node in _nodes(plan):
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            names |= {r._1().lower() for r in _items(node.cteRelations())}
        elif kind == "UnresolvedRelation":
            relations.append([str(p) for p in _items(node.multipartIdentifier())])
        elif kind == "UnresolvedFunction" and [str(p) for p in _items(node.nameParts())][-1].lower() in FOREIGN_FUNCTIONS:
            raise SqlRefused("calls into the JVM are not allowed")
    for parts in relations:
        if len(parts) != 1 or parts[0].lower() not in names:
            raise SqlRefused(f"{'.'.join(parts)} is not one of the given tables: {', '.join(sorted(allowed))}")


def sql_frame(tables: dict[str, DataFrame], text: str) -> DataFrame:
    """The query as a lazy DataFrame over the given tables alone.

    Tables are registered under names of this call and dropped once the query
    is analysed, so no view of the session is replaced, seen or left behind.
    """
    if not tables:
        raise SqlRefused("no tables given")
    spark = next(iter(tables.values())).sparkSession
    views = view_names(list(tables))
    query = text.strip().removesuffix(";")
    refuse_unsafe(spark, query, set(views.values()))
    own = {name: f"q{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.createOrReplaceTempView(own[name])
    given = ", ".join(f"`{views[n]}` AS (SELECT * FROM {own[n]})" for n in tables)
    try:
        df = spark.sql(f"WITH {given} SELECT * FROM (\n{query}\n) AS result")
        analysed = df._jdf.queryExecution().analyzed()
        if any(node.getClass().getSimpleName() in FOREIGN_EXPRESSIONS for node in _nodes(analysed)):
            raise SqlRefused("calls into the JVM are not allowed")
        return df
    except PySparkException as error:
        known = "; ".join(f"{views[n]} ({', '.join(t.columns)})" for n, t in tables.items())
        raise SqlRefused(f"{error}; available tables: {known}") from error
    finally:
        for view in own.values():
            spark.catalog.dropTempView(view)


def sql_query(tables: dict[str, DataFrame], text: str, max_rows: int = MAX_ROWS) -> SqlResult:
    """At most max_rows rows, and whether there were more."""
    df = sql_frame(tables, text)
    rows, truncated = capped(df, max_rows)
    views = view_names(list(tables))
    return SqlResult(df.columns, rows, truncated, {views[n]: t.columns for n, t in tables.items()})
