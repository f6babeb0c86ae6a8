"""Which statements ad-hoc SQL may run.

A statement is parsed and analysed by Spark, and the analysed plan decides: its leaves
are the archive's views, constants or ranges, and its expressions call no code beyond
Spark's own functions.  Names hidden in quotes, comments, functions or WITH tables
come out of the analysis as what they are.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

from pyspark.sql import DataFrame, SparkSession

# Statements that only read, and verbs that write.
READ_VERBS = ("select", "with", "explain", "describe", "show columns")
WRITE_VERBS = (
    "insert", "update", "delete", "drop", "alter", "attach", "create", "replace",
    "merge", "truncate", "load", "set", "reset", "refresh", "cache", "uncache",
)

# Comments and quoted parts, read from left to right so neither hides the other.
_NOISE = re.compile(
    r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`", re.DOTALL
)
# A verb leads a statement at its start, after ``explain`` and after the closing
# bracket of the last ``with`` table; anywhere else it is a function or a name.
_WRITE_HEAD = re.compile(
    rf"(?:^|\)|\bexplain(?:\s+(?:extended|codegen|cost|formatted))?)\s*"
    rf"(?:{'|'.join(WRITE_VERBS)})\b(?!\s*\()"
)


def read_only(sql: str) -> str:
    """The statement without trailing semicolons; ValueError unless it only reads."""
    statement = (sql or "").strip().rstrip(";").rstrip()
    if not statement:
        raise ValueError("empty SQL statement")
    bare = _NOISE.sub(" ", statement).strip().lower()
    if not re.match(rf"(?:{'|'.join(READ_VERBS)})\b", bare):
        raise ValueError("only SELECT, WITH, EXPLAIN and DESCRIBE statements are allowed")
    if ";" in bare or _WRITE_HEAD.search(bare):
        raise ValueError("write statements are not allowed")
    return statement


# Names of Spark's classes.
COMMAND = "org.apache.spark.sql.catalyst.plans.logical.Command"
STATEMENT = "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement"
NESTED_PLAN = "org.apache.spark.sql.catalyst.expressions.PlanExpression"
# Commands that tell about a table or a query, the table below them or the query inside.
TELLING = {"DescribeRelation", "DescribeColumn", "ShowColumns", "DescribeFunction", "DescribeQueryCommand"}
# Leaves without data of anyone's.
HARMLESS = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef"}
# Code of the JVM, of Python or of another program.
FOREIGN = {"CallMethodViaReflection", "TryReflect", "ScalaUDF", "ScalaUDAF", "ScalaAggregator", "ScriptTransformation"}
FOREIGN_PREFIXES = ("Python", "PythonUD", "Hive", "UnresolvedPython", "ArrowEval")
_EXPLAIN = re.compile(r"explain(?:\s+(?:extended|codegen|cost|formatted))?\s+(.*)", re.IGNORECASE | re.DOTALL)


def _items(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class _Plans:
    """Walks plans of the JVM."""

    def __init__(self, spark: SparkSession):
        load = spark._jvm.org.apache.spark.util.Utils.classForName
        self.command, self.statement, self.nested = (load(c, True, False) for c in (COMMAND, STATEMENT, NESTED_PLAN))

    def expressions(self, node) -> Iterator:
        """All expressions of a plan node, and those below them."""
        todo = list(_items(node.expressions()))
        while todo:
            expression = todo.pop()
            yield expression
            todo += _items(expression.children())

    def nodes(self, plan, views: Collection[str] = ()) -> Iterator:
        """All nodes of a plan and of the queries in its expressions, but what is below ``views``."""
        todo = [plan]
        while todo:
            node = todo.pop()
            if _kind(node) == "View" and node.isTempView() and node.desc().identifier().table().lower() in views:
                continue
            yield node
            todo += _items(node.children())
            todo += [e.plan() for e in self.expressions(node) if self.nested.isInstance(e)]


def _refuse(condition: bool, why: str) -> None:
    if condition:
        raise ValueError(why)


def only_reads(spark: SparkSession, statement: str, views: Collection[str]) -> None:
    """ValueError unless the statement reads the temporary ``views`` of the session alone.

    Nothing is run: a query is analysed only, and a statement that Spark would run at
    once is looked at as it is parsed.
    """
    if explained := _EXPLAIN.fullmatch(statement.strip()):
        only_reads(spark, explained[1], views)
        return
    plans = _Plans(spark)
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    telling = _kind(parsed) in TELLING
    for node in plans.nodes(parsed):
        kind = _kind(node)
        active = plans.command.isInstance(node) or plans.statement.isInstance(node)
        _refuse(active and not (telling and node.equals(parsed)), f"this statement is not a query: {kind}")
        _refuse("UnresolvedIdentifier" in kind, "names must be written, not computed")
        if kind in ("UnresolvedRelation", "UnresolvedTableOrView"):
            _refuse(node.multipartIdentifier().size() > 1, "only the archive's views may be read")
        if kind == "UnresolvedTableOrView":
            name = node.multipartIdentifier().apply(0)
            _refuse(name.lower() not in views, f"only the archive's views may be described, not {name!r}")
    if telling:
        if _kind(parsed) == "DescribeQueryCommand":
            only_reads(spark, re.sub(r"(?is)^\s*desc(ribe)?(\s+query)?\s+", "", statement), views)
        return
    try:
        analysed = spark.sql(statement)._jdf.queryExecution().analyzed()
    except Exception as error:
        raise ValueError(f"the statement cannot be analysed: {error}") from error
    for node in plans.nodes(analysed, views):
        kind = _kind(node)
        leaf = not node.children().size()
        foreign = kind == "View" or leaf and kind not in HARMLESS
        _refuse(foreign, f"only the archive's views may be read, not this {kind}")
        for called in [node, *plans.expressions(node)]:
            kind = _kind(called)
            _refuse(kind in FOREIGN or kind.startswith(FOREIGN_PREFIXES), f"this function is not allowed: {kind}")


def query(spark: SparkSession, statement: str, views: dict[str, DataFrame]) -> DataFrame:
    """The statement over ``views``, in a session of its own: names of the caller's are not replaced."""
    checked = read_only(statement)
    session = spark._jsparkSession.cloneSession()
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
    for name, rows in views.items():
        dataset.ofRows(session, rows._jdf.queryExecution().logical()).createOrReplaceTempView(name)
    own = SparkSession(spark.sparkContext, session)
    only_reads(own, checked, set(views))
    return own.sql(checked)
