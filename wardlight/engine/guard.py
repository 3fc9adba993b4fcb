"""Read-only guards: the product's first-word verdict, and a check of the parsed statement."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# First words that are refused.
WRITE_WORDS = ("INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "GRANT", "REVOKE")
#: Functions that run arbitrary code of the JVM.
ESCAPES = {"reflect", "java_method", "try_reflect"}


class Refused(ValueError):
    """The statement may not run; status is what an HTTP layer would answer."""

    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status = status


def verdict(sql: Column) -> Column:
    """400 for blank text, 403 for a refused first word, else 200."""
    bare = F.regexp_replace(F.coalesce(sql, F.lit("")), r"^\s+|\s+$", "")
    first = F.upper(F.split(bare, r"\s+")[0])
    return F.when(bare == "", 400).when(first.isin(*WRITE_WORDS), 403).otherwise(200)


def _walk(node):
    yield node
    for name in ("children", "innerChildren"):
        below = getattr(node, name)()
        for i in range(below.size()):
            yield from _walk(below.apply(i))


def _expressions(node):
    found = node.expressions()
    for i in range(found.size()):
        yield from _below(found.apply(i))


def _below(expression):
    yield expression
    if expression.getClass().getSimpleName() in ("Exists", "ListQuery", "ScalarSubquery", "LateralSubquery"):
        for plan in _walk(expression.plan()):
            yield from _expressions(plan)
            yield plan
    below = expression.children()
    for i in range(below.size()):
        yield from _below(below.apply(i))


def check(spark: SparkSession, sql: str) -> None:
    """Raises Refused unless the statement is one query without side effects. Nothing is run."""
    if not sql or not sql.strip():
        raise Refused(400, "empty statement")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)  # not public API; used here alone
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    for node in _walk(plan):
        for part in (node, *_expressions(node)):
            kind = part.getClass().getSimpleName()
            if command.isInstance(part) or kind in ("InsertIntoStatement", "Call", "CompoundBody", "ScriptTransformation"):
                raise Refused(403, f"{kind} is not a query")
            if kind == "UnresolvedFunction" and part.nameParts().last().lower() in ESCAPES:
                raise Refused(403, "this function is not allowed")
