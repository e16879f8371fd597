"""Text of SQL from a user: checked by Spark's own parser, run with a time limit, with an audit row."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession

#: Statements that are commands and only read.
SHOWING = ("Show", "Describe", "Explain")
#: Functions that run code of the platform's.
CALLING = re.compile(r"\b(?:try_)?(?:reflect|java_method)\s*\(", re.IGNORECASE)
_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical"


class QueryTextError(ValueError):
    """The text is not a query that may be run."""


def _nodes(plan) -> Iterator:  # noqa: ANN001
    """A parsed plan's nodes: its children, the queries of WITH, and the queries within expressions."""
    stack = [plan]
    while stack:
        node = stack.pop()
        yield node
        for some in (node.children(), node.innerChildren(), node.subqueries()):
            stack += [some.apply(i) for i in range(some.size()) if hasattr(some.apply(i), "innerChildren")]


def check(spark: SparkSession, text: str) -> None:
    """Raise unless the text is one statement that parses and reads.

    The parsed plan decides, whatever the text begins with: no insert, command or script may stand in any
    part of it; what shows or describes something may be the whole.
    """
    if not (text or "").strip():
        raise QueryTextError("there is no text")
    if CALLING.search(text):
        raise QueryTextError("a query calls no methods")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise QueryTextError(str(e).strip().split("\n")[0]) from e
    gateway = spark.sparkContext._gateway
    if is_instance_of(gateway, plan, f"{_LOGICAL}.Command") and plan.getClass().getSimpleName().startswith(SHOWING):
        return
    for node in _nodes(plan):
        name = node.getClass().getSimpleName()
        if any(is_instance_of(gateway, node, f"{_LOGICAL}.{c}") for c in ("Command", "ParsedStatement", "ScriptTransformation")) or "Insert" in name or name == "Call":
            raise QueryTextError(f"a query only reads; {name} does not")


def run(spark: SparkSession, text: str, user: str = "anonymous", seconds: float = 30.0, runner: Callable[[str], DataFrame] | None = None, most: int = 10_000) -> tuple[list, dict]:
    """The first ``most`` rows, and an audit record that says whether there were more. Jobs that run over the time are cancelled."""
    check(spark, text)
    tag, began, status, rows = f"query-{uuid.uuid4().hex}", time.time(), "ok", []
    timer = threading.Timer(seconds, lambda: spark.interruptTag(tag))
    spark.addTag(tag)
    timer.start()
    try:
        rows = (runner or spark.sql)(text).limit(most + 1).collect()
    except Exception:
        status = "timeout" if time.time() - began >= seconds else "error"
        if status == "error":
            raise
    finally:
        timer.cancel()
        spark.removeTag(tag)
    more, rows = len(rows) > most, rows[:most]
    return rows, {"user": user, "query": text, "seconds": time.time() - began, "n_rows": len(rows), "has_more": more, "status": status}
