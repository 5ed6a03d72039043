"""Free-form read-only SQL over the graph's views.

A statement passes a scan for verbs that write, must parse to a query (no command), and runs with a
row limit and a time limit.
"""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.store import Graph

#: Verbs that no read-only statement has; as words, in any case (also inside literals).
FORBIDDEN = (
    "INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "DROP", "ALTER", "TRUNCATE", "REPLACE", "SET", "RESET", "CACHE", "UNCACHE",
    "LOAD", "CALL", "ADD", "REFRESH", "MSCK", "REPAIR", "GRANT", "REVOKE", "USE", "ANALYZE", "EXECUTE", "REMOVE", "DETACH",
)
_FORBIDDEN = rf"\b({'|'.join(FORBIDDEN)})\b"
_LIMIT = re.compile(r"\blimit\s+\d+\s*;?\s*$", re.IGNORECASE)


class QueryError(Exception):
    code = "query_error"

    def __init__(self, detail: str, query: str) -> None:
        super().__init__(f"{self.code}: {detail}")
        self.detail, self.query = detail, query


class ForbiddenKeyword(QueryError):
    code = "forbidden_keyword"


class SqlSyntax(QueryError):
    code = "sql_syntax"


class Timeout(QueryError):
    code = "timeout"


class WriteAttempted(QueryError):
    code = "engine_write_attempted"


def forbidden_keyword(query: str) -> str | None:
    found = re.search(_FORBIDDEN, query, re.IGNORECASE)
    return found[1].upper() if found else None


def forbidden_column(query: Column) -> Column:
    """``forbidden_keyword`` over a column of statements."""
    found = F.upper(F.regexp_extract(query, f"(?i){_FORBIDDEN}", 1))
    return F.when(F.length(found) > 0, found)


def has_limit(query: str) -> bool:
    return _LIMIT.search(query) is not None


def with_limit(query: str, rows: int) -> str:
    return query if has_limit(query) else f"{query.rstrip().rstrip(';').rstrip()} LIMIT {rows}"


def is_read_only(spark: SparkSession, query: str) -> bool:
    """Whether the statement parses to a query: no node of it is a command or another statement."""
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    kinds = [loader.loadClass(f"org.apache.spark.sql.catalyst.plans.logical.{k}") for k in ("Command", "ParsedStatement")]
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(query)]
    while todo:
        node = todo.pop()
        if any(k.isInstance(node) for k in kinds):
            return False
        kids = node.children()
        todo += [kids.apply(k) for k in range(kids.size())]
    return True


@dataclass(frozen=True)
class Result:
    rows: list[dict[str, Any]]
    truncated: bool
    row_count: int
    summary: dict[str, Any]


def query_frame(graph: Graph, project: str, query: str, params: dict[str, Any] | None = None) -> DataFrame:
    """The checked statement as a frame; ``:project`` is bound unless the caller binds it."""
    if word := forbidden_keyword(query):
        raise ForbiddenKeyword(word, query)
    graph.register()
    args = {"project": project} | (params or {})
    args = {k: v for k, v in args.items() if re.search(rf":{re.escape(k)}\b", query)}
    try:
        if not is_read_only(graph.spark, query):
            raise WriteAttempted("only queries are allowed", query)
        return graph.spark.sql(query.rstrip().rstrip(";"), args=args)
    except (ParseException, AnalysisException) as error:
        raise SqlSyntax(str(error), query) from error
    except QueryError:
        raise
    except Exception as error:
        if "ParseException" in str(error) or "PARSE_" in str(error):
            raise SqlSyntax(str(error), query) from error
        raise


def run_sql(graph: Graph, project: str, query: str, params: dict[str, Any] | None = None, row_limit: int = 1000, timeout_seconds: int = 30) -> Result:
    """At most ``row_limit`` rows, and whether there are more."""
    frame = query_frame(graph, project, query, params).limit(row_limit + 1)
    jobs, tag = graph.spark.sparkContext, f"run-sql-{uuid.uuid4().hex}"
    late, done = threading.Event(), threading.Event()

    def watch() -> None:
        if done.wait(max(1, timeout_seconds)):
            return
        late.set()
        while not done.is_set():  # a job that has not begun yet is not stopped by the first call
            jobs.cancelJobsWithTag(tag)
            done.wait(0.5)

    watcher = threading.Thread(target=watch, daemon=True)
    jobs.addJobTag(tag)
    watcher.start()
    try:
        rows = [r.asDict(True) for r in frame.collect()]
    except Exception as error:
        if late.is_set():
            raise Timeout(f"query exceeded {timeout_seconds}s", query) from error
        raise
    finally:
        done.set()
        jobs.removeJobTag(tag)
    return Result(rows[:row_limit], len(rows) > row_limit, min(len(rows), row_limit), {"columns": frame.columns})
