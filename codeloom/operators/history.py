"""Commits by symbol, recent changes and churn.

Times are compared as instants, and equal times are told apart by sha.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.columns import KINDS, callable_kind, clamp
from codeloom.store import Graph

MOST_ROWS = 100
MOST_DAYS = 3650
NO_HISTORY = "no git history has been ingested"


def history_present(graph: Graph, project: str) -> bool:
    return bool(graph.within("commits", project).head(1))


def bad_kind(kind: str) -> str | None:
    return None if kind in KINDS else f"invalid kind {kind!r}; must be one of {', '.join(KINDS)}"


def symbol_commits(graph: Graph, project: str, qualified_name: str) -> DataFrame:
    """All commits that touched the symbol, with their authors."""
    own = graph.within("symbols", project).where(callable_kind("any", tests=True)).select("qualified_name")
    changes = graph.within("symbol_changes", project).where(F.col("qualified_name") == qualified_name).join(own, "qualified_name", "left_semi")
    commits = graph.within("commits", project).select("sha", "short_sha", "message", F.col("ts").alias("timestamp"), "author_email")
    authors = graph["authors"].select(F.col("email").alias("author_email"), F.col("name").alias("author_name"))
    out = changes.select("sha", "lines_overlapped").join(commits, "sha").join(authors, "author_email", "left")
    return out.select("sha", "short_sha", "message", "timestamp", "author_email", "author_name", "lines_overlapped")


def symbol_history(graph: Graph, project: str, qualified_name: str, limit: int = 20) -> DataFrame:
    """The symbol's commits, newest first."""
    return symbol_commits(graph, project, qualified_name).orderBy(F.desc("timestamp"), "sha").limit(clamp(limit, 1, MOST_ROWS))


def _changes(graph: Graph, project: str, kind: str, since) -> DataFrame:
    """Changes of symbols of the kind from the time on."""
    commits = graph.within("commits", project).select("sha", "ts", "author_email")
    if since is not None:
        commits = commits.where(F.col("ts") >= F.lit(since))
    symbols = graph.within("symbols", project).where(callable_kind(kind, tests=True)).select("qualified_name", "kind", "file")
    return graph.within("symbol_changes", project).select("qualified_name", "sha").join(commits, "sha").join(symbols, "qualified_name")


def recent_changes(graph: Graph, project: str, since=None, limit: int = 50, kind: str = "any") -> DataFrame:
    """Symbols changed since a time, with their latest commit."""
    latest = F.max(F.struct("ts", "sha"))
    out = _changes(graph, project, kind, since).groupBy("qualified_name", "kind", "file").agg(latest.alias("latest"), F.countDistinct("sha").alias("commit_count"))
    out = out.select("qualified_name", "kind", "file", F.col("latest.ts").alias("last_changed"), "commit_count", F.col("latest.sha").alias("latest_sha"))
    return out.orderBy(F.desc("last_changed"), "qualified_name").limit(clamp(limit, 1, MOST_ROWS))


def churn(graph: Graph, project: str, cutoff, kind: str = "any") -> DataFrame:
    """Commits and authors of each symbol from the cutoff on; an author counts where it is known."""
    authors = graph["authors"].select(F.col("email").alias("author_email"), F.col("email").alias("known"))
    rows = _changes(graph, project, kind, cutoff).join(authors, "author_email", "left")
    return rows.groupBy("qualified_name", "kind", "file").agg(
        F.countDistinct("sha").alias("commit_count"),
        F.countDistinct("known").alias("unique_authors"),
        F.min("ts").alias("first_changed"),
        F.max("ts").alias("last_changed"),
    )


def top_churn(graph: Graph, project: str, window_days: int = 30, limit: int = 20, kind: str = "any", now: datetime | None = None) -> DataFrame:
    """The symbols with most commits in the days before ``now``."""
    now = now or datetime.now(timezone.utc)
    cutoff = now - timedelta(days=clamp(window_days, 1, MOST_DAYS))
    order = (F.desc("commit_count"), F.desc("last_changed"), F.asc("qualified_name"))
    return churn(graph, project, cutoff, kind).orderBy(*order).limit(clamp(limit, 1, MOST_ROWS))
