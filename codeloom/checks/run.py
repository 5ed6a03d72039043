"""The four checks, their report and the exit code.

Counts are taken before any limit, so a threshold of any size can fail.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.checks.config import Churn, Config, Cycles, Hubs, Layering
from codeloom.functions.columns import KINDS, PROVENANCE, matches_glob
from codeloom.operators import architecture, history
from codeloom.store import Graph

#: Items that a result carries, and that the text report shows.
MOST_ITEMS, SHOWN = 100, 5


@dataclass(frozen=True)
class Result:
    check: str
    status: str  # passed, failed, skipped or error
    actual: int = 0
    threshold: int = 0
    items: tuple[dict[str, Any], ...] = ()
    reason: str | None = None

    @property
    def bad(self) -> bool:
        return self.status in ("failed", "error")


@dataclass(frozen=True)
class Report:
    project: str
    drifted_files: int
    results: tuple[Result, ...]
    warnings: tuple[str, ...] = ()

    def tally(self) -> dict[str, int]:
        return {
            "passed": sum(r.status == "passed" for r in self.results),
            "failed": sum(r.bad for r in self.results),
            "skipped": sum(r.status == "skipped" for r in self.results),
        }

    def exit_code(self, strict: bool = False) -> int:
        """0: all passed; 1: some failed; 2: strict, and files have drifted."""
        return 2 if strict and self.drifted_files else int(any(r.bad for r in self.results))


def _judge(check: str, found: DataFrame, order: list, threshold: int) -> Result:
    found = found.cache()
    try:
        n = found.count()
        items = tuple(r.asDict(True) for r in found.orderBy(*order).limit(MOST_ITEMS).collect())
    finally:
        found.unpersist()
    return Result(check, "passed" if n <= threshold else "failed", n, threshold, items)


def hotspots(graph: Graph, project: str, cfg: Churn, now: datetime | None = None) -> DataFrame:
    """Symbols with more commits in the window than the threshold, in files that are not ignored."""
    cutoff = (now or datetime.now(timezone.utc)) - timedelta(days=cfg.window_days)
    hot = history.churn(graph, project, cutoff).where(F.col("commit_count") > cfg.hot_files_threshold)
    for pattern in cfg.ignore:
        hot = hot.where(~matches_glob(F.coalesce("file", F.lit("")), pattern))
    return hot


def check_cycles(graph: Graph, project: str, cfg: Cycles) -> Result:
    if cfg.scope not in architecture.SCOPES or cfg.provenance not in PROVENANCE:
        return Result("cycles", "error", reason=f"invalid scope {cfg.scope!r} or provenance {cfg.provenance!r}")
    return _judge("cycles", architecture.cycles(graph, project, cfg.scope, cfg.provenance, cfg.min_size), [F.desc("size"), F.col("nodes")[0]], cfg.max_cycles)


def check_layering(graph: Graph, project: str, cfg: Layering) -> Result:
    if not cfg.layers:
        return Result("layering", "error", reason="no layers are defined")
    if cfg.edge_kind not in architecture.EDGE_KINDS:
        return Result("layering", "error", reason=f"invalid edge_kind {cfg.edge_kind!r}")
    return _judge("layering", architecture.violations(graph, project, list(cfg.layers), cfg.edge_kind), ["from_layer", "from_file", "to_file", "edge_kind"], cfg.max_violations)


def check_churn(graph: Graph, project: str, cfg: Churn, now: datetime | None = None) -> Result:
    if not history.history_present(graph, project):
        return Result("churn", "error", reason=history.NO_HISTORY)
    return _judge("churn", hotspots(graph, project, cfg, now), [F.desc("commit_count"), F.desc("last_changed"), "qualified_name"], 0)


def check_hubs(graph: Graph, project: str, cfg: Hubs) -> Result:
    if cfg.kind not in KINDS:
        return Result("hubs", "error", reason=f"invalid kind {cfg.kind!r}")
    return _judge("hubs", architecture.fan(graph, project, cfg.kind).where(F.col("in_callers") >= max(1, cfg.min_fanin)), [F.desc("in_callers"), "qualified_name"], cfg.max_hubs)


def run_checks(graph: Graph, config: Config, drifted_files: int = 0, fail_fast: bool = False, now: datetime | None = None) -> Report:
    """Cycles, layering, churn, hubs, in this order."""
    steps = (
        ("cycles", config.cycles, check_cycles),
        ("layering", config.layering, check_layering),
        ("churn", config.churn, lambda g, p, c: check_churn(g, p, c, now)),
        ("hubs", config.hubs, check_hubs),
    )
    results: list[Result] = []
    for name, cfg, step in steps:
        results.append(step(graph, config.project, cfg) if cfg.enabled else Result(name, "skipped", reason="disabled"))
        if fail_fast and results[-1].bad:
            break
    return Report(config.project, drifted_files, tuple(results), config.warnings)


def _line(item: dict[str, Any]) -> str:
    if "from_file" in item:
        return f"{item['from_file']} -> {item['to_file']} ({item['edge_kind']})"
    if "nodes" in item:
        more = len(item["nodes"]) - 3
        return f"{item['size']} nodes: {', '.join(item['nodes'][:3])}{f' and {more} more' if more > 0 else ''}"
    figures = [f"{k}={item[k]}" for k in ("in_callers", "commit_count") if k in item]
    return " ".join([str(item.get("qualified_name", item)), *figures])


def as_text(report: Report) -> str:
    out = [f"project {report.project}"]
    if report.drifted_files:
        out.append(f"{report.drifted_files} files differ from the graph")
    for r in report.results:
        figures = f"{r.actual} of at most {r.threshold}" if r.status in ("passed", "failed") else r.reason or ""
        out.append(f"{r.status:<8}{r.check:<10}{figures}")
        out += [f"    {_line(i)}" for i in r.items[:SHOWN]]
        if len(r.items) > SHOWN:
            out.append(f"    and {len(r.items) - SHOWN} more")
    out += [f"warning: {w}" for w in report.warnings]
    return "\n".join([*out, ", ".join(f"{n} {k}" for k, n in report.tally().items())])


def as_json(report: Report, exit_code: int) -> str:
    results = [{"check": r.check, "status": r.status, "actual": r.actual, "threshold": r.threshold, "reason": r.reason, "items": list(r.items)} for r in report.results]
    return json.dumps({"project": report.project, "drifted_files": report.drifted_files, "results": results, "summary": report.tally(), "warnings": list(report.warnings), "exit_code": exit_code}, indent=2, default=str)
