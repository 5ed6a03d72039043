"""The 21 read-only tools as one object: checked arguments in, plain rows and warnings out."""

from __future__ import annotations

from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame

from codeloom.functions.columns import KINDS, PROVENANCE
from codeloom.operators import architecture, freeform, history, impact, navigation, semantic
from codeloom.operators.embed import Provider
from codeloom.schema import describe
from codeloom.store import Graph


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(True) for r in df.collect()]


class Tools:
    NAMES = (
        "find_symbol", "get_source", "find_callers", "find_callees", "runtime_only_calls", "dead_static_calls", "tests_for", "untested_symbols", "imports", "graph_status",
        "change_impact", "describe_schema", "run_sql", "semantic_search", "semantic_neighborhood", "symbol_history", "recent_changes", "top_churn", "find_cycles", "layering_violations", "hubs",
    )

    def __init__(self, graph: Graph, project: str, provider: Provider | None = None) -> None:
        self.graph, self.project, self.provider = graph, project, provider

    def project_exists(self) -> bool:
        return bool(self.graph.within("projects", self.project).head(1) or self.graph.within("files", self.project).head(1))

    def find_symbol(self, query: str, exact: bool = False, limit: int = 50) -> list[dict]:
        return _rows(navigation.find_symbol(self.graph, self.project, query, exact, limit))

    def get_source(self, qualified_name: str) -> dict | None:
        return next(iter(_rows(navigation.get_source(self.graph, self.project, qualified_name))), None)

    def find_callers(self, qualified_name: str, provenance: str = "any", limit: int = 50) -> list[dict]:
        return _rows(navigation.find_callers(self.graph, self.project, qualified_name, provenance, limit))

    def find_callees(self, qualified_name: str, provenance: str = "any", limit: int = 50) -> list[dict]:
        return _rows(navigation.find_callees(self.graph, self.project, qualified_name, provenance, limit))

    @staticmethod
    def _pair(row: dict) -> dict:
        ends = {end: {k.removeprefix(f"{end}_"): v for k, v in row.items() if k.startswith(f"{end}_")} for end in ("caller", "callee")}
        return ends | {k: v for k, v in row.items() if not k.startswith(("caller_", "callee_"))}

    def runtime_only_calls(self, file: str | None = None, limit: int = 100) -> list[dict]:
        return [self._pair(r) for r in _rows(navigation.runtime_only_calls(self.graph, self.project, file, limit))]

    def dead_static_calls(self, file: str | None = None, limit: int = 100) -> list[dict]:
        return [self._pair(r) for r in _rows(navigation.dead_static_calls(self.graph, self.project, file, limit))]

    def tests_for(self, qualified_name: str, limit: int = 50) -> list[dict]:
        return _rows(navigation.tests_for(self.graph, self.project, qualified_name, limit))

    def untested_symbols(self, file: str | None = None, kind: str = "any", limit: int = 100) -> list[dict]:
        return _rows(navigation.untested_symbols(self.graph, self.project, file, kind, limit))

    def imports(self, file: str, direction: str = "out", limit: int = 100) -> list[dict]:
        return _rows(navigation.imports(self.graph, self.project, file, direction, limit))

    def graph_status(self) -> dict:
        return _rows(navigation.graph_status(self.graph, self.project))[0]

    def change_impact(self, diff: str, max_depth: int = 5, provenance: str = "any", limit: int = 200) -> dict:
        return impact.change_impact(self.graph, self.project, diff, max_depth, provenance, limit)

    def describe_schema(self) -> dict:
        return describe()

    def run_sql(self, query: str, params: dict | None = None, row_limit: int = 1000, timeout_seconds: int = 30) -> dict:
        return asdict(freeform.run_sql(self.graph, self.project, query, params, row_limit, timeout_seconds))

    def _semantic(self, work) -> dict:
        stored = self.graph.within("embeddings", self.project).count()
        warning = "no embedding provider" if self.provider is None else None if stored else "no symbol has been embedded"
        return {"results": [] if warning else work(), "model": getattr(self.provider, "name", None), "embedded_count": stored, "warning": warning}

    def semantic_search(self, query: str, limit: int = 10, kind: str = "any") -> dict:
        if warning := history.bad_kind(kind):
            return {"results": [], "warning": warning}

        def work() -> list[dict]:
            rows = _rows(semantic.semantic_search(self.graph, self.project, self.provider.encode([query])[0], limit, kind))
            return [r | {"snippet": "\n".join([x for x in (r["source"] or "").splitlines() if x.strip()][:3])} for r in rows]

        return self._semantic(work)

    def semantic_neighborhood(self, query: str, limit: int = 10, per_seed_limit: int = 10, kind: str = "any", include: list[str] | None = None, min_score: float = 0.0) -> dict:
        if warning := history.bad_kind(kind):
            return {"results": [], "warning": warning}
        return self._semantic(lambda: semantic.semantic_neighborhood(self.graph, self.project, self.provider.encode([query])[0], limit, per_seed_limit, kind, include, min_score))

    def _no_history(self, rows: list) -> str | None:
        return None if rows or history.history_present(self.graph, self.project) else history.NO_HISTORY

    def symbol_history(self, qualified_name: str, limit: int = 20) -> dict:
        rows = _rows(history.symbol_history(self.graph, self.project, qualified_name, limit))
        total = history.symbol_commits(self.graph, self.project, qualified_name).count()
        return {"qualified_name": qualified_name, "commits": rows, "total_commits": total, "warning": self._no_history(rows)}

    def recent_changes(self, since=None, limit: int = 50, kind: str = "any") -> dict:
        if warning := history.bad_kind(kind):
            return {"results": [], "warning": warning}
        rows = _rows(history.recent_changes(self.graph, self.project, since, limit, kind))
        return {"results": rows, "warning": self._no_history(rows)}

    def top_churn(self, window_days: int = 30, limit: int = 20, kind: str = "any", now=None) -> dict:
        if warning := history.bad_kind(kind):
            return {"window_days": window_days, "results": [], "warning": warning}
        rows = _rows(history.top_churn(self.graph, self.project, window_days, limit, kind, now))
        return {"window_days": max(1, min(window_days, history.MOST_DAYS)), "results": rows, "warning": self._no_history(rows)}

    def find_cycles(self, scope: str = "call", provenance: str = "any", min_size: int = 2, limit: int = 20) -> dict:
        out = {"scope": scope, "provenance": provenance, "cycles": [], "warning": None}
        if scope not in architecture.SCOPES or provenance not in PROVENANCE:
            return out | {"warning": f"invalid scope {scope!r} or provenance {provenance!r}"}
        return out | {"cycles": _rows(architecture.find_cycles(self.graph, self.project, scope, provenance, min_size, limit))}

    def layering_violations(self, layers: list[dict], edge_kind: str = "any", limit: int = 50) -> dict:
        none = {"violations": [], "summary": {"violations": 0, "files_unlayered": 0, "edges_checked": 0}}
        if not layers or edge_kind not in architecture.EDGE_KINDS:
            return none | {"warning": "no layers are defined" if not layers else f"invalid edge_kind {edge_kind!r}"}
        rows = _rows(architecture.layering_violations(self.graph, self.project, layers, edge_kind, limit))
        summary = _rows(architecture.layering_summary(self.graph, self.project, layers, edge_kind))[0]
        return {"violations": rows, "summary": summary | {"violations": len(rows)}, "warning": None}

    def hubs(self, kind: str = "any", min_fanin: int = 10, limit: int = 20) -> dict:
        if kind not in KINDS:
            return {"results": [], "warning": history.bad_kind(kind)}
        return {"results": _rows(architecture.hubs(self.graph, self.project, kind, min_fanin, limit)), "warning": None}
