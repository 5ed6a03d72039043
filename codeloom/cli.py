"""The command line: a thin layer over the graph's operators."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from codeloom.checks import config as check_config
from codeloom.checks import run as checks
from codeloom.operators import ingest, navigation
from codeloom.operators.embed import HashingProvider, embed_project
from codeloom.operators.resolve import TsPaths
from codeloom.server import Server
from codeloom.session import spark_session
from codeloom.settings import Settings, load
from codeloom.sources import history, runtime
from codeloom.sources.files import accepted, gitignore_lines, source_files
from codeloom.store import GraphStore
from codeloom.streaming import watch
from codeloom.streaming.observer import Observer
from codeloom.tools import Tools


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom", description="Code-graph analytics on Spark.")
    p.add_argument("--project")
    p.add_argument("--store")
    sub = p.add_subparsers(dest="command", required=True)
    for name, about in (("ingest", "read a source tree"), ("trace", "run its tests traced"), ("build", "ingest, then trace"), ("update", "bring the graph up to date"), ("watch", "follow events of a folder")):
        c = sub.add_parser(name, help=about)
        c.add_argument("root")
        if name == "watch":
            c.add_argument("events", help="folder of JSON lines: path, kind, ts")
            c.add_argument("--observe", action="store_true", help="also look for changes of the tree and drop them there")
            c.add_argument("--embed", action="store_true")
            c.add_argument("--once", action="store_true")
            c.add_argument("--ignore", action="append", default=[])
        if name == "update":
            c.add_argument("paths", nargs="*")
    sub.add_parser("mcp", help="answer tool calls over the standard streams until they end")
    sub.add_parser("status", help="counts")
    sub.add_parser("clean", help="delete the graph")
    c = sub.add_parser("embed", help="embed symbol sources")
    c.add_argument("--rebuild", action="store_true")
    c = sub.add_parser("ingest-history", help="read git history")
    c.add_argument("root")
    c.add_argument("--since-last", action="store_true")
    c.add_argument("--max-commits", type=int)
    c = sub.add_parser("check", help="thresholds for CI")
    c.add_argument("config")
    c.add_argument("--root")
    c.add_argument("--json", action="store_true")
    c.add_argument("--strict", action="store_true")
    c.add_argument("--fail-fast", action="store_true")
    c = sub.add_parser("tool", help="call one of the query tools")
    c.add_argument("name", choices=Tools.NAMES)
    c.add_argument("arguments", nargs="?", default="{}", help="JSON object")
    return p


def _ts_paths(root: str) -> TsPaths:
    path = Path(root) / "tsconfig.json"
    return TsPaths.parse(path.read_text() if path.exists() else None)


def main(argv: list[str] | None = None, settings: Settings | None = None) -> int:
    args = _parser().parse_args(argv)
    settings = settings or load()
    project = args.project or settings.project
    spark = spark_session(settings)
    store = GraphStore(spark, args.store or settings.store)
    if args.command == "clean":
        store.clean()
        return 0
    graph = store.load()

    def trace(graph):
        seen = runtime.run_tests(args.root, settings.python)
        return store.commit(ingest.augment(graph, project, *runtime.read_observations(spark, seen)))

    if args.command in ("ingest", "build"):
        graph = store.commit(ingest.build(graph, project, source_files(spark, args.root), args.root, _ts_paths(args.root)))
        if args.command == "build":
            trace(graph)
    elif args.command == "trace":
        trace(graph)
    elif args.command == "update":
        graph, summary = ingest.update(graph, project, source_files(spark, args.root), args.paths or None, _ts_paths(args.root))
        store.commit(graph)
        print(json.dumps(summary.__dict__))
    elif args.command == "watch":
        return _watch(args, settings, project, store)
    elif args.command == "embed":
        store.commit(embed_project(graph, project, HashingProvider(settings.embedding_dimensions, settings.embedding_batch), args.rebuild))
    elif args.command == "ingest-history":
        row = graph.within("projects", project).first()
        since = row["last_history_sha"] if args.since_last and row else None
        frame = history.commit_frame(spark, args.root, since, args.max_commits or settings.history_commits)
        store.commit(ingest.add_history(graph, project, frame))
    elif args.command == "status":
        counts = Tools(graph, project).graph_status()
        labels = {r["label"]: r["n"] for r in navigation.label_histogram(graph, project).collect()}
        print(json.dumps(counts | {"labels": labels}))
    elif args.command == "check":
        config = check_config.load(args.config)
        drifted = 0
        if args.root:
            drifted = ingest.drifted(graph.within("files", config.project), source_files(spark, args.root)).first()[0]
        report = checks.run_checks(graph, config, drifted, args.fail_fast)
        code = report.exit_code(args.strict)
        print(checks.as_json(report, code) if args.json else checks.as_text(report))
        return code
    elif args.command == "mcp":
        Server(store, project, HashingProvider(settings.embedding_dimensions)).serve(sys.stdin, sys.stdout)
    elif args.command == "tool":
        tools = Tools(graph, project, HashingProvider(settings.embedding_dimensions))
        print(json.dumps(getattr(tools, args.name)(**json.loads(args.arguments)), indent=2, default=str))
    return 0


def _watch(args, settings: Settings, project: str, store: GraphStore) -> int:
    spark = store.spark
    ignore_file = Path(args.root) / ".gitignore"
    gitignore = tuple(gitignore_lines(ignore_file.read_text())) if ignore_file.exists() else ()

    def update(paths: list[str]) -> int:
        graph, summary = ingest.update(store.load(), project, source_files(spark, args.root), paths, _ts_paths(args.root))
        store.commit(graph)
        return summary.parse_errors

    def embed() -> None:
        store.commit(embed_project(store.load(), project, HashingProvider(settings.embedding_dimensions, settings.embedding_batch)))

    events = watch.event_stream(spark, args.events)
    events = events.where(accepted(events["path"], tuple(args.ignore), gitignore) | (events["kind"] == watch.TICK))
    handle = watch.sink(update, embed if args.embed else None)
    how = {"availableNow": True} if args.once else {"processingTime": "500 milliseconds"}
    observer = Observer(args.root, args.events, tick=max(1.0, settings.debounce_ms / 500)) if args.observe else None
    feed = watch.start(events, handle, f"{store.path}/feed", f"{settings.debounce_ms} milliseconds", **how)
    stop = observer.start() if observer else None
    try:
        while feed.isActive:
            time.sleep(0.5)
    except KeyboardInterrupt:
        feed.stop()
    finally:
        if stop:
            stop.set()
    return 0
