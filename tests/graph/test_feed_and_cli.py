from __future__ import annotations

import io
import json
import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codeloom import cli
from codeloom.operators import ingest
from codeloom.operators.resolve import TsPaths
from codeloom.server import Server
from codeloom.settings import Settings
from codeloom.sources.files import accepted, source_files
from codeloom.store import GraphStore
from codeloom.streaming import watch
from codeloom.streaming.observer import Observer
from codeloom.tools import Tools
from tests.graph import sample


def outcome(kinds):
    """The state machine of one path's events, one by one."""
    state = None
    for kind in kinds:
        if kind == "created":
            state = "new"
        elif kind == "modified":
            state = state if state == "new" else "modified"
        elif kind == "deleted":
            state = None if state == "new" else "deleted"
    return "modified" if state == "new" else state


def test_outcomes(spark):
    cases = {
        "modified modified": "modified", "created modified": "modified", "created deleted": None, "modified deleted": "deleted", "deleted created": "modified", "deleted created deleted": None,
        "created modified deleted": None, "created deleted modified deleted": "deleted", "deleted modified": "modified", "deleted": "deleted", "created deleted created": "modified", "deleted deleted": "deleted",
    }
    rows = [r for path in cases for r in events(datetime(2024, 1, 1), *[(path, kind, ms) for ms, kind in enumerate(path.split())])]
    got = {r["path"]: r["outcome"] for r in watch.coalesced(watch.debounced(spark.createDataFrame(rows, watch.EVENTS))).collect()}
    assert {path: got.get(path) for path in cases} == cases == {path: outcome(path.split()) for path in cases}


def events(start, *rows):
    return [(p, k, start + timedelta(milliseconds=ms)) for p, k, ms in rows]


def test_debounce(spark):
    start = datetime(2024, 1, 1)
    rows = events(start, ("a.py", "created", 0), ("b.py", "modified", 100), ("a.py", "deleted", 350), ("b.py", "deleted", 640), ("c.py", "modified", 1000))
    got = watch.coalesced(watch.debounced(spark.createDataFrame(rows, watch.EVENTS))).collect()
    assert sorted((r["path"], r["outcome"]) for r in got) == [("b.py", "deleted"), ("c.py", "modified")]
    assert len({r["session"]["start"] for r in got}) == 2


def test_coalesced_paths_against_the_state_machine(spark):
    start, pick = datetime(2024, 1, 1), random.Random(5)
    kinds = ["created", "modified", "deleted", "odd", watch.TICK]
    rows = [(pick.choice(["a", "b", "c", "d", None]), pick.choice(kinds), start + timedelta(milliseconds=pick.randrange(400) + 2000 * pick.randrange(40))) for _ in range(400)]
    batches = watch.debounced(spark.createDataFrame(rows, watch.EVENTS), "300 milliseconds")
    want = []
    for b in batches.collect():
        for path in {e["path"] for e in b["events"]}:
            if left := outcome([e["kind"] for e in b["events"] if e["path"] == path]):
                want.append((*b["session"], path, left))
    got = [tuple(r) for r in watch.coalesced(batches).select("session.*", "path", "outcome").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 40


def test_observer(tmp_path):
    root, folder = tmp_path / "src", tmp_path / "events"
    (root / "node_modules").mkdir(parents=True)
    (root / "pkg").mkdir()
    for name in ("a.py", "pkg/b.ts", "node_modules/c.js", "readme.md"):
        (root / name).write_text("1")
    seen = Observer(str(root), str(folder), tick=1000)
    assert seen.step() == [] and not list(folder.iterdir())
    (root / "a.py").rename(root / "pkg" / "d.py")
    (root / "pkg" / "b.ts").write_text("22")
    (root / "new.py").write_text("")
    (root / "node_modules" / "c.js").unlink()
    (root / "readme.md").write_text("2")
    want = [("a.py", "deleted"), ("new.py", "created"), ("pkg/b.ts", "modified"), ("pkg/d.py", "created")]
    assert seen.step() == want and seen.step() == []
    seen.tick = 0
    seen.step()
    lines = [[json.loads(x) for x in f.read_text().splitlines()] for f in sorted(folder.iterdir())]
    assert [[(e["path"], e["kind"]) for e in f] for f in lines] == [want, [("", watch.TICK)]]


def test_ticks_close_the_last_batch(spark, tmp_path):
    root, folder = tmp_path / "src", tmp_path / "events"
    root.mkdir()
    seen: list[list[str]] = []
    observer = Observer(str(root), str(folder), every=0.05, tick=0.7)
    feed = watch.start(watch.event_stream(spark, str(folder)), watch.sink(lambda paths: seen.append(paths) or 0), str(tmp_path / "check"), processingTime="200 milliseconds")
    stop = observer.start()
    try:
        (root / "a.py").write_text("x = 1")
        end = time.monotonic() + 60
        while not seen and time.monotonic() < end:
            time.sleep(0.2)
    finally:
        stop.set()
        feed.stop()
    assert seen == [["a.py"]]


def test_tool_server(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/store")
    server = Server(store, "demo")

    def ask(method, /, **params):
        return server.handle(json.dumps({"jsonrpc": "2.0", "id": 7, "method": method, "params": params}))

    def call(name, **arguments):
        found = ask("tools/call", name=name, arguments=arguments)["result"]
        text = found["content"][0]["text"]
        return found["isError"], json.loads(text) if text[:1] in "[{n" else text

    assert ask("initialize")["result"]["capabilities"] == {"tools": {}} and ask("ping") == {"jsonrpc": "2.0", "id": 7, "result": {}}
    listed = {t["name"]: t["inputSchema"] for t in ask("tools/list")["result"]["tools"]}
    assert tuple(listed) == Tools.NAMES and listed["find_callers"]["required"] == ["qualified_name"]
    assert listed["find_symbol"]["properties"] == {"query": {"type": "string"}, "exact": {"type": "boolean", "default": False}, "limit": {"type": "integer", "default": 50}}
    assert listed["imports"]["properties"]["limit"]["default"] == 100 and listed["untested_symbols"]["properties"]["file"] == {"type": ["string", "null"]}
    assert call("find_symbol", query="add")[0], "no such project yet"
    root = sample.write(tmp_path / "src", sample.PYTHON)
    store.commit(ingest.build(store.load(), "demo", source_files(spark, root), root, TsPaths.parse(None)))
    failed, rows = call("find_symbol", query="add", exact=True)
    assert not failed and [r["name"] for r in rows] == ["add"]
    assert call("run_sql", query="drop table calls") == (True, {"error": "forbidden_keyword", "detail": "forbidden_keyword: " + call("run_sql", query="drop table calls")[1]["detail"].split(": ", 1)[1]})
    assert not call("run_sql", query="SELECT count(*) AS n FROM symbols")[0]
    for bad in ({"name": "nosuch"}, {"name": "find_callers", "arguments": {}}, {"name": "hubs", "arguments": {"x": 1}}, {"name": "hubs", "arguments": [1]}, {}):
        assert ask("tools/call", **bad)["error"]["code"] == -32602
    assert ask("nosuch")["error"]["code"] == -32601
    assert server.handle("{")["error"]["code"] == -32700 and server.handle("[]")["error"]["code"] == -32600
    assert server.handle('{"jsonrpc": "2.0", "method": "notifications/initialized"}') is None
    out = io.StringIO()
    server.serve(['{"jsonrpc": "2.0", "id": 1, "method": "ping"}\n', "\n", '{"jsonrpc": "2.0", "method": "x"}\n'], out)
    assert out.getvalue() == '{"jsonrpc": "2.0", "id": 1, "result": {}}\n'


def test_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    folder = tmp_path / "events"
    folder.mkdir()

    def drop(name, rows):
        (folder / name).write_text("".join(json.dumps({"path": p, "kind": k, "ts": t.isoformat() + "Z"}) + "\n" for p, k, t in rows))

    seen, embeds = [], []
    handle = watch.sink(lambda paths: seen.append(paths) or int(paths == ["b.py"]), lambda: embeds.append(1))
    for k, rows in enumerate((events(start, ("a.py", "modified", 0), ("a.py", "modified", 200)), events(start, ("b.py", "created", 5000)), events(start, ("z.py", "modified", 60000)), events(start, ("y.py", "modified", 120000)))):
        drop(f"{k}.json", rows)
        watch.start(watch.event_stream(spark, str(folder)), handle, str(tmp_path / "check"), availableNow=True).awaitTermination()
    assert seen[:2] == [["a.py"], ["b.py"]] and len(embeds) == len(seen) - 1


def test_accepted(spark):
    paths = ["a.py", "x/b.tsx", "x/readme.md", "node_modules/a.js", "gen/a.py", "x/tmp_a.py", "docs/c.py", "k/docs/c.py", "lib.js", "deep/skip.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    keep = accepted(F.col("path"), ("gen/*", "skip.py"), ("docs/", "tmp_*"))
    assert [r[0] for r in df.where(keep).collect()] == ["a.py", "x/b.tsx", "lib.js"]


def test_command_line(spark, tmp_path, capsys):
    root = sample.write(tmp_path / "src", sample.PYTHON)
    settings = Settings(project="demo", store=f"file://{tmp_path}/store", embedding_dimensions=32, python="python")

    def run(*argv):
        code = cli.main(list(argv), settings)
        return code, capsys.readouterr().out

    assert run("build", root)[0] == 0
    status = json.loads(run("status")[1])
    assert status["calls"] == 9 and status["both"] == 4 and status["runtime_only"] == 2 and status["labels"]["test"] == 3
    assert run("embed")[0] == 0
    found = json.loads(run("tool", "semantic_search", '{"query": "multiply", "limit": 1}')[1])
    assert found["results"][0]["name"] == "multiply"
    (tmp_path / "check.toml").write_text('[project]\nname = "demo"\n[checks.cycles]\nenabled = true\n')
    assert run("check", str(tmp_path / "check.toml"), "--root", root, "--strict")[0] == 0
    (tmp_path / "src" / "runner.py").write_text("def run_operation():\n    pass\n")
    assert run("check", str(tmp_path / "check.toml"), "--root", root, "--strict", "--json")[0] == 2
    assert json.loads(run("update", root)[1])["changed"] == 1
    assert run("check", str(tmp_path / "check.toml"), "--root", root, "--strict")[0] == 0
    assert run("clean")[0] == 0 and json.loads(run("status")[1])["files"] == 0
