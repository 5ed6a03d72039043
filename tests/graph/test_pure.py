from __future__ import annotations

import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.checks import config
from codeloom.functions.names import module_of, path_within, runtime_name
from codeloom.operators import freeform
from codeloom.operators.resolve import TsPaths, candidate_path
from codeloom.plans.scc import components_of
from codeloom.settings import load
from codeloom.sources import history
from codeloom.sources.diff import new_ranges, touched_lines
from codeloom.streaming.watch import Backoff


@pytest.mark.parametrize(
    ("diff", "want"),
    [
        ("", {}),
        ("nonsense\n@@ broken\n+x", {}),
        ("--- a/f\n+++ b/f\n@@ -1,2 +1,3 @@\n a\n+b\n c\n", {"f": {2}}),
        ("--- a/f\n+++ b/f\n@@ -1 +1 @@\n-a\n+b\n@@ -9,0 +10,2 @@\n+x\n+y\n", {"f": {1, 10, 11}}),
        ("--- /dev/null\n+++ b/new\n@@ -0,0 +1,2 @@\n+a\n+b\n", {"new": {1, 2}}),
        ("--- a/old\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n", {}),
        ("--- a/f\n+++ b/f\n@@ -1,2 +1,1 @@\n a\n-b\n", {}),
        ("--- a/f\n+++ b\\g\\h\n@@ -1 +1 @@\n-a\n+b\n\\ No newline at end of file\n", {"b/g/h": {1}}),
        ("--- a/f\n+++ b/f\n@@ -1,3 +1,4 @@\n a\n\n+b\n c\n", {"f": {3}}),
        ("--- a/f\n+++ b/f\n@@ -1 +1 @@\n+a\ndiff --git a/g b/g\nindex 1..2\n--- a/g\n+++ b/g\n@@ -4 +4 @@\n+z\n", {"f": {1}, "g": {4}}),
        ("diff --git a/p b/p\nBinary files a/p and b/p differ\n", {}),
    ],
)
def test_touched_lines(diff, want):
    assert touched_lines(diff) == want


def test_new_ranges():
    assert new_ranges("@@ -1,0 +5 @@\n@@ -3,2 +7,3 @@\n@@ -9,4 +12,0 @@\n") == [(5, 5), (7, 9)]


def parts(edges):
    out = {}
    for node, name in components_of(edges).items():
        out.setdefault(name, set()).add(node)
    return sorted(map(sorted, out.values()))


def test_components():
    assert parts([]) == []
    assert parts([("a", "a")]) == [["a"]]
    assert parts([("a", "b"), ("b", "a"), ("b", "c")]) == [["a", "b"], ["c"]]
    assert parts([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)]) == [[1, 2, 3], [4, 5], [6]]
    assert parts([(i, i + 1) for i in range(50000)] + [(50000, 0)]) == [list(range(50001))]


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=30))
@settings(deadline=None)
def test_components_are_mutual_reachability(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    assert components_of(edges) == {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def test_guard():
    word = freeform.forbidden_keyword
    assert word("DETACH  DELETE n") == "DETACH" and word("drop table t") == "DROP" and word("select 'set'") == "SET"
    assert word("select asset, created_at, calls from t") is None
    assert freeform.with_limit("select 1 ; ", 5) == "select 1 LIMIT 5" and freeform.with_limit("select 1 limit 3;", 5) == "select 1 limit 3;"
    assert not freeform.has_limit("select limit from t") and freeform.has_limit("x LIMIT 10 ;")


def test_names(tmp_path):
    assert module_of("a/b/__init__.py") == "a.b" and module_of("a/b.py") == "a.b" and module_of("__init__.py") == ""
    assert runtime_name("outer.<locals>.inner") == "outer.inner"
    assert path_within(str(tmp_path / "x" / "y.py"), str(tmp_path)) == "x/y.py" and path_within("/etc/passwd", str(tmp_path)) is None


def test_ts_paths():
    c = TsPaths.parse('{"compilerOptions": {"baseUrl": "./src", "paths": {"lib": ["vendor/lib"], "@/*": ["app/*", "other/*"], "~/*": ["fixed"]}}}')
    assert c.expand("lib") == "src/vendor/lib" and c.expand("@/a/b") == "src/app/a/b" and c.expand("~/x") == "src/fixed" and c.expand("react") is None
    assert TsPaths.parse("not json") == TsPaths() == TsPaths.parse(None) == TsPaths.parse('{"compilerOptions": {"paths": []}}')
    assert candidate_path("src/a/b.ts", "../c", TsPaths()) == "src/c" and candidate_path("src/a.ts", "react", TsPaths()) is None


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# comment\nCODELOOM_PROJECT='one'\nCODELOOM_ROW_LIMIT=7\n")
    s = load(str(tmp_path / ".env"), {"CODELOOM_ROW_LIMIT": "9"})
    assert (s.project, s.row_limit, s.debounce_ms) == ("one", 9, 300)


def test_check_config(tmp_path):
    p = tmp_path / "c.toml"
    with pytest.raises(config.ConfigError):
        config.load(p)
    p.write_text("[project\n")
    with pytest.raises(config.ConfigError):
        config.load(p)
    p.write_text("[checks.cycles]\nenabled = true\n")
    with pytest.raises(config.ConfigError):
        config.load(p)
    p.write_text('[project]\nname = "x"\n[odd]\n[checks.cycles]\nenabled = true\nmax_cycles = 3\nwrong = 1\n[checks.zzz]\n[checks.churn]\nignore = ["a*"]\n[[checks.layering.layers]]\nname = "w"\npatterns = ["w/*"]\n')
    c = config.load(p)
    assert c.cycles == config.Cycles(True, max_cycles=3) and c.churn.ignore == ("a*",) and c.layering.layers == ({"name": "w", "patterns": ["w/*"]},)
    assert sorted(x.split(":")[0] for x in c.warnings) == ["checks.cycles.wrong", "checks.zzz", "odd"]


def test_backoff():
    waits, tries = [], []

    def work():
        tries.append(1)
        if len(tries) < 4:
            raise ConnectionError("down")

    assert Backoff(cap=3.0, sleep=waits.append).run(work, (ConnectionError,)) and waits == [1.0, 2.0, 3.0]
    assert not Backoff(sleep=waits.append).run(lambda: 1 / 0, (ConnectionError,))


def test_git_history(tmp_path):
    def git(*args):
        subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=ann@x", "-c", "init.defaultBranch=main", *args], cwd=tmp_path, check=True, capture_output=True)

    with pytest.raises(ValueError):
        history.commits(str(tmp_path))
    git("init")
    (tmp_path / "a.py").write_text("def foo():\n    return 1\n\n\ndef bar():\n    return 2\n")
    (tmp_path / "b.bin").write_bytes(bytes(range(256)) * 4)
    git("add", "."), git("commit", "-m", "first | one")
    (tmp_path / "a.py").write_text("def foo():\n    return 10\n\n\ndef bar():\n    return 2\n")
    git("add", "."), git("commit", "-m", "second")
    git("mv", "a.py", "c.py"), git("commit", "-m", "moved")
    got = history.commits(str(tmp_path))
    assert [(c[0], c[6]) for c in got] == [(0, "moved"), (1, "second"), (2, "first | one")]
    assert got[1][7] == [("a.py", 1, 1, [(2, 2)])]
    assert sorted(got[2][7]) == [("a.py", 6, 0, [(1, 6)]), ("b.bin", 0, 0, [])]
    assert sorted(p for p, *_ in got[0][7]) == ["a.py", "c.py"]
    assert [c[6] for c in history.commits(str(tmp_path), got[2][1])] == ["moved", "second"]
    assert len(history.commits(str(tmp_path), most=1)) == 1


def test_git_history_of_odd_lines(tmp_path):
    def git(*args):
        subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=ann@x", "-c", "init.defaultBranch=main", *args], cwd=tmp_path, check=True, capture_output=True)

    git("init")
    (tmp_path / "a.py").write_bytes(b"x = 1\n++ b/z.py\ndiff --git a b\n@@ -1 +9,9 @@\n\x1ehead\x0c@@ -1 +7 @@\r\nlast")
    git("add", "."), git("commit", "-m", "odd \x0c subject")
    (tmp_path / "a.py").write_bytes(b"x = 1\nlast")
    git("commit", "-am", "less")
    got = history.commits(str(tmp_path))
    assert [c[7] for c in got] == [[("a.py", 0, 4, [])], [("a.py", 6, 0, [(1, 6)])]]
    with pytest.raises(subprocess.CalledProcessError):
        history.commits(str(tmp_path), "nosuchcommit")
