from __future__ import annotations

from codeloom.sources import python_source, ts_source
from codeloom.sources.records import COLUMNS
from tests.graph import sample


def rows(module, path, text):
    return [dict(zip(COLUMNS, r)) for r in module.extract(path, text.encode())]


def defined(found):
    return [(r["qualified_name"], r["kind"], r["start_line"], r["end_line"]) for r in found if r["record"] == "definition"]


def called(found):
    return [(r["qualified_name"].split("::")[1], r["callee"], r["line"]) for r in found if r["record"] == "call"]


def test_python_sample():
    assert defined(rows(python_source, "calculator.py", sample.CALCULATOR)) == [
        ("calculator.py::Calculator", "class", 4, 11),
        ("calculator.py::Calculator.add", "method", 7, 8),
        ("calculator.py::Calculator.multiply", "method", 10, 11),
    ]
    found = rows(python_source, "runner.py", sample.RUNNER)
    assert defined(found) == [("runner.py::run_operation", "function", 8, 9), ("runner.py::main", "function", 12, 14)]
    assert ("main", "Calculator", 13) in called(found) and ("main", "run_operation", 14) in called(found)
    assert [(r["module"], r["raw"], r["line"]) for r in found if r["record"] == "import"] == [("calculator", "from calculator import Calculator", 3)]


def test_python_rules():
    text = """import a.b, c as d
from .x import y
from .. import z
top()
@outer.mark(arg())
class A(base()):
    value = make()
    @prop
    def m(self, x=default()):
        def inner():
            return deep.er()
        class Nested:
            async def go(self): await self.run()
        return [inner() for _ in x]
    if True:
        def cond(self): pass
"""
    found = rows(python_source, "p.py", text)
    assert [(q, k) for q, k, _, _ in defined(found)] == [("p.py::A", "class"), ("p.py::A.m", "method"), ("p.py::inner", "function"), ("p.py::Nested", "class"), ("p.py::Nested.go", "method"), ("p.py::A.cond", "method")]
    assert called(found) == [("A", "make", 7), ("inner", "deep.er", 11), ("Nested.go", "self.run", 13), ("A.m", "inner", 14)]
    assert [r["module"] for r in found if r["record"] == "import"] == ["a.b", "c", ".x", ".."]
    by = {r["qualified_name"]: r for r in found if r["record"] == "definition"}
    assert by["p.py::A"]["decorators"] == ["outer.mark"] and by["p.py::A.m"]["decorators"] == ["prop"]
    assert by["p.py::A.m"]["parent_class"] == "p.py::A" and by["p.py::A"]["start_line"] == 6


def test_broken_files():
    assert [r["record"] for r in rows(python_source, "p.py", "def f(:\n")] == ["broken"]
    assert [r["record"] for r in rows(python_source, "p.py", "x = '\0'")] == ["broken"]
    assert [r["record"] for r in rows(ts_source, "p.ts", "function f( {")] == ["broken"]
    assert rows(python_source, "p.py", "") == [] and rows(ts_source, "p.ts", "") == []


def test_typescript_sample():
    assert defined(rows(ts_source, "src/calc.ts", sample.CALC_TS)) == [
        ("src/calc.ts::Calculator", "class", 1, 8),
        ("src/calc.ts::Calculator.add", "method", 2, 4),
        ("src/calc.ts::Calculator.multiply", "method", 5, 7),
    ]
    assert defined(rows(ts_source, "src/util.ts", sample.UTIL_TS)) == [("src/util.ts::normalize", "function", 1, 3)]
    found = rows(ts_source, "src/index.ts", sample.INDEX_TS)
    assert defined(found) == [("src/index.ts::default", "function", 4, 8)]
    assert called(found) == [("default", "Calculator", 5), ("default", "add", 6), ("default", "normalize", 7)]
    assert [(r["module"], r["line"]) for r in found if r["record"] == "import"] == [("./calc", 1), ("@/util", 2)]
    found = rows(ts_source, "tests/calc.test.ts", sample.TEST_TS)
    assert defined(found) == [("tests/calc.test.ts::test_add", "function", 3, 6)]
    assert ("test_add", "Calculator", 4) in called(found) and ("test_add", "add", 5) in called(found)


def test_typescript_rules():
    text = r"""
import def, * as all from 'pkg';
const plain = 1, f = (x: number): string => g(x), h = async function named() { return i(); };
let value = start();
// function commented() {}
const s = "function inString() { a(); }", t = `b() ${c}`, re = /function (x)/g;
abstract class K<T> extends Base {
  field = notSeen();
  private static async m<U>(a: U, cb = () => d()): Promise<void> {
    if (a) { this.x?.y(1); obj["computed"](2); new Foo(3); super.m(); }
    for (const q of e(4)) { }
  }
  get prop(): number { return 1; }
  other?: string;
}
function* gen() { yield one(); }
export function outer() {
  function inner() { return two(); }
  return inner();
}
var old = function () { three(); }
"""
    found = rows(ts_source, "x.js", text)
    names = [(q.split("::")[1], k) for q, k, _, _ in defined(found)]
    assert names == [("f", "function"), ("h", "function"), ("K", "class"), ("K.m", "method"), ("K.prop", "method"), ("gen", "function"), ("outer", "function"), ("inner", "function"), ("old", "function")]
    seen = [(s, c) for s, c, _ in called(found)]
    assert seen == [("f", "g"), ("h", "i"), ("K.m", "d"), ("K.m", "y"), ("K.m", "Foo"), ("K.m", "m"), ("K.m", "e"), ("gen", "one"), ("inner", "two"), ("outer", "inner"), ("old", "three")]
    assert [r["module"] for r in found if r["record"] == "import"] == ["pkg"]
