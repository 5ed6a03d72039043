"""Two small projects and what is known of them."""

from __future__ import annotations

CALCULATOR = '''"""Arithmetic."""


class Calculator:
    """Adds and multiplies."""

    def add(self, a, b):
        return a + b

    def multiply(self, a, b):
        return a * b
'''
RUNNER = '''"""Picks an operation by name."""

from calculator import Calculator

OPERATIONS = ("add", "multiply")


def run_operation(calculator, name, a, b):
    return getattr(calculator, name)(a, b)


def main():
    c = Calculator()
    return [run_operation(c, n, 2, 3) for n in OPERATIONS]
'''
TESTS = '''from calculator import Calculator
from runner import main, run_operation

# the tests

def test_add():
    assert Calculator().add(1, 2) == 3


def test_run_operation_dynamic_dispatch():
    assert run_operation(Calculator(), "multiply", 2, 3) == 6


def test_main():
    assert main() == [5, 6]
'''
PYTHON = {"calculator.py": CALCULATOR, "runner.py": RUNNER, "test_calculator.py": TESTS}

CALC_TS = """export class Calculator {
  add(a: number, b: number): number {
    return a + b;
  }
  multiply(a: number, b: number): number {
    return a * b;
  }
}
"""
UTIL_TS = """export function normalize(x: number): number {
  return Math.abs(x);
}
"""
INDEX_TS = """import { Calculator } from "./calc";
import { normalize } from "@/util";

export default function () {
  const c = new Calculator();
  const sum = c.add(1, 2);
  return normalize(sum);
}
"""
TEST_TS = """import { Calculator } from "../src/calc";

export function test_add() {
  const c = new Calculator();
  if (c.add(1, 2) !== 3) throw new Error("add");
}
"""
TYPESCRIPT = {"src/calc.ts": CALC_TS, "src/util.ts": UTIL_TS, "src/index.ts": INDEX_TS, "tests/calc.test.ts": TEST_TS}
TSCONFIG = '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}'


def write(root, files: dict[str, str]) -> str:
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)
