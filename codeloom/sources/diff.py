"""Unified diffs: which lines of which new files they touch."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: A hunk's header: the start and the count of its new lines.
HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


def touched_lines(diff: str) -> dict[str, set[int]]:
    """Added lines by new path.  Deleted files, and files without an added line, do not appear; nothing raises."""
    found: dict[str, set[int]] = {}
    path, at = None, None
    for line in diff.splitlines():
        if line.startswith("+++ "):
            name = line[4:].strip()
            path = None if name == "/dev/null" else name.removeprefix("b/").replace("\\", "/")
            at = None
        elif line.startswith("--- ") or path is None:
            continue
        elif hunk := HUNK.match(line):
            at = int(hunk[1])
        elif at is not None and line[:1] in ("+", " ", ""):
            if line[:1] == "+":
                found.setdefault(path, set()).add(at)
            at += 1
    return found


def diff_lines(spark: SparkSession, diff: str) -> DataFrame:
    """``path`` and ``line`` of each added line."""
    return spark.createDataFrame([(p, n) for p, lines in sorted(touched_lines(diff).items()) for n in sorted(lines)], "path string, line int")


def new_ranges(diff: str) -> list[tuple[int, int]]:
    """First and last new line of each hunk; hunks that only delete have none."""
    out = []
    for line in diff.splitlines():
        if (hunk := HUNK.match(line)) and (count := int(hunk[2]) if hunk[2] is not None else 1):
            out.append((int(hunk[1]), int(hunk[1]) + count - 1))
    return out
