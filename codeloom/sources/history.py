"""First-parent history of a git repository as a frame of commits."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources.diff import new_ranges

COMMITS = (
    "place int, sha string, short_sha string, timestamp string, author_email string, author_name string, message string, "
    "files array<struct<path string, additions int, deletions int, hunks array<struct<start int, end int>>>>"
)
_MARK = "\x1e"
_HEAD = f"{_MARK}%H\x1f%h\x1f%aI\x1f%aE\x1f%aN\x1f%s"


def _blocks(root: str, *args: str, keep: Callable[[str], bool] = bool) -> Iterator[tuple[str, list[str]]]:
    """Head and kept lines of each commit, as git writes them: one commit at a time is held."""
    git = subprocess.Popen(["git", "-c", "core.quotePath=false", *args], cwd=root, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    try:
        head, lines = None, []
        for raw in git.stdout:
            line = raw.decode("utf-8", "replace").rstrip("\n")
            if line.startswith(_MARK):
                if head is not None:
                    yield head, lines
                head, lines = line[len(_MARK) :], []
            elif keep(line):
                lines.append(line)
        if head is not None:
            yield head, lines
        if git.wait():
            raise subprocess.CalledProcessError(git.returncode, git.args)
    finally:
        git.stdout.close()
        if git.poll() is None:
            git.kill()
        git.wait()


def numbers(lines: Iterable[str]) -> dict[str, tuple[int, int]]:
    """Added and deleted lines by path, of numstat lines; binary files count as 0."""
    out = {}
    for line in lines:
        parts = line.split("\t", 2)
        if len(parts) == 3:
            out[parts[2]] = tuple(int(x) if x.isdigit() else 0 for x in parts[:2])
    return out


def _is_head(line: str) -> bool:
    """Lines of a patch that say where it is; a removed or added line starts with a sign."""
    return line.startswith(("diff --git ", "+++ ", "@@ "))


def patches(lines: Iterable[str]) -> dict[str, list[tuple[int, int]]]:
    """New line ranges by path, of the heads of a patch without context."""
    out: dict[str, list[tuple[int, int]]] = {}
    name, unnamed = None, False
    for line in lines:
        if line.startswith("diff --git "):
            name, unnamed = None, True
        elif line.startswith("+++ ") and unnamed:
            # the first one names the file, another one is an added line of its text
            name, unnamed = (line[6:].rstrip("\t") if line.startswith("+++ b/") else None), False
        elif name is not None:
            out.setdefault(name, []).extend(new_ranges(line))
    return out


def commits(root: str, since: str | None = None, most: int | None = None) -> list[tuple]:
    """Newest first, without merges; ``since`` is exclusive.

    Two passes of git serve the whole history; they are read side by side, and of the patches only the heads
    of files and hunks are kept.
    """
    if not (Path(root) / ".git").exists():
        raise ValueError(f"not a git repository: {root}")
    span = [f"{since}..HEAD"] if since else []
    limit = ["-n", str(most)] if most is not None else []
    base = ["log", "--first-parent", "--no-merges", "--no-renames", f"--pretty=format:{_HEAD}", *limit]
    counted = _blocks(root, *base, "--numstat", *span)
    patched = _blocks(root, *base, "-p", "--unified=0", "--no-color", *span, keep=_is_head)
    out = []
    for (head, counts), (_, heads) in zip(counted, patched, strict=True):
        sha, short, ts, email, name, message = head.split("\x1f", 5)
        ranges = patches(heads)
        files = [(path, a, d, ranges.get(path, [])) for path, (a, d) in numbers(counts).items()]
        if files:
            out.append((len(out), sha, short, ts, email, name, message, files))
    return out


def commit_frame(spark: SparkSession, root: str, since: str | None = None, most: int | None = None) -> DataFrame:
    return spark.createDataFrame(commits(root, since, most), COMMITS)
