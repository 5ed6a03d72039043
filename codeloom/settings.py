"""Settings from the environment or a ``.env`` file; arguments of the command line come first."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    project: str = "default"
    store: str = "codeloom-graph"
    master: str = "local[*]"
    shuffle_partitions: int = 8
    row_limit: int = 1000
    timeout_seconds: int = 30
    embedding_dimensions: int = 384
    embedding_batch: int = 32
    debounce_ms: int = 300
    history_commits: int = 5000
    python: str = "python"


def load(env_file: str = ".env", environ: dict[str, str] | None = None) -> Settings:
    """``CODELOOM_<NAME>`` of the environment, else of the file, else the default."""
    given: dict[str, str] = {}
    if Path(env_file).exists():
        for line in Path(env_file).read_text().splitlines():
            name, eq, value = line.strip().partition("=")
            if eq and not name.startswith("#"):
                given[name.strip()] = value.strip().strip("'\"")
    given |= dict(os.environ if environ is None else environ)
    values = {f.name: type(f.default)(given[key]) for f in fields(Settings) if (key := f"CODELOOM_{f.name.upper()}") in given}
    return Settings(**values)
