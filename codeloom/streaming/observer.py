"""A file-system observer: what changed in a tree, as JSON lines for the change feed.

It compares the tree with how it was a moment ago, so it needs nothing of the operating system and works on
shared and remote mounts.  A moved file is gone at one path and new at another: a deletion and a creation.
Ticks between the changes let the last batch close.
"""

from __future__ import annotations

import json
import os
import threading
import time
from datetime import datetime, timezone
from pathlib import Path

from codeloom.sources.files import TS_ENDINGS, UNWATCHED
from codeloom.streaming.watch import TICK

ENDINGS = (".py", *TS_ENDINGS)


class Observer:
    """Drops events of the source files below ``root`` into ``folder``.

    Paths are below the root, with forward slashes.  Files that vanish while they are looked at count as gone;
    a folder that cannot be read counts as empty; links to folders are not followed.
    """

    def __init__(self, root: str, folder: str, every: float = 0.2, tick: float = 1.0) -> None:
        self.root, self.folder, self.every, self.tick = root, Path(folder), every, tick
        self.folder.mkdir(parents=True, exist_ok=True)
        self.seen = self.scan()
        self.dropped = 0
        self.quiet_since = time.monotonic()

    def scan(self) -> dict[str, tuple[int, int, int]]:
        """Time of change, size and inode of each source file."""
        found, todo = {}, [self.root]
        while todo:
            try:
                entries = list(os.scandir(todo.pop()))
            except OSError:
                continue
            for e in entries:
                try:
                    if e.is_dir(follow_symlinks=False):
                        if e.name not in UNWATCHED:
                            todo.append(e.path)
                    elif e.name.endswith(ENDINGS) and e.is_file():
                        s = e.stat()
                        found[os.path.relpath(e.path, self.root).replace(os.sep, "/")] = (s.st_mtime_ns, s.st_size, s.st_ino)
                except OSError:
                    continue
        return found

    def changes(self) -> list[tuple[str, str]]:
        """(path, kind) of all that differs from the last look."""
        old, self.seen = self.seen, self.scan()
        out = [(p, "deleted") for p in old.keys() - self.seen.keys()]
        out += [(p, "created") for p in self.seen.keys() - old.keys()]
        out += [(p, "modified") for p in self.seen.keys() & old.keys() if self.seen[p] != old[p]]
        return sorted(out)

    def drop(self, events: list[tuple[str, str]]) -> None:
        """Writes events of this moment; the file is there whole or not at all."""
        now = datetime.now(timezone.utc).isoformat()
        text = "".join(json.dumps({"path": p, "kind": k, "ts": now}) + "\n" for p, k in events)
        name = f"{time.time_ns()}-{os.getpid()}-{self.dropped}.json"
        self.dropped += 1
        part = self.folder / f"_{name}.part"
        part.write_text(text)
        part.replace(self.folder / name)

    def step(self) -> list[tuple[str, str]]:
        """One look; events or, when it is time for one, a tick are dropped."""
        events = self.changes()
        if events or time.monotonic() - self.quiet_since >= self.tick:
            self.drop(events or [("", TICK)])
            self.quiet_since = time.monotonic()
        return events

    def run(self, stop: threading.Event) -> None:
        while not stop.wait(self.every):
            self.step()

    def start(self) -> threading.Event:
        """Looks from a thread of its own until the event that is returned is set."""
        stop = threading.Event()
        threading.Thread(target=self.run, args=(stop,), daemon=True).start()
        return stop
