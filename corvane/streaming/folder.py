"""File events of a folder as a stream: what differs between one look at it and the next."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "repo string, path string, kind string, ts timestamp, seq long, moved_to string"


def listing(root: str) -> dict[str, tuple[int, int, int]]:
    """Path to (inode, time of change, size) of all files; folders and links are left out."""
    found = {}
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d != ".git" and not os.path.islink(os.path.join(folder, d))]
        for name in names:
            full = os.path.join(folder, name)
            try:
                own = os.lstat(full)
            except OSError:
                continue
            if not os.path.islink(full):
                found[os.path.relpath(full, root)] = (own.st_ino, own.st_mtime_ns, own.st_size)
    return found


def differences(before: dict, after: dict) -> list[tuple[str, str, str | None]]:
    """(path, kind, moved to) of what changed: a file that is gone while one with its inode and size came has moved."""
    gone, new = {p: v for p, v in before.items() if p not in after}, {p: v for p, v in after.items() if p not in before}
    by_inode = {(v[0], v[2]): p for p, v in new.items()}
    moves = {p: by_inode[v[0], v[2]] for p, v in gone.items() if (v[0], v[2]) in by_inode}
    arrived = set(moves.values())
    out = [(p, "moved" if p in moves else "deleted", moves.get(p)) for p in sorted(gone)]
    out += [(p, "created", None) for p in sorted(new) if p not in arrived]
    return out + [(p, "modified", None) for p in sorted(after) if p in before and before[p][1:] != after[p][1:]]


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.repo = options["root"], options["repo"]
        self.state = options.get("state") or f"{self.root.rstrip('/')}.events"

    def _log(self) -> list[dict]:
        try:
            with open(self.state, encoding="utf-8") as file:
                return [json.loads(line) for line in file]
        except FileNotFoundError:
            return []

    def _seen(self) -> dict[str, tuple] | None:
        try:
            with open(f"{self.state}.seen", encoding="utf-8") as file:
                return {p: tuple(v) for p, v in json.load(file).items()}
        except FileNotFoundError:
            return None

    def _see(self, now: dict) -> None:
        with open(f"{self.state}.new", "w", encoding="utf-8") as file:
            json.dump(now, file)
        os.replace(f"{self.state}.new", f"{self.state}.seen")

    def initialOffset(self) -> dict:  # noqa: N802
        if self._seen() is None:
            self._see(listing(self.root))
        return {"seen": len(self._log())}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        count = len(self._log())
        if start["seen"] >= count:  # nothing is waiting: look again
            now = listing(self.root)
            found = differences(self._seen() or {}, now)
            if found:  # events first: after a failure in between they are seen again, not lost
                with open(self.state, "a", encoding="utf-8") as file:
                    file.write(json.dumps({"events": found, "at": time.time()}) + "\n")
                self._see(now)
                count += 1
        return self.readBetweenOffsets(start, {"seen": count}), {"seen": count}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        from datetime import datetime, timezone

        rows = []
        for number, entry in enumerate(self._log()[start["seen"] : end["seen"]], start["seen"]):
            at = datetime.fromtimestamp(entry["at"], timezone.utc)
            rows += [(self.repo, path, kind, at, number * 1_000_000 + k, to) for k, (path, kind, to) in enumerate(entry["events"])]
        return iter(rows)

    def commit(self, end: dict) -> None:
        pass


class FolderEvents(DataSource):
    """spark.readStream.format("folder_events").option("root", ...).option("repo", ...): events are written to a state file, so a batch can be read again, and beside it what was there last."""

    @classmethod
    def name(cls) -> str:
        return "folder_events"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> _Reader:  # noqa: N802
        return _Reader(self.options)


def watch(spark: SparkSession, repo: str, root: str, state: str | None = None):
    """The stream of events of a folder."""
    spark.dataSource.register(FolderEvents)
    reader = spark.readStream.format("folder_events").option("root", root).option("repo", repo)
    return (reader.option("state", state) if state else reader).load()
