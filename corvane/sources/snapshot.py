"""A repository's files taken over into a folder of snapshots."""

from __future__ import annotations

import filecmp
import os
import shutil
import time
from collections.abc import Callable, Iterator

from ..functions import constants as C
from . import settings
from .repository import Ignore


def wanted(source: str, most_bytes: int | None = None) -> Iterator[str]:
    """Relative paths of what a snapshot holds: neither what ignore files leave out, nor what never belongs into one, nor larger files."""
    ignore, never = Ignore.load(source), Ignore.globs(C.SNAPSHOT_SKIPS)
    for folder, dirs, names in os.walk(source):
        here = os.path.relpath(folder, source)
        inside = (lambda n, here=here: n if here == "." else f"{here}/{n}")
        dirs[:] = sorted(d for d in dirs if not never(f"{inside(d)}/") and not never(inside(d)) and not os.path.islink(os.path.join(folder, d)))
        for name in sorted(names):
            path, full = inside(name), os.path.join(folder, name)
            if not ignore(path) and not never(path) and os.path.isfile(full) and (most_bytes is None or os.path.getsize(full) <= most_bytes):
                yield path


def take(source: str, target: str, most_bytes: int | None = None, repo: str | None = None, config: str | None = None) -> dict[str, list[str]]:
    """Makes target hold what source does: gives which paths were copied and which removed. With repo and config, registers the repository."""
    if not os.path.isdir(source):
        raise FileNotFoundError(source)
    os.makedirs(target, mode=0o700, exist_ok=True)
    os.chmod(target, 0o700)
    own, copied, removed = set(wanted(source, most_bytes)), [], []
    for path in sorted(own):
        a, b = os.path.join(source, path), os.path.join(target, path)
        if not os.path.exists(b) or not filecmp.cmp(a, b, shallow=True):
            os.makedirs(os.path.dirname(b), exist_ok=True)
            shutil.copy2(a, b)
            copied.append(path)
    for folder, _, names in os.walk(target, topdown=False):
        for name in names:
            path = os.path.relpath(os.path.join(folder, name), target)
            if path not in own:
                os.remove(os.path.join(folder, name))
                removed.append(path)
        if folder != target and not os.listdir(folder):
            os.rmdir(folder)
    if repo and config:
        settings.register(config, repo, target)
    return {"copied": copied, "removed": sorted(removed)}


def follow(source: str, act: Callable[[], object], quiet: float = 2.0, every: float = 0.5, go_on: Callable[[], bool] = lambda: True) -> int:
    """Calls act whenever something wanted of source has changed and nothing more has for `quiet` seconds, as long as go_on; gives how often."""

    def look() -> dict[str, tuple[int, int]]:
        found = {}
        for path in wanted(source):
            try:
                own = os.stat(os.path.join(source, path))
            except FileNotFoundError:
                continue
            found[path] = (own.st_mtime_ns, own.st_size)
        return found

    done = seen = look()
    since, times = time.monotonic(), 0
    while go_on():
        now = look()
        if now != seen:
            seen, since = now, time.monotonic()
        elif now != done and time.monotonic() - since >= quiet:
            act()
            done, times = now, times + 1
        time.sleep(every)
    return times
