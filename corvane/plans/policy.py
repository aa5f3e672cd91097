"""What a caller may ask for: repositories, paths, line ranges, locks and private files. All on the driver."""

from __future__ import annotations

import contextlib
import fcntl
import ipaddress
import os
import re
import stat

from ..functions import constants as C


class RepoError(ValueError):
    def __init__(self, message: str, available: list[str]):
        super().__init__(message)
        self.available = available


def resolve_repo(configured: list[str], explicit: str | None = None, header: str | None = None, environment: str | None = None) -> str:
    """The repository asked for: the argument, the connection's header, the environment, in this order; blanks count as unset."""
    for asked in (explicit, header, environment):
        if asked and asked.strip():
            name = asked.strip()
            if name != "all" and name not in configured:
                raise RepoError(f"unknown repository: {name}", sorted(configured))
            return name
    raise RepoError("no repository given", sorted(configured))


def within(path: str, roots: list[str]) -> str | None:
    """The real path if it is inside one of the roots, links followed; else None."""
    real = os.path.realpath(path)
    return real if any(real == (r := os.path.realpath(root)) or real.startswith(r + os.sep) for root in roots) else None


def line_range_error(start: int, end: int) -> str | None:
    if start < 1:
        return "start must be 1 or more"
    if end < start:
        return "end is before start"
    return f"more than {C.RANGE_MAX_LINES} lines" if end - start + 1 > C.RANGE_MAX_LINES else None


def target_kind(target: str) -> str | None:
    """path, symbol, or None if it can be neither."""
    if "/" in target or target.startswith("."):
        return "path"
    return "symbol" if re.fullmatch(C.SYMBOL, target) else None


def lock_path(folder: str, repo: str) -> str:
    return os.path.join(folder, re.sub(C.UNSAFE, "_", repo) + ".lock")


@contextlib.contextmanager
def repo_lock(folder: str, repo: str, wait: bool = True):
    """One writer for each repository; yields False if another has it and wait is off."""
    os.makedirs(folder, mode=0o700, exist_ok=True)
    handle = os.open(lock_path(folder, repo), os.O_RDWR | os.O_CREAT, 0o600)
    try:
        try:
            fcntl.flock(handle, fcntl.LOCK_EX | (0 if wait else fcntl.LOCK_NB))
        except BlockingIOError:
            yield False
            return
        yield True
    finally:
        os.close(handle)


def is_loopback(host: str) -> bool:
    if host.strip("[]").lower() == "localhost":
        return True
    try:
        return ipaddress.ip_address(host.strip("[]")).is_loopback
    except ValueError:
        return False


def check_host(host: str, allow_remote: bool = False) -> str:
    if not allow_remote and not is_loopback(host):
        raise ValueError(f"{host} can be reached from outside; allow_remote permits it")
    return host


def open_to_others(path: str) -> bool:
    """Whether group or others have any right to a file."""
    try:
        return bool(stat.S_IMODE(os.stat(path).st_mode) & 0o077)
    except OSError:
        return False


def create_private(path: str, content: str = "") -> bool:
    """A new file that only its owner may read; False if it is there already."""
    try:
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as file:
            file.write(content)
        return True
    except FileExistsError:
        return False
