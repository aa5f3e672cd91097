"""Files of a repository as a table."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def listing(root: str) -> Iterator[str]:
    """Relative paths of the files of known languages, links and skipped folders left out; hidden ones, which Spark's own listing drops, are there."""
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in C.SCAN_SKIP_DIRS and not os.path.islink(os.path.join(folder, d)))
        for name in sorted(names):
            path = os.path.join(folder, name)
            if os.path.splitext(name)[1].lower() in C.LANGUAGES and not os.path.islink(path):
                yield os.path.relpath(path, root)


def scan(spark: SparkSession, repo: str, root: str, prefix: str = "", paths: DataFrame | None = None) -> DataFrame:
    """(repo, path, language, code, size, mtime, error) of a repository on a file system that driver and executors share.

    Bytes that aren't UTF-8 are dropped, line ends made one. A file that can't be looked at or read has an error instead
    of code. paths (path) in place of a listing: those that aren't there any more are left out.
    """
    listed = paths is None
    paths = spark.createDataFrame([(p,) for p in listing(root) if p.startswith(prefix)], "path string") if listed else paths.select("path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            rows = []
            for path in own["path"]:
                code = size = mtime = error = None
                try:
                    found = os.stat(os.path.join(root, path))
                    size, mtime = found.st_size, found.st_mtime
                    with open(os.path.join(root, path), "rb") as file:
                        code = file.read().decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
                except FileNotFoundError as e:
                    if not listed:
                        continue
                    error = f"stat_error:{e.strerror}"
                except OSError as e:
                    error = f"{'stat_error' if size is None else 'read_error'}:{e.strerror}"
                rows.append((path, code, size, mtime, error))
            yield pd.DataFrame(rows, columns=["path", "code", "size", "mtime", "error"]).astype({"size": "Int64", "mtime": "float64"})

    found = paths.mapInPandas(read, "path string, code string, size long, mtime double, error string")
    return found.select(F.lit(repo).alias("repo"), "path", T.language_of(F.col("path")).alias("language"), "code", "size", F.timestamp_millis((F.col("mtime") * 1000).cast("long")).alias("mtime"), "error")


def _escape(text: str) -> str:
    """Literal text in a pattern, for Python's engine and Java's."""
    return re.sub(r"([^\w\s/])", r"\\\1", text)


class Ignore:
    """Patterns of ignore files, by folder; those of nested files are anchored to their folder. The last one that fits decides."""

    def __init__(self, files: dict[str, str]):
        self.rules: list[tuple[str, bool]] = []
        for folder, content in sorted(files.items()):
            for line in content.splitlines():
                line = re.sub(r"(?<!\\)\s+$", "", line)
                if not line or line.startswith("#"):
                    continue
                keep = line.startswith("!")
                self.rules.append((self._pattern(folder, line[1:] if keep else line), keep))

    @classmethod
    def globs(cls, patterns: list[str]) -> Ignore:
        return cls({"": "\n".join(patterns)})

    @staticmethod
    def _pattern(folder: str, rule: str) -> str:
        """A rule as a pattern of whole paths."""
        only_dir = rule.endswith("/")
        body = rule.rstrip("/")
        anchored = bool(folder) or "/" in body
        parts = []
        for part in body.strip("/").split("/"):
            if part == "**":
                parts.append(None)
                continue
            out = ""
            for m in re.finditer(r"\\(.)|(\*+)|(\?)|\[([!^]?)(\]?[^\]]*)\]|(.)", part):
                literal, stars, one, negated, members, other = m.groups()
                if members is not None:
                    out += "[" + ("^/" if negated else "") + re.sub(r"([\\\[\]&^])", r"\\\1", members) + "]"
                else:
                    out += "[^/]*" if stars else "[^/]" if one else _escape(literal or other)
            parts.append(out)
        found = ""
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            if part is None:
                found += ".*" if last else "(?:.*/)?"
            else:
                found += part + ("" if last else "/")
        start = f"{_escape(folder)}/" if folder else ""
        return f"^{start}{'' if anchored else '(?:.*/)?'}{found}{'/.*' if only_dir else '(?:/.*)?'}$"

    @classmethod
    def load(cls, root: str) -> Ignore:
        files = {}
        for folder, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if d != ".git"]
            if ".gitignore" in names:
                with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="ignore") as file:
                    key = os.path.relpath(folder, root)
                    files["" if key == "." else key] = file.read()
        return cls(files)

    def __call__(self, path: str) -> bool:
        return next((not keep for pattern, keep in reversed(self.rules) if re.search(pattern, path)), False)

    def column(self, path: Column) -> Column:
        """The same in the JVM."""
        found = F.lit(False)
        for pattern, keep in self.rules:  # later rules stand before earlier ones
            found = F.when(path.rlike(pattern), F.lit(not keep)).otherwise(found)
        return found


def git_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(path, commit_sha, last_author, last_modified) of each file's last commit, from one pass over the history; no rows without one."""
    schema = "path string, commit_sha string, last_author string, last_modified timestamp"
    try:  # names end with a null byte, so that none is quoted
        log = subprocess.run(["git", "-C", root, "log", "-z", "--format=%x01%H|%ae|%ct", "--name-only"], capture_output=True, timeout=600, check=True).stdout.decode("utf-8", "surrogateescape")
    except (OSError, subprocess.SubprocessError):
        return spark.createDataFrame([], schema)
    seen: dict[str, tuple] = {}
    for commit in log.split("\x01")[1:]:
        head, *names = commit.split("\0")
        sha, author, at = head.strip().split("|")
        for name in (n.lstrip("\n") for n in names):
            if name:
                seen.setdefault(name, (name, sha, author, int(at)))
    rows = spark.createDataFrame([r for r in seen.values() if r[0].isprintable()], "path string, commit_sha string, last_author string, at long")
    return rows.select("path", "commit_sha", "last_author", F.timestamp_seconds("at").alias("last_modified"))
