"""Which files are left out, and why."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


@dataclass(frozen=True)
class Rules:
    """What can be set for a repository."""

    respect_gitignore: bool = True
    max_file_bytes: int = C.MAX_BYTES
    max_file_lines: int = C.MAX_LINES
    secret_scan: bool = True
    extra_exclude_dirs: list[str] = field(default_factory=list)
    extra_exclude_globs: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, settings: dict | None) -> Rules:
        """From a section of the settings; unknown names don't matter, empty lists may be null."""
        known = {k: v for k, v in (settings or {}).items() if k in cls.__dataclass_fields__ and v is not None}
        return cls(**known)


def path_reason(path: Column, ignored: Column | None = None, extra: Column | None = None, extra_dirs: list[str] = ()) -> Column:
    """Why a path (relative to its repository) is left out, null if it isn't: the first rule that applies, with what it applies to.

    ignored and extra: whether ignore files and further globs leave it out.
    """
    name, suffix = T.name_of(path), F.lower(T.suffix_of(path))
    folders = F.array(*[F.lit(d) for d in dict.fromkeys([*C.EXCLUDED_DIRS, *extra_dirs])])
    folder = F.get(F.filter(T.parts(path), lambda p: F.array_contains(folders, p)), F.lit(0))
    reason = F.when(folder.isNotNull(), F.concat(F.lit("excluded_dir:"), folder))
    reason = reason.when(name.isin(C.EXCLUDED_NAMES), F.concat(F.lit("excluded_filename:"), name))
    reason = reason.when(suffix.isin([s for s in C.EXCLUDED_SUFFIXES if s.count(".") == 1]), F.concat(F.lit("excluded_ext:"), suffix))
    for several in (s for s in C.EXCLUDED_SUFFIXES if s.count(".") > 1):
        reason = reason.when(name.endswith(several), F.lit(f"excluded_ext:{several}"))
    if ignored is not None:
        reason = reason.when(ignored, "gitignore")
    if extra is not None:
        reason = reason.when(extra, "extra_glob")
    return reason


def secret_pattern(text: Column) -> Column:
    """The first 20 characters of the first pattern of a credential that the text has, else null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(p[:20])) for p in C.SECRETS])


def content_reason(text: Column, size: Column, max_bytes: int = C.MAX_BYTES, max_lines: int = C.MAX_LINES, secrets: bool = True, error: Column | None = None) -> Column:
    """Why a file's content is left out, null if it isn't. error: what went wrong with the file, as kind:detail."""
    count = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    head = F.decode(F.substring(F.encode(text, "UTF-8"), 1, C.HEAD_BYTES), "ISO-8859-1")  # a character for each byte
    failed = F.lit(None).cast("string") if error is None else error
    reason = F.when(failed.startswith("stat_error"), failed).when(size > max_bytes, F.concat(F.lit("too_large:"), size.cast("string")))
    reason = reason.when(failed.isNotNull(), failed).when(text.isNull(), "read_error").when(F.locate("\0", head) > 0, "binary")
    reason = reason.when(count > max_lines, F.concat(F.lit("too_many_lines:"), count.cast("string")))
    return reason.when(secret_pattern(text).isNotNull(), "secret_detected") if secrets else reason


def judged(files: DataFrame, rules: Rules = Rules(), ignored: Column | None = None, extra: Column | None = None, path: str = "path", text: str = "code") -> DataFrame:
    """files with reason: null for those that stay. Sizes and errors are those of the columns size and error, if there are any."""
    size = F.coalesce(F.col("size"), F.octet_length(text)) if "size" in files.columns else F.octet_length(text)
    error = F.col("error") if "error" in files.columns else None
    ignored = ignored if rules.respect_gitignore else None
    of_path = path_reason(F.col(path), ignored, extra, rules.extra_exclude_dirs)
    of_content = content_reason(F.col(text), size, rules.max_file_bytes, rules.max_file_lines, rules.secret_scan, error)
    return files.withColumn("reason", F.coalesce(of_path, of_content))


def filter_files(files: DataFrame, rules: Rules = Rules(), **more) -> tuple[DataFrame, DataFrame]:
    """The files that stay, and (reason, n) of the others."""
    found = judged(files, rules, **more)
    return found.where("reason is null").drop("reason"), found.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def secret_hits(found: DataFrame, path: str = "path") -> DataFrame:
    """(ts, path) of what judged() leaves out for a credential: the side output that a warning log is written from."""
    return found.where("reason = 'secret_detected'").select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.col(path).alias("path"))


def warn_secrets(paths: list[str], folder: str, now: datetime | None = None) -> None:
    """Adds lines (time, path; never the credential) to a log that only its owner may read. Failures aren't the caller's."""
    at = (now or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    try:
        os.makedirs(folder, mode=0o700, exist_ok=True)
        with os.fdopen(os.open(os.path.join(folder, C.SECRETS_LOG), os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o600), "a", encoding="utf-8") as file:
            file.writelines(f"{at} {p}\n" for p in paths)
    except OSError:
        pass
