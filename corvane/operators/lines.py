"""Lines of files: search by pattern, ranges, and symbols."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..plans.policy import line_range_error
from .hygiene import secret_pattern

#: What may match in a line but not in the file around it, or the other way round.
_BOUND = re.compile(r"[\^$]|\\[AZzGbB]|\(\?[=!<>]|[+*?}]\+")


def java_pattern(spark, pattern: str) -> str:
    """A pattern as the executors' engine writes it: named groups and the end of the text have other spellings. Raises ValueError on one that isn't a pattern."""
    found = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern))
    found = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", found)
    try:
        spark._jvm.java.util.regex.Pattern.compile(found)
    except Exception as error:  # what py4j makes of Java's PatternSyntaxException
        raise ValueError(f"Invalid regex: {str(error).splitlines()[0]}") from None
    return found


def grep(files: DataFrame, pattern: str, path_glob: str | None = None, limit: int | None = C.GREP_LIMIT) -> DataFrame:
    """(path, lineno, line) of the lines that match, by path and line. Raises ValueError on a pattern that isn't one."""
    found = java_pattern(files.sparkSession, pattern)
    own = files.where(T.glob(F.col("path"), path_glob)) if path_glob else files
    if not _BOUND.search(found):
        own = own.where(F.col("code").rlike(found))  # whole files without a match aren't split
    lines = own.select("path", F.posexplode(T.lines(F.col("code"))).alias("i", "line")).where(F.col("line").rlike(found))
    lines = lines.select("path", (F.col("i") + 1).alias("lineno"), "line")
    return lines.orderBy("path", "lineno").limit(limit) if limit else lines


def line_range(files: DataFrame, start: int, end: int) -> DataFrame:
    """(path, content, error): lines start to end of each file, or why not: a bad range, a file too large, or a credential in it."""
    bad = line_range_error(start, end)
    large = F.octet_length("code") > C.RANGE_MAX_BYTES
    error = F.lit(bad) if bad else F.when(large, "file too large").when(secret_pattern(F.col("code")).isNotNull(), "secret detected")
    content = F.array_join(F.slice(T.lines(F.col("code")), start if not bad else 1, end - start + 1 if not bad else 1), "\n")
    return files.select("path", F.when(error.isNull(), content).alias("content"), error.alias("error"), F.lit(C.TRUST).alias("context_trust"))


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, lineno_start, lineno_end) of all definitions."""
    from .graph import with_symbols

    return with_symbols(files).select("path", F.inline("symbols"))
