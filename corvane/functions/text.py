"""Column expressions over texts and paths; all run in the JVM."""

from __future__ import annotations

import fnmatch
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C

#: Python's line ends.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one more column, computed once a row: the optimizer doesn't write an expression out again, in filters or in lambdas, across a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def any_of(column: Column, values: list[str], test) -> Column:
    found = F.lit(False)
    for v in values:
        found = found | test(column, v)
    return found


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix_of(path: Column) -> Column:
    """The last suffix, with its dot; '' for none, for hidden names and names that end in a dot."""
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1)


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in C.LANGUAGES.items() for x in pair])
    return F.try_element_at(known, F.lower(suffix_of(path)))


def file_role(path: Column, language: Column) -> Column:
    """test, build, docs, script, config, source or unknown: the first that fits."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    own, name, suffix = parts(low), name_of(F.rtrim(low, F.lit("/"))), suffix_of(low)
    has = lambda names: F.arrays_overlap(own, F.array(*[F.lit(n) for n in names]))
    test = has(C.TEST_DIRS) | name.startswith("test_") | any_of(name, C.TEST_ENDS, Column.endswith)
    config = suffix.isin(C.CONFIG_SUFFIXES) | name.startswith("config.") | name.endswith(".config.js") | name.endswith(".config.ts")
    return (
        F.when(test, "test")
        .when(name.isin(C.BUILD_NAMES), "build")
        .when(has(["docs"]) | name.startswith("readme") | suffix.isin(C.DOC_SUFFIXES), "docs")
        .when(has(["scripts"]) | suffix.isin(C.SCRIPT_SUFFIXES), "script")
        .when(config, "config")
        .when(F.coalesce(language.isin(C.SOURCE_LANGUAGES), F.lit(False)) | suffix.isin(C.SOURCE_SUFFIXES), "source")
        .otherwise("unknown")
    )


def context_range(start: Column, end: Column, around: int = C.CONTEXT_LINES, most: int = C.CONTEXT_MAX) -> Column:
    """The lines to read around a hit: `around` on both sides, `most` lines at most, and never less than up to its end."""
    first, last = F.greatest(F.lit(1), start - around), F.greatest(end, end + around)
    cut = F.least(last, first + most - 1)
    short = cut < end  # the hit itself doesn't fit: its last lines do
    first = F.when(short, F.greatest(F.lit(1), end - most + 1)).otherwise(first)
    last = F.when(short, end).otherwise(cut)
    return F.struct(F.lit("context_window").alias("kind"), first.cast("int").alias("lineno_start"), last.cast("int").alias("lineno_end"))


def fold(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), C.MARKED, C.PLAIN)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def lines(text: Column) -> Column:
    """Lines as Python's splitlines gives them."""
    found = F.split(text, LINE_ENDS, -1)
    return F.when(F.element_at(found, -1) == "", F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found)


def glob(path: Column, pattern: str) -> Column:
    """Shell-style match anywhere in the path; * crosses folders, case counts."""
    return path.rlike(fnmatch.translate(f"*{pattern}*"))


def _spellings(token: str) -> list[str]:
    """A token, its parts in camel case if there are several, and those between underscores if there are any."""
    camel = re.sub(C.CAMEL, r" \1", token).split()
    return [token] + camel * (len(camel) > 1) + token.split("_") * ("_" in token)


def expand_query(query: str) -> str:
    """Words of a query with the parts of camel and snake case, lower-case, each once."""
    spelled = (part.lower() for token in query.split() for part in _spellings(token) if part)
    return " ".join(dict.fromkeys(spelled))


def expanded(query: Column) -> Column:
    """expand_query as an expression."""
    tokens = F.filter(F.split(query, r"\s+"), lambda t: t != "")

    def parts_of(token: Column) -> Column:
        camel = F.filter(F.split(F.regexp_replace(token, C.CAMEL, " $1"), r"\s+"), lambda p: p != "")
        none = F.array().cast("array<string>")
        return F.concat(F.array(token), F.when(F.size(camel) > 1, camel).otherwise(none), F.when(F.instr(token, "_") > 0, F.split(token, "_")).otherwise(none))

    return F.array_join(F.array_distinct(F.transform(F.filter(F.flatten(F.transform(tokens, parts_of)), lambda p: p != ""), F.lower)), " ")


def phrases(query: str) -> list[list[str]]:
    """The phrases of a query's lexical search: the terms of each of its expanded tokens; tokens without a word character have none."""
    table = str.maketrans(C.MARKED, C.PLAIN)
    found = []
    for token in expand_query(query).split():
        if re.search(r"\w", token):
            own = re.findall(r"[^\W_]+", token.lower().translate(table))
            if own:
                found.append(own)
    return found


#: Units of a span of time, in seconds.
_SECONDS = {"d": 86_400, "h": 3_600, "m": 60}


def parse_since(value: str | None, now: datetime | None = None) -> datetime | None:
    """A number of days, hours or minutes before now (7d, 24h, 30m), a date or an ISO time, as UTC; None if it's none of them."""
    own = (value or "").strip()
    if own[-1:] in _SECONDS and own[:-1].isdecimal():
        return (now or datetime.now(timezone.utc)) - timedelta(seconds=int(own[:-1]) * _SECONDS[own[-1]])
    try:
        found = datetime.fromisoformat(own.replace("Z", "+00:00"))
    except ValueError:
        return None
    return found.replace(tzinfo=found.tzinfo or timezone.utc)


def scrub(value, most: int = C.SCRUB_LENGTH):
    """Long strings cut, at any depth of lists and dicts."""
    if isinstance(value, str):
        return value[:most] + "...[truncated]" if len(value) > most else value
    if isinstance(value, dict):
        return {k: scrub(v, most) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [scrub(v, most) for v in value]
    return value


def scrubbed(text: Column, most: int = C.SCRUB_LENGTH) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("...[truncated]"))).otherwise(text)


def target_kind(target: Column) -> Column:
    """What is asked about: path, symbol, or null if it can be neither."""
    return F.when(target.contains("/") | target.startswith("."), "path").when(target.rlike(f"^{C.SYMBOL}$"), "symbol")


def range_error(start: Column, end: Column, most: int = C.RANGE_MAX_LINES) -> Column:
    """What is wrong with a range of lines, null if nothing is."""
    return F.when(start < 1, "start must be 1 or more").when(end < start, "end is before start").when(end - start + 1 > most, f"more than {most} lines")


def safe_name(name: Column) -> Column:
    """A name that can be a file's."""
    return F.regexp_replace(name, C.UNSAFE, "_")


def commit_line(line: Column) -> Column:
    """commit_sha, last_author and last_modified of a line 'sha|author|seconds'; null for lines of another form."""
    parts = F.split(line, r"\|")
    at = F.timestamp_seconds(F.get(parts, F.lit(2)).try_cast("long"))
    return F.when((F.size(parts) == 3) & at.isNotNull(), F.struct(parts[0].alias("commit_sha"), parts[1].alias("last_author"), at.alias("last_modified")))


def log_day(path: Column) -> Column:
    """The day that a log's name says, null if it is no log's."""
    return F.to_date(F.nullif(F.regexp_extract(path, C.LOG_DAY, 1), F.lit("")))


def since(value: Column, now: Column) -> Column:
    """parse_since() as an expression: a number of days, hours or minutes before now, a date or a time, as a timestamp."""
    number = F.regexp_extract(value, r"^\s*(\d+)[dhm]\s*$", 1)
    unit = F.regexp_extract(value, r"([dhm])\s*$", 1)
    seconds = number.cast("long") * F.when(unit == "d", 86_400).when(unit == "h", 3_600).otherwise(60)
    return F.when(number != "", F.timestamp_seconds(F.unix_micros(now) / 1e6 - seconds)).otherwise(F.try_to_timestamp(F.trim(value)))
