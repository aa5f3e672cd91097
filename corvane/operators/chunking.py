"""Files cut into overlapping windows of lines, with a header, an id and a hash each."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def header(path: Column, language: Column, symbol: Column | None = None, signature: Column | None = None) -> Column:
    rows = [F.concat(F.lit("# file: "), path), F.concat(F.lit("# language: "), language)]
    for label, value in (("symbol", symbol), ("signature", signature)):
        if value is not None:
            rows.append(F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"# {label}: "), value)))
    return F.concat(F.concat_ws("\n", *rows), F.lit("\n"))


def enclosing(symbols: Column, start: Column, end: Column) -> Column:
    """The name of the smallest of symbols (structs name, lineno_start, lineno_end) around the lines, the first of equals."""
    around = F.filter(symbols, lambda s: (s["lineno_start"] <= start) & (s["lineno_end"] >= end))
    sized = F.transform(around, lambda s, i: F.struct((s["lineno_end"] - s["lineno_start"]).alias("size"), i.alias("i"), s["name"].alias("name")))
    return F.array_min(sized)["name"]


def signature(symbols: Column, name: Column, lines: Column) -> Column:
    """The stripped line where the first symbol of that name starts."""
    first = F.get(F.filter(symbols, lambda s: s["name"] == name), F.lit(0))
    return F.regexp_replace(F.get(lines, first["lineno_start"] - 1), r"^\s+|\s+$", "")


def windows(files: DataFrame, size: int = C.CHUNK_LINES, overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """A row for each window of files (repo, path, language, code, and symbols if there): the file's other columns, symbol, lines, code, id and content_hash.

    Every file is cut on its own: no shuffle. Lines keep their ends; a window of blanks only isn't a chunk.
    """
    # a line end stays with its line: split behind it
    ended = F.split("code", r"(?<=\n|\r(?!\n)|[\x0b\x0c\x1c-\x1e\x85  ])", -1)
    kept = F.filter(ended, lambda x: x != "")
    cut = T.once(files.where(F.trim("code") != ""), "_lines", kept)
    cut = cut.withColumn("_at", F.explode(F.sequence(F.lit(0), F.size("_lines") - 1, F.lit(size - overlap))))
    start, end = (F.col("_at") + 1).cast("int"), F.least(F.col("_at") + size, F.size("_lines")).cast("int")
    cut = cut.withColumns({"lineno_start": start, "lineno_end": end, "code": F.array_join(F.slice("_lines", F.col("_at") + 1, F.lit(size)), "")})
    cut = cut.where(F.length(F.regexp_replace("code", r"\s+", "")) > 0)
    return _named(cut, files.columns).drop("_lines", "_at")


def _named(cut: DataFrame, columns: list[str]) -> DataFrame:
    """cut (repo, path, language, code, lines of the file, first and last line) with symbol, header, id and content_hash."""
    if "symbols" in columns:
        cut = cut.withColumn("symbol", enclosing(F.col("symbols"), F.col("lineno_start"), F.col("lineno_end")))
        head = header(F.col("path"), F.col("language"), F.col("symbol"), signature(F.col("symbols"), F.col("symbol"), F.col("_lines")))
    else:
        cut = cut.withColumn("symbol", F.lit(None).cast("string"))
        head = header(F.col("path"), F.col("language"))
    ident = F.concat_ws(":", "repo", "path", F.col("lineno_start").cast("string"), F.col("lineno_end").cast("string"))
    cut = cut.withColumns({"id": F.sha1(ident), "code": F.concat(head, F.col("code"))})
    return cut.withColumn("content_hash", F.sha2("code", 256))


def statements(code: str, most_chars: int = C.CHUNK_CHARS) -> list[tuple[int, int]]:
    """(first line, last line) of runs of whole statements of Python code of up to most_chars characters; a longer statement gives its own
    parts, one that has none is by itself. None for code that can't be parsed."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = code.split("\n")
    size = lambda a, b: sum(len(x) + 1 for x in lines[a - 1 : b])
    out: list[tuple[int, int]] = []

    def run(nodes: list[ast.stmt]) -> None:
        start = end = None
        for node in nodes:
            low = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
            high, parts = node.end_lineno or node.lineno, [n for name in ("body", "handlers", "orelse", "finalbody") for n in getattr(node, name, [])]
            long = size(low, high) > most_chars and bool(parts)
            if start is not None and (long or size(start, high) > most_chars):
                out.append((start, end))
                start = None
            if long:
                out.append((low, max(low, min(n.lineno for n in parts) - 1)))
                run(parts)
            else:
                start, end = low if start is None else start, high
        if start is not None:
            out.append((start, end))

    if tree.body:
        run(tree.body)
    return sorted({(a, b) for a, b in out if b >= a and "".join(lines[a - 1 : b]).strip()})


def by_statements(files: DataFrame, most_chars: int = C.CHUNK_CHARS) -> DataFrame:
    """Chunks like those of windows(), of whole statements where the language is Python and the file can be parsed; windows of the other files."""

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def cut(code: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in statements(c or "", most_chars)] if x == "python" else [] for c, x in zip(code, language)])

    known = T.once(files, "_spans", cut("code", "language"))
    plain = windows(known.where(F.size("_spans") == 0).drop("_spans"))
    own = known.where(F.size("_spans") > 0).withColumn("_lines", F.split("code", "\n", -1)).withColumn("_span", F.explode("_spans"))
    own = own.withColumns({"lineno_start": F.col("_span.a"), "lineno_end": F.col("_span.b"), "code": F.array_join(F.slice("_lines", F.col("_span.a"), F.col("_span.b") - F.col("_span.a") + 1), "\n")})
    return plain.unionByName(_named(own, files.columns).drop("_spans", "_span", "_lines"))
