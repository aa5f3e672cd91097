"""The graph of definitions, imports and references of code, and what is asked of it."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C

EDGES = "repo string, src_kind string, src string, dst_kind string, dst string, edge_type string, path string, lineno int"
SYMBOLS = "name string, lineno_start int, lineno_end int"
PRIORITY = {"imports": 0, "defines": 1, "references": 2}
#: Of edges of any other kind.
OTHER_PRIORITY = 9
REVERSED = {"imports": "imported_by", "defines": "defined_in", "references": "referenced_by"}

#: What starts a definition in languages without a parser here: approximate.
DEFINITIONS = {
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\*?|class|interface|enum|type)\s+([A-Za-z_$][\w$]*)",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class)\s+([A-Za-z_$][\w$]*)",
    "go": r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+)*(?:fn|struct|enum|trait)\s+([A-Za-z_]\w*)",
    "java": r"^\s*(?:(?:public|protected|private|static|final|abstract)\s+)*(?:class|interface|enum|record)\s+([A-Za-z_]\w*)",
    "ruby": r"^\s*(?:def|class|module)\s+(?:self\.)?([A-Za-z_]\w*[?!]?)",
}


#: Texts in quotes and comments, in which braces mean nothing.
_QUOTED = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/", re.S)


def _brace_ends(code: str, starts: list[int]) -> list[int]:
    """The last line of what begins on each of the lines: where the first brace from there on closes; the line itself if a statement ends before."""
    plain = _QUOTED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    lines, out = plain.split("\n"), []
    for start in starts:
        depth, end = 0, start
        for number in range(start, len(lines) + 1):
            for c in re.findall(r"[{};]", lines[number - 1]):
                depth += (c == "{") - (c == "}")
                if depth <= 0:
                    end = number
                    break
            else:
                continue
            break
        out.append(end)
    return out


def _word_ends(code: str, starts: list[int]) -> list[int]:
    """The same for blocks that close with the word end, indented as they begin."""
    lines, out = code.split("\n"), []
    for start in starts:
        indent = re.match(r"\s*", lines[start - 1])[0]
        closes = re.compile(rf"{indent}end\b")
        out.append(next((n for n in range(start + 1, len(lines) + 1) if closes.match(lines[n - 1])), start))
    return out


def symbols_of(code: str, language: str | None) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of each definition, in order of lines; by patterns where there's no parser, or it fails."""
    if language == "python":
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError):
            found = re.compile(r"^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)")
            return [(m[1], i, i) for i, line in enumerate(code.split("\n"), 1) if (m := found.match(line))]
        own = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
        return sorted(((n.name, n.lineno, n.end_lineno or n.lineno) for n in own), key=lambda s: (s[1], -s[2]))
    if language not in DEFINITIONS:
        return []
    found = re.compile(DEFINITIONS[language])
    named = [(m[1], i) for i, line in enumerate(code.split("\n"), 1) if (m := found.match(line))]
    ends = (_word_ends if language == "ruby" else _brace_ends)(code, [i for _, i in named])
    return [(name, i, end) for (name, i), end in zip(named, ends)]


def _imports(path: str, node: ast.AST) -> Iterator[tuple[str, str]]:
    """(module as written, folder it is looked for from; '' for the root) of an import."""
    if isinstance(node, ast.Import):
        for alias in node.names:
            yield alias.name, ""
    elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
        folder = path.split("/")[:-1]
        base = "/".join(folder[: len(folder) - (node.level - 1)]) if node.level else ""
        if node.module:
            yield node.module, base if node.level else ""
        else:
            for alias in node.names:
                if alias.name != "*":
                    yield alias.name, base


def raw_edges(path: str, code: str, language: str | None) -> list[tuple[str, str, str, str, int]]:
    """(edge type, target kind, target, folder of an import, line) of a file; only definitions if it can't be parsed."""
    out = [("defines", "symbol", name, "", start) for name, start, _ in symbols_of(code, language)]
    if language != "python":
        return out
    try:
        nodes = list(ast.walk(ast.parse(code)))
    except (SyntaxError, ValueError, RecursionError):
        return out
    called = set()
    for node in nodes:
        out += [("imports", "module", module, base, node.lineno) for module, base in _imports(path, node)]
        names = [node.func] if isinstance(node, ast.Call) else node.bases if isinstance(node, ast.ClassDef) else []
        for name in names:
            if isinstance(name, (ast.Name, ast.Attribute)):
                called.add((name.id if isinstance(name, ast.Name) else name.attr, name.lineno if isinstance(name, ast.Name) else name.end_lineno))
    return out + [("references", "symbol", name, "", line) for name, line in sorted(called, key=lambda c: (c[1], c[0]))]


def with_symbols(files: DataFrame) -> DataFrame:
    """files (repo, path, language, code) with symbols."""

    @F.pandas_udf(f"array<struct<{SYMBOLS.replace(' ', ':').replace(',:', ',')}>>")
    def run(code: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("name", "lineno_start", "lineno_end"), s)) for s in symbols_of(c or "", x)] for c, x in zip(code, language)])

    return files.withColumn("symbols", run("code", "language"))


def resolve(imports: DataFrame, listing: DataFrame) -> DataFrame:
    """imports (repo, module, base, and more) with dst_kind and dst: the first file there is of base/a/b.py and base/a/b/__init__.py, else the module as external."""
    stem = F.concat(F.when(F.col("base") != "", F.concat("base", F.lit("/"))).otherwise(F.lit("")), F.replace("module", F.lit("."), F.lit("/")))
    tagged = imports.withColumn("_row", F.monotonically_increasing_id())
    tried = tagged.select("repo", "_row", F.posexplode(F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))).alias("nth", "path"))
    found = tried.join(listing.select("repo", "path").distinct(), ["repo", "path"]).groupBy("_row").agg(F.min_by("path", "nth").alias("_file"))
    named = tagged.join(found, "_row", "left").drop("_row")
    return named.withColumns({"dst_kind": F.when(F.col("_file").isNotNull(), "file").otherwise("external"), "dst": F.coalesce("_file", "module")}).drop("_file")


def edges(files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """All edges of files (repo, path, language, code). Modules are found by a join with the listing (repo, path; files if not given), not on any machine's disk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            rows = [(r.repo, r.path, *e) for r in own.itertuples() for e in raw_edges(r.path, r.code or "", r.language)]
            yield pd.DataFrame(rows, columns=["repo", "path", "edge_type", "kind", "module", "base", "lineno"])

    raw = files.select("repo", "path", "language", "code").mapInPandas(run, "repo string, path string, edge_type string, kind string, module string, base string, lineno int")
    known = raw.where("kind = 'symbol'").withColumns({"dst_kind": F.lit("symbol"), "dst": F.col("module")})
    found = known.unionByName(resolve(raw.where("kind = 'module'"), files if listing is None else listing))
    return found.select("repo", F.lit("file").alias("src_kind"), F.col("path").alias("src"), "dst_kind", "dst", "edge_type", "path", "lineno")


def find_references(edges: DataFrame, symbol: str, limit: int = C.REFS_LIMIT, repo: str | None = None) -> DataFrame:
    """Definitions of a symbol, then references to it, by path and line; of one repository if named."""
    own = edges.where((F.col("dst") == symbol) & F.col("edge_type").isin("defines", "references"))
    if repo is not None:
        own = own.where(F.col("repo") == repo)
    own = own.withColumn("kind", F.when(F.col("edge_type") == "defines", "definition").otherwise("reference"))
    return own.orderBy("kind", "path", "lineno").limit(limit).select("kind", "path", "lineno")


def related(edges: DataFrame, target: str, kind: str, depth: int = 1, most: int = C.BFS_MAX_RESULTS, repo: str | None = None) -> DataFrame:
    """(kind, value, edge_type, depth, via, lineno, place, truncated): what is linked to a node in up to `depth` steps, the first `most`.

    A step joins the few nodes found last with the edges on either end. A node is found once: by the least
    step, then imports before definitions before references (others last), along edges before against them, then by
    names. Nodes outside the repository aren't gone on from. truncated: `most` nodes were found, so there may be more.
    Frontiers are `most` rows at most, so they are part of the plan.
    """
    spark = edges.sparkSession
    edges = edges if repo is None else edges.where(F.col("repo") == repo)
    depth, most = min(max(depth, 1), C.BFS_MAX_DEPTH), min(max(most, 1), C.BFS_MAX_RESULTS)
    schema = "kind string, value string, edge_type string, depth int, via string, lineno int, place long, truncated boolean"
    found, frontier, seen = [], [target], [(kind, target)]
    named = lambda names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    backwards = F.coalesce(F.try_element_at(named(REVERSED), F.col("edge_type")), F.col("edge_type"))
    priority = F.coalesce(F.try_element_at(named(PRIORITY), F.col("edge_type")), F.lit(OTHER_PRIORITY)).alias("prio")
    for step in range(1, depth + 1):
        if not frontier or len(found) >= most:
            break
        ahead = edges.where(F.col("src").isin(frontier)).select(F.col("dst_kind").alias("kind"), F.col("dst").alias("value"), "edge_type", F.col("src").alias("via"), "lineno", F.lit(0).alias("way"), priority)
        behind = edges.where(F.col("dst").isin(frontier)).select(F.col("src_kind").alias("kind"), F.col("src").alias("value"), backwards.alias("edge_type"), F.col("dst").alias("via"), "lineno", F.lit(1).alias("way"), priority)
        known = spark.createDataFrame(seen, "kind string, value string")
        order = ("prio", "way", "via", "lineno", "value")
        new = ahead.union(behind).join(F.broadcast(known), ["kind", "value"], "left_anti")
        first = new.withColumn("_n", F.row_number().over(Window.partitionBy("kind", "value").orderBy(*order))).where("_n = 1")
        rows = first.orderBy(*order, "kind").limit(most - len(found)).collect()  # `most` rows at most
        found += [(r["kind"], r["value"], r["edge_type"], step, r["via"], r["lineno"], len(found) + i + 1) for i, r in enumerate(rows)]
        seen += [(r["kind"], r["value"]) for r in rows]
        frontier = [r["value"] for r in rows if r["kind"] != "external"]
    return spark.createDataFrame([(*row, len(found) >= most) for row in found], schema)


def kind_of(edges: DataFrame, target: str, repo: str | None = None) -> str | None:
    """file, symbol, or None if the graph doesn't have the target."""
    own = edges if repo is None else edges.where(F.col("repo") == repo)
    own = own.where((F.col("src") == target) | (F.col("path") == target) | (F.col("dst") == target))
    hits = own.agg(F.max((F.col("src") == target) | (F.col("path") == target)), F.max((F.col("dst") == target) & (F.col("edge_type") == "defines"))).first()
    return "file" if hits[0] else "symbol" if hits[1] else None


def expand(edges: DataFrame, target: str, depth: int = 1, most: int = C.BFS_MAX_RESULTS, repo: str | None = None) -> dict:
    """The neighbourhood of a node as a caller gets it: target, depth, related, truncated, error."""
    kind, depth = kind_of(edges, target, repo), min(max(depth, 1), C.BFS_MAX_DEPTH)
    rows = [] if kind is None else related(edges, target, kind, depth, most, repo).orderBy("place").collect()
    nodes = [{n: r[n] for n in ("kind", "value", "edge_type", "depth", "via", "lineno")} for r in rows]
    return {"target": {"kind": kind, "value": target}, "depth": depth, "related": nodes, "truncated": bool(rows and rows[0]["truncated"]), "error": None if kind else "target_not_found"}
