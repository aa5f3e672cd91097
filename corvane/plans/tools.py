"""What a caller asks for: each tool resolves the repository, runs its plan, writes a record of the call and gives plain values."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators import evaluate, graph, hygiene, lines, retrieval, stats
from ..operators.embedding import Embedder, HashEmbedder
from ..operators.store import Store, apply_events, index_repo
from ..sources import query_log, repository
from ..streaming import events as streams
from ..streaming import folder as folders
from . import policy


class Tools:
    """The tools over a store, for the repositories of the settings (name, path, languages)."""

    def __init__(self, spark: SparkSession, settings: dict, store: Store, log_folder: str, model: Embedder | None = None, rerank=None, connection_repo: str | None = None, environment_repo: str | None = None):
        self.spark, self.settings, self.store, self.log_folder = spark, settings, store, log_folder
        self.repos = {r["name"]: r for r in settings.get("repos") or []}
        self.dimension = (settings.get("embedding") or {}).get("dimension", C.EMBEDDING_DIM)
        self.model, self.rerank = model or HashEmbedder(self.dimension), rerank
        self.connection_repo, self.environment_repo = connection_repo, environment_repo

    # ------------------------------------------------------------------ what all share

    def _repo(self, repo: str | None) -> str:
        return policy.resolve_repo(list(self.repos), repo, self.connection_repo, self.environment_repo)

    def _call(self, tool: str, args: dict, run: Callable[[str], tuple[object, dict]], denied: Callable[[dict], object], repo: str | None):
        """Runs a tool for the repository asked for; what goes wrong with the repository is an answer, all else is raised. Both are logged."""
        began, error, more = time.perf_counter(), None, {}
        try:
            try:
                name = self._repo(repo)
            except policy.RepoError as e:
                error = str(e)
                return denied({"error": error, "available_repos": e.available})
            answer, more = run(name)
            error = more.pop("error", None)
            return answer
        except Exception as e:
            error = str(e)
            raise
        finally:
            query_log.append(self.log_folder, tool, args, (time.perf_counter() - began) * 1000, error=error, **more)

    def _files(self, repo: str, paths: list[str] | None = None) -> DataFrame:
        """Files of a repository, or of all; paths are whole paths."""
        out = None
        for name, r in self.repos.items():
            if repo in (name, "all"):
                own = None if paths is None else self.spark.createDataFrame([(os.path.relpath(p, r["path"]),) for p in paths], "path string")
                found = repository.scan(self.spark, name, r["path"], paths=own)
                found = found.withColumn("path", F.concat(F.lit(r["path"].rstrip("/") + "/"), "path"))
                out = found if out is None else out.unionByName(found)
        return out

    def _inside(self, path: str, repo: str) -> str | None:
        """A path, taken to be in the repository if it isn't whole, if it is inside a configured one; links followed."""
        if not os.path.isabs(path) and repo in self.repos:
            path = os.path.join(self.repos[repo]["path"], path)
        return policy.within(path, [r["path"] for r in self.repos.values()])

    # ------------------------------------------------------------------ search

    def _search(self, query: str, repo: str, k: int, lang, path_glob, modified_since, author) -> dict[str, DataFrame]:
        version = self.store.version()
        read = lambda table, name=repo: self.store.read(table, name, version)
        where = None
        since = T.parse_since(modified_since) if modified_since else None
        if lang or path_glob or since or author:
            where = retrieval.filters(lang, path_glob, since, author)
        vector = self.model([query])[0]
        chunks = read("chunks")
        index, scope = read("postings", "all"), None if repo == "all" else repo  # counts are those of all repositories
        return retrieval.hybrid(chunks, index, read("totals", "all"), chunks.select("id", "repo", "vector"), query, vector, k, where, scope, self.rerank)

    @staticmethod
    def _hits(final: DataFrame, chunks: DataFrame) -> list[dict]:
        names = ["path", "symbol", "lineno_start", "lineno_end", "language", "code", "score", "suggested_ranges", "file_role", "is_test", "is_doc", "is_config", "context_trust"]
        rows = retrieval.present(final, chunks).orderBy("place").select("place", *names).collect()  # k at most
        return [{n: [x.asDict() for x in r[n]] if n == "suggested_ranges" else r[n] for n in names} for r in rows]

    def search_code(self, query: str, repo: str | None = None, k: int = C.FINAL, lang: str | None = None, path_glob: str | None = None, modified_since: str | None = None, author: str | None = None) -> list[dict]:
        args = {"query": query, "repo": repo, "k": k, "lang": lang, "path_glob": path_glob, "modified_since": modified_since, "author": author}

        def run(name: str):
            found = self._search(query, name, k, lang, path_glob, modified_since, author)
            hits = self._hits(found["final"], found["candidates"])
            return hits, {"paths": [f"{h['path']}:{h['lineno_start']}-{h['lineno_end']}" for h in hits], "scores": [h["score"] for h in hits]}

        return self._call("search_code", args, run, lambda payload: [payload], repo)

    def search_code_debug(self, query: str, repo: str | None = None, k: int = C.FINAL, lang: str | None = None, path_glob: str | None = None, modified_since: str | None = None, author: str | None = None) -> dict:
        """The same ranking, with what each stage gave."""
        args = {"query": query, "repo": repo, "k": k, "lang": lang, "path_glob": path_glob, "modified_since": modified_since, "author": author}

        def run(name: str):
            found = self._search(query, name, k, lang, path_glob, modified_since, author)
            hits = self._hits(found["final"], found["candidates"])
            named = found["candidates"].select("id", "path", "symbol")

            def stage(key: str, order: str, **columns) -> list[dict]:
                own = found[key]
                own = own if "path" in own.columns else own.join(named, "id", "left")
                values = [F.col(order).alias("rank"), "id", "path", *[c.alias(n) for n, c in columns.items()]]
                return [r.asDict() for r in own.select(*values).orderBy("rank").collect()]

            debug = {
                "query": query,
                "preprocessed_query": T.expand_query(query),
                "vector": stage("vector", "rank", cosine=F.round("score", 4)),
                "bm25": stage("lexical", "rank", bm25=F.round("score", 4)),
                "rrf": stage("fused", "position", rrf_score=F.round("rrf", 5), vector_rank=F.col("vector_rank"), bm25_rank=F.col("lexical_rank")),
                "final": stage("final", "place", score=F.round("score", 4)),
            }
            if "rerank" in found and len(debug["rrf"]) > 1:
                debug["rerank"] = stage("rerank", "rank", score=F.round("score", 4))
                debug["diversity_dropped"] = [{"id": r["id"], "path": r["path"], "reason": r["reason"]} for r in found["dropped"].orderBy("rank").collect()]
                guard = found["guard"].first()
                debug["consensus_guard"] = {"injected": False} if guard is None else {"injected": True, "id": guard["id"], "path": guard["path"]}
            more = {"paths": [f"{h['path']}:{h['lineno_start']}-{h['lineno_end']}" for h in hits], "scores": [h["score"] for h in hits]}
            return {"hits": hits, "debug": debug, "context_trust": C.TRUST}, more

        return self._call("search_code_debug", args, run, lambda payload: {"hits": [], "debug": {}, "error": payload, "context_trust": C.TRUST}, repo)

    # ------------------------------------------------------------------ files

    def grep_code(self, pattern: str, repo: str | None = None, path_glob: str | None = None, max_results: int = C.GREP_LIMIT) -> list[dict]:
        args = {"pattern": pattern, "repo": repo, "path_glob": path_glob, "max_results": max_results}

        def run(name: str):
            try:
                rows = lines.grep(self._files(name).where("code is not null"), pattern, path_glob, max_results).collect()
            except ValueError as e:
                return [{"error": str(e), "context_trust": C.TRUST}], {"error": str(e)}
            found = [r.asDict() for r in rows]
            return [{**r, "context_trust": C.TRUST} for r in found], {"paths": [r["path"] for r in found]}

        return self._call("grep_code", args, run, lambda payload: [payload], repo)

    def get_file_range(self, path: str, start: int, end: int, repo: str | None = None) -> dict:
        args = {"path": path, "start": start, "end": end, "repo": repo}

        def run(name: str):
            whole, bad = self._inside(path, name), policy.line_range_error(start, end)
            content, error = "", None
            if bad:
                content, error = f"Access denied: {bad}", "invalid_range"
            elif whole is None:
                content, error = f"Access denied: path outside configured repos: {path}", "path_outside_repos"
            elif not os.path.exists(whole):
                content, error = f"File not found: {path}", "not_found"
            elif os.path.getsize(whole) > C.RANGE_MAX_BYTES:
                content, error = f"Access denied: file too large (max {C.RANGE_MAX_BYTES >> 20}MB)", "file_too_large"
            else:
                own = next(n for n, r in self.repos.items() if policy.within(whole, [r["path"]]))
                row = lines.line_range(self._files(own, [whole]), start, end).first()
                if row is None or (row["content"] is None and row["error"] is None):
                    content, error = f"Error reading file: {path}", "read_error"
                elif row["error"]:
                    hit = self._files(own, [whole]).select(hygiene.secret_pattern(F.col("code"))).first()[0]
                    content, error = f"Access denied: secret pattern detected ({hit})", "secret_detected"
                else:
                    content = row["content"]
            return {"content": content, "error": error, "context_trust": C.TRUST}, {"error": error}

        return self._call("get_file_range", args, run, lambda payload: {"content": "", "error": payload, "context_trust": C.TRUST}, repo)

    def list_symbols(self, path: str, repo: str | None = None) -> list[dict]:
        def run(name: str):
            whole = self._inside(path, name)
            if whole is None:
                return [{"error": f"Access denied: path outside configured repos: {path}"}], {"error": "path_outside_repos"}
            if not os.path.exists(whole):
                return [{"error": f"File not found: {path}"}], {"error": "not_found"}
            if os.path.splitext(whole)[1].lower() not in C.LANGUAGES:
                return [{"error": f"Unsupported language for: {path}"}], {"error": "unsupported_lang"}
            own = next(n for n, r in self.repos.items() if policy.within(whole, [r["path"]]))
            rows = lines.symbols(self._files(own, [whole])).select("name", "lineno_start", "lineno_end").collect()
            return [r.asDict() for r in rows], {}

        return self._call("list_symbols", {"path": path, "repo": repo}, run, lambda payload: [payload], repo)

    # ------------------------------------------------------------------ graph

    def find_references(self, symbol: str, repo: str | None = None) -> list[dict]:
        """From the graph; where that has nothing, lines with the word, marked as approximate."""

        def run(name: str):
            try:
                rows = [r.asDict() for r in graph.find_references(self.store.read("edges", name), symbol).collect()]
            except Exception as e:  # a graph that can't be read is one that has nothing
                rows, error = [], str(e)
            else:
                error = None
            if rows:
                return [{**r, "approximate": False, "context_trust": C.TRUST} for r in rows], {"paths": [r["path"] for r in rows]}
            found = self.grep_code(rf"\b{re.escape(symbol)}\b", name, max_results=C.REFS_LIMIT)
            return [{**r, "kind": "reference", "approximate": True} for r in found], {"paths": [r["path"] for r in found if "path" in r], "error": error}

        return self._call("find_references", {"symbol": symbol, "repo": repo}, run, lambda payload: [payload], repo)

    def related_code(self, target: str, repo: str | None = None, depth: int = 1, max_results: int = C.BFS_MAX_RESULTS) -> dict:
        args = {"target": target, "repo": repo, "depth": depth, "max_results": max_results}

        def run(name: str):
            kind, whole = policy.target_kind(target), self._inside(target, name)
            if whole is not None and os.path.exists(whole):
                asked, error = os.path.relpath(whole, self.repos[name]["path"]) if name in self.repos else whole, None
            elif kind == "path" or os.path.isabs(target):
                asked, error = None, "path_outside_repos" if whole is None else "target_not_found"
            else:
                asked, error = target, None if kind else "invalid_target"
            if error:
                out = {"target": {"kind": "file" if kind == "path" else None, "value": target}, "depth": depth, "related": [], "truncated": False, "error": error}
            else:
                out = graph.expand(self.store.read("edges", name), asked, depth, max_results)
            files = [str(r["value"]) for r in out["related"] if r["kind"] == "file"]
            return {**out, "context_trust": C.TRUST}, {"paths": files, "error": out["error"]}

        denied = lambda payload: {"target": {"kind": None, "value": target}, "depth": depth, "related": [], "truncated": False, "error": payload, "context_trust": C.TRUST}
        return self._call("related_code", args, run, denied, repo)

    # ------------------------------------------------------------------ catalog and log

    def _logged(self, tool: str, args: dict, run: Callable[[], object]):
        began = time.perf_counter()
        try:
            return run()
        finally:
            query_log.append(self.log_folder, tool, args, (time.perf_counter() - began) * 1000)

    def list_repos(self) -> list[dict]:
        """The configured repositories with what is indexed of them; 0 chunks of those that aren't."""

        def run():
            known = {r["repo"]: r for r in self.store.read("repos").collect()}  # a row for each repository
            out = []
            for name, r in self.repos.items():
                own = {"name": name, "path": r["path"], "languages": r.get("languages", []), "chunk_count": known[name]["chunk_count"] if name in known else 0}
                out.append(own | ({"last_indexed_at": known[name]["last_indexed_at"].isoformat()} if name in known and known[name]["last_indexed_at"] else {}))
            return out

        return self._logged("list_repos", {}, run)

    def stats(self, days: int = 7) -> dict:
        return self._logged("stats", {"days": days}, lambda: stats.summary(query_log.read(self.spark, self.log_folder, days), days))

    # ------------------------------------------------------------------ indexing

    def _root(self, repo: str) -> str:
        return os.path.realpath(os.path.expanduser(self.repos[repo]["path"]))

    def index(self, repo: str, sample: str | None = None, wait: bool = True) -> dict | None:
        """Indexes a repository; None if another writer has it and wait is off."""
        root = self._root(repo)
        rules = hygiene.Rules.of(self.settings.get("hygiene"))
        with policy.repo_lock(os.path.join(self.log_folder, "locks"), repo, wait) as mine:
            if not mine:
                return None
            files = repository.scan(self.spark, repo, root)
            metadata = repository.git_metadata(self.spark, root)
            ignore = repository.Ignore.load(root) if rules.respect_gitignore else None
            return index_repo(self.store, repo, files, root, rules, ignore, metadata, self.model, self.dimension, sample, log_folder=self.log_folder)

    def admin_reindex(self, body: dict) -> tuple[int, dict]:
        """(status, answer) of a request to index a repository: 400 without one, 404 for one that isn't configured, 500 if it fails."""
        repo = (body or {}).get("repo")
        if not repo:
            return 400, {"ok": False, "error": "missing repo"}
        if repo not in self.repos:
            return 404, {"ok": False, "error": f"repo '{repo}' not in config"}
        try:
            found = self._logged("admin_reindex", {"repo": repo, "commit_sha": body.get("commit_sha")}, lambda: self.index(repo))
        except Exception as e:
            return 500, {"ok": False, "error": str(e)}
        return 200, {"ok": True, "repo": repo, "chunks": found["chunks"]}

    def apply(self, repo: str, events: DataFrame) -> bool:
        """Applies coalesced events of a repository to the store."""
        root = self._root(repo)
        rules = hygiene.Rules.of(self.settings.get("hygiene"))
        paths = events.where("kind <> 'deleted'").select("path").distinct()
        files = repository.scan(self.spark, repo, root, paths=paths)
        ignore = repository.Ignore.load(root) if rules.respect_gitignore else None
        return apply_events(self.store, repo, events, files, self.model, self.dimension, root=root, rules=rules, ignore=ignore, metadata=repository.git_metadata(self.spark, root))

    def watch(self, repo: str, checkpoint: str, interval: str = "1 second"):
        """A stream that keeps a repository's rows up to date with its folder; stop() ends it."""
        changes = folders.watch(self.spark, repo, self._root(repo), f"{checkpoint.rstrip('/')}.listing")
        return streams.follow(changes, lambda batch, _: self.apply(repo, batch), checkpoint, interval)


def compare_models(make: Callable[[str, Embedder], Tools], models: dict[str, Embedder], repo: str, questions: list[dict], folder: str, sample: str | None = None) -> list[dict]:
    """Indexes a repository with each model, asks all questions, and writes the runs side by side; the first model is the baseline.

    make(alias, model) gives tools over a store of the model's own.
    """
    results = []
    for name, model in models.items():
        alias = re.sub(r"[^A-Za-z0-9]+", "_", name.split("/")[-1])
        tools = make(alias, model)
        tools.index(repo, sample)
        results.append({"model": name, "alias": alias, **evaluate.run(questions, lambda query, k, tools=tools: tools.search_code(query, repo, k))})
    evaluate.write_comparison(folder, results)
    return results
