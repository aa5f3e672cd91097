"""The stored state of all repositories, and the operations that change it.

A version of the store names, for each table and repository, the folder that holds its rows. A change writes new folders
for one repository and then one more version; readers hold on to the version they began with, and a job that fails
before leaves the old one in place. All is written through Spark, so that any store will do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..sources.repository import Ignore
from . import chunking, graph, hygiene, incremental, retrieval
from .embedding import Embedder, HashEmbedder, embedded

CHUNKS = (
    "id string, repo string, path string, symbol string, lineno_start int, lineno_end int, language string, code string, content_hash string, "
    "indexed_at timestamp, file_mtime timestamp, commit_sha string, last_modified timestamp, last_author string, vector array<float>"
)
SCHEMAS = {
    "chunks": CHUNKS,
    "edges": graph.EDGES,
    "repos": "repo string, path string, last_indexed_at timestamp, chunk_count long",
    "postings": f"repo string, {retrieval.POSTINGS}",
    "totals": f"repo string, {retrieval.TOTALS}",
}
_COLUMNS = [c.split()[0] for c in CHUNKS.split(", ")]
_METADATA = "path string, commit_sha string, last_author string, last_modified timestamp"


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _numbers(self) -> list[int]:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_versions")
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        if not files.exists(path):  # any other failure to look is the caller's
            return []
        done = [f.getPath() for f in files.listStatus(path) if files.exists(context._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def version(self, number: int | None = None) -> dict[tuple[str, str], str]:
        """(table, repository) to folder, of the last version or a given one; as many rows as repositories have tables."""
        numbers = self._numbers()
        if not numbers:
            return {}
        rows = self.spark.read.parquet(f"{self.folder}/_versions/{numbers[-1] if number is None else number:010d}").collect()
        return {(r["table"], r["repo"]): r["path"] for r in rows}

    def read(self, table: str, repo: str | None = None, version: dict | None = None) -> DataFrame:
        """A table, of one repository (None or 'all': of all). No other repository's files are opened."""
        version = self.version() if version is None else version
        paths = [path for (name, owner), path in version.items() if name == table and repo in (None, "all", owner)]
        reader = self.spark.read.schema(SCHEMAS[table])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[table])

    def publish(self, repo: str, tables: dict[str, DataFrame | None]) -> int:
        """Writes tables of a repository (None: without rows) and names them in a new version; gives its number.

        Of two writers that began with the same version, the second one fails.
        """
        numbers, now = self._numbers(), self.version()
        for name, df in tables.items():
            path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
            if df is None:
                now.pop((name, repo), None)
                continue
            columns = [c.strip().split()[0] for c in SCHEMAS[name].split(", ")]
            df = df.select(*columns)
            if name == "postings":  # a search opens the parts that have its terms
                df = df.repartitionByRange("term").sortWithinPartitions("term", "id")
            df.write.parquet(path)
            now[name, repo] = path
        number = numbers[-1] + 1 if numbers else 0
        rows = self.spark.createDataFrame([(t, r, p) for (t, r), p in now.items()], "table string, repo string, path string")
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/_versions/{number:010d}")
        return number


def prepared(files: DataFrame, root: str = "", rules: hygiene.Rules = hygiene.Rules(), ignore: Ignore | None = None) -> tuple[DataFrame, DataFrame]:
    """The files (repo, path, language, code and more) that stay, and all of them with their reasons."""
    extra = Ignore.globs(rules.extra_exclude_globs).column(F.col("path")) if rules.extra_exclude_globs else None
    found = hygiene.judged(files, rules, None if ignore is None or not ignore.rules else ignore.column(F.col("path")), extra)
    return found.where("reason is null").drop("reason"), found


def cut(files: DataFrame, metadata: DataFrame | None = None, now=None) -> DataFrame:
    """The chunks of files, with what is known of each file's last commit, without vectors."""
    chunks = chunking.windows(graph.with_symbols(files))
    metadata = files.sparkSession.createDataFrame([], _METADATA) if metadata is None else metadata
    at = F.current_timestamp() if now is None else F.lit(now)
    mtime = F.col("mtime") if "mtime" in files.columns else F.lit(None).cast("timestamp")
    chunks = chunks.withColumns({"indexed_at": at, "file_mtime": F.coalesce(mtime, at)})
    chunks = chunks.join(metadata, "path", "left").withColumn("commit_sha", F.coalesce("commit_sha", F.lit("")))
    return chunks.select(*[c for c in _COLUMNS if c != "vector"])


def reindexed(existing: DataFrame, current: DataFrame, model: Embedder, dimension: int | None = C.EMBEDDING_DIM, keep: bool = False) -> DataFrame:
    """The chunks after indexing: unchanged ones as they were, new and changed ones embedded, others gone (unless keep)."""
    new = incremental.changed(current, existing)
    same = current.join(new.select("id"), "id", "left_anti")
    whole = same.withColumn("vector", F.lit(None).cast("array<float>")).unionByName(new.withColumn("vector", embedded(F.col("code"), model, dimension)))
    return incremental.upsert(existing.select(*_COLUMNS), whole.select(*_COLUMNS), keep=keep).select(*_COLUMNS)


def index_repo(store: Store, repo: str, files: DataFrame, root: str = "", rules: hygiene.Rules = hygiene.Rules(), ignore: Ignore | None = None, metadata: DataFrame | None = None, model: Embedder | None = None, dimension: int | None = C.EMBEDDING_DIM, sample: str | None = None, now=None, log_folder: str | None = None) -> dict:
    """Brings a repository up to date with its files: chunks by difference, edges whole, postings and totals of the chunks, the catalog.

    sample: only paths that begin with it are looked at; what is there of others stays, and nothing is dropped. Gives
    the number of chunks, how many were embedded, and the reasons for files that were left out.
    """
    model = model or HashEmbedder(dimension or C.EMBEDDING_DIM)
    before = store.version()
    existing = store.read("chunks", repo, before)
    own = files if sample is None else files.where(F.col("path").startswith(sample))
    kept, found = prepared(own, root, rules, ignore)
    if log_folder:
        hygiene.warn_secrets([r["path"] for r in hygiene.secret_hits(found).toLocalIterator()], log_folder)
    reasons = {r["reason"]: r["n"] for r in found.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    current = cut(kept, metadata, now)
    chunks = reindexed(existing, current, model, dimension, keep=sample is not None)
    edges = graph.edges(kept)
    if sample is not None:  # only files that have edges now lose their old ones
        edges = edges.unionByName(incremental.without_paths(store.read("edges", repo, before), edges.select("repo", "path")))
    embedded_now = incremental.changed(current, existing).count()
    _publish(store, repo, chunks, edges, root, now)
    count = store.read("repos", repo).first()["chunk_count"]
    return {"chunks": count, "embedded": embedded_now, "reasons": reasons}


def _publish(store: Store, repo: str, chunks: DataFrame, edges: DataFrame, root: str, now) -> None:
    """Writes the chunks first, and what is derived from them from what was written."""
    path = f"{store.folder}/chunks/{uuid.uuid4().hex}"
    chunks.write.parquet(path)
    written = store.spark.read.schema(CHUNKS).parquet(path)
    postings = retrieval.postings(written).withColumn("repo", F.lit(repo))
    at = F.current_timestamp() if now is None else F.lit(now)
    catalog = written.agg(F.count(F.lit(1)).alias("chunk_count")).select(F.lit(repo).alias("repo"), F.lit(root).alias("path"), at.alias("last_indexed_at"), "chunk_count")
    store.publish(repo, {"chunks": written, "edges": edges, "postings": postings, "totals": retrieval.totals(written).withColumn("repo", F.lit(repo)), "repos": catalog})


def after_events(chunks: DataFrame, edges: DataFrame, events: DataFrame, files: DataFrame, model: Embedder, dimension: int | None = C.EMBEDDING_DIM, rules: hygiene.Rules = hygiene.Rules(), ignore: Ignore | None = None, metadata: DataFrame | None = None, now=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, edges, touched) of a repository after a batch of coalesced events (repo, path, kind).

    files: those of the events' paths that are there (repo, path, language, code ...). Deleted paths, and created or
    modified ones that aren't there any more, lose all rows. Of the others, what the rules leave out and what has
    no chunks stays as it was; the rest is cut again, and where a chunk was added, changed or dropped, its edges are made
    anew. touched (repo, path, changed, deleted): which paths lost, won or changed a chunk.
    """
    named = events.select("repo", "path", "kind").distinct()
    there = files.join(named.where("kind <> 'deleted'"), ["repo", "path"], "left_semi")
    of_path = hygiene.path_reason(F.col("path"), None if ignore is None or not ignore.rules or not rules.respect_gitignore else ignore.column(F.col("path")), Ignore.globs(rules.extra_exclude_globs).column(F.col("path")) if rules.extra_exclude_globs else None, rules.extra_exclude_dirs)
    watched = named.where((F.col("kind") == "deleted") | of_path.isNull())  # the path rules come before whether a file is there
    gone = watched.join(there.select("repo", "path"), ["repo", "path"], "left_anti").select("repo", "path")
    kept, _ = prepared(there, "", rules, ignore)
    current = cut(kept, metadata, now)
    again = current.select("repo", "path").distinct()
    old = chunks.join(again, ["repo", "path"], "left_semi")
    new, dropped = incremental.changed(current, old), incremental.stale(current, old)
    changed = new.select("repo", "path").union(dropped.select("repo", "path")).distinct()
    lost = chunks.join(gone, ["repo", "path"], "left_semi").select("repo", "path").distinct()
    stay = chunks.join(gone.union(again), ["repo", "path"], "left_anti")
    state = stay.unionByName(reindexed(old, current, model, dimension))
    links = incremental.without_paths(edges, gone.union(changed)).unionByName(graph.edges(kept.join(changed, ["repo", "path"], "left_semi"), files.select("repo", "path").union(chunks.select("repo", "path"))))
    flag = lambda df, deleted: df.select("repo", "path", F.lit(True).alias("changed"), F.lit(deleted).alias("deleted"))
    return state, links, flag(lost, True).union(flag(changed, False))


def apply_events(store: Store, repo: str, events: DataFrame, files: DataFrame, model: Embedder | None = None, dimension: int | None = C.EMBEDDING_DIM, now=None, root: str | None = None, **more) -> bool:
    """Applies a batch of coalesced events to the store, as one new version; gives whether anything changed (else none is written)."""
    before = store.version()
    chunks, edges = store.read("chunks", repo, before), store.read("edges", repo, before)
    state, links, touched = after_events(chunks, edges, events.where(F.col("repo") == repo), files, model or HashEmbedder(dimension or C.EMBEDDING_DIM), dimension, now=now, **more)
    if touched.isEmpty():
        return False
    catalog = store.read("repos", repo, before).first()
    _publish(store, repo, state, links, root or (catalog["path"] if catalog else ""), now)
    return True
