"""Near-duplicates by SimHash, searched with vantage-point trees.

A fingerprint's bit is 1 if it is set in over half the hashes of a text's shingles. Equal fingerprints are one
point. A vantage-point tree, grown on the driver from a sample of the points, parts them by their Hamming distance
from a chosen one: those within its radius, and those beyond it. By the triangle bound two points on different
sides can only be neighbours if the inner one is less than the linking distance from the border; such points go to
both sides, so every pair of neighbours meets in some leaf. Leaves are the shards; one that still has too many points
gets a tree of its own, until all are small enough. In each the same parting goes on in memory until few points are
left, which are compared all with all, and what comes out is one edge for each point that isn't the first of its
group, not the pairs. (Points that no tree parts, all close to one another, are dealt out to pairs of blocks; there
are at most 43,745 points within DISTANCE of any.) Components are found from the edges.

Null and empty texts have fingerprint zero and are linked like any other. Rows whose id is null are left out. Repeated
rows give repeated results, rows that share an id each have the fingerprint of their own text, and an empty table gives
an empty one. Long texts are hashed piece by piece. fingerprints() replaces a column named like its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: How many points a shard has at most, how many it should have as long as there are no more shards than partitions, and points of a sample for each shard.
MOST, SHARD, EACH = 500_000, 20_000, 24
#: Points of all samples of a round together, at least and at most (16 MB on the driver).
LEAST_SAMPLE, SAMPLE = 20_000, 2_000_000
#: Points that are compared all with all, and steps of parting below which a leaf isn't worth another.
FEW = 256
#: A point is parted from the sample's this often at most.
DEPTH = 48


def fingerprint_of(data: bytes, shingle: int = SHINGLE) -> int:
    words = data.lower().split()
    if not words:
        return 0
    digest, ones, step = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 1 << 16
    total = max(1, len(words) - shingle + 1)
    for start in range(0, total, step):
        own = words[start : start + step + shingle - 1]
        parts = [b" ".join(p) for p in zip(*(own[i:] for i in range(shingle)))] or [b" ".join(own)]
        hashes = np.array([digest(p, SEED) for p in parts], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", output: str = "fingerprint") -> DataFrame:
    """docs without text, with its fingerprint (a long with the same bits)."""
    docs, names, schema = common.reduced(docs, [text], {output: "long"}, last=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.chunks(batches, len(names)):
            found = np.array([fingerprint_of(t) if t else 0 for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*names, output])

    return docs.mapInArrow(run, schema)


def _distances(points: np.ndarray, to: int | np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(to))


def _vantage(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A point and a radius that part these points well: few of them near the border for what is gained. None if nothing is."""
    best = None
    for i in {0, len(points) // 3, 2 * len(points) // 3}:
        share = np.cumsum(np.bincount(_distances(points, points[i]), minlength=65)) / len(points)
        for radius in range(65):
            inner = share[radius]
            if not 0 < inner < 1:
                continue
            near = inner - (share[radius - DISTANCE] if radius >= DISTANCE else 0)
            bits = -(inner * np.log2(inner) + (1 - inner) * np.log2(1 - inner))
            price = (np.log2(1 + near) + 1e-3) / bits
            if inner > 0.02 and 1 - inner + near < 0.98 and (best is None or price < best[0]):
                best = (price, points[i], radius)
    return best and (best[1], int(best[2]))


class Tree:
    """Inner nodes as rows (vantage point, radius, node within, node beyond); a negative node is leaf -1 - node."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list[list] = []
        self.leaves = 0
        self.root = self._grow(np.unique(sample), max(1, len(sample) // max(1, shards)), 0)

    def _grow(self, points: np.ndarray, enough: int, depth: int) -> int:
        found = _vantage(points) if len(points) > max(enough, 16) and depth < DEPTH else None
        if found is None:
            self.leaves += 1
            return -self.leaves
        at = len(self.nodes)
        self.nodes.append([found[0], found[1], 0, 0])
        far = _distances(points, found[0])
        self.nodes[at][2] = self._grow(points[far <= found[1]], enough, depth + 1)
        self.nodes[at][3] = self._grow(points[far > found[1] - DISTANCE], enough, depth + 1)
        return at

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The indices of the points that go to each leaf; together they hold each pair of neighbours at least once."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                yield -1 - node, own
                continue
            vantage, radius, within, beyond = self.nodes[node]
            far = _distances(points[own], vantage)
            todo += [(within, own[far <= radius]), (beyond, own[far > radius - DISTANCE])]


def _near(points: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of neighbours between two sets, compared block by block."""
    for a in range(0, len(left), 512):
        x = left[a : a + 512]
        for b in range(0, len(right), 4096):
            y = right[b : b + 4096]
            i, j = np.nonzero(np.bitwise_count(points[x][:, None] ^ points[y][None, :]) <= DISTANCE)
            yield x[i], y[j]


class _Groups:
    """Which points are linked, kept as a forest."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        for x, y in pairs:
            real = x != y
            for i, j in zip(x[real].tolist(), y[real].tolist()):
                i, j = self.top(i), self.top(j)
                if i != j:
                    self.up[max(i, j)] = min(i, j)


def link(points: np.ndarray, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that link the same groups as all pairs of neighbours do: among points, or between points and others."""
    if others is not None:
        both = np.concatenate([points, others])
        groups = _Groups(len(both))
        groups.link(_near(both, np.arange(len(points)), np.arange(len(points), len(both))))
        points = both
    else:
        groups, todo = _Groups(len(points)), [(np.arange(len(points)), 0)]
        while todo:
            own, depth = todo.pop()
            found = _vantage(points[own]) if len(own) > FEW and depth < DEPTH else None
            if found is None:
                groups.link(_near(points, own, own))
                continue
            far = _distances(points[own], found[0])
            todo += [(own[far <= found[1]], depth + 1), (own[far > found[1] - DISTANCE], depth + 1)]
    tops = np.array([groups.top(i) for i in range(len(points))], np.int64)
    moved = np.flatnonzero(tops != np.arange(len(points)))
    return points[moved], points[tops[moved]]


def _sampled(routed: DataFrame, leaves: DataFrame, total: int, shards: dict[int, int]) -> dict[int, Tree]:
    """A tree for each of the leaves (leaf), which have `total` points, from a sample of theirs: those of least hash."""
    wanted = min(SAMPLE, max(LEAST_SAMPLE, EACH * sum(shards.values())))
    share = min(1.0, wanted / max(1, total))
    own = routed.join(F.broadcast(leaves), "leaf").where(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).toPandas()
    return {leaf: Tree(part["fp"].to_numpy(np.int64).view(np.uint64), shards[leaf]) for leaf, part in own.groupby("leaf")}


def edges(points: DataFrame) -> DataFrame:
    """Edges (a, b: fingerprints as longs) that link the same groups as all pairs of neighbours among points (fp: long, distinct).

    To the driver come samples of SAMPLE points a round at most, and a row for each leaf (a MOST-th of the points, or more
    as long as there are no more of them than shuffle partitions).
    """
    spark = points.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = points.select(F.lit(0).cast("long").alias("leaf"), "fp")
    sizes, done, size = {0: points.count()}, [], None
    while sizes:
        # leaves to part, and how many shards each should give
        total = sum(sizes.values())
        size = size or (max(MOST // 2, 1) if total > parts * SHARD else SHARD)
        shards = {leaf: max(1, round(n / size)) for leaf, n in sizes.items()}
        leaves = spark.createDataFrame([(leaf,) for leaf in sizes], "leaf long")
        trees = spark.sparkContext.broadcast(_sampled(routed, leaves, total, shards))
        base = {leaf: k for leaf, k in zip(trees.value, np.cumsum([0, *(t.leaves for t in trees.value.values())]).tolist())}

        def route(batches: Iterator[pa.RecordBatch], trees=trees, base=base) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
                for name in np.unique(leaf).tolist():
                    own = fps[leaf == name]
                    for k, which in trees.value[name].route(own) if name in trees.value else ():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), base[name] + k)), pa.array(own[which].view(np.int64))], ["leaf", "fp"])

        before = total
        routed = common.durable(routed.join(F.broadcast(leaves), "leaf").mapInArrow(route, "leaf long, fp long"))
        found = {r["leaf"]: r["n"] for r in routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
        sizes = {leaf: n for leaf, n in found.items() if n > MOST}
        small = spark.createDataFrame([(leaf,) for leaf in found if leaf not in sizes], "leaf long")
        done.append(routed.join(F.broadcast(small), "leaf").select(F.lit(len(done)).alias("round"), "leaf", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("own"), "fp"))
        if len(found) == 1 and sizes and sum(sizes.values()) >= before:  # nothing parts them: pairs of blocks
            blocks = -(-max(sizes.values()) // max(1, MOST // 2))
            own = F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int")
            pair = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least("own", k).alias("x"), F.greatest("own", k).alias("y")))
            dealt = routed.withColumn("own", own).withColumn("pair", F.explode(pair))
            done.append(dealt.select(F.lit(len(done)).alias("round"), "leaf", "pair.x", "pair.y", "own", "fp"))
            sizes = {}

    def search(own: pd.DataFrame) -> pd.DataFrame:
        fps, block = own["fp"].to_numpy(np.int64).view(np.uint64), own["own"].to_numpy()
        if own["x"].iat[0] == own["y"].iat[0]:
            a, b = link(fps)
        else:
            first = block == own["x"].iat[0]
            a, b = link(fps[first], fps[~first])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    keys = ("round", "leaf", "x", "y")
    return out.repartition(parts, *keys).groupBy(*keys).applyInPandas(search, "a long, b long")  # dealt out by number: shards are small but take long


def _grouped(prints: DataFrame) -> DataFrame:
    """prints (doc_id, fp, and more) with component_id, by components of the fingerprints: the smallest id of any of its rows."""
    points = common.durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = connected(edges(points.select("fp"))).withColumnsRenamed({"node": "fp", "component": "group"})
    named = common.durable(points.join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp")))
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    return prints.join(common.durable(named.join(least, "group").select("fp", "component_id", "group")), "fp")


def _read(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    return fingerprints(own.where(F.col("doc_id").isNotNull()), output="fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as a long, component_id) of every row: component_id is the smallest id that links lead to.

    The fingerprints are written once to the shared checkpoint folder; texts are read once and never shuffled. Rows that
    share an id are linked only if their fingerprints are.
    """
    prints = common.durable(_read(docs, doc_id, text).drop("hash"))
    return _grouped(prints).select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """The query: every document's fingerprint and component."""
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs of each component: the one with the smallest id, of rows that share it the one whose text has the
    least hash, of those with the same text the first by its other columns as JSON. Rows without an id stay."""
    prints = common.durable(_read(docs, doc_id, text))
    firsts = _grouped(prints).groupBy("group").agg(F.min(F.struct("doc_id", "hash")).alias("first")).select("first.doc_id", "first.hash")
    names = docs.columns
    numbered = docs.toDF(*[f"c{k}" for k in range(len(names))])
    own, body = F.col(f"c{names.index(doc_id)}"), F.col(f"c{names.index(text)}")
    keyed = numbered.where(own.isNotNull()).withColumns({"doc_id": own.cast("long"), "hash": F.xxhash64(body)})
    kept = keyed.join(common.durable(firsts), ["doc_id", "hash"], "left_semi")
    others = [c for c in numbered.columns if c != f"c{names.index(text)}"]
    whole = kept.groupBy("doc_id", "hash").agg(F.min_by(F.struct(*numbered.columns), F.to_json(F.struct(*others))).alias("row")).select("row.*")
    return whole.unionByName(numbered.where(own.isNull())).toDF(*names)
