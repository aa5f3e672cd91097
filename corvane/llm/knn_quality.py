"""Quality by nearest-neighbour voting over latent-semantic vectors.

Features are words and word shapes (letters and digits by kind, runs drawn together), and for a word that repeats
the one before it only that it does, hashed into a fixed number of buckets; their weights are logarithmic counts times the inverse
document frequency over all documents. The leading directions of a bounded sample of labelled documents make
the latent space. The sample's vectors are broadcast; every document is compared with all of them in blocks, and
its NEIGHBOURS nearest vote, each with its cosine. The score is the share of votes for label 1.

The sample takes at most `most` labelled documents (SAMPLE of them in the query), those whose hashed ids come first; the
rest of the training labels isn't used. A document with several labels has the least, of texts that share an id that
with the least hash is learned from. Null and empty texts have a zero vector: all labelled documents are then as near,
and the share of label 1 among them is the score. With no labels every score is 0.5. Neighbours that are equally near
(to six places) are taken in the sample's order, that of ids. Repeated rows are scored as often as they are there, an
empty table gives an empty one. Words and texts of any length are taken whole; a long text's features are added up
piece by piece. A column named score is replaced, others are passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 13
#: Labelled documents that are learned from, at most.
SAMPLE = 3000
DIMENSIONS = 48
NEIGHBOURS = 15
#: From this share of votes on, label 1 is predicted.
LEAST = 0.3
#: Distinct words a worker remembers the features of.
MEMORY = 300_000

_KINDS = bytes.maketrans(bytes(range(256)), bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)))
_runs = re.compile(rb"(.)\1+", re.S)


class Features(dict):
    """The two buckets of each word, of the last ones met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        shape = _runs.sub(rb"\1", word.translate(_KINDS))
        found = (xxhash.xxh64_intdigest(word.lower(), 1) % BUCKETS) << 32 | xxhash.xxh64_intdigest(b"\0" + shape, 1) % BUCKETS
        if len(word) < 200:
            self[word] = found
        return found


_REPEAT = xxhash.xxh64_intdigest(b"\0repeat", 1) % BUCKETS


#: Words whose features are counted at once.
_WORDS = 1 << 20


def counts(texts: list[bytes | None], features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of all texts' features, sorted."""
    found, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = [t.split() if t else [] for t in texts]
    lengths = np.array([len(x) for x in lists], np.int64)
    words, doc = (w for x in lists for w in x), np.repeat(np.arange(len(texts)), lengths)
    before = (-1, -1)
    for a in range(0, len(doc), _WORDS):
        own = doc[a : a + _WORDS]
        both = np.fromiter((features[w] for w in islice(words, len(own))), np.int64, len(own))
        again = (both == np.concatenate(([before[1]], both[:-1]))) & (own == np.concatenate(([before[0]], own[:-1])))
        before = (int(own[-1]), int(both[-1]))
        new = ~again
        keys = np.concatenate([own[new] * BUCKETS + (both[new] >> 32), own[new] * BUCKETS + (both[new] & 0xFFFFFFFF), own[again] * BUCKETS + _REPEAT])
        keys, n = np.unique(keys, return_counts=True)
        if len(found):
            keys, where = np.unique(np.concatenate((found, keys)), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate((total, n))).astype(np.int64)
        found, total = keys, n
    return found // BUCKETS, found % BUCKETS, total


def frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each bucket is, and the number of documents. A table of BUCKETS rows comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, found, total = Features(), np.zeros(BUCKETS + 1, np.int64), 0
        for _, texts in common.chunks(batches, text):
            found[:BUCKETS] += np.bincount(counts(texts, features)[1], minlength=BUCKETS)
            total += len(texts)
        found[BUCKETS] = total
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(found)], ["bucket", "n"])

    rows = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    found = np.zeros(BUCKETS + 1, np.int64)
    found[rows["bucket"]] = rows["n"]
    return found[:BUCKETS], int(found[BUCKETS])


class Space:
    """Weights of the buckets and their directions."""

    def __init__(self, weights: np.ndarray, basis: np.ndarray):
        self.weights, self.basis = weights, basis

    def vectors(self, texts: int, doc: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Unit vectors (zero where nothing is known)."""
        out = np.zeros((texts, self.basis.shape[1]), np.float32)
        step = 1 << 18
        for a in range(0, len(doc), step):
            d, b = doc[a : a + step], bucket[a : a + step]
            part = self.basis[b] * (np.log1p(n[a : a + step]) * self.weights[b]).astype(np.float32)[:, None]
            heads = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            out[d[heads]] += np.add.reduceat(part, heads, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], found: np.ndarray, total: int) -> Space:
        """From the (buckets, counts) of the sample, by a randomised singular value decomposition with a fixed start."""
        weights = np.log((1 + total) / (1 + found)) + 1
        dense = np.zeros((max(1, len(rows)), BUCKETS), np.float32)
        for i, (bucket, n) in enumerate(rows):
            dense[i, bucket] = np.log1p(n) * weights[bucket]
        dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
        rank = min(DIMENSIONS, len(dense))
        start = np.random.default_rng(0).standard_normal((BUCKETS, rank + 8)).astype(np.float32)
        for _ in range(3):
            start = np.linalg.qr(dense.T @ (dense @ start))[0]
        _, _, turn = np.linalg.svd(dense @ start, full_matrices=False)
        return cls(weights, np.ascontiguousarray((start @ turn[:rank].T).astype(np.float32)))


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = SAMPLE) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, buckets, counts) of at most `most` labelled documents, by id; features are made where the texts are."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    own = own.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch, texts in common.chunks(batches, "text"):
            doc, bucket, n = counts(texts, features)
            edges = np.searchsorted(doc, np.arange(len(texts) + 1))
            lists = [pa.array([x[a:b] for a, b in zip(edges, edges[1:])], pa.list_(pa.int64())) for x in (bucket, n)]
            names = ["doc_id", "quality"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in names), *lists], [*names, "buckets", "counts"])

    rows = own.mapInArrow(run, "doc_id long, quality int, buckets array<long>, counts array<long>").toArrow().to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    return [(int(r["quality"]), np.array(r["buckets"], np.int64), np.array(r["counts"], np.int64)) for r in rows]


def nearest(cosine: np.ndarray, near: int) -> np.ndarray:
    """Which columns of each row are among the `near` largest; of equal ones the first."""
    least = np.partition(cosine, cosine.shape[1] - near, axis=1)[:, [cosine.shape[1] - near]]
    above = cosine > least
    even = cosine == least
    even &= np.cumsum(even, axis=1, dtype=np.int32) <= near - above.sum(1, keepdims=True)
    return above | even


def vote(docs: DataFrame, space: Space, vectors: np.ndarray, labels: np.ndarray, text: str = "text") -> DataFrame:
    """docs without text, with score. Exact cosines to all labelled vectors, in blocks; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((space, vectors, labels))
    docs, names, schema = common.reduced(docs, [text], {"score": "double"}, last=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, vectors, labels = shared.value
        features, near = Features(), min(NEIGHBOURS, len(labels))
        for batch, texts in common.chunks(batches, len(names), 1 << 21):
            scores = np.full(len(texts), 0.5)
            if near:
                own = space.vectors(len(texts), *counts(texts, features))
                for a in range(0, len(texts), 512):
                    cosine = np.round(own[a : a + 512] @ vectors.T, 6)
                    weight = np.where(nearest(cosine, near), np.maximum(cosine, 0), 0).astype(np.float64)
                    total = weight.sum(1)
                    scores[a : a + 512] = np.where(total > 0, weight @ labels / np.maximum(total, 1e-12), labels.mean())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.clip(scores, 0, 1))], [*names, "score"])

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, training: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """docs with score in place of text: training and labels give the sample of at most `most`, docs the document frequencies."""
    found, total = frequencies(docs)
    rows = sample(training, labels, most=most)
    space = Space.fit([(b, n) for _, b, n in rows], found, total)
    doc = np.repeat(np.arange(len(rows)), [len(b) for _, b, _ in rows]) if rows else np.zeros(0, np.int64)
    joined = [np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64) for k in (1, 2)]
    vectors = space.vectors(len(rows), doc, *joined)
    return vote(docs, space, vectors, np.array([q for q, _, _ in rows], np.float64))


def query(spark, sf_dir: str) -> DataFrame:
    """The query: learned from the labels of four fifths of the documents, scored for all."""
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    held_out = common.doc_remainder(F.col("doc_id"), 5) == 0
    own = docs.select("doc_id", held_out.alias("held_out"), "text")
    found = score(own, own.where(~F.col("held_out")), labels.where(~held_out))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
