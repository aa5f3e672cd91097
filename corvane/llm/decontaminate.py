"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts become lower-case words of letters and digits. A document leaks an item if the best local alignment of the
two (match 1, mismatch or gap -1) scores LEAST or more of the number of the item's words; this is the score given.

Seeds lose none of these. An alignment of m matches in k runs has k - 1 edits or more between them, so its score is
m - k + 1 at most, while the runs have m - k n-grams of two words: an alignment that scores s has s - 1 of the item's
n-grams or more. Every n-gram of the items is counted over all documents; of an item with p n-grams that needs n of
them, the p - n + 1 rarest are its seeds, of which such an alignment then has one. Where a document has a seed and
n of the n-grams, the stretch around it that the alignment can cover is aligned with the item word by word.

Items of one or two words have one seed, themselves. Null and empty texts leak nothing, null or empty items
are not looked for. Repeated rows and items give repeated results; of equally good places in a text the first one counts.
With an empty table of documents or of items there are no results. Of long texts only the stretches around seeds are
aligned. Other columns aren't read; clean() passes all on.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Of longer n-grams an alignment with an edit in every few words has none.
NGRAM = 2
LEAST = 0.5
#: Items are taken in blocks of about so many bytes, which are broadcast; each block reads the documents twice.
BLOCK_BYTES = 16 << 20

_words = re.compile(r"[^\W_]+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[str]:
    return _words(text.decode().lower())


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over word numbers: best score, and the stretch of the passage (start, end) that it covers."""
    size = len(passage)
    row, begin = np.zeros(size + 1, np.int64), np.arange(size + 1)
    best = (0, 0, 0)
    at = np.arange(size + 1)
    for word in item:
        step = np.where(passage == word, 1, -1)
        from_left_up = row[:-1] + step
        from_up = row[1:] - 1
        up = from_up > from_left_up
        score = np.concatenate(([0], np.maximum(np.maximum(from_left_up, from_up), 0)))
        first = np.concatenate(([0], np.where(up, begin[1:], begin[:-1])))
        fresh = score == 0
        first[fresh] = at[fresh]
        # gaps along the row: the best start so far, less one for each word since
        reach = np.maximum.accumulate(score + at)
        source = np.maximum.accumulate(np.where(score + at == reach, at, 0))
        row, begin = reach - at, first[source]
        end = int(row.argmax())
        if row[end] > best[0]:
            best = (int(row[end]), int(begin[end]), end)
    return best


class Items:
    """The test items as word numbers, and where each n-gram of theirs is."""

    def __init__(self, items: list[tuple[int, bytes]], size: int = NGRAM):
        self.size, self.numbers, self.ids, self.words = size, {}, [], []
        places: dict[int, list[tuple[int, int]]] = {}
        for item, text in items:
            words = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)], np.int64)
            if len(words):
                for at, key in enumerate(self.keys(words).tolist()):
                    places.setdefault(key, []).append((len(self.ids), at))
                self.ids.append(item)
                self.words.append(words)
        self.grams = np.array(sorted(places), np.uint64)
        self.places = [places[k] for k in self.grams.tolist()]
        #: of each item the n-grams (by their place in grams), in order
        self.own = [np.searchsorted(self.grams, self.keys(w)) for w in self.words]
        self.sizes = sorted({min(self.size, len(w)) for w in self.words})

    def keys(self, words: np.ndarray) -> np.ndarray:
        """A key for each n-gram; texts shorter than one have a single key."""
        size = min(self.size, len(words))
        key = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            key = (key ^ words[k : len(words) - size + 1 + k].astype(np.uint64)) * _MIX
            key ^= key >> np.uint64(29)
        return key

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a document, and the n-grams (by their place in grams) found there."""
        found = []
        for size in self.sizes:
            if len(numbers) < size:
                continue
            key = Items.keys(_Sized(size), numbers)
            at = np.searchsorted(self.grams, key)
            at[at == len(self.grams)] = 0
            own = np.flatnonzero(self.grams[at] == key)
            found.append((own, at[own]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class _Sized:
    def __init__(self, size: int):
        self.size = size


def _numbers(items: Items, text: bytes) -> np.ndarray:
    get = items.numbers.get
    return np.array([get(w, 0) for w in words_of(text)], np.int64)


def _frequencies(docs: DataFrame, shared, text: str) -> dict[int, int]:
    """In how many documents each n-gram of the items is; summed within a task first. As many rows as the block has n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        counts = np.zeros(len(items.grams), np.int64)
        for _, texts in common.chunks(batches, text):
            for t in texts:
                if t:
                    counts[np.unique(items.hits(_numbers(items, t))[1])] += 1
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own])], ["gram", "n"])

    rows = docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    return dict(zip(rows["gram"], rows["n"]))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) of every document and item it leaks, at the best place (the first of equals).

    Two narrow passes over docs for each block of items; texts are never shuffled.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    out = None
    block: list[tuple[int, bytes]] = []
    held = 0
    for row in (*rows.toLocalIterator(), None):
        if row is not None:
            block.append((row["i"], row["t"].encode()))
            held += len(block[-1][1])
        if block and (row is None or held >= BLOCK_BYTES):
            found = _block(spark, docs, Items(block), least)
            out = found if out is None else out.union(found)
            block, held = [], 0
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, score double, start_word long, end_word long")


def _block(spark, docs: DataFrame, items: Items, least: float) -> DataFrame:
    shared = spark.sparkContext.broadcast(items)
    often = _frequencies(docs, shared, "text")
    frequency = np.array([often.get(g, 0) for g in range(len(items.grams))], np.int64)
    score = [math.ceil(least * len(w)) for w in items.words]
    needed = [max(1, n - 1) for n in score]
    # seeds of each n-gram: the places at which it is rare for an item, as items and places one after the other
    rare: list[list[tuple[int, int]]] = [[] for _ in items.grams]
    for item, own in enumerate(items.own):
        for at in np.argsort(frequency[own], kind="stable")[: len(own) - needed[item] + 1].tolist():
            rare[own[at]].append((item, at))
    starts = np.cumsum([0, *map(len, rare)])
    flat = np.array([p for places in rare for p in places], np.int64).reshape(-1, 2)
    seeds = spark.sparkContext.broadcast((starts, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, (starts, flat) = shared.value, seeds.value
        seen = np.zeros(len(items.grams), bool)
        for batch, texts in common.chunks(batches, "text"):
            found = []
            ids = batch.column(0).to_pylist()
            for doc, t in zip(ids, texts):
                if not t:
                    continue
                numbers = _numbers(items, t)
                at, gram = items.hits(numbers)
                often = starts[gram + 1] - starts[gram]
                total = int(often.sum())
                if not total:
                    continue
                which = flat[np.repeat(starts[gram], often) + np.arange(total) - np.repeat(common.segments(often), often)]
                shift = np.repeat(at, often) - which[:, 1]
                order = np.lexsort((shift, which[:, 0]))
                of_item, shift = which[order, 0], shift[order]
                edges = np.flatnonzero(np.concatenate(([True], of_item[1:] != of_item[:-1], [True])))
                seen[gram] = True
                near = [(item, a, b) for item, a, b in zip(of_item[edges[:-1]].tolist(), edges.tolist(), edges[1:].tolist()) if np.count_nonzero(seen[items.own[item]]) >= needed[item]]
                seen[gram] = False
                for item, a, b in near:
                    best = (0, 0, 0)
                    size = len(items.words[item])
                    reach = size - score[item]  # as many edits at most
                    low, high = np.maximum(0, shift[a:b] - reach), np.minimum(len(numbers), shift[a:b] + size + reach)
                    cuts = np.flatnonzero(low[1:] > high[:-1]) + 1
                    for start, end in zip(low[[0, *cuts]].tolist(), high[[*(cuts - 1), -1]].tolist()):
                        if np.count_nonzero(np.isin(items.own[item], gram[(at >= start) & (at < end)])) < needed[item]:
                            continue
                        points, x, y = align(items.words[item], numbers[start:end])
                        if points > best[0]:
                            best = (points, start + x, start + y)
                    if best[0] >= least * len(items.words[item]):
                        found.append((doc, items.ids[item], best[0] / len(items.words[item]), best[1], best[2]))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "score", "start_word", "end_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, score double, start_word long, end_word long")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text leaks no item (whatever other rows with their id have; null texts stay)."""
    names = docs.columns
    numbered = docs.toDF(*[f"c{k}" for k in range(len(names))]).withColumn("row", F.xxhash64(F.lit(0), f"c{names.index('text')}"))
    texts = numbered.select("row", F.col(f"c{names.index('text')}").alias("text"))
    found = leaks(texts, benchmark, doc_id="row").select(F.col("doc_id").alias("row")).distinct()
    return numbered.join(found, "row", "left_anti").drop("row").toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    """The query: every document held against every test item."""
    return leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
