"""Language-model scores by a weighted backoff automaton.

The model is counted over all training documents, n-grams of up to `order` words, and smoothed level by level: a word w
after a context u that was seen has (c(uw) + M p(w after the rest of u)) / (c(u) + M), one without any
p(w) = (c(w) + 1) / (N + V + 1). Its automaton has a state for each context that was seen, an arc for each n-gram,
from each state a failure arc of weight M / (c(u) + M) to the context without its first word, and at the end of
these chains the root, which has an arc for every word. A text is read once, left to right, the state carried from word
to word and the logarithms added up; its end is a word, too, and its start a context.

The model grows with the corpus, so it's neither broadcast nor brought to the driver. Documents are dealt out to
parts of a bounded size. Each part asks for the n-grams it has, as sorted blocks of 64-bit keys; the tasks that hold a
range of keys add up their counts and answer every part with the totals of its own, in the order of its keys, from
which the part builds the automaton its texts can reach. It is one job, which shuffles texts and keys once each. (Two of
n different n-grams share a key with a probability of about n squared over 2^57.)

Null texts are empty: an end only. Repeated rows train and are scored as often as they are there. With nothing to
train on, p(w) is 1 for every word and all scores are 0. An empty table gives an empty one. A text that is longer than
a part is a part of its own. Columns but doc_id, held_out and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The words of the longest n-grams, and the weight of what shorter ones say, in words.
ORDER, PRIOR = 2, 30.0
#: Text of a part, in bytes.
PART_BYTES = 5 << 20
_END, _START = b" end", b" start"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers, or counts, with equal bytes side by side, as compression likes them."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


class Block:
    """The words of some texts as numbers, one text after the other, each with its start and its end."""

    def __init__(self, texts: list[bytes | None], order: int = ORDER):
        numbers: dict[bytes, int] = {_END: 0, _START: 1}
        lists = [(t.lower().split() if t else []) for t in texts]
        #: of each text, with its end
        self.lengths = np.array([len(x) + 1 for x in lists], np.int64)
        out = np.zeros(int((self.lengths + 1).sum()), np.int64)
        self.first = common.segments(self.lengths + 1)
        out[self.first] = 1
        put = numbers.setdefault
        for at, words in zip((self.first + 1).tolist(), lists):
            out[at : at + len(words)] = [put(w, len(numbers)) for w in words]
        self.words, self.size = out, len(numbers)
        keys = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in numbers), np.uint64, len(numbers))
        place = np.arange(len(out)) - np.repeat(self.first, self.lengths + 1)
        #: by level (of so many words): the n-gram that ends at each place (-1 for none), and of the different ones the key, the n-gram without the last and without the first word
        self.at, self.keys, self.prefix, self.suffix, self.last = {1: out}, {1: keys}, {}, {}, {1: np.arange(self.size)}
        for level in range(2, order + 1):
            own = np.flatnonzero(place >= level - 1)
            before, now = self.at[level - 1][own - 1], self.at[level - 1][own]
            distinct, inverse = np.unique(before * len(self.keys[level - 1]) + now, return_inverse=True)
            self.at[level] = np.full(len(out), -1, np.int64)
            self.at[level][own] = inverse
            self.prefix[level], self.suffix[level] = np.divmod(distinct, len(self.keys[level - 1]))
            self.last[level] = self.last[level - 1][self.suffix[level]]
            key = (self.keys[level - 1][self.prefix[level]] * _MIX) ^ keys[self.last[level]]
            key = (key ^ (key >> np.uint64(31))) * _MIX
            self.keys[level] = key >> np.uint64(8) << np.uint64(8)  # 56 bits are moved


class Request:
    """What a part asks for: its n-grams' keys by level, sorted, and where each range of keys ends."""

    def __init__(self, block: Block, parts: int):
        self.numbers, self.keys, self.ends = {}, {}, {}
        borders = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
        for level, keys in block.keys.items():
            own = np.arange(len(keys)) if level > 1 else np.flatnonzero(np.arange(len(keys)) != 1)  # the start is no word
            turn = own[np.argsort(keys[own])]
            self.numbers[level], self.keys[level] = turn, keys[turn]
            edges = np.concatenate(([0], np.searchsorted(self.keys[level], borders), [len(turn)]))
            #: of the ranges it has keys of: with more ranges there are no more blocks than keys
            self.ends[level] = [(k, (int(edges[k]), int(edges[k + 1]))) for k in np.flatnonzero(np.diff(edges)).tolist()]


_BLOCKS = "part int, order int, bucket int, keys binary, counts binary, types long, tokens long"
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], ["part", "order", "bucket", "keys", "counts", "types", "tokens"])


def _ask(parts: int, order: int):
    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        block = Block(group.column("text").cast(pa.large_binary()).to_pylist(), order)
        train = np.repeat(np.array([not x for x in group.column("held_out").to_pylist()]), block.lengths + 1)
        request = Request(block, parts)
        rows = []
        for level, at in block.at.items():
            here = train & (at >= 0)
            own = np.bincount(at[here], minlength=len(block.keys[level]))[request.numbers[level]].astype(np.uint32)
            rows += [(part, level, bucket, pack(_steps(request.keys[level][a:b])), pack(own[a:b]), None, None) for bucket, (a, b) in request.ends[level]]
        return _table(rows)

    return run


def _answer(group: pa.Table) -> pa.Table:
    """To each part the totals of the keys it asked for; one row for part -1 with the types and tokens of the range."""
    order, bucket = group.column("order")[0].as_py(), group.column("bucket")[0].as_py()
    asked = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in group.column("keys").to_pylist()]
    counts = [unpack(x, np.uint32) for x in group.column("counts").to_pylist()]
    keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.uint64)
    rows, at = [(-1, order, bucket, None, None, int(np.count_nonzero(totals)), int(totals.sum()))], 0
    for part, own in zip(group.column("part").to_pylist(), asked):
        rows.append((part, order, bucket, None, pack(np.minimum(totals[inverse[at : at + len(own)]], 2**32 - 1).astype(np.uint32)), None, None))
        at += len(own)
    return _table(rows)


class Automaton:
    """States are contexts, the root (0) is the empty one; each has arcs for the words seen after it, and a failure arc.

    root: the weight of each word's arc from the root; home: the state it leads to. arcs: state * words + word to the weight
    of an arc and the state it leads to. failure and up: weight and end of each state's failure arc.
    """

    def __init__(self, root: list[float], home: list[int], arcs: dict[int, tuple[float, int]], failure: list[float], up: list[int]):
        self.root, self.home, self.arcs, self.failure, self.up = root, home, arcs, failure, up

    def read(self, words: list[int], state: int) -> float:
        total, size, find = 0.0, len(self.root), self.arcs.get
        root, home, failure, up = self.root, self.home, self.failure, self.up
        for word in words:
            arc = find(state * size + word)
            while arc is None:
                total += failure[state]
                state = up[state]
                arc = find(state * size + word) if state else (root[word], home[word])
            total += arc[0]
            state = arc[1]
        return total

    @classmethod
    def of(cls, block: Block, counts: dict[int, np.ndarray], p: np.ndarray, prior: float) -> Automaton:
        """From the counts of a block's n-grams by level, and the probabilities of its words."""
        order, size = max(counts), block.size
        # states: 1 + n-grams of a level, level after level; those that weren't seen are where their failure arcs end
        base = dict(zip(range(1, order), (1 + np.cumsum([0, *(len(block.keys[k]) for k in range(1, order))])).tolist()))
        number = {1: np.where(counts[1] > 0, np.arange(size) + 1, 0)} if order > 1 else {}
        up, failure = [np.zeros(1, np.int64)], [np.zeros(1)]
        for level in range(1, order):
            if level > 1:
                number[level] = np.where(counts[level] > 0, np.arange(len(counts[level])) + base[level], number[level - 1][block.suffix[level]])
            up.append(np.zeros(size, np.int64) if level == 1 else number[level - 1][block.suffix[level]])
            failure.append(np.log10(prior / (counts[level] + prior)))
        chance, arcs = {1: p}, {}
        for level in range(2, order + 1):
            seen, after = counts[level], counts[level - 1][block.prefix[level]]
            lower = chance[level - 1][block.suffix[level]]
            chance[level] = np.where(after > 0, (seen + prior * lower) / (after + prior), lower)
            own = np.flatnonzero(seen > 0)
            state = number[level - 1][block.prefix[level][own]]
            end = number[level][own] if level < order else number[level - 1][block.suffix[level][own]]
            arcs.update(zip((state * size + block.last[level][own]).tolist(), zip(np.log10(chance[level][own]).tolist(), end.tolist())))
        home = number[1].tolist() if order > 1 else [0] * size
        return cls(np.log10(p).tolist(), home, arcs, np.concatenate(failure).tolist(), np.concatenate(up).tolist())


def _scorer(parts: int, order: int, prior: float):
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], k) for k in kinds], columns)
        block = Block(docs.column("text").cast(pa.large_binary()).to_pylist(), order)
        request = Request(block, parts)
        types, tokens = answers.column("all_types")[0].as_py(), answers.column("all_tokens")[0].as_py()
        totals = {level: np.zeros(len(keys)) for level, keys in block.keys.items()}
        answered = {(o, b): c for o, b, c in zip(*(answers.column(n).to_pylist() for n in ("order", "bucket", "counts")))}
        for level, ends in request.ends.items():
            for bucket, (a, b) in ends:
                totals[level][request.numbers[level][a:b]] = unpack(answered[level, bucket], np.uint32)
        count = totals[1]
        p = (count + 1) / (tokens + types + 1)
        known, root = count > 0, np.log10(p)
        count[1] = count[0]  # as many starts as ends
        automaton = Automaton.of(block, totals, p, prior)
        start = automaton.home[1]
        scores, of_text = [], block.words.tolist()
        for a, n in zip((block.first + 1).tolist(), block.lengths.tolist()):
            scores.append(automaton.read(of_text[a : a + n], start))
        inner = np.ones(len(block.words), bool)
        inner[block.first] = False  # sums leave the starts out
        words, heads = block.words[inner], common.segments(block.lengths)
        base = np.add.reduceat(root[words], heads)
        n_known = np.add.reduceat(known[words].astype(np.int64), heads)
        values = [docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), block.lengths, n_known, np.full(docs.num_rows, tokens), base, scores]
        return pa.table([pa.array(v, k) if not isinstance(v, (pa.Array, pa.ChunkedArray)) else v for v, k in zip(values, kinds)], columns)

    return run


def score(docs: DataFrame, prior: float = PRIOR, part_bytes: int = PART_BYTES, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of all rows of docs (doc_id, held_out, text), learned from those not held out."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part"))
    answers = dealt.groupBy("part").applyInArrow(_ask(parts, order), _BLOCKS).groupBy("order", "bucket").applyInArrow(_answer, _BLOCKS)
    whole = answers.where("part = -1 and order = 1").agg(F.coalesce(F.sum("types"), F.lit(0)).alias("all_types"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))  # one row
    replies = answers.where("part >= 0").select("part", "order", "bucket", "counts").crossJoin(F.broadcast(whole))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_scorer(parts, order, prior), out)


def query(spark, sf_dir: str) -> DataFrame:
    """The query: learned from six sevenths of the documents, scored for all; gain is what the model adds to the base for each token."""
    docs = common.read(spark, sf_dir, "documents")
    found = score(docs.select("doc_id", (common.doc_remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "text"))
    gain = F.round((F.col("score") - F.col("base_score")) / F.col("n_tokens"), 6)
    return found.select(*[F.round(n, 6).alias(n) if n.endswith("score") else n for n in found.columns], gain.alias("gain"))


def oracle() -> str:
    """The query in SQL: the model's probabilities by joins."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    p = "(coalesce(u.c, 0) + 1) / (n + v + 1)::DOUBLE"
    return f"""WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {common.remainder_sql("doc_id", 7)} = 2 AS held_out, list_append(list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x09-\\x0D ]+'), lambda w: w <> ''), ' end') AS w FROM documents),
tok AS (SELECT r, held_out, word, coalesce(lag(word) OVER (PARTITION BY r ORDER BY i), ' start') AS prev FROM (SELECT r, held_out, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM doc)),
uni AS (SELECT word, count(*) AS c FROM tok WHERE NOT held_out GROUP BY word),
big AS (SELECT prev, word, count(*) AS c FROM tok WHERE NOT held_out GROUP BY prev, word),
tot AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM uni),
sta AS (SELECT word, c FROM uni UNION ALL SELECT ' start', c FROM uni WHERE word = ' end'),
sco AS (SELECT r, count(*) AS n_tokens, count(u.c) AS n_known, sum(log10({p})) AS base, sum(log10((coalesce(b.c, 0) + {PRIOR} * {p}) / (coalesce(s.c, 0) + {PRIOR}))) AS score FROM tok CROSS JOIN tot LEFT JOIN uni u ON u.word = tok.word LEFT JOIN big b ON b.word = tok.word AND b.prev = tok.prev LEFT JOIN sta s ON s.word = tok.prev GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n::BIGINT AS train_tokens, round(base, 6) AS base_score, round(score, 6) AS score, round((score - base) / n_tokens, 6) AS gain FROM doc JOIN sco USING (r) CROSS JOIN tot"""
