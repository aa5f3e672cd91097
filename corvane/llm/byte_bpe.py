"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece exactly one token can be the last one of its encoding. A token that ends at a
position is that one if the encoding of what precedes it ends in a token with which it forms a valid pair: two
tokens whose concatenation BPE would give back as these two. The table of last tokens so holds the encodings
of all prefixes; an append goes on from it, and an edit recomputes it only until it agrees with the old one.
Whole tables of documents are encoded with the tables of many pieces side by side, place by place.

Null texts count as empty and give no ids. Repeated rows give repeated results, an empty table an empty one. Long
texts are split and encoded a block of pieces at a time, pieces of over LONG_PIECE bytes each by a table of its own.
Columns named like a result are replaced by it. Ranks are given as bytes of a rank file (base64 token, space, rank).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pieces whose ids a worker remembers, twice: those met since there were as many, and those before.
MEMORY = 150_000
#: Bytes of the longest pieces that are remembered and encoded side by side.
LONG_PIECE = 64
#: Pairs of tokens of which a worker remembers whether they are valid: a power of two.
PAIRS = 1 << 20
#: Text that is split at once, in bytes, and pieces of a longer text.
BLOCK_BYTES, BLOCK_PIECES = 4 << 20, 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ranks_of(content: bytes) -> dict[bytes, int]:
    """The tokens and ranks of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class Vocabulary:
    """Tokens by rank, the merge that makes each, and the test for valid pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.split: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for rank in sorted(self.tokens):
            token = self.tokens[rank]
            self.split[rank] = (rank, rank)
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None and left < rank and right < rank and self.valid(left, right):
                    self.pairs[left, right] = rank
                    self.split[rank] = (left, right)
                    break
        #: Tokens of several bytes that no merge makes appear only as whole pieces.
        self.whole_only = {r for r, s in self.split.items() if s == (r, r) and len(self.tokens[r]) > 1}
        #: The tokens that merges make as a tree of bytes: (node << 8 | byte) to the next node, from node 0.
        self.tree: dict[int, int] = {}
        #: The token that ends at a node, else -1.
        self.at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            if rank not in self.whole_only:
                for byte in token:
                    following = self.tree.setdefault(node << 8 | byte, len(self.at))
                    if following == len(self.at):
                        self.at.append(-1)
                    node = following
                self.at[node] = rank

    @classmethod
    def from_file(cls, content: bytes) -> Vocabulary:
        return cls(ranks_of(content))

    def valid(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between two adjacent tokens in place.

        Their merges are undone from the last one on; a merge across the border that came before what is left
        of both would have won.
        """
        pairs, split, bound = self.pairs, self.split, 1 << 62
        while True:
            if pairs.get((left, right), bound) < bound:
                return False
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left":
                    inner = split[left][1]
                    if inner != left:
                        bound, left = left, inner
                        break
                else:
                    inner = split[right][0]
                    if inner != right:
                        bound, right = right + 1, inner
                        break
            else:
                return True


class PrefixTable:
    """The unique valid last token of each prefix of a byte string that is encoded as one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.computed = 0
        self.append(data)

    def _token_at(self, end: int) -> int:
        data, last, ranks, voc = self.data, self.last, self.vocabulary.ranks, self.vocabulary
        for start in range(max(0, end - voc.longest), end):
            token = ranks.get(data[start:end])
            if token is None or token in voc.whole_only:
                continue
            if start == 0 or voc.valid(last[start], token):
                return token
        raise ValueError("the vocabulary has no token for a byte")

    def append(self, data: bytes) -> PrefixTable:
        done, self.data, voc = len(self.data), self.data + data, self.vocabulary
        data, last, stop, follow, at = self.data, self.last, len(self.data), voc.tree.get, voc.at
        last += [-1] * (stop - done)
        for start in range(max(0, done + 1 - voc.longest), stop):  # what follows each prefix, while tokens begin so
            before, node, end = last[start], 0, start
            for byte in data[start : start + voc.longest]:
                end += 1
                node = follow(node << 8 | byte)
                if node is None:
                    break
                if end > done and last[end] < 0 and (token := at[node]) >= 0 and (start == 0 or voc.valid(before, token)):
                    last[end] = token
        self.computed += stop - done
        return self

    def replace(self, start: int, stop: int, data: bytes) -> PrefixTable:
        """Puts data in place of data[start:stop]; entries are recomputed until as many as the longest token has bytes agree with the old table, from where on all do."""
        old, shift = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = old[: start + 1]
        agreed, edge = 0, start + len(data)
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._token_at(end))
            self.computed += 1
            agreed = agreed + 1 if end > edge and self.last[end] == old[end - shift] else 0
            if agreed >= self.vocabulary.longest and end - shift > self.vocabulary.longest:
                self.last += old[end - shift + 1 :]
                break
        return self

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of data[:end]."""
        end, found = len(self.data) if end is None else end, []
        if end and (whole := self.vocabulary.ranks.get(self.data[:end])) is not None:
            return [whole]
        while end:
            found.append(self.last[end])
            end -= len(self.vocabulary.tokens[found[-1]])
        return found[::-1]


class Tables:
    """The prefix tables of many pieces at once, with the vocabulary as arrays."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.size = vocabulary, max(vocabulary.tokens, default=0) + 1
        self.length = np.zeros(self.size, np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        for rank, (left, right) in vocabulary.split.items():
            self.length[rank], self.left[rank], self.right[rank] = len(vocabulary.tokens[rank]), left, right
        pairs = np.array([(a * self.size + b, rank) for (a, b), rank in vocabulary.pairs.items()], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pair_keys, self.pair_ranks = np.append(pairs[:, 0], np.iinfo(np.int64).max), np.append(pairs[:, 1], 0)
        # the tree with inner nodes first; only these have a row of followers
        keys, nodes = (np.fromiter(x, np.int64, len(vocabulary.tree)) for x in (vocabulary.tree.keys(), vocabulary.tree.values()))
        inner = np.unique(np.append(keys >> 8, 0))
        number = np.full(len(vocabulary.at), -1, np.int64)
        number[inner] = np.arange(len(inner))
        number[number < 0] = np.arange(len(inner), len(number))
        self.inner = len(inner)
        self.follow = np.full((self.inner, 256), -1, np.int32)
        self.follow[number[keys >> 8], keys & 255] = number[nodes]
        self.at = np.full(len(number), -1, np.int32)
        self.at[number] = vocabulary.at
        #: Pairs by a hash of theirs, with what was found in the lowest bit: the last one met of those that share a place.
        self.known = np.full(PAIRS, -1, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], 1 << 40)

    def valid(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Vocabulary.valid() of pairs side by side."""
        found, open_, bound = np.ones(len(left), bool), np.arange(len(left)), np.full(len(left), 1 << 40)
        while len(open_):
            wins = self._rank(left, right) < bound
            found[open_[wins]] = False
            inner, outer = self.right[left], self.left[right]
            into_left, into_right = inner != left, outer != right
            into_left &= (left > right) | ~into_right
            go = (into_left | into_right) & ~wins
            bound = np.where(into_left, left, right + 1)[go]
            left, right = np.where(into_left, inner, left)[go], np.where(into_left, right, outer)[go]
            open_ = open_[go]
        return found

    def borders(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """valid(), remembered."""
        key = left.astype(np.int64) * self.size + right
        place = (key.astype(np.uint64) * _MIX >> np.uint64(65 - PAIRS.bit_length())).astype(np.int64)
        held = self.known[place]
        found, new = (held & 1).astype(bool), np.flatnonzero(held >> 1 != key)
        if len(new):
            if len(new) < 64:
                own, test = key[new], self.vocabulary.valid
                fits = np.array([test(*divmod(k, self.size)) for k in own.tolist()], bool)
            else:
                distinct, own = np.unique(key[new], return_inverse=True)
                fits, own = self.valid(distinct // self.size, distinct % self.size)[own], key[new]
            found[new] = fits
            self.known[place[new]] = own * 2 + fits
        return found

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as 32-bit numbers: the last tokens of all prefixes, place by place, then read from the ends back."""
        if not pieces:
            return []
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-lengths, kind="stable")  # the pieces that reach a place come first
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        most = int(lengths.max())
        data = np.zeros((most, len(pieces)), np.uint8)
        total = int(lengths.sum())
        data[np.arange(total) - np.repeat(common.segments(lengths), lengths), np.repeat(column, lengths)] = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = lengths[order]
        reach = np.searchsorted(-sizes, -np.arange(most + 1), side="left")  # pieces of more than so many bytes
        last = np.full((most + 1, len(pieces)), -1, np.int32)
        for start in range(most):
            own, before = np.arange(reach[start]), last[start]
            node, end = self.follow[0, data[start, : reach[start]]], start
            while True:
                there = node >= 0
                if not there.all():
                    own, node = own[there], node[there]
                end += 1
                token, row = self.at[node], last[end]
                new = np.flatnonzero((token >= 0) & (row[own] < 0))
                who, token = own[new], token[new]
                if start:
                    fits = self.borders(before[who], token)
                    who, token = who[fits], token[fits]
                row[who] = token
                if end >= most:
                    break
                on = np.flatnonzero((node < self.inner) & (own < reach[end]))
                if not len(on):
                    break
                own = own[on]
                node = self.follow[node[on], data[end, own]]
        counts, steps, at, open_ = np.zeros(len(pieces), np.int64), [], sizes.copy(), np.arange(len(pieces))
        while len(open_):
            token = last[at[open_], open_]
            if (token < 0).any():
                raise ValueError("the vocabulary has no token for a byte")
            steps.append((open_, token))
            counts[open_] += 1
            at[open_] -= self.length[token]
            open_ = open_[at[open_] > 0]
        ends = np.cumsum(counts)
        out = np.empty(int(counts.sum()), np.int32)
        for k, (own, token) in enumerate(steps):
            out[ends[own] - 1 - k] = token
        found, ends = out.tobytes(), (4 * ends).tolist()
        sorted_ids = [found[a:b] for a, b in zip([0, *ends], ends)]
        return [sorted_ids[k] for k in column.tolist()]


class Encoder:
    """Encodes whole texts: each match of the pattern apart, without special tokens."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern, self.tables = vocabulary, regex.compile(pattern), Tables(vocabulary)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Makes sure that the memory has the pieces; gives the ids of those too long for it."""
        missing = pieces - self.memory.keys()
        if len(self.memory) + len(missing) > MEMORY:
            self.older, self.memory = self.memory, {}
            missing = pieces
        new, long, ranks, memory, older = [], {}, self.vocabulary.ranks, self.memory, self.older.get
        for piece in missing:
            found = older(piece)
            if found is None:
                data = piece.encode()
                if (whole := ranks.get(data)) is not None:
                    found = whole.to_bytes(4, "little")
                elif len(data) <= LONG_PIECE:
                    new.append((piece, data))
                    continue
                else:
                    found = np.array(PrefixTable(self.vocabulary, data).tokens(), np.int32).tobytes()
            if len(piece) <= LONG_PIECE:
                memory[piece] = found
            else:
                long[piece] = found
        memory.update(zip([p for p, _ in new], self.tables.encode([d for _, d in new])))
        return long

    def _ids(self, lists: list[list[str]]) -> list[bytes]:
        long = self._learn(set(chain.from_iterable(lists)))
        get = self.memory.__getitem__
        if long:
            return [b"".join([long.get(p) or get(p) for p in x]) for x in lists]
        return [b"".join(map(get, x)) for x in lists]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers. What texts of BLOCK_BYTES together have is split at once."""
        if sum(map(len, texts)) <= BLOCK_BYTES:
            return self._ids([self.pattern.findall(t) for t in texts])
        out = []
        for text in texts:
            matches, parts = (m.group() for m in self.pattern.finditer(text)), []
            while block := list(islice(matches, BLOCK_PIECES)):
                parts += self._ids([block])
            out.append(b"".join(parts))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


class Document:
    """A text that is edited: after a change only the pieces around it are split and encoded again."""

    def __init__(self, encoder: Encoder, pattern: str, text: str = ""):
        self.encoder, self.pattern, self.text, self.starts = encoder, regex.compile(pattern), text, []
        self.starts = [m.start() for m in self.pattern.finditer(text)]

    def replace(self, start: int, stop: int, new: str) -> int:
        """Replaces text[start:stop]; returns how many pieces had to be split again."""
        shift = len(new) - (stop - start)
        keep = 0
        while keep + 1 < len(self.starts) and self.starts[keep + 1] <= start - 4:  # no match looks further ahead
            keep += 1
        kept, edge = self.starts[:keep], start + len(new)
        rest = {s + shift: i for i, s in enumerate(self.starts) if s >= stop}
        self.text = self.text[:start] + new + self.text[stop:]
        at, again = self.starts[keep] if keep < len(self.starts) else 0, 0
        while (m := self.pattern.search(self.text, at)) is not None:
            if m.start() > edge and m.start() in rest:
                kept += [s + shift for s in self.starts[rest[m.start()] :]]
                break
            kept.append(m.start())
            again, at = again + 1, m.end()
        self.starts = kept
        return again

    def tokens(self) -> list[int]:
        pieces = [self.text[a:b] for a, b in zip(self.starts, [*self.starts[1:], len(self.text)])]
        return np.frombuffer(self.encoder._ids([pieces])[0], np.int32).tolist()


_made: dict[bytes, Vocabulary] = {}
_encoders: dict[tuple[bytes, str], Encoder] = {}


def vocabulary(content: bytes) -> Vocabulary:
    """One for each worker process and rank file."""
    if content not in _made:
        _made.clear()
        _made[content] = Vocabulary.from_file(content)
    return _made[content]


def _encoder(ranks: bytes, pattern: str) -> Encoder:
    """One for each worker process, rank file and pattern."""
    key = (ranks, pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary(ranks), pattern)
    return _encoders[key]


def _release() -> None:
    """At the end of a task: a worker that waits for another one holds neither vocabulary nor memory (half a second to make again)."""
    _encoders.clear()
    _made.clear()
    common.trim()


def _ids(texts: list[bytes | None], encoder: Encoder) -> pa.ListArray:
    found = encoder.encode_all([t.decode() if t else "" for t in texts])
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _bytes(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """What each list of ids stands for: the tokens one after the other are the texts one after the other. Null lists count as empty."""
    flat, starts = ids.flatten(), np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())))
    whole = tokens.take(flat)
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    data = whole.buffers()[2] or pa.py_buffer(b"")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ends[starts])), data]).cast(pa.binary())


def _tokens(ranks: dict[bytes, int]) -> pa.Array:
    """The tokens by rank; ranks that none has are null."""
    found: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        found[rank] = token
    return pa.array(found, pa.large_binary())


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", output: str = "ids") -> DataFrame:
    """docs with the token ids of its text column in place of the text (array<int>; null texts give none).

    ranks is the content of a rank file (a fixed size, under 1 MB). A narrow operation: no shuffle, and each
    row depends on its own text only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    docs, names, schema = common.reduced(docs, [text], {output: "array<int>"}, last=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch, texts in common.chunks(batches, len(names)):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _ids(texts, encoder)], [*names, output])
        del encoder
        _release()

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, ranks: bytes, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """docs with one more column: the bytes that its ids stand for (binary)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    docs, names, schema = common.reduced(docs, [], {output: "binary"})
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(ranks_of(shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, _bytes(part.column(at), tokens)], [*names, output])

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids and decoded in place of the text: encode() and decode() in one pass, with one worker for both."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    docs, names, schema = common.reduced(docs, [text], {"ids": "array<int>", "decoded": "binary"}, last=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        tokens = _tokens(encoder.vocabulary.ranks)
        for batch, texts in common.chunks(batches, len(names)):
            ids = _ids(texts, encoder)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, _bytes(ids, tokens)], [*names, "ids", "decoded"])
        del encoder, tokens
        _release()

    return docs.mapInArrow(run, schema)


def digests(spark, sf_dir: str) -> DataFrame:
    """The query: every text encoded by a public vocabulary and decoded again, as counts and digests."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    found = round_trip(common.read(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
