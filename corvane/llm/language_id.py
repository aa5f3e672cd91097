"""Language identification by multilingual mixture inference.

A language is a distribution over letter n-grams (three bytes of lower-cased text, hashed into a fixed number
of buckets), learned from all training documents. A document is a mixture of languages: units of a few words
each come from one of them, and expectation-maximisation finds the proportions. The set of languages is the
one with the best penalised likelihood (half a logarithm of the number of units for each language): starting
from all, the least is dropped while that doesn't make it worse. Its largest proportion names the language.

Null texts and texts without a letter get 'und' with score 0. Rows with a null language or text teach nothing;
with nothing learned, every text is 'und'. Equal proportions go to the language that sorts first. Repeated rows teach
and are identified as often as they are there, an empty table gives an empty one. Units of a long text are scored
piece by piece. Columns named like a result are replaced, others are passed on.

The model has BUCKETS numbers for each language and is broadcast: with over `most` languages (LANGUAGES of them if not
told otherwise) learning raises ValueError, before anything of it is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 15
UNIT_WORDS = 4
ROUNDS = 10
#: Languages that are learned, at most (64 MB), and bytes that are scored at once.
LANGUAGES, PIECE = 500, 1 << 20

#: Bytes that count as white space between words: all of ASCII but letters.
_BLANK = np.array([not (chr(b).isalpha() or b >= 128) for b in range(256)])


def _grams(data: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes around each byte, ends left out."""
    code = (data[:-2].astype(np.uint32) << 16) | (data[1:-1].astype(np.uint32) << 8) | data[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)


def _bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in lower case behind each other, all but letters blank, a blank before and after each; their starts."""
    lowered = [b" " + t.decode().lower().encode() for t in texts]
    data = np.frombuffer(b"".join(lowered) + b" ", np.uint8).copy()
    data[_BLANK[data]] = 32
    return data, common.segments(np.array([len(t) for t in lowered]))


def count(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """How often each language has each bucket: (lang, bucket, n), summed within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch, texts in common.chunks(batches, text):
            langs = batch.column(batch.schema.get_field_index(lang)).to_pylist()
            by: dict[str, list[bytes]] = {}
            for name, t in zip(langs, texts):
                by.setdefault(name, []).append(t)
            for name, own in by.items():
                data, _ = _bytes(own)
                inner = data[1:-1] != 32
                totals[name] = totals.get(name, 0) + np.bincount(_grams(data)[inner], minlength=BUCKETS)
        for name, n in totals.items():
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(found.astype(np.int32)), pa.array(n[found])], ["lang", "bucket", "n"])

    known = docs.select(F.col(lang), F.col(text)).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    return known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities of the buckets in each language; its size is that of the languages, whatever the corpus."""

    def __init__(self, langs: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.langs = langs
        shown = (counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * BUCKETS)
        self.logs = np.ascontiguousarray(np.log(shown).T.astype(np.float32))

    @classmethod
    def learn(cls, docs: DataFrame, lang: str = "lang", text: str = "text", most: int = LANGUAGES) -> Model:
        """From all rows of docs; a table of `most` languages times buckets at most comes to the driver."""
        names = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang).distinct()
        if names.limit(most + 1).count() > most:
            raise ValueError(f"over {most} languages to learn")
        table = count(docs, lang, text).toArrow().to_pydict()
        langs = sorted(set(table["lang"]))
        counts = np.zeros((len(langs), BUCKETS))
        at = {name: i for i, name in enumerate(langs)}
        counts[[at[x] for x in table["lang"]], table["bucket"]] = table["n"]
        return cls(langs, counts)

    def units(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log-likelihood of each unit in each language, and the document of each unit."""
        letters = data[1:-1] != 32
        first = letters & (data[:-2] == 32)
        doc = np.zeros(len(letters), np.int64)
        doc[starts[1:] - 1] = 1  # position i stands for byte i + 1
        doc = np.cumsum(doc)
        heads = np.flatnonzero(first)
        word_doc = doc[heads]
        of_doc = np.bincount(word_doc, minlength=len(starts))
        nth = np.arange(len(heads)) - np.repeat(common.segments(of_doc), of_doc)
        heads = heads[nth % UNIT_WORDS == 0]
        if not len(heads):
            return np.zeros((0, len(self.langs)), np.float32), heads
        out = np.empty((len(heads), len(self.langs)), np.float32)
        edges, a = np.append(heads, len(letters)), 0
        while a < len(heads):  # as many units as fit in a piece, one at least
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + PIECE, side="right")) - 1)
            b = min(b, len(heads))
            low, high = int(edges[a]), int(edges[b])
            scores = self.logs[_grams(data[low : high + 2])]
            scores[~letters[low:high]] = 0
            out[a:b] = np.add.reduceat(scores, heads[a:b] - low, axis=0)
            a = b
        return out, doc[heads]

    def infer(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text, proportions of all languages before any is dropped, and of those that remain (0 for others)."""
        size = len(self.langs)
        data, starts = _bytes(texts)
        scores, doc = self.units(data, starts)
        whole, chosen = np.zeros((len(texts), size)), np.zeros((len(texts), size))
        if not len(doc):
            return whole, chosen
        present, lengths = np.unique(doc, return_counts=True)
        peak = scores.max(1, keepdims=True)
        likely = np.exp(scores - peak)
        heads, inverse = common.segments(lengths), np.repeat(np.arange(len(present)), lengths)
        shares = self._settle(likely, heads, inverse, lengths, np.full((len(present), size), 1 / size), ROUNDS)
        whole[present] = shares
        # dropping languages: the documents one language suffices for first, the others step by step
        penalty = 0.5 * np.log(lengths + 1.0)
        fit = np.add.reduceat(np.log((likely * shares[inverse]).sum(1) + 1e-30), heads)
        alone = np.add.reduceat(np.log(likely + 1e-30), heads, axis=0)
        best = alone.argmax(1)
        single = alone[np.arange(len(best)), best] + penalty * (size - 1) >= fit
        kept = shares.copy()
        kept[single] = np.eye(size)[best[single]]
        open_ = np.flatnonzero(~single)
        while len(open_):
            rows = np.isin(inverse, open_)
            own, own_lengths = likely[rows], lengths[open_]
            own_heads, own_inverse = common.segments(own_lengths), np.repeat(np.arange(len(open_)), own_lengths)
            tried = kept[open_]
            least = np.where(tried > 0, tried, 2).argmin(1)
            tried[np.arange(len(open_)), least] = 0
            tried /= np.maximum(tried.sum(1, keepdims=True), 1e-30)
            tried = self._settle(own, own_heads, own_inverse, own_lengths, tried, ROUNDS // 2)
            now = np.add.reduceat(np.log((own * tried[own_inverse]).sum(1) + 1e-30), own_heads)
            better = now + penalty[open_] >= fit[open_]
            kept[open_[better]], fit[open_[better]] = tried[better], now[better]
            open_ = open_[better & ((tried > 0).sum(1) > 1)]
        chosen[present] = kept
        return whole, chosen

    @staticmethod
    def _settle(likely, heads, inverse, lengths, shares, rounds):
        """Expectation-maximisation of the proportions, all documents at once."""
        for _ in range(rounds):
            part = likely * shares[inverse]
            part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
            shares = np.add.reduceat(part, heads, axis=0) / lengths[:, None]
        return shares


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without text, with lang_pred, score (the share of that language) and shares (lang to share, of the chosen set).

    A narrow operation; the model, of bounded size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logs))
    results = {"lang_pred": "string", "score": "double", "shares": "map<string,double>"}
    docs, names, schema = common.reduced(docs, [text], results, last=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.langs, own.logs = shared.value
        for batch, texts in common.chunks(batches, len(names), 1 << 20):
            known = np.array([bool(own.langs) and t is not None and common.has_letter(t.decode()) for t in texts])
            langs, scores, sets = ["und"] * len(texts), np.zeros(len(texts)), [{}] * len(texts)
            if known.any():
                whole, chosen = own.infer([t for t, k in zip(texts, known) if k])
                for i, a, b in zip(np.flatnonzero(known), whole, chosen):
                    if b.any():
                        top = int(b.argmax())
                        langs[i], scores[i] = own.langs[top], min(1.0, float(a[top]))
                        sets[i] = {own.langs[j]: float(b[j]) for j in np.flatnonzero(b > 0)}
            shares = pa.array([list(x.items()) for x in sets], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs), pa.array(scores), shares], [*names, *results])

    return docs.mapInArrow(run, schema)


def predicted(spark, sf_dir: str) -> DataFrame:
    """The query: learned from two thirds of the documents, predicted for all."""
    docs = common.read(spark, sf_dir, "documents")
    held_out = common.doc_remainder(F.col("doc_id"), 3) == 1
    model = Model.learn(docs.where(~held_out))
    found = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("shares").alias("n_langs"))
