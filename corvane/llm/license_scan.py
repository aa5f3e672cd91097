"""Licence texts and notices found by the Dice coefficient over word bigrams.

Texts and templates become lower-case words of letters and digits. Dice is twice the shared bigrams over the sum of
both counts (multisets). A template is compared with the whole text, and with every stretch of as many words as it has
(fewer at the text's end) that begins with one of its bigrams. A result of at least t needs t / (2 - t) of the
template's bigrams, and as many or up to (2 - t) / t of them in what it is compared with: templates that the
text has too few bigrams for are left out before any comparison, and so are whole texts of another size.

The templates are the texts in the folder licences: whole licences, and the notices that refer to one. Any other
mapping of names to texts can be given.

Null, empty and one-word texts match nothing. A document gets one row for each template it matches: the best
place, the first one of equals, the whole text last. Repeated rows give repeated results, an empty table gives none.
Stretches of long texts are gone through with counts that are kept up from one to the next. Columns named like
a result are replaced, others but the text are passed on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 0.8
RESULTS = {"license": "string", "dice": "double", "start_word": "long", "n_words": "long"}

_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def templates() -> dict[str, str]:
    """The texts of the folder licences, by name; notices.txt has one in each line."""
    found = {}
    for path in sorted((Path(__file__).parent / "licences").glob("*.txt")):
        content = path.read_text(encoding="utf-8")
        if path.stem == "notices":
            found |= dict(line.split(": ", 1) for line in content.splitlines() if line)
        else:
            found[path.stem] = content
    return found


def words_of(text: bytes) -> list[bytes]:
    return _words(text.lower())


def dice(shared: int, left: int, right: int) -> float:
    return 2.0 * shared / (left + right) if left + right else 0.0


class Scanner:
    """The templates' bigrams as numbers, and which templates have each how often."""

    def __init__(self, texts: dict[str, str], least: float):
        self.least, self.names, self.counts, self.numbers = least, sorted(texts), [], {}
        self.sizes = []
        for name in self.names:
            words = words_of(texts[name].encode())
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            self.sizes.append(max(0, len(words) - 1))
            self.counts.append(Counter(zip(own, own[1:])))
        self.base = len(self.numbers) + 1
        pairs = sorted({a * self.base + b for c in self.counts for a, b in c})
        self.pairs = np.array([*pairs, np.iinfo(np.int64).max], np.int64)
        at = {pair: i for i, pair in enumerate(pairs)}
        self.has = np.zeros((len(self.names), len(pairs)), np.int64)  # templates times their bigrams: of the templates' size
        for i, c in enumerate(self.counts):
            for (a, b), n in c.items():
                self.has[i, at[a * self.base + b]] = n

    def scan(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """(template, Dice, first word, words) of each template that the text has."""
        get = self.numbers.get
        own = [get(w, 0) for w in words_of(text)]
        if len(own) < 2 or not any(own):
            return []
        numbers = np.array(own, np.int64)
        keys = numbers[:-1] * self.base + numbers[1:]
        which = np.searchsorted(self.pairs, keys)
        places = np.flatnonzero(self.pairs[which] == keys)
        if not len(places):
            return []
        which, bigrams = which[places], len(numbers) - 1
        there, often = np.unique(which, return_counts=True)
        shared = np.minimum(self.has[:, there], often).sum(1)
        out = []
        for i in np.flatnonzero(shared > 0).tolist():
            size = self.sizes[i]
            if shared[i] < self.least / (2 - self.least) * size:
                continue
            best = self._window(self.has[i], which, places, size, bigrams)
            if self.least / (2 - self.least) * size <= bigrams <= (2 - self.least) / self.least * size:
                best = max(best, (dice(int(shared[i]), size, bigrams), -len(numbers), len(numbers)))
            if best[0] >= self.least:
                out.append((self.names[i], best[0], 0 if best[1] == -len(numbers) else -best[1], best[2]))
        return out

    def _window(self, has: np.ndarray, which: np.ndarray, places: np.ndarray, size: int, bigrams: int) -> tuple[float, int, int]:
        """(Dice, minus the first word, words) of the best stretch of size bigrams that begins at one of the template's."""
        own = has[which] > 0
        which, places = which[own].tolist(), places[own].tolist()
        have, shared, stop, best = dict.fromkeys(which, 0), 0, 0, (0.0, 0, 0)
        limit = {b: int(has[b]) for b in have}
        for start, place in enumerate(places):
            while stop < len(places) and places[stop] < place + size:
                b = which[stop]
                have[b] += 1
                shared += have[b] <= limit[b]
                stop += 1
            length = min(size, bigrams - place)
            found = (dice(shared, size, length), -place, length + 1)
            if found > best:
                best = found
            b = which[start]
            shared -= have[b] <= limit[b]
            have[b] -= 1
        return best


def scan(docs: DataFrame, texts: dict[str, str] | None = None, least: float = LEAST, text: str = "text") -> DataFrame:
    """A row for each document and template it has: docs without text, license, dice, start_word, n_words. No shuffle.

    The templates go to the executors as they are, with their words as numbers: as large as what is given.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates() if texts is None else texts, least))
    docs, names, schema = common.reduced(docs, [text], RESULTS, last=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch, own in common.chunks(batches, len(names)):
            found = [(i, *hit) for i, t in enumerate(own) if t for hit in scanner.scan(t)]
            kept = batch.take(pa.array([f[0] for f in found], pa.int64()))
            more = [pa.array([f[k] for f in found], kind) for k, kind in ((1, pa.string()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *more], [*names, *RESULTS])

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """The query: the licences of every document that has any."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "license", F.round("dice", 6).alias("dice"), "start_word", "n_words")


def oracle() -> str:
    """The query in SQL, with the templates as rows."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates().items())
    words = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    need = f"{LEAST} / (2 - {LEAST})"
    return f"""WITH tw AS (SELECT name AS license, {words} AS w FROM (VALUES {rows}) t(name, text)),
dw AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
tb AS (SELECT license, len(w) - 1 AS size, w[i] || ' ' || w[i + 1] AS b FROM (SELECT license, w, unnest(range(1, len(w))) AS i FROM tw)),
tc AS (SELECT license, size, b, count(*) AS own FROM tb GROUP BY ALL),
db AS (SELECT doc_id, n, i - 1 AS place, w[i] || ' ' || w[i + 1] AS b FROM (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w))) AS i FROM dw)),
hit AS (SELECT doc_id, n, place, db.b, license, size, own FROM db JOIN tc ON db.b = tc.b),
whole AS (SELECT doc_id, license, any_value(n) AS n, any_value(size) AS size, sum(least(c, own))::BIGINT AS shared FROM (SELECT doc_id, license, b, any_value(n) AS n, any_value(size) AS size, any_value(own) AS own, count(*) AS c FROM hit GROUP BY doc_id, license, b) GROUP BY doc_id, license),
few AS (SELECT * FROM whole WHERE shared >= {need} * size),
own AS (SELECT hit.* FROM hit JOIN few USING (doc_id, license)),
win AS (SELECT s.doc_id, s.license, s.place, h.b, any_value(s.n) AS n, any_value(s.size) AS size, any_value(h.own) AS own, count(*) AS c FROM (SELECT DISTINCT doc_id, license, place, n, size FROM own) s JOIN own h ON s.doc_id = h.doc_id AND s.license = h.license AND h.place >= s.place AND h.place < s.place + s.size GROUP BY s.doc_id, s.license, s.place, h.b),
cmp AS (SELECT doc_id, license, 2.0::DOUBLE * sum(least(c, own)) / (any_value(size) + least(any_value(size), any_value(n) - 1 - place)) AS dice, place AS start_word, least(any_value(size), any_value(n) - 1 - place) + 1 AS n_words, 0 AS last FROM win GROUP BY doc_id, license, place
UNION ALL SELECT doc_id, license, 2.0::DOUBLE * shared / (size + n - 1), 0, n, 1 FROM few WHERE n - 1 BETWEEN {need} * size AND size / ({need}))
SELECT doc_id, license, round(dice, 6) AS dice, start_word::BIGINT AS start_word, n_words::BIGINT AS n_words FROM cmp WHERE dice >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, last, start_word) = 1"""
