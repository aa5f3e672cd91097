"""Repeated substrings by enhanced suffix arrays.

Every string of LENGTH bytes has one anchor: of the ANCHOR-byte strings in it, the one with the least hash, the
first of equals. Equal strings have equal anchors at equal places, so strings that start one after the other
and share an anchor's place make a segment, and repeats are only looked for among segments whose anchors have
equal hashes. Segments with equal bytes are one class, with as many members.

Strings of classes that share an anchor can only be equal if they start as far before it. So the suffix array is
kept by that distance: for distance 0 the classes are sorted by the bytes from the anchor on, with the common
prefixes of neighbours, and one step to the left sorts those of equal left sides by one byte more. For each
distance a stack scan gives the tree of intervals with a common prefix of LENGTH bytes or more; an interval is
scanned where its suffixes can't all be drawn out by the same byte to the left: it is a maximal repeat then, with
all of its occurrences, which are those of all members of its classes. A class with several members is one as well.
What repeats cover is removed. (A repeat is maximal within its segments; a longer one is a series of these.)

An anchor that over MOST classes share is parted: the strings that start LOW to HIGH bytes before it all hold the
bytes from LOW before it to LENGTH - HIGH after its start, so classes meet again by those bytes, cut to what the
strings of the range cover. Equal ones are then one class. Ranges are halved until few classes are left; a
range of one distance leaves one class. No group of classes so ever has to be in one task, and none is left out.

Matches never cross documents. A null or empty text, or one of fewer bytes, has no repeats; the digest of a null one is
that of no bytes. Rows are told apart by a hash of id and text, so repeated rows are repeats of each other. An empty
table gives an empty one. Long texts are cut piece by piece. Columns but doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, ANCHOR = 400, 64
#: Classes of an anchor that are scanned in one task, at most; those of more are parted first.
MOST = 2000
#: Bytes that are scanned side by side, about.
ARRAY_BYTES = 4 << 20
#: Up to so many shared anchors, a filter of 16 bits each (8 MB at most) is broadcast; beyond, texts are joined with what is wanted of them.
FILTER_KEYS = 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the size bytes (a power of two, 8 or more) from each place."""
    n = len(data) - size + 1
    padded = data.astype(np.uint64)
    word = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        word |= padded[k : k + len(word)] << np.uint64(8 * k)
    word *= _MIX
    word ^= word >> np.uint64(29)
    span = 8
    while span < size:
        word = (word[:-span] * _MIX) ^ word[span:]
        word ^= word >> np.uint64(31)
        word *= _MIX
        span *= 2
    word ^= word >> np.uint64(30)
    return word[:n]


def _least(values: np.ndarray, window: int) -> np.ndarray:
    """The least value in each window."""
    n = len(values) - window + 1
    padded = np.full(-(-len(values) // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, window)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[window - 1 : window - 1 + n])


def cut(data: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments of a text: first and last start of their strings, the anchor's place and its hash."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = [[], [], [], []]
    window, piece = length - anchor + 1, 1 << 22
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(data) - length + 1, piece):  # the places of a piece fit beside the hash
        own = _hashes(whole[at : at + piece + length - 1], anchor)
        packed = (own >> np.uint64(24) << np.uint64(24)) | np.arange(len(own), dtype=np.uint64)
        where = (_least(packed, window) & np.uint64((1 << 24) - 1)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        for x, values in zip(out, (starts + at, np.append(starts[1:], len(where)) - 1 + at, where[starts] + at, own[where[starts]])):
            x.append(values)
    return tuple(map(np.concatenate, out))


def intervals(prefixes: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of each interval of sorted suffixes whose common prefix is at least length, inner ones first.

    prefixes: how much each suffix has in common with the one before it.
    """
    wide = np.flatnonzero(prefixes >= length)
    if not len(wide):
        return
    values = prefixes[wide].tolist()
    stack: list[tuple[int, int]] = []
    before = None
    for at, value in zip(wide.tolist(), values):
        if before is not None and at != before + 1:
            while stack:
                depth, left = stack.pop()
                yield depth, left, before
        left = at - 1
        while stack and stack[-1][0] > value:
            depth, left = stack.pop()
            yield depth, left, at - 1
        if not stack or stack[-1][0] < value:
            stack.append((value, left))
        before = at
    while stack:
        depth, left = stack.pop()
        yield depth, left, before


class _Least:
    """The least of any stretch of an array, from tables of stretches of 1, 2, 4 ... values."""

    def __init__(self, values: np.ndarray, longest: int):
        self.tables = [values]
        step = 1
        while 2 * step <= longest:
            last = self.tables[-1].copy()
            last[:-step] = np.minimum(last[:-step], last[step:])
            self.tables.append(last)
            step *= 2
        self.tables = np.stack(self.tables)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        level = np.frexp((stop - start).astype(np.float64))[1] - 1
        return np.minimum(self.tables[level, start], self.tables[level, stop - (1 << level)])


def scan(texts: list[bytes], place: np.ndarray, members: np.ndarray, group: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """The maximal repeats of classes, a distance from the anchor at a time.

    texts: the classes' bytes, those that share an anchor (the same number in group) one after the other; place: where
    the anchor is in each. Yields (classes, starts, repeats): suffixes in order, as numbers of classes and where they
    start in them, and (length, first, last) of each repeat, as places in that order; inner ones come first.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat, base, room = np.frombuffer(b"".join(texts), np.uint8), common.segments(sizes), sizes - place
    width = int(room.max())
    right = np.zeros((len(texts), width), np.uint8)
    nth = np.arange(int(room.sum())) - np.repeat(common.segments(room), room)
    right[np.repeat(np.arange(len(texts)), room), nth] = flat[np.repeat(base + place, room) + nth]
    turn = np.lexsort((room, right.view(f"S{width}").ravel(), group))  # a text that ends comes before those that go on
    place, room, sizes, members, group, base, right = (x[turn] for x in (place, room, sizes, members, group, base, right))
    differ = right[1:] != right[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), width)
    shared = np.minimum(shared, np.minimum(room[1:], room[:-1]))
    shared[group[1:] != group[:-1]] = -length
    del right, differ
    least = _Least(np.concatenate(([-length], shared)).astype(np.int32), int(np.bincount(group).max()))
    most = int(place.max())
    left = np.zeros((most + 1, len(texts)), np.uint8)  # the byte before the suffix that starts so far before the anchor
    nth = np.arange(int(place.sum())) - np.repeat(common.segments(place), place)
    left[nth, np.repeat(np.arange(len(texts)), place)] = flat[np.repeat(base + place - 1, place) - nth]

    own, run = np.arange(len(texts)), group
    for distance in range(most + 1):
        # classes that go so far back, those of equal left sides side by side and sorted by what follows
        alone = np.ones(len(own) + 1, bool)
        alone[1:-1] = run[1:] != run[:-1]
        single = alone[1:] & alone[:-1]
        if single.any():  # nothing else has its strings from here on
            several = own[single & (members[own] > 1)]
            if len(several):
                yield turn[several], np.zeros(len(several), np.int64), [(int(sizes[k]), i, i) for i, k in enumerate(several.tolist())]
            own, run = own[~single], run[~single]
        if not len(own):
            return
        heads = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        of_run = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(own))))
        ends = place[own] == distance
        before = np.where(ends, np.int64(256), left[distance, own])
        odd = ends | (before != before[heads][of_run])
        if not odd.any():
            continue  # all are drawn out to the left alike
        event = np.logical_or.reduceat(odd, heads)[of_run]
        which, code = own[event], before[event]
        prefixes = np.full(len(which), -1, np.int64)
        inside = np.flatnonzero(of_run[event][1:] == of_run[event][:-1]) + 1
        prefixes[inside] = distance + least(which[inside - 1] + 1, which[inside] + 1)
        changes = np.concatenate(([0], np.cumsum((code[1:] != code[:-1]) | (code[1:] == 256))))
        found = [(depth, a, b) for depth, a, b in intervals(prefixes, length) if code[a] == 256 or changes[b] > changes[a]]
        around = np.maximum(prefixes, np.append(prefixes[1:], -1))
        leaves = np.flatnonzero((code == 256) & (members[which] > 1) & (sizes[which] > around))
        found = [(int(sizes[which[k]]), k, k) for k in leaves.tolist()] + found
        if found:
            yield turn[which], place[which] - distance, found
        order = np.argsort(of_run * 257 + before, kind="stable")
        order = order[~ends[order]]
        own, run = own[order], (of_run * 257 + before)[order]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _covered(scanned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, start, end) of what the repeats cover, overlapping ones drawn together."""
    owners, starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for which, start, found in scanned:
        longest = np.zeros(len(which), np.int64)
        for depth, a, b in found:
            np.maximum(longest[a : b + 1], depth, out=longest[a : b + 1])
        own = np.flatnonzero(longest)
        owners.append(which[own])
        starts.append(start[own])
        ends.append(start[own] + longest[own])
    owner, start, end = map(np.concatenate, (owners, starts, ends))
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    room = int(end.max()) + 1
    reach = np.maximum.accumulate(owner * room + end)
    first = np.flatnonzero(np.concatenate(([True], (owner * room + start)[1:] > reach[:-1])))
    return owner[first], start[first], reach[np.append(first[1:], len(owner)) - 1] - owner[first] * room


def _segments(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(row, key, class, first, span, place) of every segment: class is a 128-bit hash of its bytes, span its last start less the first, place that of the anchor in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.chunks(batches, 1):
            rows, classes, out, digest = [], [], [[], [], [], []], xxhash.xxh3_128_digest
            for row, t in zip(batch.column(0).to_pylist(), texts):
                if not t or len(t) < length:
                    continue
                first, last, place, keys = cut(t, length, anchor)
                rows += [row] * len(first)
                view = memoryview(t)
                classes += [digest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist())]
                for x, values in zip(out, (keys.view(np.int64), first, last - first, place - first)):
                    x.append(values)
            key, first, span, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            values = [pa.array(rows, pa.binary()), pa.array(key), pa.array(classes, pa.binary()), pa.array(first), pa.array(span.astype(np.int32)), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(values, ["row", "key", "class", "first", "span", "place"])

    return docs.select("row", "text").mapInArrow(run, "row binary, key long, class binary, first long, span int, place int")


_HELD = "key long, class binary, bytes binary, span int, place int"


def _filtered(docs: DataFrame, shared: DataFrame, many: int, length: int, anchor: int) -> DataFrame:
    """The segments whose anchor is in shared, by a bitmap of 16 bits or more for each of the `many` keys (and a few others)."""
    bits = 1 << max(12, (16 * many).bit_length())
    words = shared.select((F.pmod("key", F.lit(bits)) / 64).cast("int").alias("word"), F.pmod("key", F.lit(64)).cast("int").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    found = np.zeros(bits // 64, np.int64)
    found[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    bitmap = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value
        for _, texts in common.chunks(batches, 0):
            out, digest = [[], [], [], [], []], xxhash.xxh3_128_digest
            for t in texts:
                if not t or len(t) < length:
                    continue
                first, last, place, keys = cut(t, length, anchor)
                keys = keys.view(np.int64)
                at = np.mod(keys, bits)
                own = np.flatnonzero((held[at // 64] >> (at % 64)) & 1)
                parts = [t[a : b + length] for a, b in zip(first[own].tolist(), last[own].tolist())]
                for x, values in zip(out, (keys[own].tolist(), map(digest, parts), parts, (last - first)[own].tolist(), (place - first)[own].tolist())):
                    x += values
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["key", "class", "bytes", "span", "place"])

    return docs.select("text").mapInArrow(run, _HELD)


def _joined(docs: DataFrame, classes: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """The same, of one member of each class, by a join of the texts with what is wanted of them."""
    wanted = classes.join(shared.select("key"), "key").select("at.row", F.struct("key", "class", "span", "place", F.col("at.first").alias("first")).alias("part"))
    wanted = wanted.groupBy("row").agg(F.collect_list("part").alias("parts"))  # as many as the text has segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.chunks(batches, 0):
            rows = [(p["key"], p["class"], t[p["first"] : p["first"] + p["span"] + length], p["span"], p["place"]) for t, parts in zip(texts, batch.column(1).to_pylist()) for p in parts]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["key", "class", "bytes", "span", "place"])

    return docs.select("row", "text").join(wanted, "row").select("text", "parts").mapInArrow(run, _HELD)


_FOUND = "key long, class binary, start long, end long, repeat binary"


def _scanned(length: int, named: bool):
    """For whole anchors, about ARRAY_BYTES at once: (key, class, start, end) of what repeats cover; if named, of each repeat in each class, with a hash of its bytes."""

    def flush(keys: list[int], classes: list[bytes], texts: list[bytes], place: list[int], members: list[int]) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate(([0], np.diff(np.array(keys)) != 0)))
        found = scan(texts, np.array(place, np.int64), np.array(members, np.int64), group, length)
        repeat = None
        if named:
            rows = [(w, s, s + depth) for which, start, own in found for depth, a, b in own for w, s in zip(which[a : b + 1].tolist(), start[a : b + 1].tolist())]
            owner, start, end = (np.array([r[k] for r in rows], np.int64) for k in range(3))
            repeat = [xxhash.xxh3_128_digest(texts[w][a:b]) for w, a, b in rows]
        else:
            owner, start, end = _covered(found)
        own = owner.tolist()
        values = [pa.array([keys[k] for k in own], pa.int64()), pa.array([classes[k] for k in own], pa.binary()), pa.array(start), pa.array(end), pa.array(repeat or [None] * len(own), pa.binary())]
        return pa.RecordBatch.from_arrays(values, ["key", "class", "start", "end", "repeat"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], [], [], []), 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if held[0] and row[0] != held[0][-1] and size >= ARRAY_BYTES:
                    yield flush(*held)
                    held, size = ([], [], [], [], []), 0
                for x, value in zip(held, row):
                    x.append(value)
                size += len(row[2])
        if held[0]:
            yield flush(*held)
        common.trim()

    return run


_PART = f"{_HELD}, members long, low int, high int, parent_key long, parent binary, shift int"


def _halved(length: int):
    """Each class's strings by the halves of their range: what they cover, and the hash of what all strings of the half have in common with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "class", "bytes", "span", "place", "members", "low", "high", "parent_key", "parent", "shift"]
        for batch in batches:
            rows = []
            for key, name, data, span, place, members, low, high in zip(*(batch.column(n).to_pylist() for n in names[:8])):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    near, far = max(a, place - span), min(b, place)  # distances from the anchor
                    if a <= b and near <= far:
                        own = data[place - far : place - near + length]
                        core = xxhash.xxh64_intdigest(data[place - a : place - b + length], key & 0xFFFFFFFF)
                        core = (core ^ (a << 20 | b) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
                        rows.append((core - (1 << 64) if core >> 63 else core, xxhash.xxh3_128_digest(own), own, far - near, far, members, a, b, key, name, place - far))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return run


def _repeated(held: DataFrame, length: int, named: bool) -> DataFrame:
    """_FOUND of classes (key, class, bytes, span, place, members, classes, low, high): classes is how many share the key."""
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = held.where(F.col("classes") <= MOST).select("key", "class", "bytes", "place", "members")
    few = few.repartition(parts, "key").sortWithinPartitions("key", "class")
    found = few.mapInArrow(_scanned(length, named), _FOUND)
    crowded = held.where(F.col("classes") > MOST)
    if crowded.isEmpty():
        return found
    halves = common.durable(crowded.select("key", "class", "bytes", "span", "place", "members", "low", "high").mapInArrow(_halved(length), _PART))
    own = halves.groupBy("key", "class").agg(*[F.first(n).alias(n) for n in ("bytes", "span", "place", "low", "high")], F.sum("members").alias("members"))
    own = common.durable(own)
    held = own.join(common.durable(own.groupBy("key").agg(F.count(F.lit(1)).alias("classes"))), "key").where("classes > 1 or members > 1")
    inner = common.durable(_repeated(held, length, named))
    up = halves.select("key", "class", "parent_key", "parent", "shift").join(inner, ["key", "class"])
    up = up.select(F.col("parent_key").alias("key"), F.col("parent").alias("class"), (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end"), "repeat")
    return found.unionByName(up)


def _all(docs: DataFrame, length: int, anchor: int, named: bool) -> tuple[DataFrame, DataFrame]:
    """The segments of docs (row, text), and _FOUND of their classes."""
    found = common.durable(_segments(docs, length, anchor))
    classes = common.durable(found.groupBy("key", "class").agg(F.count(F.lit(1)).alias("members"), F.first("span").alias("span"), F.first("place").alias("place"), F.min(F.struct("row", "first")).alias("at")))
    counted = classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.max("members").alias("most"), F.first("class").alias("class"), F.first("span").alias("span"))
    counted = common.durable(counted.where("classes > 1 or most > 1"))
    whole = counted.where("classes = 1").select("key", "class", F.lit(0).cast("long").alias("start"), (F.col("span") + length).cast("long").alias("end"), F.col("class").alias("repeat"))
    shared = counted.where("classes > 1").select("key", "classes")
    many = shared.count()
    taken = _filtered(docs, shared, many, length, anchor) if many <= FILTER_KEYS else _joined(docs, classes, shared, length)
    taken = taken.groupBy("key", "class").agg(*[F.first(n).alias(n) for n in ("bytes", "span", "place")])
    members = classes.join(shared, "key").select("key", "class", "members", "classes")
    held = taken.join(members, ["key", "class"]).withColumns({"low": F.lit(0), "high": F.lit(length - anchor)})
    return found, whole.unionByName(_repeated(common.durable(held), length, named))


def maximal_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(repeat, doc_id, start, end) of every occurrence of every maximal repeat of docs (doc_id, text), in bytes; repeat is a 128-bit hash of its bytes."""
    docs = _rows(docs)
    found, repeats = _all(docs, length, anchor, named=True)
    places = found.join(common.durable(repeats), ["key", "class"])
    places = places.select("repeat", "row", (F.col("start") + F.col("first")).alias("start"), (F.col("end") + F.col("first")).alias("end"))
    return places.join(docs.select("row", "doc_id"), "row").select("repeat", "doc_id", "start", "end").distinct()


def _rows(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    row = F.unhex(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), "text")))
    return docs.select(doc_id.alias("doc_id"), F.col("text").alias("text"), row.alias("row"))


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(row, spans: array of (start, end) in bytes) of the rows of docs (row: binary, text) that have repeats. A hot class is one side's hot key in a plain join, which Spark can split."""
    found, covered = _all(docs, length, anchor, named=False)
    spans = covered.groupBy("key", "class").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # within a segment: few bytes
    placed = found.select("row", "key", "class", "first").join(common.durable(spans), ["key", "class"])
    placed = placed.select("row", F.transform("spans", lambda s: F.struct((s["start"] + F.col("first")).alias("start"), (s["end"] + F.col("first")).alias("end"))).alias("spans"))
    return placed.groupBy("row").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def remove(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """docs (doc_id, text) with kept (binary), n_bytes, n_removed and n_spans in place of text."""
    docs = _rows(docs)
    spans = repeats(docs.select("row", "text"), length, anchor)
    joined = docs.join(spans, "row", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.chunks(batches, 1):
            kept, removed, count = [], [], []
            for t, spans in zip(texts, batch.column(2).to_pylist()):
                t = t or b""
                merged = _merge([(s["start"], s["end"]) for s in spans or ()])
                edges = [0, *(x for span in merged for x in span), len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append(sum(b - a for a, b in merged))
                count.append(len(merged))
            n_bytes = [len(t or b"") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, count))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def query(spark, sf_dir: str) -> DataFrame:
    """The query: what is left of every document, as counts and a digest."""
    found = remove(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_removed", "n_spans", "n_bytes", F.sha2("kept", 256).alias("kept_sha256"))


def oracle() -> str:
    """The query in SQL: every string by its hash. Bytes are written in hexadecimal, in pieces, as a place in a long text is slow to reach."""
    piece, size = 2000, 2 * LENGTH
    return f"""WITH doc AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pce AS (SELECT r, a, substr(h, 2 * a + 1, {2 * (piece + LENGTH - 1)}) AS h FROM (SELECT r, h, unnest(range(0, length(h) // 2, {piece})) AS a FROM doc)),
str AS (SELECT r, a + i AS p, md5(substr(h, 2 * i + 1, {size})) AS s FROM (SELECT r, a, h, unnest(range(0, least({piece}, length(h) // 2 - {LENGTH - 1}))) AS i FROM pce WHERE length(h) >= {size})),
dup AS (SELECT r, p FROM str WHERE s IN (SELECT s FROM str GROUP BY s HAVING count(*) > 1)),
isl AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS n FROM (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM dup)),
run AS (SELECT r, min(p) AS a, max(p) + {LENGTH} AS b FROM isl GROUP BY r, n),
gap AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM run UNION ALL SELECT r, max(b), NULL FROM run GROUP BY r UNION ALL SELECT r, 0, NULL FROM doc WHERE r NOT IN (SELECT r FROM run)),
kept AS (SELECT r, string_agg(CASE WHEN gap.b IS NULL THEN substr(h, 2 * gap.a + 1) ELSE substr(h, 2 * gap.a + 1, 2 * (gap.b - gap.a)) END, '' ORDER BY gap.a) AS k FROM gap JOIN doc USING (r) GROUP BY r),
cnt AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM run GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM doc JOIN kept USING (r) LEFT JOIN cnt USING (r)"""
