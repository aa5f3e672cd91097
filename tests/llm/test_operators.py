"""Each operator against a brute-force version on small tables with nulls, empty and repeated rows, and other columns."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import byte_bpe, decontaminate, knn_quality, language_id, license_scan, ngram_lm, passage_dedup, quality_rules, simhash, suffix_dedup
from corvane.llm.components import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long"


def words(rng, n, vocabulary=200, prefix="w"):
    return " ".join(f"{prefix}{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, words(rng, rng.randrange(5, 160)), rng.choice(["en", "fr", None]), "s", 1, 0.5, 9) for i in range(40)]
    base = out[7][1] + " " + words(rng, 120)
    out += [(100 + i, base, "en", "s", 1, 0.5, 9) for i in range(6)]
    out += [(120, base + " tail here", "en", None, None, None, None), (121, None, None, "s", 1, 0.5, 9), (122, "", "en", "s", 1, 0.5, 9), (123, "one", "en", "s", 1, 0.5, 9)]
    out += [(124, "ab" * 900, "en", "s", 1, 0.5, 9), (100, base, "en", "s", 1, 0.5, 9), (125, "The the " * 60, "en", "s", 1, 0.5, 9), (126, " \n\t x\n\n", "en", "s", 1, 0.5, 9)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_base_counts(docs, rows, empty):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for doc_id, text, *_ in rows:
        own = [w.decode() for w in (text or "").encode().split()]
        windows = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
        often, covered = Counter(windows), set()
        for i, w in enumerate(windows):
            if often[w] > 1:
                covered |= set(range(i, i + 5))
        lines, dup, seen = (text or "").split("\n"), 0, set()
        for line in lines:
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        r = got[doc_id]
        expected = (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(own) < 10 or 100 * len(covered) > 20 * len(own))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(empty).count() == 0


def test_quality_distance_is_jensen_shannon(spark):
    texts = [(i, "der die das und wort Satz. " * 12, "de") for i in range(12)] + [(99, "%%% ### $$$ !!! " * 30 + words(random.Random(1), 60), "de")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    refs = quality_rules.references(docs)
    assert [r["lang"] for r in refs] == ["de"]
    got = {r["doc_id"]: r["distance"] for r in quality_rules.distances(quality_rules.measure(docs), refs).select("doc_id", "distance").collect()}
    own = texts[0][1].split()
    share, common = Counter(own), refs[0]["common"]
    p = np.array([share[w] / len(own) for w in common] + [sum(n for w, n in share.items() if w not in common) / len(own)])
    q = np.array([*common.values(), 1 - sum(common.values())])
    half = lambda a, m: float(np.sum(np.where(a > 0, a * np.log2(np.maximum(a, 1e-300) / m), 0)))
    m = np.maximum((p + q) / 2, 1e-300)
    assert got[0]["w"] == pytest.approx(max(0, (half(p, m) + half(q, m)) / 2) ** 0.5, abs=1e-9)
    assert got[99]["c"] > 0.3 > got[0]["c"]


def test_quality_of_languages_without_reference(spark):
    rng = random.Random(2)
    texts = [(i, words(rng, 80, 300, "wort"), "de") for i in range(12)]
    texts += [(50, " ".join("語" * 3 + chr(0x4E00 + rng.randrange(500)) for _ in range(80)), "ja"), (51, "$$$ 111 " * 60, "ja")]
    texts += [(52, " ".join("語" * 3 + chr(0x4E00 + rng.randrange(500)) for _ in range(80)), None)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()}
    assert kept[50] and not kept[51] and not kept[52] and kept[0]


def test_quality_has_references_of_all_languages(spark):
    texts = [(i, f"a b c d e w{i % 66}", f"l{i % 66}") for i in range(660)]
    assert len(quality_rules.references(spark.createDataFrame(texts, "doc_id long, text string, lang string"))) == 66


def test_align_matches_plain_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 12))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i, j] = max(0, table[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == table.max()


def test_leaks(spark, docs, empty):
    rng = random.Random(8)
    item = words(rng, 30, 5000, "q")
    edited = item.split()
    for i in (4, 13, 22):
        edited[i] = "changed"
    found = docs.select("doc_id", "text").union(spark.createDataFrame([(500, "Some words, " + item.upper() + " and more"), (501, " ".join(edited)), (502, item.split()[3])], "doc_id long, text string"))
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, words(rng, 25, 5000, "z"))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(found, benchmark).collect()}
    assert set(got) == {(500, 1), (501, 1)}
    assert got[500, 1] == 1.0 and 0.7 < got[501, 1] < 1
    assert decontaminate.leaks(empty, benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.where("false")).count() == 0


def test_leaks_are_those_of_all_pairs(spark):
    rng = random.Random(12)
    items = {i: words(rng, n, 3000, "q").split() for i, n in enumerate([20, 30, 30, 45, 12, 3])}
    texts = {}
    for i, item in items.items():
        for edits in range(4, 9) if len(item) > 12 else range(1, 4):
            for kind in ("even", "random", "insert", "delete"):
                own = item.copy()
                at = range(edits, len(own), max(1, len(own) // edits)) if kind == "even" else sorted(rng.sample(range(len(own)), min(edits, len(own))), reverse=True)
                for k in at:
                    own[k : k + (kind != "insert")] = [] if kind == "delete" else [f"new{rng.randrange(99)}"]
                texts[len(texts)] = words(rng, rng.randrange(40), 3000, "q").split() + own + words(rng, 30, 3000, "q").split()
    # every fourth word is another one: no four words in a row are left
    texts[len(texts)] = [w if k % 4 != 3 else "x" for k, w in enumerate(items[1])]
    texts[len(texts)] = items[2]  # an exact copy
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    numbers: dict[str, int] = {}
    as_numbers = lambda own: np.array([numbers.setdefault(w, len(numbers)) for w in own], np.int64)
    expected = {}
    for d, text in texts.items():
        for i, item in items.items():
            points, start, end = decontaminate.align(as_numbers(item), as_numbers(text))
            if points >= decontaminate.LEAST * len(item):
                expected[d, i] = (points / len(item), start, end)
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["start_word"], r["end_word"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got == expected and len(expected) > 60


def plain_fingerprint(text):
    own = [w for w in (text or "").encode().lower().split()]
    if not own:
        return 0
    import xxhash

    parts = [b" ".join(own)] if len(own) < 3 else [b" ".join(own[i : i + 3]) for i in range(len(own) - 2)]
    values = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


@pytest.mark.parametrize("shard,most", [(8, 12), (20_000, 500_000), (40, 3)])
def test_simhash_groups(docs, rows, empty, monkeypatch, shard, most):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "MOST", most)
    monkeypatch.setattr(simhash, "LEAST_SAMPLE", 20)
    monkeypatch.setattr(simhash, "FEW", 4)
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows}
    up = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 3 and up[j] < up[i]:
                    up[i], changed = up[j], True
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["fingerprint"] & (2**64 - 1) == prints[r["doc_id"]] and r["component_id"] == up[r["doc_id"]]
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(up.values())) and kept.columns == docs.columns


def test_simhash_of_rows_that_share_an_id(spark):
    rng = random.Random(4)
    one, two, three = (words(rng, 60, 9000) for _ in range(3))
    rows = [(1, one, "a"), (1, two, "b"), (2, two, "c"), (3, three, "e"), (3, three, "d"), (None, one, "f"), (None, None, None), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 4), (5, 4)]
    kept = {tuple(r) for r in simhash.one_of_each(docs).collect()}
    assert kept == {(1, one, "a"), (1, two, "b"), (3, three, "d"), (None, one, "f"), (None, None, None), (4, None, None)}


def test_vantage_point_search_finds_all_pairs():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = centres[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64))
    points = np.unique(np.concatenate([centres, near]))
    a, b = simhash.link(points)
    groups = {int(p): int(p) for p in points}
    for x, y in zip(a.tolist(), b.tolist()):
        groups[x] = y
    for i, p in enumerate(points):
        for q in points[np.bitwise_count(points ^ p) <= 3]:
            assert groups[int(p)] == groups[int(q)]
    tree = simhash.Tree(points, 8)
    met = {(int(i), int(j)) for _, own in tree.route(points) for i in own for j in own}
    assert all((i, j) in met for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 3))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(50, 90)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(7, 7)] + [(1000, 1000 + i) for i in range(1, 60)]
    up = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in up:
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == up
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_licences(spark, empty):
    known = license_scan.templates()
    mit = known["mit-notice"]
    rows = [(1, f"words before\n{mit}\nand after"), (2, mit), (3, "nothing of the kind"), (4, None), (5, ""), (6, known["isc"].replace("without fee", "gratis")), (2, mit), (7, "before it " + known["apache-2.0"] + " and after it")]
    got = sorted((r["doc_id"], r["license"], r["dice"] == 1.0, r["start_word"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [g for g in got if g[0] != 7] == [(1, "mit-notice", True, 2), (2, "mit-notice", True, 0), (2, "mit-notice", True, 0), (6, "isc", False, 0)]
    assert (7, "apache-2.0", True, 2) in got
    assert license_scan.scan(empty).count() == 0


def test_licences_are_those_of_all_places():
    rng = random.Random(11)
    texts = {f"t{i}": words(rng, rng.randrange(2, 12), 6) for i in range(6)}
    least = 0.6
    scanner = license_scan.Scanner(texts, least)

    def dice(a, b):
        left, right = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
        return 2.0 * sum((left & right).values()) / (sum(left.values()) + sum(right.values()))

    found = 0
    for _ in range(600):
        own = words(rng, rng.randrange(2, 40), 6).split()
        expected = []
        for name, text in sorted(texts.items()):
            other = text.split()
            pairs, size = set(zip(other, other[1:])), len(other) - 1
            places = [i for i in range(len(own) - 1) if (own[i], own[i + 1]) in pairs]
            tried = [(dice(own[i : i + size + 1], other), -i, len(own[i : i + size + 1])) for i in places]
            if places and least / (2 - least) * size <= len(own) - 1 <= (2 - least) / least * size:
                tried.append((dice(own, other), -len(own), len(own)))
            best = max(tried, default=(0.0, 0, 0))
            if best[0] >= least:
                expected.append((name, best[0], 0 if best[1] == -len(own) else -best[1], best[2]))
        assert scanner.scan(" ".join(own).encode()) == expected
        found += len(expected)
    assert found > 100


def test_language_model(docs, rows, empty):
    from pyspark.sql import functions as F

    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    assert any(held.values())
    own = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).alias("held_out"), "text")
    seqs = [(r[0], [*(r[1] or "").encode().lower().split(), None]) for r in rows]
    uni, bi = Counter(), Counter()
    for i, seq in seqs:
        if not held[i]:
            uni.update(seq)
            bi.update(zip(["<s>", *seq], seq))
    n, v = sum(uni.values()), len(uni)
    starts = sum(not held[i] for i, _ in seqs)
    p = lambda w: (uni[w] + 1) / (n + v + 1)
    for r in ngram_lm.score(own, part_bytes=2000).collect():
        seq = next(s for i, s in seqs if i == r["doc_id"])
        total = lambda u: starts if u == "<s>" else uni[u]
        expected = sum(np.log10((bi[u, w] + 30 * p(w)) / (total(u) + 30)) for u, w in zip(["<s>", *seq], seq))
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(seq) and r["train_tokens"] == n
        assert r["n_known"] == sum(uni[w] > 0 for w in seq)
        assert r["base_score"] == pytest.approx(sum(np.log10(p(w)) for w in seq))
        assert r["score"] == pytest.approx(expected)
    assert ngram_lm.score(own.where("false")).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model_of_any_order(spark, rows, order):
    """The recursion itself, against the automaton's chains of failure arcs."""
    rows = [r for r in rows if r[1] is not None][:30]
    held = {r[0]: r[0] % 4 == 1 for r in rows}
    docs = spark.createDataFrame([(r[0], held[r[0]], r[1]) for r in rows], "doc_id long, held_out boolean, text string").repartition(3)
    seqs = [(r[0], ["<s>", *(r[1] or "").encode().lower().split(), None]) for r in rows]
    count = Counter()
    for i, seq in seqs:
        if not held[i]:
            for n in range(1, order + 1):
                count.update(tuple(seq[k : k + n]) for k in range(len(seq) - n + 1))
    words = {g: c for g, c in count.items() if len(g) == 1 and g != ("<s>",)}
    n, v = sum(words.values()), len(words)

    def p(context, word):
        if not context:
            return (words.get((word,), 0) + 1) / (n + v + 1)
        total, lower = count[context], p(context[1:], word)
        return (count[*context, word] + 30 * lower) / (total + 30) if total else lower

    for r in ngram_lm.score(docs, part_bytes=3000, order=order).collect():
        seq = next(s for i, s in seqs if i == r["doc_id"])
        expected = sum(np.log10(p(tuple(seq[max(0, k - order + 1) : k]), seq[k])) for k in range(1, len(seq)))
        assert r["score"] == pytest.approx(expected, rel=1e-9)


def test_languages(spark, empty):
    rng = random.Random(4)
    sounds = {"aa": ["ka", "mo", "ri"], "bb": ["schl", "ung", "eit"]}
    text = lambda k, n: " ".join("".join(rng.choice(sounds[k]) for _ in range(3)) for _ in range(n))
    train = spark.createDataFrame([(i, text(k, 60), k) for i, k in enumerate(["aa", "bb"] * 8)] + [(90, None, "aa"), (91, "kamori", None)], "doc_id long, text string, lang string")
    model = language_id.Model.learn(train)
    assert model.langs == ["aa", "bb"]
    rows = [(1, text("aa", 30)), (2, text("bb", 30)), (3, text("aa", 60) + " " + text("bb", 20)), (4, None), (5, "123 !?"), (6, "")]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["aa", "bb", "aa", "und", "und", "und"]
    assert set(got[1]["shares"]) == {"aa"} and set(got[3]["shares"]) == {"aa", "bb"} and 0.6 < got[3]["score"] < 0.9
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.Model.learn(empty)
    assert language_id.identify(train, nothing).where("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("most,keys", [(2000, 1 << 22), (1, 1 << 22), (3, 0)])
def test_repeated_bytes(spark, docs, rows, empty, monkeypatch, most, keys):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    monkeypatch.setattr(suffix_dedup, "FILTER_KEYS", keys)
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh \n") for _ in range(900))  # with other text around it in each document
    more = [(300 + i, words(rng, rng.randrange(60)) + passage[rng.randrange(200) : 900 - rng.randrange(200)] + words(rng, rng.randrange(60)), None, None, None, None, None) for i in range(12)]
    rows = rows + more + [(400, "\0" * 1000 + "é" * 300, None, None, None, None, None), (None, passage, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    seen = Counter()
    for r in rows:
        data = (r[1] or "").encode()
        seen.update(data[i : i + 400] for i in range(len(data) - 399))
    got = {r["doc_id"]: r for r in suffix_dedup.remove(docs).collect()}
    for r in rows:
        data = (r[1] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 399):
            if seen[data[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        own = got[r[0]]
        assert (bytes(own["kept"]), own["n_bytes"], own["n_removed"], own["n_spans"]) == (kept, len(data), sum(gone), spans)
    assert suffix_dedup.remove(empty).count() == 0


@pytest.mark.parametrize("most", [2000, 1])
def test_maximal_repeats_have_all_occurrences(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rng = random.Random(6)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(4, 30))) for _ in range(12)]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for i in range(40)}
    texts |= {50: texts[1], 51: texts[1], 52: "x" + texts[2], 53: "ab" * 30}
    where = {}
    for i, t in texts.items():
        for a in range(len(t)):
            for b in range(a + 12, len(t) + 1):
                where.setdefault(t[a:b], set()).add((i, a))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    groups = {}
    for r in suffix_dedup.maximal_repeats(docs, 12, 8).collect():
        groups.setdefault(bytes(r["repeat"]), set()).add((r["doc_id"], r["start"], r["end"]))
    covered = {i: bytearray(len(t)) for i, t in texts.items()}
    strings = set()
    for own in groups.values():
        found = {texts[i][a:b] for i, a, b in own}
        assert len(found) == 1
        string = found.pop()
        assert len(string) >= 12 and {(i, a) for i, a, _ in own} == where[string] and len(own) > 1
        strings.add(string)
        for i, a, b in own:
            covered[i][a:b] = b"\1" * (b - a)
    for string, places in where.items():
        if len(string) == 12 and len(places) > 1:
            assert any(string in s for s in strings)
            for i, a in places:
                assert all(covered[i][a : a + 12])


def test_scan_finds_what_a_plain_search_does():
    rng = random.Random(8)
    for _ in range(30):
        middle = bytes(rng.choice(b"xy") for _ in range(8))
        texts, place = [], []
        for _ in range(rng.randrange(2, 9)):
            left = bytes(rng.choice(b"ab") for _ in range(rng.randrange(5)))
            right = bytes(rng.choice(b"ab") for _ in range(rng.randrange(max(0, 4 - len(left)), 5)))
            texts.append(left + middle + right)
            place.append(len(left))
        texts, place = zip(*dict(zip(texts, place)).items())
        got = {}
        for which, start, found in suffix_dedup.scan(list(texts), np.array(place), np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64), 12):
            for depth, a, b in found:
                own = {(int(w), int(s)) for w, s in zip(which[a : b + 1], start[a : b + 1])}
                w, s = min(own)
                assert texts[w][s : s + depth] not in got
                got[texts[w][s : s + depth]] = own
        expected = {}
        for n in range(12, 17):
            for s in {t[i : i + n] for t in texts for i in range(len(t) - n + 1)}:
                places = {(k, i) for k, (t, p) in enumerate(zip(texts, place)) for i in range(p + 1) if t[i : i + n] == s}
                left = [None if i == 0 else texts[k][i - 1] for k, i in places]
                right = [None if i + n == len(texts[k]) else texts[k][i + n] for k, i in places]
                if len(places) > 1 and (None in left or len(set(left)) > 1) and (None in right or len(set(right)) > 1):
                    expected[s] = places
        assert got == expected


def test_passages(spark, empty):
    rng = random.Random(9)
    passage = words(rng, 80, 4000, "p").split()
    edited = passage.copy()
    edited[20], edited[50] = "new", "other"
    del edited[35]
    rows = [(1, words(rng, 40, 4000) + " " + " ".join(passage)), (2, " ".join(passage) + " " + words(rng, 30, 4000)), (3, words(rng, 50, 4000) + " " + " ".join(edited)), (4, words(rng, 100, 4000)), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = passage_dedup.passages(docs).collect()
    linked = {r["doc_id"] for r in got} | {r["other_id"] for r in got}
    assert linked == {1, 2, 3}
    assert any(r["doc_id"] == 2 and r["other_id"] == 1 and (r["start_word"], r["end_word"], r["n_same"]) == (0, 80, 80) for r in got)
    left = {r["doc_id"]: r["text"] for r in passage_dedup.without_repeats(docs).collect()}
    assert left[1] == rows[0][1] and left[4] == rows[3][1] and left[5] is None
    assert len(left[2].split()) == 30 and len(left[3].split()) <= 52
    assert passage_dedup.passages(empty).count() == 0


def test_passages_with_different_text_between(spark):
    rng = random.Random(14)
    rows, shared = [], {}
    for n, gaps in ((60, (0, 5, 20, 40, 60, 100, 150, 300)), (100, (20, 60, 130, 250)), (300, (100, 200, 500, 800))):
        for gap in gaps:
            for other_gap in {gap, gap + 7, gap // 2}:
                one, two = (words(rng, n, 10**6, "p") for _ in range(2))
                for g in (gap, other_gap):
                    head, between = words(rng, rng.randrange(40), 10**6, "h"), words(rng, g, 10**6, "g")
                    text = " ".join([head, one, between, two, words(rng, 30, 10**6, "t")]).split()
                    doc = len(rows)
                    at = len(head.split())
                    shared[doc] = set(range(at, at + n)) | set(range(at + n + g, at + n + g + n))
                    rows.append((doc, " ".join(text)))
    covered = {doc: set() for doc in shared}
    for r in passage_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["doc_id"] // 2 == r["other_id"] // 2
        length = max(r["end_word"] - r["start_word"], r["other_end"] - r["other_start"])
        assert r["n_same"] >= passage_dedup.SAME * length
        covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        covered[r["other_id"]] |= set(range(r["other_start"], r["other_end"]))
    assert [doc for doc in shared if shared[doc] - covered[doc]] == []


def edited(rng, own, every, how="even"):
    """A copy with an edit in every so many words (on average)."""
    out = []
    for i, w in enumerate(own):
        hit = i % every == every - 1 if how == "even" else rng.random() < 1 / every
        kind = rng.randrange(3) if hit else 3
        out += [f"new{rng.randrange(10**6)}"] if kind == 0 else [w, f"more{rng.randrange(10**6)}"] if kind == 1 else [] if kind == 2 else [w]
    return out


def agreeing(a, b):
    """The longest common subsequence, plainly."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_passage_among_pieces_of_it(spark):
    rng = random.Random(21)
    own = words(rng, 80, 10**6, "p").split()
    text = lambda middle: " ".join([words(rng, rng.randrange(60), 10**6, "h"), *middle, words(rng, rng.randrange(60), 10**6, "t")])
    rows = [(100, text(own)), (200, text(own))]
    for doc in (*range(1, 60), *range(101, 160), *range(201, 260)):
        at = rng.randrange(65)
        rows.append((doc, text(own[at : at + 16])))
    got = passage_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == {(200, 100)}
    assert sum(r["end_word"] - r["start_word"] for r in got) == 80


def test_passage_among_long_pieces_of_it(spark, monkeypatch):
    """The pieces have the contexts of the passage's seeds, too, but none of its strings of LEAST words."""
    rng = random.Random(22)
    own = words(rng, 80, 10**6, "p").split()
    text = lambda middle: " ".join([words(rng, rng.randrange(60), 10**6, "h"), *middle, words(rng, rng.randrange(60), 10**6, "t")])
    rows = [(100, text(own)), (200, text(own)), (300, text(own[15:65]))]
    for doc in (*range(1, 60), *range(101, 160), *range(201, 260)):
        at = rng.randrange(36)
        rows.append((doc, text(own[at : at + 45])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts, bits in ((1, 1 << 26), (5, 1 << 12)):
        monkeypatch.setattr(passage_dedup, "FILTER_BITS", bits)
        got = passage_dedup.passages(docs.repartition(parts)).collect()
        assert {(r["doc_id"], r["other_id"]) for r in got} >= {(200, 100), (300, 100)}
        assert {r["doc_id"] for r in got} | {r["other_id"] for r in got} == {100, 200, 300}
        assert {r["end_word"] - r["start_word"] for r in got if r["doc_id"] == 200} == {80}


def test_open_windows_are_those_without_two_rare_seeds():
    rng = np.random.default_rng(3)
    lengths = np.array([0, 3, 49, 50, 51, 300, 7, 200])
    hashes = rng.integers(0, 1 << 63, int(lengths.sum())).astype(np.uint64)
    text, at, *_ = passage_dedup.seeds_of(hashes, lengths)
    for share in (0, 0.05, 0.2, 1):
        rare = rng.random(len(at)) < share
        got = set(passage_dedup.open_windows(hashes, lengths, 50, text, at, rare).tolist())
        expected, start = set(), 0
        for t, n in enumerate(lengths.tolist()):
            own = at[rare & (text == t)].tolist()
            for i in range(n - 49):
                inside = [x for x in own if i <= x <= i + 45]
                nexts = [next((y for y in own if y >= x + 5), None) for x in inside]
                if not any(y in inside and y - x <= passage_dedup.STEP for x, y in zip(inside, nexts) if y is not None):
                    expected.add(start + i)
            start += n
        assert got == expected


def test_strings_that_a_better_chain_leaves(spark):
    """A passage ends with words that another string of 50 words begins with; a chain is on its way through both."""
    rng = random.Random(24)
    rows = []
    for k in range(12):
        own, more = words(rng, 60, 10**6, "p").split(), words(rng, 40, 10**6, "q").split()
        rows.append((2 * k, " ".join([*words(rng, 20, 10**6, "h").split(), *own, *more, words(rng, 20, 10**6, "t")])))
        rows.append((2 * k + 1, " ".join([*words(rng, 20, 10**6, "h").split(), *own, *words(rng, 30, 10**6, "g").split(), *own[50:], *more, words(rng, 20, 10**6, "t")])))
    got = [tuple(r) for r in passage_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    for k in range(12):
        spans = [r[1:3] + r[4:6] for r in got if (r[0], r[3]) == (2 * k + 1, 2 * k)]
        for a, b, c, d in ((20, 80, 20, 80), (110, 160, 70, 120)):
            assert any(s <= a and b <= e and t <= c and d <= u for s, e, t, u in spans), (k, spans)
    assert {(r[0], r[3]) for r in got} == {(2 * k + 1, 2 * k) for k in range(12)}


def test_repeated_words_in_longer_and_shorter_runs(spark):
    rng = random.Random(25)
    rows = []
    for k, line in enumerate(("run", "to and", "one two three four five six seven")):
        own = [f"{w}{k}" for w in line.split()] * 400
        rows += [(20 * k + j, " ".join([*words(rng, 20, 10**6, "h").split(), *own[:n], words(rng, 20, 10**6, "t")])) for j, n in enumerate((60, 333, 75, *[60] * 10))]
    got = {}
    for r in passage_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["doc_id"] // 20 == r["other_id"] // 20
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    for doc, text in rows:
        if doc % 20:
            assert got[doc] >= set(range(20, len(text.split()) - 20)), doc
    assert len(got) == len(rows) - 3


def test_links_that_chains_have_no_use_for():
    x, y = np.array([0, 4, 9, 40, 3, 30]), np.array([20, 24, 29, 60, 1, 51])
    assert passage_dedup.strays(x, y, 50) == [[0, 1, 2]]  # the others are too far on, or of another diagonal
    assert passage_dedup.strays(x[:2], y[:2], 50) == []


def test_passages_of_all_pairs(spark):
    rng = random.Random(5)
    rows, where = [], []
    for k in range(60):
        n, every = rng.choice([55, 80, 150, 400]), rng.choice([0, 0, 30, 20, 12, 10])
        own = words(rng, n, 10**6, "p").split()
        for copy in range(rng.choice([2, 2, 3, 14])):
            middle = edited(rng, own, every, rng.choice(["even", "random"])) if every and copy else own
            head = words(rng, rng.randrange(50), 10**6, "h").split()
            where.append((len(rows), k, middle))
            rows.append((len(rows), " ".join([*head, *middle, *words(rng, rng.randrange(50), 10**6, "t").split()])))
    linked = {}
    for r in passage_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        linked.setdefault(r["doc_id"], set()).add(r["other_id"])
        linked.setdefault(r["other_id"], set()).add(r["doc_id"])
        assert where[r["doc_id"]][1] == where[r["other_id"]][1]
    exact = lost = pairs = 0
    for i, k, a in where:
        for j, m, b in where[:i]:
            if k == m and agreeing(a, b) >= 0.8 * max(len(a), len(b)):
                pairs += 1
                reached, todo = {i}, [i]  # through other copies, too
                while todo:
                    new = linked.get(todo.pop(), set()) - reached
                    reached |= new
                    todo += new
                lost += j not in reached
                exact += a == b and j not in reached
    assert exact == 0 and lost <= 0.1 * pairs, (lost, pairs)


def test_passages_with_repeated_ids_and_other_names(spark):
    rng = random.Random(2)
    own, other = words(rng, 70, 10**6, "p"), words(rng, 90, 10**6, "q")
    rows = [(1, own, 1, "a"), (1, other, 2, "b"), (2, own, 3, "c"), (3, "x y z " + other, 4, "d"), (3, "x y z " + other, 5, "e"), (4, None, 6, "f"), (None, own, 7, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans long, hash string")
    got = {tuple(r) for r in passage_dedup.passages(docs).collect()}
    assert got == {(2, 0, 70, 1, 0, 70, 70), (3, 3, 93, 1, 0, 90, 90)}
    left = passage_dedup.without_repeats(docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([(1, own, 1, "a"), (1, other, 2, "b"), (3, "x y z ", 4, "d"), (3, "x y z ", 5, "e"), (4, None, 6, "f"), (None, own, 7, "g")], key=repr)


def test_passage_longer_than_what_is_fetched(spark):
    rng = random.Random(31)
    one = words(rng, 400, 10**6, "p").split()
    changed = [w if i % 4 or 60 < i < 90 else f"n{i}" for i, w in enumerate(one)]  # seeds in the middle only
    docs = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(changed))], "doc_id long, text string")
    for r in passage_dedup.passages(docs).collect():
        assert r["n_same"] >= 0.8 * (r["end_word"] - r["start_word"])
    both = words(rng, 30_000, 10**6, "w")
    got = passage_dedup.passages(spark.createDataFrame([(1, both), (2, "a " + both)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(2, 1, 30_001, 1, 0, 30_000, 30_000)]


def test_stretches_are_the_longest():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a = rng.integers(0, 10**9, 160).astype(np.uint64)
        b = a.copy()
        differ = rng.random(160) < np.repeat(rng.choice([0.0, 0.1, 0.3, 0.9], 8), 20)
        b[differ] += np.uint64(10**10)
        equal = np.concatenate(([0], np.cumsum(~differ)))
        own = [i for i in range(156) if not differ[i : i + 5].any()]
        if not own:
            continue
        x = np.array(own)
        borders = passage_dedup.path(a, b, x, x)
        start, end = int(borders[0, 0]), int(borders[-1, 0])
        if (borders[:, 0] != borders[:, 1]).any():
            continue  # drawn out over other words
        pairs = [(equal[j] - equal[i], j - i) for i in range(start, end) for j in range(i + 50, end + 1) if not differ[i] and not differ[j - 1] and equal[j] - equal[i] >= passage_dedup.SAME * (j - i)]
        got = passage_dedup.stretches(borders, 50)
        assert max((g[4] for g in got), default=0) == max((s for s, _ in pairs), default=0)
        assert all(j <= k for (_, j, *_), (k, *_) in zip(got, got[1:]))


def test_fenwick_chains_are_best():
    rng = random.Random(3)
    for _ in range(40):
        links = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(12)})
        x, y = np.array([a for a, _ in links]), np.array([b for _, b in links])
        best = [1.0] * len(links)
        for j in range(len(links)):
            for i in range(len(links)):
                if x[i] < x[j] and y[i] < y[j]:
                    best[j] = max(best[j], best[i] + 1 - passage_dedup.GAP * (x[j] - x[i] + y[j] - y[i]))
        found = passage_dedup.chains(x, y)
        if found:
            own = found[0]
            score = len(own) - passage_dedup.GAP * (x[own[-1]] - x[own[0]] + y[own[-1]] - y[own[0]])
            assert score == pytest.approx(max(best))
            assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(own, own[1:]))


@pytest.fixture(scope="module")
def ranks():
    tokenizers = pytest.importorskip("public_tokenizers")
    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read(), tokenizers.PATTERN


def test_bpe_equals_tiktoken_and_follows_edits(ranks):
    import tiktoken

    content, pattern = ranks
    voc = byte_bpe.vocabulary(content)
    encoder = byte_bpe.Encoder(voc, pattern)
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=voc.ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["a", "é", "the", " ", "  ", "\n", "12", "'s", "'", "日本", "🙂", "!!", "ing", "\xa0", "\x1c", "½"]) for _ in range(rng.randrange(40)))
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == plain.encode_ordinary(text)
        a = rng.randrange(len(text) + 1)
        b = min(len(text), a + rng.randrange(4))
        document = byte_bpe.Document(encoder, pattern, text)
        document.replace(a, b, "re x")
        assert document.tokens() == plain.encode_ordinary(document.text)
        table = byte_bpe.PrefixTable(voc, text.encode()).append(b"ing").replace(0, 0, b"th")
        assert table.last == byte_bpe.PrefixTable(voc, table.data).last
    long = " " * 3000 + "a" * 2000
    assert np.frombuffer(encoder.encode(long), np.int32).tolist() == plain.encode_ordinary(long)


def test_bpe_round_trip(docs, rows, empty, ranks):
    got = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.round_trip(docs, *ranks).collect()}
    assert got == {r[0]: (r[1] or "").encode() for r in rows}
    assert byte_bpe.round_trip(empty, *ranks).count() == 0


def test_quality_votes(spark, empty):
    rng = random.Random(7)
    rows = [(i, words(rng, 50) if i % 3 else "SPAM!! " * 30 + words(rng, 5)) for i in range(90)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(5, 1, 0), (None, 1, 0), (999, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in knn_quality.score(docs, docs, labels).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 92
    assert all((got[i] >= 0.3) == (i % 3 > 0) for i in range(60, 90))
    assert got[200] == got[201] == pytest.approx(2 / 3)
    assert {r["score"] for r in knn_quality.score(docs, docs, labels.where("false")).collect()} == {0.5}
    assert knn_quality.score(empty.select("doc_id", "text"), docs, labels).count() == 0


