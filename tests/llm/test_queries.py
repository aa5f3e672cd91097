"""The queries as they are registered, and the pipeline, on a small folder of tables: against SQL where there is any, else against brute force."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from corvane.llm import byte_bpe, decontaminate, knn_quality, language_id, license_scan, ngram_lm, passage_dedup, quality_rules, registry, simhash, suffix_dedup

SYLLABLES = {"aa": ["ka", "mo", "ri", "to"], "bb": ["schl", "ung", "eit", "er"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, documents, items): clean texts, copies, near copies, leaks, passages, notices, junk, nulls, a long text and repeated rows."""
    rng = random.Random(17)
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [[i, prose(rng, rng.choice(["aa", "bb"]), rng.randrange(30, 160))] for i in range(60)]
    items = {i: prose(rng, "aa", n) for i, n in enumerate((18, 25, 30, 2))}
    docs += [[100 + i, docs[3][1]] for i in range(5)]
    words = docs[8][1].split()
    docs += [[110, " ".join([*words[:-1], "other"])]]
    docs += [[120 + i, prose(rng, "aa", 30) + " " + items[i].upper() + " " + prose(rng, "aa", 20)] for i in range(3)]
    passage = prose(rng, "bb", 90)
    docs += [[130 + i, prose(rng, "bb", 40) + "\n" + passage + "\n" + prose(rng, "bb", 40)] for i in range(4)]
    docs += [[140, prose(rng, "aa", 40) + "\nReleased under the MIT License.\n"], [141, license_scan.templates()["mit"]], [142, "Licensed under the Apache License, Version 2.0!"]]
    docs += [[150, "$$$ ### 111 " * 60], [151, "buy now " * 50], [152, "short"], [153, ""], [154, None], [155, " \n\t \n"]]
    docs += [[160, prose(rng, "aa", 20_000)], [161, "ab" * 900], [60, docs[0][1]], [60, docs[0][1]]]
    rows = [(i, t, None if i % 13 == 0 else "bb" if t and "schl" in t else "aa", f"s{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*items.items(), (9, None), (10, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(r[0], int(r[0] < 140), 0) for r in rows if r[0] % 2 or r[0] >= 140]
    spark.createDataFrame([*labels, (None, 1, 0), (5000, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, items


def rows_of(spark, name, folder):
    df = registry.QUERIES[name](spark, folder)
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, tables, name):
    import duckdb

    folder = tables[0]
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        files = [f"{folder}/{table}.parquet/{f}" for f in os.listdir(f"{folder}/{table}.parquet") if f.endswith(".parquet")]
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet({files})")
    found = con.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    got = rows_of(spark, name, folder)
    assert sorted(names) == sorted(got[0])
    want = sorted((tuple(row) for row in found.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == want and want


def test_decontaminate_query(spark, tables):
    folder, rows, items = tables
    numbers: dict[str, int] = {}
    as_numbers = lambda t: np.array([numbers.setdefault(w, len(numbers)) for w in decontaminate.words_of(t.encode())], np.int64)
    expected = []
    for doc, text, *_ in rows:
        for item, words in items.items():
            if text:
                own = as_numbers(words)
                points, start, end = decontaminate.align(own, as_numbers(text))
                if points >= (decontaminate.LEAST if len(own) > 2 else 1) * len(own):  # short items have to be there whole
                    expected.append((doc, item, points / len(own), start, end))
    got = [tuple(r.values()) for r in rows_of(spark, "op2_decontaminate", folder)]
    assert sorted(got) == sorted(expected) and {e[1] for e in expected} >= {0, 1, 2}


def plain_fingerprint(text):
    import xxhash

    own = (text or "").encode().lower().split()
    parts = [b" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
    values = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(rows):
    prints = [plain_fingerprint(r[1]) for r in rows]
    up = list(range(len(rows)))
    for _ in rows:
        changed = False
        for i, p in enumerate(prints):
            near = min(up[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3)
            if near < up[i]:
                up[i], changed = near, True
        if not changed:
            break
    least = {}
    for i, r in enumerate(rows):
        least[up[i]] = min(least.get(up[i], r[0]), r[0])
    return prints, up, least


def test_simhash_query(spark, tables):
    folder, rows, _ = tables
    prints, up, least = plain_components(rows)
    expected = sorted((r[0], f"{p:016x}", least[u]) for r, p, u in zip(rows, prints, up))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(spark, "op3_simhash", folder)) == expected


def plain_mixture(texts, training):
    """Expectation-maximisation text by text, without arrays of all of them."""
    blank = lambda t: "".join(c if c.isalpha() or ord(c) > 127 else " " for c in t.lower())
    langs = sorted({k for _, k in training})
    grams = {k: Counter() for k in langs}

    def units(text):
        data = (" " + blank(text) + " ").encode()
        words, at = [], 1
        for i in range(1, len(data) - 1):
            if data[i] == 32:
                continue
            if data[i - 1] == 32:
                words.append([])
            words[-1].append(int(language_id._grams(np.frombuffer(data[i - 1 : i + 2], np.uint8))[0]))
        return [sum(words[a : a + language_id.UNIT_WORDS], []) for a in range(0, len(words), language_id.UNIT_WORDS)], at

    for text, lang in training:
        for unit in units(text)[0]:
            grams[lang].update(unit)
    sums = {k: sum(c.values()) for k, c in grams.items()}
    log = lambda k, g: math.log((grams[k][g] + 0.5) / (sums[k] + 0.5 * language_id.BUCKETS))
    out = []
    for text in texts:
        own = units(text)[0] if text else []
        if not own:
            out.append(("und", 0.0))
            continue
        likely = [[sum(log(k, g) for g in u) for k in langs] for u in own]
        likely = [[math.exp(x - max(u)) for x in u] for u in likely]

        def settle(shares, rounds, likely=likely):
            for _ in range(rounds):
                part = [[x * s for x, s in zip(u, shares)] for u in likely]
                part = [[x / max(sum(u), 1e-30) for x in u] for u in part]
                shares = [sum(u[k] for u in part) / len(part) for k in range(len(langs))]
            return shares

        fit = lambda shares, likely=likely: sum(math.log(sum(x * s for x, s in zip(u, shares)) + 1e-30) for u in likely)
        whole = settle([1 / len(langs)] * len(langs), language_id.ROUNDS)
        penalty, kept, best = 0.5 * math.log(len(own) + 1), whole, fit(whole)
        alone = [sum(math.log(u[k] + 1e-30) for u in likely) for k in range(len(langs))]
        if max(alone) + penalty * (len(langs) - 1) >= best:
            kept = [float(k == alone.index(max(alone))) for k in range(len(langs))]
        else:
            while sum(s > 0 for s in kept) > 1:
                least = min((s, k) for k, s in enumerate(kept) if s > 0)[1]
                tried = [0.0 if k == least else s for k, s in enumerate(kept)]
                tried = settle([s / sum(tried) for s in tried], language_id.ROUNDS // 2)
                if fit(tried) + penalty < best:
                    break
                kept, best = tried, fit(tried)
        top = kept.index(max(kept))
        out.append((langs[top], min(1.0, whole[top])))
    return out


def test_language_query(spark, tables):
    folder, rows, _ = tables
    held = lambda i, n: zlib.crc32(str(i).encode()) % n
    expected = plain_mixture([r[1] for r in rows], [(r[1], r[2]) for r in rows if r[1] is not None and r[2] and held(r[0], 3) != 1])
    want = sorted((r[0], held(r[0], 3) == 1, lang, round(score, 4)) for r, (lang, score) in zip(rows, expected))
    got = sorted((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 4)) for r in rows_of(spark, "op6_language_id", folder))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-3 for g, w in zip(got, want))


def test_passage_query(spark, tables):
    folder, rows, _ = tables
    texts = {r[0]: (r[1] or "").encode().lower().split() for r in rows}
    got = rows_of(spark, "op8_passage_dedup", folder)
    linked = set()
    for r in got:
        a, b = texts[r["doc_id"]][r["start_word"] : r["end_word"]], texts[r["other_id"]][r["other_start"] : r["other_end"]]
        row = [0] * (len(b) + 1)  # longest common subsequence
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        assert min(len(a), len(b)) >= 50 and r["other_id"] < r["doc_id"] and 0.8 * max(len(a), len(b)) <= r["n_same"] <= row[-1]
        linked |= {(r["doc_id"], r["other_id"])}
    grams = {}
    for i, words in texts.items():
        for k in range(len(words) - 49):
            grams.setdefault(tuple(words[k : k + 50]), set()).add(i)
    up = {i: {i} for i in texts}
    for a, b in linked:
        for i in up[a] | up[b]:
            up[i] = up[i] | up[a] | up[b]
    assert all(up[a] >= own for own in grams.values() for a in own)  # all that share fifty words are linked
    assert any(len(own) > 1 for own in grams.values())


def test_bpe_query(spark, tables):
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    folder, rows, _ = tables
    expected = []
    for doc, text, *_ in rows:
        ids = plain.encode_ordinary(text or "")
        expected.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(tuple(r.values()) for r in rows_of(spark, "op9_byte_bpe", folder)) == sorted(expected)


def test_quality_query(spark, tables):
    """Plain features, one by one, in the space that the operator fits; the nearest by sorting."""
    import xxhash

    folder, rows, _ = tables
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0

    def features(text):
        found, last = Counter(), None
        for word in (text or "").encode().split():
            shape = knn_quality._runs.sub(rb"\1", word.translate(knn_quality._KINDS))
            both = (xxhash.xxh64_intdigest(word.lower(), 1) % knn_quality.BUCKETS, xxhash.xxh64_intdigest(b"\0" + shape, 1) % knn_quality.BUCKETS)
            found.update([knn_quality._REPEAT] if both == last else both)
            last = both
        return found

    labels = {}
    for i, q in [(r[0], int(r[0] < 140)) for r in rows if r[0] % 2 or r[0] >= 140]:
        if not held(i):
            labels[i] = min(q, labels.get(i, q))
    of_doc = [features(r[1]) for r in rows]
    often = np.zeros(knn_quality.BUCKETS, np.int64)
    for f in of_doc:
        often[list(f)] += 1
    taught = sorted({(r[0], k) for k, r in enumerate(rows) if r[0] in labels and not held(r[0])})
    space = knn_quality.Space.fit([(np.array(sorted(of_doc[k]), np.int64), np.array([of_doc[k][b] for b in sorted(of_doc[k])], np.int64)) for _, k in taught], often, len(rows))

    def vector(f):
        out = sum((space.basis[b] * np.float32(math.log1p(n) * space.weights[b]) for b, n in sorted(f.items())), np.zeros(space.basis.shape[1], np.float32))
        return out / max(float(np.linalg.norm(out)), 1e-12)

    vectors, marks = np.stack([vector(of_doc[k]) for _, k in taught]), np.array([labels[i] for i, _ in taught])
    want = []
    for r, f in zip(rows, of_doc):
        cosine = np.round(vectors @ vector(f), 6)
        top = sorted(range(len(marks)), key=lambda k: (-cosine[k], k))[: knn_quality.NEIGHBOURS]
        weight = np.maximum(cosine[top], 0)
        want.append((r[0], held(r[0]), float((weight * marks[top]).sum() / weight.sum()) if weight.sum() > 0 else float(marks.mean())))
    got = sorted((r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in rows_of(spark, "op10_knn_quality", folder))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert sum(abs(g[2] - w[2]) > 1e-3 for g, w in zip(got, sorted(want))) <= len(got) // 20  # equally near to six places, but for rounding
    assert all(g[3] == (g[2] >= 0.3) for g in got)


def test_nearest_takes_the_first_of_equals():
    rng = np.random.default_rng(1)
    for _ in range(50):
        values = rng.integers(0, 4, (6, 12)).astype(np.float32)
        near = int(rng.integers(1, 12))
        got = knn_quality.nearest(values, near)
        for row, own in zip(values, got):
            assert np.flatnonzero(own).tolist() == sorted(sorted(range(12), key=lambda k: (-row[k], k))[:near])


def test_pipeline(spark, tables):
    """Stage by stage by plain means: the quality query's verdicts, all pairs of fingerprints, shared runs of fifty words, alignment with all items, tiktoken."""
    folder, rows, items = tables
    kept = Counter(r["doc_id"] for r in rows_of(spark, "op1_quality_rules", folder) if r["kept"])
    rows = [r for r in rows if kept[r[0]]]
    _, up, least = plain_components(rows)
    rows = [next(r for r, u in zip(rows, up) if u == top and r[0] == least[top]) for top in sorted(least)]
    grams, texts = {}, {r[0]: (r[1] or "").split() for r in rows}
    for i in sorted(texts):
        low = [w.lower() for w in texts[i]]
        for k in range(len(low) - 49):
            grams.setdefault(tuple(low[k : k + 50]), i)
    left = {}
    for i, words in texts.items():
        low, gone = [w.lower() for w in words], set()
        for k in range(len(low) - 49):
            if grams[tuple(low[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        left[i] = [w for k, w in enumerate(words) if k not in gone]
    numbers: dict[str, int] = {}
    as_numbers = lambda t: np.array([numbers.setdefault(w, len(numbers)) for w in decontaminate.words_of(t.encode())], np.int64)
    clean = {i for i, words in left.items() if words and not any(decontaminate.align(own, as_numbers(" ".join(words)))[0] >= (0.5 if len(own) > 2 else 1) * len(own) for own in map(as_numbers, items.values()))}
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(clean) and all(r["round_trip"] for r in got)
    content = byte_bpe.ranks_of(open(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken"), "rb").read())
    tokens = {rank: token for token, rank in content.items()}
    cut = 0
    for r in got:
        text = b"".join(tokens[i] for i in r["ids"]).decode()
        assert text.split() == left[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        cut += len(text.split()) < len(texts[r["doc_id"]])
    assert cut == 3


# ------------------------------------------------------------------ names, long texts, empty tables

NAMES = """base distance word_list class_n n_words word_chars kept base_failed license dice start_word score lang_pred shares held_out ids decoded fp fingerprint
component_id hash row first component node spans _spans _leaking doc other chain open words parts key class bytes _text _lang _last c0 c1 _0 _1 group doc_hash quality n_tokens""".split()
CALLS = {
    "quality": (lambda d, x: quality_rules.judge(d), set(quality_rules.RESULTS)),
    "licences": (lambda d, x: license_scan.scan(d), {"text", *license_scan.RESULTS}),
    "languages": (lambda d, x: language_id.identify(d, language_id.Model.learn(d)), {"text", "lang_pred", "score", "shares"}),
    "votes": (lambda d, x: knn_quality.score(d, d, x["labels"]), {"text", "score"}),
    "bpe": (lambda d, x: byte_bpe.round_trip(d, *x["ranks"]), {"text", "ids", "decoded"}),
    "encode": (lambda d, x: byte_bpe.encode(d, *x["ranks"]), {"text", "ids"}),
    "fingerprints": (lambda d, x: simhash.fingerprints(d), {"text", "fingerprint"}),
    **{f"stage {name}": ((lambda d, x, stage=stage: stage(d.sparkSession, d, x["folder"])), set()) for name, stage in corpus_pipeline.STAGES[:-1]},
}
OTHERS = {
    "decontaminate": lambda d, x: decontaminate.leaks(d, x["benchmark"]),
    "near-duplicates": lambda d, x: simhash.near_duplicates(d),
    "model": lambda d, x: ngram_lm.score(d),
    "bytes": lambda d, x: suffix_dedup.remove(d),
    "repeats": lambda d, x: suffix_dedup.maximal_repeats(d),
    "passages": lambda d, x: passage_dedup.passages(d),
    "tokens": lambda d, x: corpus_pipeline.tokens(d.sparkSession, d, x["folder"]),
}


@pytest.fixture(scope="module")
def more(spark, tables):
    tokenizers = pytest.importorskip("public_tokenizers")
    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    folder = tables[0]
    return {"folder": folder, "ranks": (ranks, tokenizers.PATTERN), "labels": spark.read.parquet(f"{folder}/labels.parquet"), "benchmark": spark.read.parquet(f"{folder}/benchmark.parquet")}


@pytest.fixture(scope="module")
def named(spark, tables):
    """A few documents with a column for every name that an operator has for something, and values told apart by row."""
    names = ["doc_id", "text", "lang", "source", "n_chars", *NAMES]
    rows = [(*r, *[f"{n} {r[0]}" for n in NAMES]) for r in tables[1] if r[0] < 12 or r[0] in (140, 153, 154)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    df = spark.createDataFrame(rows, schema)
    return df, names


@pytest.mark.parametrize("call", sorted(CALLS))
def test_other_columns_are_passed_on(named, more, call):
    df, names = named
    run, replaced = CALLS[call]
    out = run(df, more)
    assert len(set(out.columns)) == len(out.columns)
    rows = [r.asDict() for r in out.collect()]
    assert rows
    for r in rows:
        for n in NAMES:
            if n not in replaced:
                assert r[n] == f"{n} {r['doc_id']}", n


@pytest.mark.parametrize("call", sorted(OTHERS))
def test_other_columns_do_no_harm(named, more, call):
    from pyspark.sql import functions as F

    df, _ = named
    if call == "model":
        df = df.withColumn("held_out", F.lit(False))
    plain = df.select("doc_id", "text", "lang", "source", *(["held_out"] if call == "model" else []))
    assert sorted(map(repr, OTHERS[call](df, more).collect())) == sorted(map(repr, OTHERS[call](plain, more).collect()))


@pytest.mark.parametrize("call", sorted({**CALLS, **OTHERS}))
def test_empty_tables(spark, more, call):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    run = CALLS[call][0] if call in CALLS else OTHERS[call]
    assert run(df.withColumn("held_out", F.lit(False)) if call == "model" else df, more).collect() == []


@pytest.mark.parametrize("call", sorted({**CALLS, **OTHERS}))
def test_a_long_text(spark, more, call):
    """Two texts of 3 MB, equal but for their first word."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    text = " ".join(prose(rng, "aa", 1000) for _ in range(400))
    rows = [(1, text, "aa", "s", 1), (2, "first " + text, "aa", "s", 1), (3, None, "aa", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    run = CALLS[call][0] if call in CALLS else OTHERS[call]
    got = run(df.withColumn("held_out", F.lit(False)) if call == "model" else df, more).collect()
    if call == "passages":
        assert [(r["doc_id"], r["start_word"], r["end_word"]) for r in got] == [(2, 1, 400_001)]
    if call == "bytes":
        assert {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in got} == {1: 0, 2: 6, 3: 0}
    if call in ("bpe", "encode", "languages", "votes", "quality"):
        assert len(got) == 3


# ------------------------------------------------------------------ on the supplied tables, where they are

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_languages(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows_of(spark, "op6_language_id", SF) if r["held_out"] and langs[r["doc_id"]]]
    right = sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held)
    print(f"held-out languages right: {right:.4f} of {len(held)}")
    assert right > 0.98


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_quality(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in rows_of(spark, "op10_knn_quality", SF) if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    area = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    print(f"area under the curve on held-out labels: {area:.4f} of {len(held)}")
    assert area > 0.95
