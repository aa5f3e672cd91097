"""The engine's functions on hand-made cases, and its queries on the smallest tables against SQL."""

import json
import math
import os
import subprocess
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import chunking, embedding, evaluate, graph, hygiene, incremental, lines, retrieval, stats, store
from corvane.plans import catalog, policy
from corvane.plans.tools import Tools, compare_models
from corvane.sources import query_log, repository, settings, snapshot
from corvane.sources.repository import Ignore
from corvane.streaming import events, folder

SF = "/root/testdata/sf0.001"

ROLES = {
    "pkg/__tests__/a.js": "test", "lib/test_x.rb": "test", "Spec/deep/n.go": "test", "ui/Form.TEST.tsx": "test", "go.mod": "build", "sub/Dockerfile": "build", "api/Cargo.toml": "build",
    "notes.rst": "docs", "a/docs/b/c.py": "docs", "readme": "docs", "tools/run.zsh": "script", "x/scripts/y.py": "script", "a.ini": "config", "src/config.local.js": "config", ".env": "unknown",
    "w/webpack.config.ts": "config", "main.cpp": "source", "LICENSE": "unknown", "a/.hidden.py": "source", "dir\\\\win.java": "source",
}


def test_roles_and_ranges(spark):
    df = spark.createDataFrame([(p,) for p in ROLES], "path string")
    got = {r["path"]: r["role"] for r in df.select("path", T.file_role(F.col("path"), T.language_of(F.col("path"))).alias("role")).collect()}
    assert got == ROLES
    lines = spark.createDataFrame([(10, 20), (1, 1000)], "a int, b int").select(T.context_range(F.col("a"), F.col("b")).alias("r")).collect()
    assert [(x["r"]["lineno_start"], x["r"]["lineno_end"]) for x in lines] == [(1, 50), (701, 1000)]


def test_query_words(spark):
    for query in ("parse_http getUserName XMLParser foo_Bar Foo", "a  a __x__ 'q' HTTP", ""):
        assert spark.createDataFrame([(query,)], "q string").select(T.expanded(F.col("q"))).first()[0] == T.expand_query(query)
    assert T.phrases('get_openapi "..." é') == [["get", "openapi"], ["get"], ["openapi"], ["e"]]
    now = datetime(2024, 1, 31, tzinfo=timezone.utc)
    assert T.parse_since("7d", now).day == 24 and T.parse_since("30m", now).minute == 30 and T.parse_since("soon") is None


def test_bm25_closed_form(spark):
    texts = {1: "get openapi now", 2: "openapi get", 3: "get openapi get openapi", 4: "nothing", 5: None, 6: ""}
    docs = spark.createDataFrame(list(texts.items()), "id long, code string")
    index, whole = retrieval.postings(docs), retrieval.totals(docs)
    rows = {(r["id"], r["term"]): r["places"] for r in index.collect()}
    assert rows[3, "get"] == [0, 2] and rows[3, "openapi"] == [1, 3] and rows[4, "nothing"] == [0] and len(rows) == 8
    got = {r["id"]: r["score"] for r in retrieval.bm25(index, whole, [["get", "openapi"]], None).collect()}
    length = {i: len((t or "").split()) for i, t in texts.items()}
    mean, idf = sum(length.values()) / 6, math.log((6 - 2 + 0.5) / (2 + 0.5))
    expected = {i: idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[i] / mean)) for i, f in ((1, 1), (3, 2))}
    assert got == {i: pytest.approx(x) for i, x in expected.items()}
    twice = {r["id"]: r["score"] for r in retrieval.bm25(index, whole, [["nothing"], ["nothing"]], None).collect()}
    once = {r["id"]: r["score"] for r in retrieval.bm25(index, whole, [["nothing"]], None).collect()}
    assert twice == {4: pytest.approx(2 * once[4])} and retrieval.bm25(index, whole, []).count() == 0


def test_lists_take_scores_that_agree_in_nine_places_by_id(spark):
    near = spark.createDataFrame([(1, [1.0, 1e-7]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, vector array<double>")
    found = [(r["id"], r["score"]) for r in retrieval.cosine(near, [1.0, 0.0], 2).collect()]
    assert found == [(1, found[0][1]), (2, found[0][1])]
    index = spark.createDataFrame([("a", 1, [0], 1001), ("a", 2, [0], 1000), ("a", 3, [0], 9)], "term string, id long, places array<int>, length int")
    whole = spark.createDataFrame([(3, 3000)], "docs long, terms long")
    assert [r["id"] for r in retrieval.ranked(retrieval.bm25(index, whole, [["a"]], 3)).orderBy("rank").collect()] == [3, 1, 2]


def test_stages_round_halves_as_sql_does(spark):
    import duckdb

    halves = [(398, 640), (388, 1280), (378, 640), (203, 400), (201, 400), (1, 64), (1, 80)]
    values = [(i, a / n) for i, (a, n) in enumerate(halves)]
    stage = spark.createDataFrame([(i, x, i) for i, x in values], "id long, score double, place int")
    got = {r["id"]: r["score"] for r in catalog._stages({"final": stage}, final=("place", "score")).collect()}
    assert got == {i: duckdb.connect().execute(f"SELECT round({x!r}::DOUBLE, 5)").fetchone()[0] for i, x in values}
    # 0.5025 is 0.502 in SQL, as 0.502 is, so that positions decide
    tied = spark.createDataFrame([(1, "a", 0.502, 1, 0.1), (2, "b", 201 / 400, 2, 0.1)], "id long, path string, score double, position int, rrf double")
    assert {r["id"]: r["rank"] for r in retrieval.diversify(tied, 2).collect()} == {1: 1, 2: 2}


def test_diversity_and_guard(spark):
    rows = [(i, f"p{i % 2}" if i < 6 else "q", score, i + 1, 1 / (61 + i)) for i, score in enumerate([0.1, 0.9, 0.8, 0.7, 0.9, 0.9, 0.5])]
    df = spark.createDataFrame(rows, "id long, path string, score double, position int, rrf double")
    for k in (1, 2, 3, 4, 5, 9):
        ranked = sorted(rows, key=lambda r: (-round(r[2], 3), r[3]))
        picked, seen, dropped = [], {}, []
        for r in ranked:
            if len(picked) == k:
                break
            if seen.get(r[1], 0) >= 2:
                dropped.append(r[0])
                continue
            seen[r[1]] = seen.get(r[1], 0) + 1
            picked.append((r[0], r[2], False))
        if all(p[0] != 0 for p in picked):
            picked = [*picked[: k - 1], (0, rows[0][4], True)]
        got = retrieval.diversify(df, k).collect()
        assert [(r["id"], r["score"], r["guarded"]) for r in sorted((r for r in got if r["place"]), key=lambda r: r["place"])] == picked
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["dropped"]] == dropped


@pytest.mark.parametrize("n", [0, 1, 35, 36, 38, 40, 41, 75, 76])
def test_windows(spark, n):
    code = "".join(f"line {i}\n" for i in range(n))
    got = chunking.windows(spark.createDataFrame([("r", "a.py", "python", code)], "repo string, path string, language string, code string")).collect()
    assert sorted((r["lineno_start"], r["lineno_end"]) for r in got) == [(a + 1, min(a + 40, n)) for a in range(0, n, 35)]


def test_hygiene(spark):
    key = "AKIA" + "A" * 16
    cases = [
        ("a/b.py", "x", None), ("node_modules/x.js", "x", "excluded_dir:node_modules"), ("own/z/k.py", "x", "excluded_dir:own"), ("uv.lock", "x", "excluded_filename:uv.lock"),
        ("m.min.js", "x", "excluded_ext:.min.js"), ("M.MIN.JS", "x", None), ("a.PNG", "x", "excluded_ext:.png"), ("gen/x.go", "x", "extra_glob"), ("q.tmp", "x", "gitignore"),
        ("k.py", key, "secret_detected"), ("z.py", "a\0b", "binary"), ("y.py", "\u00e9" * 600 + "\0", None), ("w.py", "é" * 500 + "\0", "binary"), ("l.py", "\n" * 7, "too_many_lines:8"), ("big.py", "y" * 3000, "too_large:3000"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "path string, code string")
    rules = hygiene.Rules.of({"extra_exclude_dirs": ["own"], "extra_exclude_globs": ["/gen/"], "max_file_lines": 7, "max_file_bytes": 2000, "other": 1, "secret_scan": None})
    ignored = Ignore({"": "*.tmp"})
    kept, found = store.prepared(df, "", rules, ignored)
    assert {r["path"]: r["reason"] for r in found.collect()} == {c[0]: c[2] for c in cases}
    assert {r["path"] for r in kept.collect()} == {c[0] for c in cases if c[2] is None}
    assert [r["path"] for r in hygiene.secret_hits(found).collect()] == ["k.py"]
    failed = spark.createDataFrame([("a.py", None, None, "stat_error:gone"), ("b.py", None, 3, "read_error:denied"), ("c.py", None, None, None)], "path string, code string, size long, error string")
    assert [r["reason"] for r in hygiene.judged(failed).collect()] == ["stat_error:gone", "read_error:denied", "read_error"]


APP = "from pkg.core import helper\nimport os\n\n# helper\nx = 'helper'\n\n\nclass App(Base):\n    def run(self):\n        helper()\n"


def test_graph(spark):
    files = [("r", "pkg/__init__.py", "python", ""), ("r", "pkg/core.py", "python", "def helper():\n    pass\n\n\nclass Base:\n    pass\n"), ("r", "pkg/app.py", "python", APP), ("r", "pkg/rel.py", "python", "from . import core\nfrom .core import helper\nfrom __future__ import x\n")]
    edges = graph.edges(spark.createDataFrame(files, "repo string, path string, language string, code string")).cache()
    got = {(r["path"], r["edge_type"], r["dst_kind"], r["dst"], r["lineno"]) for r in edges.collect()}
    app = {e[1:] for e in got if e[0] == "pkg/app.py"}
    assert app == {("imports", "file", "pkg/core.py", 1), ("imports", "external", "os", 2), ("defines", "symbol", "App", 8), ("defines", "symbol", "run", 9), ("references", "symbol", "Base", 8), ("references", "symbol", "helper", 10)}
    assert {e[1:] for e in got if e[0] == "pkg/rel.py"} == {("imports", "file", "pkg/core.py", 1), ("imports", "file", "pkg/core.py", 2)}
    refs = [tuple(r) for r in graph.find_references(edges, "helper").collect()]
    assert refs == [("definition", "pkg/core.py", 1), ("reference", "pkg/app.py", 10)]
    found = graph.related(edges, "pkg/core.py", "file", 1).collect()
    assert {(r["value"], r["edge_type"]) for r in found} == {("pkg/app.py", "imported_by"), ("pkg/rel.py", "imported_by"), ("helper", "defines"), ("Base", "defines")}
    assert graph.kind_of(edges, "helper") == "symbol" and graph.kind_of(edges, "nobody") is None
    cycle = spark.createDataFrame([("r", "file", a, "file", b, "imports", a, 1) for a, b in (("a", "b"), ("b", "a"))], graph.EDGES)
    assert [r["value"] for r in graph.related(cycle, "a", "file", 3).collect()] == ["b"]


def test_events(spark):
    import itertools

    kinds = ("created", "modified", "deleted")
    rows, expected = [], {}
    for n in (1, 2, 3, 4):
        for k, seq in enumerate(itertools.product(kinds, repeat=n)):
            state = None
            for kind in seq:
                state = "deleted" if kind == "deleted" else "modified" if state == "deleted" else state or kind
            expected[f"{n}-{k}"] = state
            rows += [("r", f"{n}-{k}", kind, i) for i, kind in enumerate(seq)]
    got = {r["path"]: r["kind"] for r in events.coalesce(spark.createDataFrame(rows, "repo string, path string, kind string, seq long")).collect()}
    wrong = {p for p in got if got[p] != expected[p]}
    assert not wrong


def test_ignore_and_policy(tmp_path):
    rules = Ignore({"": "*.log\n/top.txt\nbuild/\n!keep.log\n", "sub": "x.py"})
    assert [rules(p) for p in ("a/b.log", "keep.log", "build/a.py", "sub/x.py", "x.py", "a.py")] == [True, False, True, True, False, False]
    assert policy.resolve_repo(["a", "b"], " ", "b", "a") == "b"
    with pytest.raises(policy.RepoError):
        policy.resolve_repo(["a"], "zzz")
    assert policy.is_loopback("::1") and not policy.is_loopback("0.0.0.0")
    assert os.path.dirname(policy.lock_path(str(tmp_path), "a/b/../c")) == str(tmp_path)
    with policy.repo_lock(str(tmp_path), "r") as first, policy.repo_lock(str(tmp_path), "r", wait=False) as second:
        assert first and second is False


def test_ignore_rules_agree_with_git(spark, tmp_path):
    """What git itself says of files that are there, for rules of the top folder."""
    rules = "# note\n*.log\n!keep.log\n/top.txt\nbuild/\ndoc/*.txt\na/**/z.c\n[ab]?.py\n[!x]1.md\n\\#odd\nfoo*bar\n**/deep/x\ntail\\ \n"
    paths = ["x.log", "q/x.log", "keep.log", "top.txt", "s/top.txt", "build/a.py", "s/build/b.py", "doc/a.txt", "doc/s/a.txt", "a/z.c", "a/b/c/z.c", "a1.py", "c1.py", "x1.md", "y1.md", "#odd", "foo1bar", "fobar", "q/deep/x/y.py", "tail "]
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    (tmp_path / ".gitignore").write_text(rules)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    said = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "-z", "--stdin"], input="\0".join(paths), capture_output=True, text=True).stdout.split("\0")
    own = Ignore.load(str(tmp_path))
    assert {p for p in paths if own(p)} == set(filter(None, said))
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"] for r in df.where(own.column(F.col("path"))).collect()} == set(filter(None, said))


def test_grep_anchors_and_groups(spark):
    files = spark.createDataFrame([("a.py", "foo x\nbar"), ("b.py", "y x"), ("c.py", "foofoo\n  bar")], "path string, code string")
    found = lambda p: [(r["path"], r["lineno"]) for r in lines.grep(files, p, None, None).collect()]
    assert found(r"x\Z") == [("a.py", 1), ("b.py", 1)] and found(r"\Abar") == [("a.py", 2)] and found("^bar$") == [("a.py", 2)]
    assert found(r"(?P<n>foo)(?P=n)") == [("c.py", 1)] and found("foo[^z]+bar") == [] and found(r"\bx\b") == [("a.py", 1), ("b.py", 1)]
    with pytest.raises(ValueError):
        lines.grep(files, "(")


def test_p95_by_place(spark):
    import random

    rng = random.Random(1)
    rows = [("few", float(x)) for x in range(7)] + [("many", rng.choice([1.0, 2.5, 9.0, 9.5]) if x % 3 else rng.random() * 50) for x in range(30_000)] + [(None, 3.0), ("none", None)]
    log = spark.createDataFrame([(t, "q", v, None, "2024") for t, v in rows], "tool string, query string, latency_ms double, error string, ts string").repartition(4)
    place = lambda own: sorted(own)[min(len(own) - 1, int(len(own) * 0.95))] if own else 0.0
    expected = {name or "unknown": place([v for t, v in rows if t == name and v is not None]) for name in ("few", "many", None, "none")}
    assert {r["tool"]: r["p95_latency_ms"] for r in stats.by_tool(log).collect()} == expected
    assert stats.p95(log).first()[0] == place([v for _, v in rows if v is not None]) and stats.p95(log.where("false")).first()[0] == 0.0


def test_bursts_over_slots(spark):
    import random

    rng, rows, now, burst, expected = random.Random(4), [], 0.0, 0, {}
    for seq in range(400):
        step = rng.choice([0.2, 0.9, 1.0, 30.0, 4000.0])
        burst += seq == 0 or step >= 1.0
        now += step
        expected[seq] = burst
        rows.append(("r", datetime.fromtimestamp(now, timezone.utc), seq))
    got = events.bursts(spark.createDataFrame(rows, "repo string, ts timestamp, seq long"), 1.0, slot_seconds=60)
    assert {r["seq"]: r["burst"] for r in got.collect()} == expected


def test_upsert_keeps_and_drops(spark):
    old = spark.createDataFrame([(1, "a", "o"), (2, "b", "o"), (3, None, "o")], "id long, content_hash string, state string")
    new = spark.createDataFrame([(1, "a", "n", 7), (2, "x", "n", 8), (4, "y", "n", 9), (3, None, "n", 1)], "id long, content_hash string, state string, more int")
    rows = lambda keep: {tuple(r) for r in incremental.upsert(old.union(spark.createDataFrame([(5, "z", "o")], old.schema)), new, keep=keep).select("id", "state", "more").collect()}
    expected = {(1, "o", None), (2, "n", 8), (4, "n", 9), (3, "o", None)}
    assert rows(False) == expected and rows(True) == expected | {(5, "o", None)}


def test_embedder_checks(spark):
    texts = spark.createDataFrame([(i, f"word{i} and more") for i in range(70)] + [(99, None)], "id long, code string")
    got = {r["id"]: r["v"] for r in texts.select("id", embedding.embedded(F.col("code"), embedding.HashEmbedder(16), 16, 32).alias("v")).collect()}
    assert all(len(v) == 16 for v in got.values()) and abs(sum(x * x for x in got[3]) - 1) < 1e-5 and set(got[99]) == {0.0}
    with pytest.raises(ValueError):
        embedding.checked([[1.0]], 1, 2)
    with pytest.raises(Exception, match="16 expected|numbers"):
        texts.select(embedding.embedded(F.col("code"), embedding.HashEmbedder(8), 16)).collect()


def test_a_model_is_loaded_once():
    import pickle
    from functools import partial

    loaded = []
    model = embedding.Lazy(lambda: loaded.append(1) or embedding.HashEmbedder(4))
    assert not loaded and model(["a"]) == model(["a"]) and loaded == [1]
    assert pickle.loads(pickle.dumps(embedding.Lazy(partial(embedding.HashEmbedder, 4))))(["a"]) == model(["a"])


FILES = {
    "app.py": "from lib import util\n\n\nclass Runner:\n    def start_engine(self):\n        return util.spin_wheel()\n",
    "lib/__init__.py": "", "lib/util.py": "def spin_wheel():\n    return 'wheel'\n", "lib/notes.md": "notes", "web/é.ts": "export function draw() {}\n",
    "tests/test_app.py": "def test():\n    pass\n", "secret.py": "key = '" + "AKIA" + "B" * 16 + "'\n", "skip.py": "x = 1\n", "long.py": "\n".join(f"value_{i} = {i}" for i in range(90)) + "\n",
}


@pytest.fixture
def tools(spark, tmp_path):
    root = tmp_path / "repo"
    for path, code in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(code, encoding="utf-8")
    (root / ".gitignore").write_text("skip.py\n")
    for args in (["init", "-q"], ["add", "-A"], ["-c", "user.name=Jo", "-c", "user.email=jo@example.org", "commit", "-qm", "first"]):
        subprocess.run(["git", "-C", str(root), *args], check=True)
    config = {"repos": [{"name": "shop", "path": str(root), "languages": ["python"]}, {"name": "empty", "path": str(tmp_path / "none")}], "embedding": {"dimension": 16}}
    return Tools(spark, config, store.Store(spark, str(tmp_path / "store")), str(tmp_path / "logs"), environment_repo="shop")


def test_index_search_and_change(spark, tools, tmp_path):
    root = tmp_path / "repo"
    first = tools.index("shop")
    assert first["reasons"] == {"secret_detected": 1, "gitignore": 1}
    assert (tmp_path / "logs/secrets_warn.log").read_text().rstrip().endswith("secret.py")
    chunks = {r["id"]: r for r in tools.store.read("chunks", "shop").collect()}
    assert {r["path"] for r in chunks.values()} == {"app.py", "lib/util.py", "web/é.ts", "long.py"} and first["chunks"] == first["embedded"] == len(chunks) == 6
    assert all(r["commit_sha"] and r["last_author"] == "jo@example.org" and len(r["vector"]) == 16 for r in chunks.values())
    inside = next(r for r in chunks.values() if r["path"] == "lib/util.py")
    assert inside["symbol"] == "spin_wheel" and inside["code"].startswith("# file: lib/util.py\n# language: python\n# symbol: spin_wheel\n# signature: def spin_wheel():\n")

    hits = tools.search_code("spin_wheel")
    assert hits[0]["path"] == "lib/util.py" and hits[0]["file_role"] == "source" and hits[0]["suggested_ranges"][0]["lineno_start"] == 1
    assert tools.search_code("spin_wheel", path_glob="app")[0]["path"] == "app.py" and tools.search_code("wheel", lang="go") == []
    assert tools.search_code("wheel", author="JO@") and not tools.search_code("wheel", author="other") and not tools.search_code("wheel", modified_since="2100-01-01")
    with_model = Tools(spark, tools.settings, tools.store, tools.log_folder, tools.model, retrieval.overlap_reranker, environment_repo="shop")
    debug = with_model.search_code_debug("spin_wheel")
    assert set(debug["debug"]) == {"query", "preprocessed_query", "vector", "bm25", "rrf", "rerank", "diversity_dropped", "consensus_guard", "final"}
    assert [h["path"] for h in debug["hits"]] == [x["path"] for x in debug["debug"]["final"]] and debug["debug"]["rrf"][0]["rank"] == 1
    assert [d["path"] for d in with_model.search_code_debug("value_1 value_40 value_80", k=9)["debug"]["diversity_dropped"]] == ["long.py"]

    assert tools.find_references("spin_wheel") == [{"kind": k, "path": p, "lineno": n, "approximate": False, "context_trust": "untrusted_repository_content"} for k, p, n in (("definition", "lib/util.py", 1), ("reference", "app.py", 6))]
    assert tools.find_references("value_7")[0]["approximate"] is True
    near = tools.related_code("lib/util.py", depth=2)
    assert {(r["value"], r["edge_type"]) for r in near["related"]} >= {("spin_wheel", "defines"), ("app.py", "referenced_by")} and near["error"] is None and not near["truncated"]
    assert tools.related_code("app.py", max_results=1)["truncated"] and tools.related_code("nobody")["error"] == "target_not_found"
    assert tools.related_code("../x.py")["error"] == "path_outside_repos" and tools.related_code("no/file.py")["error"] == "target_not_found" and tools.related_code("a b")["error"] == "invalid_target"

    # nothing changed, then a change, a deletion and a new file
    again = tools.index("shop")
    assert again["embedded"] == 0 and again["chunks"] == 6
    (root / "long.py").write_text(FILES["long.py"].replace("value_89 = 89", "value_89 = 0"))
    (root / "lib/util.py").unlink()
    (root / "new.py").write_text("def fresh():\n    return 1\n")
    third = tools.index("shop")
    assert third["embedded"] == 2 and third["chunks"] == 6
    state = {r["id"]: r for r in tools.store.read("chunks", "shop").collect()}
    same = set(state) & set(chunks)
    assert sum(state[i]["indexed_at"] != chunks[i]["indexed_at"] for i in same) == 1
    assert not tools.store.read("edges", "shop").where("path = 'lib/util.py'").count() and not tools.store.read("postings", "shop").where("term = 'spin' and id in ('x')").count()
    assert {r["path"] for r in tools.store.read("postings", "shop").join(tools.store.read("chunks", "shop").select("id", "path"), "id").where("term = 'fresh'").collect()} == {"new.py"}
    part = tools.index("shop", sample="new")
    assert part["chunks"] == 6 and part["embedded"] == 0 and tools.store.read("edges", "shop").where("path = 'app.py'").count()
    listed = {r["name"]: r["chunk_count"] for r in tools.list_repos()}
    assert listed == {"shop": 6, "empty": 0}
    assert len(tools.store.version()) == 5 and len(tools.store._numbers()) == 4


def test_events_are_applied(spark, tools, tmp_path):
    root = tmp_path / "repo"
    tools.index("shop")
    (root / "app.py").write_text(FILES["app.py"] + "\n\ndef later():\n    pass\n")
    (root / "lib/util.py").rename(root / "lib/moved.py")
    (root / "long.py").unlink()
    rows = [("app.py", "modified"), ("lib/util.py", "deleted"), ("lib/moved.py", "created"), ("long.py", "modified"), ("tests/test_app.py", "modified"), ("secret.py", "modified"), ("lib/__init__.py", "modified")]
    batch = spark.createDataFrame([("shop", *r) for r in rows], "repo string, path string, kind string")
    assert tools.apply("shop", batch)
    assert {r["path"] for r in tools.store.read("chunks", "shop").collect()} == {"app.py", "lib/moved.py", "web/é.ts"}
    edges = {(r["path"], r["dst"]) for r in tools.store.read("edges", "shop").collect()}
    assert ("app.py", "later") in edges and ("lib/moved.py", "spin_wheel") in edges and not any(p in ("lib/util.py", "long.py") for p, _ in edges)
    assert tools.list_repos()[0]["chunk_count"] == 3 and tools.search_code("later")[0]["path"] == "app.py"
    count = len(tools.store._numbers())
    assert not tools.apply("shop", batch) and len(tools.store._numbers()) == count  # nothing is different any more


def test_a_folder_is_watched(spark, tools, tmp_path):
    root = tmp_path / "repo"
    tools.index("shop")
    stream = tools.watch("shop", str(tmp_path / "checkpoint"), "200 milliseconds")
    try:
        time.sleep(4)
        (root / "web/é.ts").unlink()
        (root / "extra.py").write_text("def appeared():\n    pass\n")
        until = time.time() + 60
        wanted = {"app.py", "lib/util.py", "long.py", "extra.py"}
        while time.time() < until and {r["path"] for r in tools.store.read("chunks", "shop").collect()} != wanted:
            time.sleep(1)
        assert {r["path"] for r in tools.store.read("chunks", "shop").collect()} == wanted
    finally:
        stream.stop()


def test_folder_differences():
    a = {"x": (1, 5, 9), "y": (2, 5, 9), "z": (3, 5, 9), "gone": (4, 1, 1)}
    b = {"x": (1, 5, 9), "new/y": (2, 5, 9), "z": (3, 6, 9), "w": (7, 1, 1)}
    assert folder.differences(a, b) == [("gone", "deleted", None), ("y", "moved", "new/y"), ("w", "created", None), ("z", "modified", None)]


def test_sessions_of_a_stream(spark, tmp_path):
    source = tmp_path / "events"
    rows = [("r", "a.py", "created", "2024-01-01T00:00:00", 1), ("r", "a.py", "deleted", "2024-01-01T00:00:00.5", 2), ("r", "b.py", "modified", "2024-01-01T00:00:10", 3), ("q", "c.py", "modified", "2024-01-01T01:00:00", 4)]
    spark.createDataFrame(rows, "repo string, path string, kind string, ts string, seq long").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.json(str(source))
    stream = events.bursts_stream(spark.readStream.schema("repo string, path string, kind string, ts timestamp, seq long").json(str(source)), "1 second", "1 second")
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(60)
    got = sorted((r["repo"], sorted(e["seq"] for e in r["events"])) for r in spark.table("sessions").collect())
    assert got == [("r", [1, 2]), ("r", [3])]


def test_files_and_answers(spark, tools, tmp_path):
    assert tools.get_file_range("lib/util.py", 1, 1)["content"] == "def spin_wheel():"
    errors = {tools.get_file_range(*a)["error"] for a in (("lib/util.py", 0, 1), ("../../etc/passwd", 1, 2), ("none.py", 1, 2), ("secret.py", 1, 2))}
    assert errors == {"invalid_range", "path_outside_repos", "not_found", "secret_detected"}
    assert tools.get_file_range("a", 1, 2, "other")["error"]["available_repos"] == ["empty", "shop"] and "error" in tools.search_code("x", "other")[0]
    assert [(r["name"], r["lineno_start"], r["lineno_end"]) for r in tools.list_symbols("app.py")] == [("Runner", 4, 6), ("start_engine", 5, 6)]
    assert "Unsupported" in tools.list_symbols("lib/notes.md")[0]["error"] and "not found" in tools.list_symbols("x.py")[0]["error"]
    found = tools.grep_code(r"value_1\d ", max_results=3)
    assert [r["lineno"] for r in found] == [11, 12, 13] and found[0]["path"].endswith("repo/long.py") and "error" in tools.grep_code("(")[0]
    assert tools.admin_reindex({})[0] == 400 and tools.admin_reindex({"repo": "zzz"})[0] == 404
    status, answer = tools.admin_reindex({"repo": "shop", "commit_sha": "abc"})
    assert status == 200 and answer["chunks"] == 6
    figures = tools.stats()
    assert figures["by_tool"]["get_file_range"] == 6 and figures["errors"] >= 8 and figures["total_calls"] == sum(figures["by_tool"].values())
    assert oct(os.stat(tmp_path / "logs" / os.listdir(tmp_path / "logs")[0]).st_mode & 0o777) in ("0o600", "0o700")


def test_log_window(spark, tmp_path):
    now = datetime(2024, 5, 10, 12, tzinfo=timezone.utc)
    for hours in (1, 47, 49, 200):
        query_log.append(str(tmp_path), "search_code", {"query": f"q{hours}", "deep": ["x" * 600]}, 1.234, now=now - timedelta(hours=hours))
    with open(tmp_path / "queries-2024-05-10.jsonl", "a") as file:
        file.write("not json\n" + json.dumps({"ts": "never", "tool": "t"}) + "\n")
    got = query_log.read(spark, str(tmp_path), 2, now).collect()
    assert sorted(r["query"] for r in got) == ["q1", "q47"] and query_log.read(spark, str(tmp_path / "none"), 2, now).count() == 0


def test_settings_questions_and_snapshots(spark, tmp_path):
    config = str(tmp_path / "own.json")
    assert settings.register(config, "a", "/x") and not settings.register(config, "a", "/y")
    own = settings.settings(config)
    assert own["repos"][0]["path"] == "/x" and own["retrieval"]["rrf_k"] == 60 and own["hygiene"] == {}
    questions = str(tmp_path / "qa.json")
    settings.save(questions, [{"id": 1, "query": "where", "expected_paths": ["a.py"]}, {"id": "two", "query": "what"}])
    assert [tuple(r) for r in settings.questions(spark, questions).collect()] == [("1", "where", ["a.py"], []), ("two", "what", [], [])]
    source, target = tmp_path / "src", tmp_path / "snap"
    for path, text in {"a.py": "1", "b/c.py": "2", "x.log": "3", ".env": "4", "node_modules/m.js": "5", "big.py": "y" * 99, "ign.py": "6", ".gitignore": "ign.py\n"}.items():
        (source / path).parent.mkdir(parents=True, exist_ok=True)
        (source / path).write_text(text)
    assert snapshot.take(str(source), str(target), 50, "b", config)["copied"] == [".gitignore", "a.py", "b/c.py"]
    (source / "b/c.py").unlink()
    (source / "a.py").write_text("changed")
    assert snapshot.take(str(source), str(target), 50) == {"copied": ["a.py"], "removed": ["b/c.py"]} and not (target / "b").exists()
    assert [r["name"] for r in settings.load(config)["repos"]] == ["a", "b"]


def test_a_source_is_followed(tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    (source / "a.py").write_text("1")
    looks, acted = iter(range(40)), []

    def go_on():
        n = next(looks, None)
        if n in (3, 5, 6):
            (source / f"new{n}.py").write_text("x")
        if n == 25:
            (source / "x.log").write_text("left out")
        return n is not None

    assert snapshot.follow(str(source), lambda: acted.append(len(list(snapshot.wanted(str(source))))), 0.1, 0.02, go_on) == 1 and acted == [4]


def test_definitions_with_ends():
    go = 'package p\n\nfunc (t *T) Get() string {\n\tif x { return "}" } // }\n\treturn y\n}\n\nfunc two() {}\n'
    assert graph.symbols_of(go, "go") == [("Get", 3, 6), ("two", 8, 8)]
    ts = "export interface A {\n  b: string;\n}\nexport type B = string;\nclass C {\n  run() {\n  }\n}\n"
    assert graph.symbols_of(ts, "typescript") == [("A", 1, 3), ("B", 4, 4), ("C", 5, 8)]
    ruby = "class A\n  def b?\n    if x\n    end\n  end\nend\n"
    assert graph.symbols_of(ruby, "ruby") == [("A", 1, 6), ("b?", 2, 5)]
    assert graph.symbols_of("def broken(:\n", "python") == [("broken", 1, 1)] and graph.symbols_of("x", "cobol") == []


def test_chunks_of_statements(spark):
    body = "".join(f"    y{i} = {i} * 2\n" for i in range(30))
    code = f"import os\nimport re\n\n\n@deco\ndef long():\n{body}\n\ndef short():\n    return 1\n\n\nz = 3\n"
    spans = chunking.statements(code, 200)
    lines_ = code.split("\n")
    covered = [n for a, b in spans for n in range(a, b + 1)]
    assert len(covered) == len(set(covered)) and {n for n, x in enumerate(lines_, 1) if x.strip()} <= set(covered)
    assert all(sum(len(x) + 1 for x in lines_[a - 1 : b]) <= 200 for a, b in spans) and spans[0] == (1, 2)
    files = spark.createDataFrame([("r", "a.py", "python", code), ("r", "b.py", "python", "def (:\n"), ("r", "c.go", "go", "package x\n")], "repo string, path string, language string, code string")
    got = chunking.by_statements(files, 200).collect()
    assert {(r["lineno_start"], r["lineno_end"]) for r in got if r["path"] == "a.py"} == set(spans) and {r["path"] for r in got} == {"a.py", "b.py", "c.go"}
    assert len({r["id"] for r in got}) == len(got) and all(r["code"].startswith("# file: ") for r in got)


def test_models_side_by_side(spark, tools, tmp_path):
    made = []

    def make(alias, model):
        made.append(alias)
        return Tools(spark, tools.settings, store.Store(spark, str(tmp_path / alias)), tools.log_folder, model, environment_repo="shop")

    asked = [{"id": 1, "query": "spin_wheel", "expected_paths": ["lib/util.py"]}]
    found = compare_models(make, {"own/first": embedding.HashEmbedder(16), "second": lambda texts: [[1.0] * 16 for _ in texts]}, "shop", asked, str(tmp_path / "results"))
    assert made == ["first", "second"] and [r["recall_hits"] for r in found] == [1, 1] and len(os.listdir(tmp_path / "results")) == 1


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from corvane.__main__ import main

    monkeypatch.chdir(tmp_path)
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def only_one():\n    pass\n")
    config = str(tmp_path / "config.json")
    settings.save(config, {"repos": [], "embedding": {"dimension": 16}, "storage": {"path": str(tmp_path / "store")}})
    assert main(["--config", config, "snapshot", "own", str(tmp_path / "src"), str(tmp_path / "snap")]) == 0
    assert main(["--config", config, "index", "--repo", "nobody"]) == 1 and main(["--config", config, "index"]) == 0
    assert '"chunks": 1' in capsys.readouterr().out
    settings.save(str(tmp_path / "qa.json"), [{"id": 1, "query": "only_one", "expected_paths": ["a.py"]}])
    assert main(["--config", config, "evaluate", str(tmp_path / "qa.json"), "--repo", "own"]) == 0
    assert len(os.listdir(tmp_path / "results")) == 2


def test_evaluation(tmp_path):
    asked = [{"id": "1", "query": "a", "expected_paths": ["x.py"]}, {"id": "2", "query": "b", "expected_symbols": ["S"]}, {"id": "3", "query": "fail"}, {"id": "4", "query": "c", "expected_paths": ["none"]}]

    def search(query, k):
        if query == "fail":
            raise RuntimeError("broken")
        return [{"path": "dir/other.py", "symbol": None, "score": 1.0}, {"path": "dir/x.py", "symbol": "S", "score": 0.5}]

    result = evaluate.run(asked, search)
    assert (result["recall_hits"], result["total"], result["recall_at_5"], result["mrr"]) == (2, 4, 0.5, 0.25)
    as_json, as_text = evaluate.write_results(str(tmp_path), "own", result)
    assert json.load(open(as_json))["details"][2]["error"] == "broken" and "| 1 | a | ✅ | 2 |" in open(as_text).read()
    both = evaluate.write_comparison(str(tmp_path), [{"model": "m1", "alias": "one", **result}, {"model": "m2", "alias": "two", **result, "recall_at_5": 0.75}])
    assert "| m2 | 0.75 (2/4) | 0.25 |" in open(both).read() and "+0.25" in open(both).read()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["hybrid_search", "hybrid_reranked", "consensus_guard", "rrf_shared_ids", "bfs_capped", "chunk_windows", "events_chunks", "events_edges", "stats_p95"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    df = catalog.QUERIES[name](spark, SF)
    found = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(tidy(v) for v in row) for row in found.fetchall()), key=repr)
    assert sorted((tuple(tidy(r[n]) for n in names) for r in df.collect()), key=repr) == want
