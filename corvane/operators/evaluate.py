"""How good ranked lists are: recall, reciprocal rank, latency."""

from __future__ import annotations

import json
import os
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matches(hit_path, hit_symbol, expected_paths, expected_symbols):
    by_path = F.exists(expected_paths, lambda p: F.instr(hit_path, p) > 0)
    by_symbol = F.exists(expected_symbols, lambda s: hit_symbol.eqNullSafe(s) | (F.instr(hit_path, s) > 0))
    return by_path | by_symbol


def first_ranks(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, rank, latency_ms, error): the first rank at which a question's hits match. hits: qid, rank, path, symbol."""
    own = questions.join(hits, "qid", "left")
    fits = matches(F.col("path"), F.col("symbol"), F.col("expected_paths"), F.col("expected_symbols"))
    return own.groupBy("qid").agg(F.min(F.when(fits, F.col("rank"))).alias("rank"), F.first("latency_ms").alias("latency_ms"), F.first("error").alias("error"))


def summary(ranks: DataFrame, k: int = 5) -> DataFrame:
    """One row: questions, recall at k, mean reciprocal rank, mean latency. Questions that failed count as missed, but not for the latency."""
    hit = F.coalesce(F.col("rank") <= k, F.lit(False))
    return ranks.agg(
        F.count(F.lit(1)).alias("total"),
        F.avg(hit.cast("double")).alias("recall"),
        F.avg(F.when(hit, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"),
        F.avg(F.when(F.col("error").isNull(), F.col("latency_ms"))).alias("avg_latency_ms"),
    )


def against_first(results: DataFrame) -> DataFrame:
    """results (place, model, recall, mrr) with the difference to the first model."""
    first = results.orderBy("place").limit(1).select(F.col("recall").alias("_r"), F.col("mrr").alias("_m"))
    return results.crossJoin(F.broadcast(first)).withColumns({"recall_delta": F.col("recall") - F.col("_r"), "mrr_delta": F.col("mrr") - F.col("_m")}).drop("_r", "_m")


def run(questions: list[dict], search, k: int = 5) -> dict:
    """Asks each question (id, query, expected_paths, expected_symbols) of search(query, k), which gives hits (path, symbol, score).

    One question's failure is its own: it counts as missed, and not for the latency. For a question set, which is small; the
    figures of large ones come from first_ranks() and summary().
    """
    details, taken = [], []
    for q in questions:
        began = time.perf_counter()
        try:
            hits = search(q["query"], k)
        except Exception as e:
            details.append({"id": q["id"], "query": q["query"], "recall": False, "rank": None, "error": str(e)})
            continue
        taken.append((time.perf_counter() - began) * 1000)
        paths, symbols = q.get("expected_paths") or [], q.get("expected_symbols") or []
        fits = lambda h: any(p in (h.get("path") or "") for p in paths) or any(s == h.get("symbol") or s in (h.get("path") or "") for s in symbols)
        rank = next((n for n, h in enumerate(hits, 1) if fits(h)), None)
        top = [{n: h.get(n) for n in ("path", "symbol", "score")} for h in hits]
        details.append({"id": q["id"], "query": q["query"], "recall": rank is not None, "rank": rank, "latency_ms": taken[-1], "top_hits": top})
    total, found = len(questions), [d["rank"] for d in details if d["rank"]]
    share = lambda x: x / total if total else 0.0
    return {"recall_at_5": share(len(found)), "mrr": share(sum(1 / r for r in found)), "recall_hits": len(found), "total": total, "avg_latency_ms": sum(taken) / len(taken) if taken else 0.0, "details": details}


def _table(head: list[str], rows: list[list]) -> str:
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |\n"
    return line(head) + "|" + "---|" * len(head) + "\n" + "".join(map(line, rows))


def _mark(detail: dict) -> str:
    return "✅" if detail["recall"] else "❌"


def write_results(folder: str, label: str, result: dict, title: str | None = None, at: datetime | None = None) -> tuple[str, str]:
    """A run as JSON and as Markdown; gives both paths."""
    stamp = f"{at or datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}"
    os.makedirs(folder, exist_ok=True)
    paths = tuple(os.path.join(folder, f"{label}_{stamp}.{kind}") for kind in ("json", "md"))
    with open(paths[0], "w", encoding="utf-8") as file:
        json.dump({"phase": label, "timestamp": stamp, **result}, file, ensure_ascii=False, indent=2)
    rows = [[d["id"], d["query"], _mark(d), d.get("rank") or "-", f"{d['latency_ms']:.0f}" if "latency_ms" in d else "-"] for d in result["details"]]
    with open(paths[1], "w", encoding="utf-8") as file:
        file.write(f"# {title or label}\n\n**Timestamp**: {stamp}\n**recall@5**: {result['recall_at_5']:.2f} ({result['recall_hits']}/{result['total']})\n")
        file.write(f"**MRR**: {result['mrr']:.2f}\n**avg latency**: {result['avg_latency_ms']:.0f} ms\n\n## Per-Query Results\n\n")
        file.write(_table(["ID", "Query", "Recall", "Rank", "Latency (ms)"], rows))
    return paths


def write_comparison(folder: str, results: list[dict], at: datetime | None = None) -> str:
    """Runs of several models (model, alias and what run() gives) side by side, the first one as the baseline; gives the path."""
    stamp = f"{at or datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}"
    os.makedirs(folder, exist_ok=True)
    path, base = os.path.join(folder, f"embeddings_{stamp}.md"), results[0]["recall_at_5"] if results else 0.0
    rows = [[r["model"], f"{r['recall_at_5']:.2f} ({r['recall_hits']}/{r['total']})", f"{r['mrr']:.2f}", f"{r['avg_latency_ms']:.0f}", f"{r['recall_at_5'] - base:+.2f}"] for r in results]
    asked = results[0]["details"] if results else []
    each = [[d["id"], d["query"], *(f"{_mark(r['details'][i])} r={r['details'][i].get('rank') or '-'}" for r in results)] for i, d in enumerate(asked)]
    with open(path, "w", encoding="utf-8") as file:
        file.write(f"# Embedding comparison\n\n**Timestamp**: {stamp}\n**Baseline model**: {results[0]['model'] if results else '-'}\n\n")
        file.write(_table(["model", "recall@5", "MRR", "avg latency (ms)", "Δ recall vs baseline"], rows))
        file.write("\n## Per-Query Ranks\n\n" + _table(["ID", "Query", *(r["alias"] for r in results)], each))
    return path
