"""Figures from the log of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How far from the place looked for a sketch may be, as a share of the values, and from how many values on it is used.
NEAR, MANY = 0.001, 10_000


def _failed():
    return F.coalesce(F.col("error"), F.lit("")) != ""


def totals(log: DataFrame) -> DataFrame:
    """One row: calls, errors, mean latency. log: tool, query, latency_ms, error, ts."""
    return log.agg(F.count(F.lit(1)).alias("total"), F.count_if(_failed()).alias("errors"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"))


def _p95(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, p95_latency_ms): the value at place min(n, floor(0.95 n) + 1) of the sorted ones; keys without a value have no row.

    A first pass gives for each key a stretch of values around that place, from a sketch of fixed size, a second one
    counts what is below it, and how often each value in it is there: of many values a few thousandths are sorted.
    """
    known = log.where("latency_ms is not null").select(*keys, F.col("latency_ms").alias("_v"))
    sketch = F.percentile_approx("_v", F.array(F.lit(0.95 - NEAR), F.lit(0.95 + NEAR)), 20_000)
    around = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), sketch.alias("_near"))
    many = F.col("_n") >= MANY
    around = around.select(*keys, "_n", F.when(many, F.col("_near")[0]).otherwise(F.col("_least")).alias("_low"), F.when(many, F.col("_near")[1]).otherwise(F.col("_most")).alias("_high"))
    both = known.join(around, list(keys)) if keys else known.crossJoin(F.broadcast(around))  # one row without keys
    value = F.when(F.col("_v") < F.col("_low"), F.lit(None)).otherwise(F.col("_v"))  # all that are below are one
    counts = both.where("_v <= _high").groupBy(*keys, value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    order = Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    place = F.least(F.col("_n"), F.floor(F.col("_n") * F.lit(0.95)) + 1)
    running = counts.withColumn("_upto", F.sum("_c").over(order)).where(F.col("_upto") >= place)
    return running.groupBy(*keys).agg(F.min("_v").alias("p95_latency_ms"))


def p95(log: DataFrame) -> DataFrame:
    """The latency by rank; 0 for none."""
    return _p95(log).agg(F.coalesce(F.max("p95_latency_ms"), F.lit(0.0)).alias("p95_latency_ms"))


def by_tool(log: DataFrame) -> DataFrame:
    """(tool, n, avg_latency_ms, p95_latency_ms); calls without a tool are those of 'unknown'."""
    named = log.withColumn("tool", F.coalesce("tool", F.lit("unknown")))
    found = named.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"))
    return found.join(_p95(named, "tool"), "tool", "left").withColumn("p95_latency_ms", F.coalesce("p95_latency_ms", F.lit(0.0)))


def top_queries(log: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent queries; of equals, the one asked first."""
    counted = log.where("query is not null").groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))
    return counted.orderBy(F.desc("n"), "first_ts", "query").limit(k).select("query", "n")


def summary(log: DataFrame, days: int = 7) -> dict:
    """All figures as a caller gets them; latencies to one place. Small results come to the driver: a row for each tool, ten queries."""
    whole = totals(log).first()
    return {
        "days": days,
        "total_calls": whole["total"],
        "by_tool": {r["tool"]: r["n"] for r in by_tool(log).select("tool", "n").collect()},
        "errors": whole["errors"],
        "avg_latency_ms": round(whole["avg_latency_ms"], 1),
        "p95_latency_ms": round(p95(log).first()[0], 1),
        "top_queries": [(r["query"], r["n"]) for r in top_queries(log).collect()],
    }
