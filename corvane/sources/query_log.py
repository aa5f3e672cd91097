"""The log of calls: one JSON object a line, one file a day."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import scrub

SCHEMA = "ts string, query_id string, tool string, args struct<query:string, repo:string>, returned_chunk_ids array<string>, returned_paths array<string>, rerank_scores array<double>, latency_ms double, client string, session_id string, error string, bad string"


def append(folder: str, tool: str, args: dict, latency_ms: float, paths=(), chunk_ids=(), scores=(), error: str | None = None, now: datetime | None = None) -> str:
    """Adds a call to today's file, which only its owner may read; returns the call's id. Failures to write are not the caller's."""
    now, ident = now or datetime.now(timezone.utc), str(uuid.uuid4())
    record = {"ts": now.strftime("%Y-%m-%dT%H:%M:%SZ"), "query_id": ident, "tool": tool, "args": scrub(args), "returned_chunk_ids": list(chunk_ids), "returned_paths": list(paths), "rerank_scores": list(scores), "latency_ms": round(latency_ms, 2), "client": None, "session_id": None}
    if error:
        record["error"] = error
    try:
        os.makedirs(folder, mode=0o700, exist_ok=True)
        with os.fdopen(os.open(f"{folder}/queries-{now:%Y-%m-%d}.jsonl", os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o600), "a") as file:
            file.write(json.dumps(record) + "\n")
    except OSError:
        pass
    return ident


def read(spark: SparkSession, folder: str, days: int = 7, now: datetime | None = None) -> DataFrame:
    """Calls since so many days before now: only files of that day and later are opened. Lines and times that can't be read are left out; a time without a zone is UTC."""
    since = (now or datetime.now(timezone.utc)) - timedelta(days=days)
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/queries-*.jsonl")
    found = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path) or []
    first = f"queries-{since:%Y-%m-%d}"
    wanted = sorted(str(f.getPath()) for f in found if f.getPath().getName().removesuffix(".jsonl") >= first)
    rows = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(wanted) if wanted else spark.createDataFrame([], SCHEMA)
    return rows.withColumn("at", F.expr("try_to_timestamp(ts)")).where(F.col("at") >= F.lit(since)).withColumn("query", F.col("args.query")).drop("bad")
