"""What the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: everything else belongs to a word. bytes.split() uses the same set.
SPACES = "\t\n\x0b\x0c\r "
#: Text handled at once in a Python worker, in bytes; bounds its memory whatever the size of Arrow's batches.
CHUNK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application's in the one that all executors share, removed when the application ends.

    That one is spark.checkpoint.dir; where a session names none (tests), it is made under the warehouse.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None)
    if found is None and not (own := context._jsc.sc().getCheckpointDir()).isEmpty():
        found = own.get()
    folder = f"{(found or spark.conf.get('spark.sql.warehouse.dir') + '/_checkpoints').rstrip('/')}/corvane-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if files.mkdirs(path):
        files.deleteOnExit(path)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage: df written as a table in the shared folder, and read back. What was written outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo modulus; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def reduced(docs: DataFrame, drop: list[str], results: dict[str, str], last: str | None = None) -> tuple[DataFrame, list[str], str]:
    """docs without the columns named in drop or like a result, and with `last` as the last column (under a name of its own);
    the names that are left, without that one; and the schema of these and the results.

    Columns are told apart by place afterwards, so that no name of the caller's can clash with one of ours.
    """
    gone = {n.lower() for n in (*drop, *results)}
    fields = [f for f in docs.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields), *(f"`{n}` {kind}" for n, kind in results.items())])
    own = "_" * (1 + max(map(len, names), default=0))  # longer than any other name
    return docs.select(*[docs[quoted(n)] for n in names], *([docs[quoted(last)].alias(own)] if last else [])), names, schema


def quoted(name: str) -> str:
    """A column's name as it has to be written where dots and quotes have a meaning."""
    return "`" + name.replace("`", "``") + "`"


def remainder_sql(doc_id: str, modulus: int) -> str:
    """doc_remainder() in SQL."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = f"list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: {step}))"
    codes = f"list_transform(string_split(coalesce({doc_id}::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)"
    codes = f"CASE WHEN {doc_id} IS NULL THEN [] ELSE {codes} END"
    return f"(SELECT xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {modulus} FROM (SELECT {table} AS t) _)"


def trim() -> None:
    """Gives memory that is free back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str | int, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches whose texts add up to about limit bytes (one text at least), with the texts as UTF-8."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text)).cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + batch.num_rows + 1]
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
            stop = min(stop, batch.num_rows)
            yield batch.slice(start, stop - start), column.slice(start, stop - start).to_pylist()
            start = stop
    trim()


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def segments(lengths: np.ndarray) -> np.ndarray:
    """Starts of consecutive runs of the given lengths."""
    return np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
