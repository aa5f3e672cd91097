"""A pipeline over documents; each stage's result is written as Parquet and is the next one's documents.

All stages take any table with the columns of documents; other columns, whatever their names, are passed on by all but
the last. An empty table gives an empty one at each stage. What becomes of nulls, empty texts, repeated rows and ties:

| Stage | null or empty text | null id | repeated rows and shared ids | ties |
|---|---|---|---|---|
| quality rules | goes: it has under ten words | judged like others | each is judged by itself | a language's equally common words in their order |
| near-duplicates | one fingerprint, so one row stays | stays | of rows with the same id and text one stays; others by their own texts | smallest id, then least hash of the text |
| repeated passages | stays | stays | each is cut by its own text; copies under one id aren't held against each other | the smallest id keeps the passage |
| benchmark decontamination | stays | judged by its text | all copies of a leaking text go | any leak counts |
| tokens | no ids | like others | repeated results | - |

Texts of any length go through whole; the operators' docstrings say how.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import byte_bpe, common, decontaminate, passage_dedup, quality_rules, simhash


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents with smaller ids have."""
    return passage_dedup.without_repeats(docs)


def benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no test item."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether they decode to the text."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    own = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))  # no other names come in
    found = byte_bpe.round_trip(own, ranks, public_tokenizers.PATTERN)
    return found.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark decontamination", benchmark),
    ("tokens", tokens),
]

#: No SQL for the fingerprints' groups, chains and merges.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents. What is between them is kept in the shared checkpoint folder until the application ends."""
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
