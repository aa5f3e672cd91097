"""A table kept up to date by difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(current: DataFrame, existing: DataFrame, key: str = "id", digest: str = "content_hash") -> DataFrame:
    """Rows of current that are new or differ from the existing ones: those to embed again."""
    old = existing.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_there"))
    return current.join(old, key, "left").where(F.col("_there").isNull() | ~F.col(digest).eqNullSafe(F.col("_old"))).drop("_old", "_there")


def stale(current: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows of existing that current no longer has."""
    return existing.join(current.select(key), key, "left_anti")


def upsert(existing: DataFrame, current: DataFrame, key: str = "id", digest: str = "content_hash", keep: bool = False) -> DataFrame:
    """The state after, from one join: rows that are equal stay as they were, others come from current; those that current
    no longer has go, unless keep. Columns that one side lacks are null in its rows."""
    fields = {f.name: f.dataType for table in (current, existing) for f in table.schema.fields}

    def side(table: DataFrame, name: str) -> DataFrame:
        row = F.struct(*[F.col(n) if n in table.columns else F.lit(None).cast(kind).alias(n) for n, kind in fields.items()])
        return table.select(F.col(key).alias("_key"), row.alias(name))

    both = side(existing, "_old").join(side(current, "_new"), "_key", "full_outer" if keep else "right")
    old = F.col("_new").isNull() | (F.col("_old").isNotNull() & F.col(f"_old.{digest}").eqNullSafe(F.col(f"_new.{digest}")))
    return both.select(F.when(old, F.col("_old")).otherwise(F.col("_new")).alias("_row")).select("_row.*")


def without_paths(table: DataFrame, paths: DataFrame) -> DataFrame:
    """The table without the rows of some (repo, path)."""
    return table.join(paths.select("repo", "path").distinct(), ["repo", "path"], "left_anti")


def catalog(chunks: DataFrame, repos: DataFrame) -> DataFrame:
    """repos (name, path) with the number of chunks of each, 0 for none."""
    counts = chunks.groupBy(F.col("repo").alias("name")).agg(F.count(F.lit(1)).alias("chunk_count"))
    return repos.join(counts, "name", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
