"""File events: what a burst of them comes to, and its application to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_moves(events: DataFrame) -> DataFrame:
    """events (repo, path, kind, ts, seq, moved_to) with each move as a deletion and a creation."""
    after = F.struct(F.col("moved_to").alias("path"), F.lit("created").alias("kind"))
    before = F.struct(F.col("path"), F.lit("deleted").alias("kind"))
    plain = F.struct(F.col("path"), F.col("kind"))
    both = F.when(F.col("kind") == "moved", F.array(before, after)).otherwise(F.array(plain))
    return events.select("repo", "ts", "seq", F.posexplode(both).alias("part", "e")).select("repo", "e.path", "e.kind", "ts", (F.col("seq") * 2 + F.col("part")).alias("seq"))


def coalesce(events: DataFrame, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """One kind for each path: deleted if the last event is a deletion, modified if one came before, else the first kind."""
    grouped = events.groupBy(*keys).agg(
        F.max_by("kind", "seq").alias("_last"), F.min_by("kind", "seq").alias("_first"), F.max(F.when(F.col("kind") == "deleted", 1).otherwise(0)).alias("_deleted"), F.count(F.lit(1)).alias("n_events")
    )
    kind = F.when(F.col("_last") == "deleted", "deleted").when(F.col("_deleted") == 1, "modified").otherwise(F.col("_first"))
    return grouped.select(*keys, kind.alias("kind"), "n_events")


def bursts(events: DataFrame, gap_seconds: float = 1.0, key: str = "repo", slot_seconds: int = 3600) -> DataFrame:
    """events with burst: a number that rises whenever nothing came for the gap, for each key.

    Each key's events are sorted by slots of time, so that a busy key isn't one task's; what a slot begins with comes
    from a table with a row for each key and slot: the last time before it, and the bursts so far.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    own = events.withColumns({"_at": micros, "_slot": F.floor(micros / F.lit(int(slot_seconds * 1e6)))})
    slots = own.groupBy(key, "_slot").agg(F.max("_at").alias("_last"))
    slots = slots.withColumn("_before", F.lag("_last").over(Window.partitionBy(key).orderBy("_slot"))).drop("_last")
    own = own.join(slots, [key, "_slot"])
    order = Window.partitionBy(key, "_slot").orderBy("_at", "seq")
    since = (F.col("_at") - F.coalesce(F.lag("_at").over(order), F.col("_before"))) / 1e6
    own = own.withColumn("_starts", F.when(since.isNull() | (since >= gap_seconds), 1).otherwise(0))
    earlier = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy(key, "_slot").agg(F.sum("_starts").alias("_n")).withColumn("_so_far", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    own = own.join(sums, [key, "_slot"]).withColumn("burst", F.col("_so_far") + F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return own.drop("_at", "_slot", "_before", "_starts", "_so_far")


def bursts_stream(events: DataFrame, gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """The same over a stream: sessions by repository, with the events of each, once they are over."""
    own = events.withWatermark("ts", late)
    return own.groupBy(F.session_window("ts", gap), "repo").agg(F.collect_list(F.struct("seq", "path", "kind")).alias("events"))


def follow(events: DataFrame, apply, checkpoint: str, interval: str = "1 second"):
    """Runs apply(coalesced batch, batch id) on each micro-batch of a stream of events."""

    def batch(df: DataFrame, number: int) -> None:
        apply(coalesce(split_moves(df)), number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
