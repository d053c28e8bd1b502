"""Streams: new files, counters by session, containers to rebuild, and windows over activity; each with its batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SAVE_EVERY, REBUILD_AFTER = 15, 20
#: Containers that hold records of the engine itself.
SENTINELS = ("hall_registry", "_registry", "diary")


def save_points(turns: DataFrame, every: int = SAVE_EVERY) -> DataFrame:
    """conv_id, turn, batch: each `every`-th human turn of a conversation."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.where("role = 'user'").withColumn("n", n).where(F.col("n") % every == 0).select("conv_id", "turn", (F.col("n") / every).cast("long").alias("batch"))


def save_points_stream(turns: DataFrame, every: int = SAVE_EVERY) -> DataFrame:
    """The same over a stream: the state of a conversation is one counter."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def count(key, frames, state):
        n = state.get[0] if state.exists else 0
        rows = []
        for turn in sorted(t for frame in frames for t in frame["turn"]):  # a key's rows may come in several frames
            n += 1
            if n % every == 0:
                rows.append((key[0], turn, n // every))
        state.update((n,))
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "batch"])

    return turns.where("role = 'user'").groupBy("conv_id").applyInPandasWithState(count, "conv_id long, turn long, batch long", "n long", "append", GroupStateTimeout.NoTimeout)


def dirty_containers(changes: DataFrame) -> DataFrame:
    """container, changes: containers that something has changed in; registries and diaries are never among them."""
    return changes.where(~F.col("container").isin(*SENTINELS)).groupBy("container").agg(F.count("*").alias("changes"))


def due(dirty: DataFrame, after: int = REBUILD_AFTER) -> DataFrame:
    """All of dirty if it has `after` containers or more, else none."""
    enough = dirty.agg((F.count("*") >= after).alias("enough"))
    return dirty.join(F.broadcast(enough)).where("enough").drop("enough")  # one row


def rebuild_dirty(changes: DataFrame, rebuild: Callable[[DataFrame], None], marks: str, checkpoint: str, after: int = REBUILD_AFTER, **trigger):
    """A stream that hands the dirty containers to rebuild() as soon as there are `after` of them; nothing else is computed again.

    Marks outlive their micro-batch: batch n writes those that are open to a table of its own below `marks`, from that of
    batch n - 1, so that a batch that runs again after a failure starts from the same marks.
    """

    def batch(rows: DataFrame, n: int) -> None:
        dirty = dirty_containers(rows)
        if n:
            dirty = dirty.union(rows.sparkSession.read.schema("container string, changes long").parquet(f"{marks}/batch={n - 1}"))
        dirty = dirty.groupBy("container").agg(F.sum("changes").alias("changes")).persist()
        enough = dirty.count() >= after
        if enough:
            rebuild(dirty.select("container"))
        (dirty.limit(0) if enough else dirty).write.mode("overwrite").parquet(f"{marks}/batch={n}")
        dirty.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str, key: str = "drawer_id"):
    """A stream of Parquet files: those not seen before are appended; ids that come again within a batch count once.

    Ids are made of content, so a batch that is run again after a failure writes the same rows; a reader that needs
    each id once across batches takes dropDuplicates.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.dropDuplicates([key]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, by: str = "kind", width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by window; in a stream, events later than `late` are dropped and windows are final."""
    rows = events.withWatermark("ts", late) if late else events
    return _windows(rows, F.window("ts", width), by)


def sliding(events: DataFrame, by: str = "kind", width: str = "2 hours", step: str = "1 hour", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return _windows(rows, F.window("ts", width, step), by)


def session_windows(events: DataFrame, gap: str = "30 minutes", by: str = "session", late: str | None = None) -> DataFrame:
    """Runs of events of which none follows the last by the gap or more."""
    rows = events.withWatermark("ts", late) if late else events
    return _windows(rows, F.session_window("ts", gap), by)


def _windows(rows: DataFrame, window: Column, by: str) -> DataFrame:
    found = rows.groupBy(window.alias("w"), by).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "events", "total")


def diary_news(entries: DataFrame, done: DataFrame) -> DataFrame:
    """entries (path, entry, ...) beyond those that were taken of their file before (path, entry_count)."""
    joined = entries.join(done.select("path", "entry_count"), "path", "left")
    return joined.where(F.col("entry") >= F.coalesce("entry_count", F.lit(0))).drop("entry_count")
