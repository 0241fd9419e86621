"""Change events to index updates: events of a batch are merged by file, then applied as one delta."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.chunking import chunk_files
from lodestone.operators.maintain import apply_delta
from lodestone.sources.tables import Versions

EVENTS = "workspace_id string, file_path string, seq long, deleted boolean, text string"


def coalesce(events: DataFrame) -> DataFrame:
    """The last event of each file."""
    last = events.groupBy("workspace_id", "file_path").agg(F.max_by(F.struct("deleted", "text"), "seq").alias("e"), F.count("*").alias("merged"))
    return last.select("workspace_id", "file_path", "e.deleted", "e.text", "merged")


def apply(versions: Versions, events: DataFrame) -> None:
    """Apply a batch of events to the chunks in force and write the next version."""
    touched = coalesce(events)
    new = chunk_files(touched.where("not deleted").select("workspace_id", "file_path", "text"))
    done = new if versions.current() is None else apply_delta(versions.read("chunks"), touched, new)
    versions.write({"chunks": done})


def watch(spark: SparkSession, events_dir: str, root: str, checkpoint: str, on_batch: Callable[[int], None] | None = None, **trigger) -> StreamingQuery:
    """Follow a folder of change events (JSON). A batch that is sent again after a failure gives the same result."""
    versions = Versions(spark, root)

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            apply(versions, df)
        if on_batch is not None:
            on_batch(number)

    stream = spark.readStream.schema(EVENTS).json(events_dir)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
