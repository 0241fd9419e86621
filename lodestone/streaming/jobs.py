"""Who works on a workspace: a ledger of heartbeats, stalled jobs, and cancelling by tag."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Seconds without a heartbeat after which a job counts as stalled.
TIME_TO_LIVE = {"Watcher": 15, "Indexing": 20, "Enhancement": 20}
RECORDS = "workspace_id string, job string, kind string, phase string, attempt int, heartbeat_unix long, active boolean, details map<string,string>"


class Ledger:
    """Heartbeats as small JSON files below ``root``; the last one of a job counts."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def beat(self, workspace: str, job: str, kind: str, phase: str, attempt: int = 1, active: bool = True, now: float | None = None, **details: str) -> None:
        row = {"workspace_id": workspace, "job": job, "kind": kind, "phase": phase, "attempt": attempt, "heartbeat_unix": int(time.time() if now is None else now), "active": active, "details": details}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{row['heartbeat_unix']:012d}-{uuid.uuid4().hex}.json")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()

    def jobs(self, now: float | None = None) -> DataFrame:
        """The last record of each job, and whether it is stalled: active, but silent for longer than its kind may be."""
        rows = self.spark.read.schema(RECORDS).json(self.root)
        last = rows.groupBy("workspace_id", "job").agg(F.max_by(F.struct("kind", "phase", "attempt", "heartbeat_unix", "active", "details"), "heartbeat_unix").alias("r")).select("workspace_id", "job", "r.*")
        limit = F.element_at(F.create_map(*[F.lit(x) for pair in TIME_TO_LIVE.items() for x in pair]), F.col("kind"))
        return last.withColumn("stalled", F.col("active") & (F.lit(int(time.time() if now is None else now)) - F.col("heartbeat_unix") > F.coalesce(limit, F.lit(20))))


def phase_of(query: StreamingQuery) -> str:
    """idle, indexing or stopped, from a stream's own status."""
    if not query.isActive:
        return "stopped"
    return "indexing" if query.status["isTriggerActive"] else "idle"


@contextlib.contextmanager
def cancellable(spark: SparkSession, tag: str | None = None) -> Iterator[str]:
    """Jobs started within carry a tag; ``cancel`` with it stops them."""
    tag = tag or f"lodestone-{uuid.uuid4().hex[:8]}"
    spark.addTag(tag)
    try:
        yield tag
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.interruptTag(tag)
