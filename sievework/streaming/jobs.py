"""Structured Streaming jobs: incremental ingest, outcome state, event derivation, retention.

Each takes a streaming DataFrame and returns a started query; ``available_now`` triggers run to the end of what is
there and stop, which is also how a scheduler runs them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sievework.operators.memory import relationships_of
from sievework.sources.corpus import chunks, scan_directory


def _started(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingest_files(spark: SparkSession, root: str, target: str, checkpoint: str, size: int = 1000, overlap: int = 200, every: str | None = None, per_trigger: int = 1000) -> StreamingQuery:
    """New text files below a root as chunks; the checkpoint is the cursor, moved only when a batch is written."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(root)
    docs = files.select(F.col("path").alias("source_document_id"), F.col("modificationTime").alias("ts"), F.col("content").cast("string").alias("text"))

    def write(batch: DataFrame, batch_id: int) -> None:
        # One folder a batch: a batch that is run again replaces its own rows.
        chunks(batch, "text", size, overlap).drop("text").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return _started(docs.writeStream.foreachBatch(write), checkpoint, every)


def ingest_changes(spark: SparkSession, root: str, snapshot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(changes, new snapshot) of a directory against the last snapshot (path, ts): files that went are seen as well,
    which a file stream does not report. Without a snapshot every file is new."""
    from sievework.sources.corpus import changes

    now = scan_directory(spark, root).select("path", "ts")
    before = snapshot if snapshot is not None else now.limit(0)
    return changes(before, now, "ts"), now


def ingest_once(spark: SparkSession, root: str, state: str, size: int = 1000, overlap: int = 200, fail: Callable[[DataFrame], None] | None = None) -> dict[str, int]:
    """One run of an ingest that sees deletions: changes of a directory since the last run that ended well are applied
    to the chunks under ``state``, deletions first, and then the new snapshot becomes the cursor. A run that fails
    leaves the cursor where it was. Returns how many files were added, modified and deleted.

    state/chunks-N and state/snapshot-N belong together; the snapshot is written last. fail: called with the new
    chunks before they count, for checks of the caller's.
    """
    last = last_run(spark, state)
    before = spark.read.parquet(f"{state}/snapshot-{last}") if last else None
    found, now = ingest_changes(spark, root, before)
    gone = found.where("change <> 'ADDED'").select(F.col("path").alias("source_document_id"))
    fresh = scan_directory(spark, root).join(found.where("change <> 'DELETED'"), "path").select(F.col("path").alias("source_document_id"), F.col("content").cast("string").alias("text"))
    new = chunks(fresh, "text", size, overlap).drop("text")
    if last:
        new = spark.read.schema(new.schema).parquet(f"{state}/chunks-{last}").join(gone, "source_document_id", "left_anti").unionByName(new)
    new.write.mode("overwrite").parquet(f"{state}/chunks-{last + 1}")
    if fail is not None:
        fail(spark.read.schema(new.schema).parquet(f"{state}/chunks-{last + 1}"))
    counts = {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}  # three rows at most
    now.write.mode("overwrite").parquet(f"{state}/snapshot-{last + 1}")
    return {k: counts.get(k, 0) for k in ("ADDED", "MODIFIED", "DELETED")}


def last_run(spark: SparkSession, state: str) -> int:
    """The number of the last run whose snapshot is whole; 0 before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return 0
    names = [f.getPath().getName() for f in store.listStatus(path)]
    done = [int(n.removeprefix("snapshot-")) for n in names if n.startswith("snapshot-") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{n}/_SUCCESS"))]
    return max(done, default=0)


def ingested(spark: SparkSession, state: str) -> DataFrame:
    """The chunks after the last run that ended well."""
    return spark.read.parquet(f"{state}/chunks-{last_run(spark, state)}")


def debounced(events: DataFrame, gap: str = "2 seconds") -> DataFrame:
    """(path, change, ts) from file events (path, change, ts): events of one path with less than ``gap`` between them
    count as the last of them; paths with a hidden part are left out. A change OVERFLOW (its path is null) stays and
    asks for a scan of everything. Works on tables and, behind a watermark, on streams."""
    seen = events.where(F.col("path").isNull() | ~F.regexp_like(F.coalesce("path", F.lit("")), F.lit(r"(^|/)\.")))
    bursts = seen.groupBy("path", F.session_window("ts", gap).alias("_w")).agg(F.max_by("change", "ts").alias("change"), F.max("ts").alias("ts"))
    return bursts.select("path", "change", "ts")


class OutcomeState(StatefulProcessor):
    """Confidence of a case: moved by each outcome later than the last one; earlier ones are dropped."""

    def __init__(self, learning_rate: float = 0.2):
        self.learning_rate = learning_rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "confidence double, last long, applied long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        confidence, last, applied = self.state.get() if self.state.exists() else (1.0, None, 0)
        events = pd.concat(list(rows)).sort_values(["observed_us", "seq"])
        for at, rate in zip(events["observed_us"].tolist(), events["rate"].tolist(), strict=True):
            if last is None or at > last:
                confidence, last, applied = (1 - self.learning_rate) * confidence + self.learning_rate * rate, at, applied + 1
        self.state.update((confidence, last, applied))
        yield pd.DataFrame({"case_id": [key[0]], "confidence": [confidence], "last_us": [last], "applied": [applied]})

    def close(self) -> None:
        pass


def outcome_confidence(events: DataFrame, learning_rate: float = 0.2) -> DataFrame:
    """A streaming table case_id, confidence, last_us, applied from events case_id, observed_at, seq, rate."""
    rows = events.select("case_id", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("observed_us"), F.col("seq").cast("long").alias("seq"), F.col("rate").cast("double").alias("rate"))
    return rows.groupBy("case_id").transformWithStateInPandas(OutcomeState(learning_rate), "case_id string, confidence double, last_us long, applied long", "Update", "None")


def derive_relationships(experiences: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Relationship rows of an experience stream."""
    return _started(relationships_of(experiences).writeStream.format("parquet").option("path", target).outputMode("append"), checkpoint, every)


def append_valid(events: DataFrame, valid, target: str, quarantine: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Rows to a table, those that fail the condition to another: a bad row does not stop the stream."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ok = F.coalesce(valid, F.lit(False))
        batch.where(ok).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        batch.where(~ok).write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")

    return _started(events.writeStream.foreachBatch(write), checkpoint, every)


def reflect(memory: DataFrame, agent: str, tenant: str, since: Any, synthesise: Callable[[DataFrame], DataFrame], limit: int = 50) -> DataFrame:
    """Reflection rows from an agent's experiences since a time, newest first, by a pluggable function."""
    from sievework.operators.memory import experiences, query

    return synthesise(query(memory, experiences(tenant, agent, since=since, limit=limit)))
