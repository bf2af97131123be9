"""Incremental refresh as Structured Streaming.

A source that changes arrives again as a whole, so the log keeps, per batch, the sources it saw and the
timeline rows they gave. The current timeline is, for each source, what its latest batch gave: a
re-delivered batch overwrites its own folder and changes nothing. Deletions do not show in a file
stream; they are found against a listing when the timeline is read.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import VaultConfig
from ..operators import timeline as TL


def note_stream(spark: SparkSession, path: str, schema: str, per_batch: int | None = None) -> DataFrame:
    """A stream over parquet files of notes(rel, text, in_vault, mtime)."""
    r = spark.readStream.schema(schema)
    if per_batch:
        r = r.option("maxFilesPerTrigger", per_batch)
    return r.parquet(path)


def refresh(stream: DataFrame, entities: DataFrame, cfg: VaultConfig, log: str, checkpoint: str, every: str | None = None):
    """Start the refresh. Without `every` it takes what is there and stops; with it (for example
    `1 minute`) it keeps polling. One query per checkpoint is the single writer."""

    def batch(notes: DataFrame, n: int) -> None:
        notes.persist()
        rows = TL.collect(notes, entities, cfg)
        rows.write.mode("overwrite").parquet(os.path.join(log, "rows", f"batch={n}"))
        notes.select("rel").distinct().write.mode("overwrite").parquet(os.path.join(log, "seen", f"batch={n}"))
        notes.unpersist()

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def current(spark: SparkSession, log: str, listed: DataFrame | None = None) -> DataFrame:
    """The timeline the log stands for; with listed(rel), rows of vanished sources are marked."""
    rows = spark.read.parquet(os.path.join(log, "rows"))
    seen = spark.read.parquet(os.path.join(log, "seen"))
    latest = seen.groupBy("rel").agg(F.max("batch").alias("batch"))
    now = rows.join(latest, ["rel", "batch"]).drop("batch").select(*TL.FIELDS)
    if listed is None:
        return now
    live = now.join(listed.select("rel").distinct(), "rel", "left_semi")
    return TL.merge(live.select(*TL.FIELDS), now, listed)


def latest_value(stream: DataFrame, keys: list[str], value: str, at: str, out: str, checkpoint: str, every: str | None = None):
    """Keep the latest value per key. `max_by` on the event's own time makes late and repeated events
    harmless. Each batch writes the keys it touched."""
    state = stream.groupBy(*keys).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(os.path.join(out, f"batch={n}"))

    w = state.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def read_latest(spark: SparkSession, out: str, keys: list[str], value: str, at: str) -> DataFrame:
    d = spark.read.parquet(out)
    return d.groupBy(*keys).agg(F.max_by(value, "batch").alias(value), F.max_by(at, "batch").alias(at))
