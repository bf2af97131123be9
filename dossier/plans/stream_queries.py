"""Streaming forms run to the end of the tables and read back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..config import VaultConfig
from ..operators import timeline as TL
from ..session import fresh_path
from ..sources.tables import notes, table
from ..streaming import refresh as R
from . import sqltext as Q
from .registry import query
from .timeline_queries import _WORDS, dictionary


def _stream(spark, sf, name):
    path = os.path.join(sf, f"{name}.parquet")
    # a pattern, since a file stream takes a folder or a pattern but no single file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")


@query("select user_id, event_type, max_by(value, ts) as value, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as ts from events group by all")
def stream_latest_value(spark, sf):
    """The latest value per user and event type, kept by a streaming aggregate."""
    out = fresh_path(spark, "latest")
    keys = ["user_id", "event_type"]
    R.latest_value(_stream(spark, sf, "events").select(*keys, "value", "ts"), keys, "value", "ts", os.path.join(out, "rows"),
                   os.path.join(out, "checkpoint")).awaitTermination()
    return R.read_latest(spark, os.path.join(out, "rows"), keys, "value", "ts").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(f"with {_WORDS} select slug, count(*) as entries, max({Q.DAY}) as last_seen from m group by slug")
def stream_timeline(spark, sf):
    """Entity timelines refreshed from a stream of documents."""
    out = fresh_path(spark, "timeline")
    d = _stream(spark, sf, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    s = d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel"), "text", F.lit(True).alias("in_vault"),
                 day.cast("timestamp").alias("mtime"))
    R.refresh(s, dictionary(spark, sf), VaultConfig(), out, os.path.join(out, "checkpoint")).awaitTermination()
    t = R.current(spark, out)
    return t.groupBy("slug").agg(F.count(F.lit(1)).alias("entries"), F.max("when").alias("last_seen"))
