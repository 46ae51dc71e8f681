"""Structured Streaming: quality control of arriving acquisitions, and event-time windows (extensions)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ionlake.sources import header as H


def plane_totals_stream(spark: SparkSession, folder: str, pattern: str = "*.im") -> DataFrame:
    """(path, plane, total) of every file that arrives in a folder, as a stream."""
    import pandas as pd

    def totals(batches):
        for pdf in batches:
            rows = []
            for path, size, content in zip(pdf["path"], pdf["length"], pdf["content"], strict=True):
                data = bytes(content)
                head = H.parse_header(data, size)
                counts = np.frombuffer(data, "<u4", offset=head["data_offset"]).reshape(head["n_planes"], -1)
                rows += [(path, p, float(t)) for p, t in enumerate(counts.sum(axis=1, dtype=np.int64))]
            yield pd.DataFrame(rows, columns=["path", "plane", "total"])

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", "content").mapInPandas(totals, "path string, plane int, total double")


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, end, event_type, n, value) in tumbling or sliding windows of ts; later rows than the watermark are left out in a stream."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return held.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("w.start", "w.end", "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, user_id, n): session windows by user."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("w.start", "w.end", "user_id", "n")
