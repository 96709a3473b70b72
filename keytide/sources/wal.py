"""Logs of checksummed frames as a source and a sink."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions.codec import frame, parse, payload


def encode(changes: DataFrame) -> DataFrame:
    """Adds ``frame``: each change as a log frame."""
    return changes.withColumn("frame", frame(payload(F.col("key"), F.col("value"), F.col("is_delete"), F.col("expire_at"))))


def replay(files: DataFrame) -> DataFrame:
    """Changes of log files (path, content), broken stretches left out and counted in a row with a null key."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Ships with the function, so that workers need nothing but the standard library and pyarrow.
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, broken = [], 0
                for pos, change in enumerate(parse(bytes(data or b""))):
                    if change is None:
                        broken += 1
                    else:
                        rows.append((path, pos, *change, 0))
                if broken:
                    rows.append((path, None, None, None, None, None, broken))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 7
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["path", "pos", "key", "value", "is_delete", "expire_at", "broken"])

    return files.select("path", "content").mapInArrow(read, "path string, pos long, key binary, value binary, is_delete boolean, expire_at long, broken long")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Replay of all logs in a folder; a file is one task's work."""
    return replay(spark.read.format("binaryFile").load(path).select("path", "content"))
