"""Continuous ingest: a stream of changes into a store or into a table of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from keytide.operators import resolve
from keytide.sources.store import KvStore

#: Batches after which the newest changes of all batches are written anew as one table.
MERGE_EVERY = 16


def change_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1, pattern: str | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (r.option("pathGlobFilter", pattern) if pattern else r).parquet(path)


def ingest(changes: DataFrame, store: KvStore, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is one commit of the store; merging happens within the commit, so a slow merge holds the stream back."""
    return changes.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: store.put_df(batch) and None).start()


class StateTable:
    """Newest changes of keys: one table of merged batches and a table for each batch since."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _whole(self, kind: str) -> list[int]:
        """Numbers of the tables that were written to their end."""
        fs, p = self._fs(f"{self.path}/{kind}")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if fs.exists(self._fs(f"{self.path}/{kind}/{n}/_SUCCESS")[1]))

    def rows(self, below: int | None = None) -> DataFrame:
        """Newest change of each key; with ``below`` no merged table of that batch or a later one is used."""
        merged = [n for n in self._whole("merged") if below is None or n < below][-1:]
        paths = [f"{self.path}/merged/{n}" for n in merged] + [f"{self.path}/batch/{n}" for n in self._whole("batch") if not merged or n > merged[0]]
        return resolve.latest(self.spark.read.schema(self.schema).parquet(*paths)) if paths else self.spark.createDataFrame([], self.schema)

    def add(self, batch: DataFrame, n: int, every: int = MERGE_EVERY) -> None:
        """A batch that comes again after a failure writes the same tables again."""
        resolve.latest(batch).write.mode("overwrite").parquet(f"{self.path}/batch/{n}")
        if (n + 1) % every == 0:
            self.rows(below=n).write.mode("overwrite").parquet(f"{self.path}/merged/{n}")
            old = [f"batch/{k}" for k in self._whole("batch") if k < n - every] + [f"merged/{k}" for k in self._whole("merged") if k < n - every]
            for name in old:
                fs, p = self._fs(f"{self.path}/{name}")
                fs.delete(p, True)


def ingest_state(changes: DataFrame, out: str, checkpoint: str, every: int = MERGE_EVERY) -> DataFrame:
    """The newest change of each key of all that a stream holds; an empty table if the stream is empty."""
    table = StateTable(changes.sparkSession, out, changes.schema)
    q = changes.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: table.add(batch, n, every)).start()
    q.awaitTermination()
    return table.rows()
