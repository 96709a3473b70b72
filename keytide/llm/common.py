"""Shared parts of the corpus operators: scratch tables, words, global order, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: the blank and the five ASCII controls from tab to carriage return.
WS = r"[\x20\x09-\x0D]"


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a session; the driver serves the archive."""
    sc = spark.sparkContext
    if getattr(sc, "_keytide_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="keytide-")) / "keytide.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._keytide_shipped = True


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the folder that all executors share, to cut lineage and to survive lost executors.

    The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset (tests, a local
    master) a temporary folder stands in for it.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="keytide-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.base = f"{base.rstrip('/')}/keytide-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the table as read back."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._keytide_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete kept tables which no later result reads, and let Spark delete the shuffles behind them."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            if t is not None:
                p = jvm.org.apache.hadoop.fs.Path(t._keytide_path)
                p.getFileSystem(conf).delete(p, True)
        # Spark deletes a shuffle's files once the driver's collectors have seen that nothing refers to it.
        gc.collect()
        jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(df: DataFrame) -> Column:
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """Words of a text as an array; no word, no element."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def placed(scratch: Scratch, df: DataFrame, *order: Column) -> DataFrame:
    """``df`` dealt by range of ``order`` with the number of its range in ``_pid``, written down.

    Rows of a lower ``_pid`` come before those of a higher one, so prefix sums need only the totals
    of each range (one row a range) and a window inside each range.
    """
    n = shuffle_partitions(df.sparkSession)
    return scratch.keep(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))


def before(table: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """For each range and key the sums over all lower ranges of the same key; a row for each pair."""
    totals = table.groupBy("_pid", *keys).agg(*(v.alias(f"_t_{k}") for k, v in sums.items()))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_pid", *keys, *(F.coalesce(F.sum(f"_t_{k}").over(w), F.lit(0)).alias(k) for k in sums))


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as (node, label), label being the least node; nodes are those in ``edges``.

    Labels spread along links and then jump to their label's label, so that chains halve each round.
    Every round is written to the shared folder, both sides of each join are plain tables, and AQE can
    split the links of a hot node. Stops after the first round that changes no label.
    """
    links = scratch.keep(
        edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
        .union(edges.select(F.col(b).alias("node"), F.col(a).alias("other")))
        .where("node != other").distinct()
    )
    labels = scratch.keep(links.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        far = labels.select(F.col("node").alias("other"), F.col("label").alias("far"))
        least = scratch.keep(
            links.join(far, "other").select("node", F.col("far").alias("label")).union(labels)
            .groupBy("node").agg(F.min("label").alias("label"))
        )
        up = least.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = scratch.keep(least.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
        old = labels.select("node", F.col("label").alias("was"))
        changed = jumped.join(old, "node").where("label != was").limit(1).count()
        scratch.drop(labels, least)
        labels = jumped
        if not changed:
            scratch.drop(links)
            return labels


def extended(scratch: Scratch, labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` of :func:`components` with further edges (a, b); only the labels which these join are worked on again."""
    ends = more
    for c in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")), c, "left")
    tops = components(scratch, ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    moved = labels.join(tops.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    fresh = tops.join(labels.select("node"), "node", "left_anti").select("node", "label")
    out = scratch.keep(moved.union(fresh))
    scratch.drop(tops)
    return out
