"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected ``target / source_size`` times. The documents of a source
stand in a row (largest first, then by id), their expected copies are summed along it, one random
offset in [0, 1) is added, and a document is taken once for each integer that its stretch crosses. As
the order is by size, the words taken miss the target by less than the largest document of the source.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and share ``budget`` times
all sizes; no target exceeds ``cap`` times its source's size and the excess is shared anew by weight.

The place in the row is found without a task that holds a source: rows are dealt by ranges of
(source, size, id), each range is counted, and a rank is the count of lower ranges plus the rank
within the range. The same is done for the table of sources, of which there may be any number. All of it is DataFrame
functions; texts are read once.

Defined cases: a null text has size 0; a document of size 0 may be taken but adds nothing; null is a
source of its own; a source without words has target 0; repeated rows are documents of their own; ties of size go
by id; a long text is one document; an empty table gives an empty result. Columns other than doc_id, text and source
are not read; ``mixed_documents`` returns all columns, and none may be named ``_kt_uid``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytide.llm.common import Scratch, before, documents, placed, text_of, word_array

WEIGHTS = (3, 1, 2)


def running(rows: DataFrame, lower: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``rows`` (dealt by ``order``) with sums over all rows before each, of which ``lower`` has those of lower ranges."""
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for k, v in sums.items():
        rows = rows.withColumn(f"_own_{k}", F.coalesce(v.over(w), F.lit(0)))
    rows = rows.join(lower, "_pid")
    for k in sums:
        rows = rows.withColumn(k, F.col(k) + F.col(f"_own_{k}"))
    return rows.drop(*(f"_own_{k}" for k in sums))


def targets(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Of a table (no_source, source_key, source_size), a row a source, the same with ``target``."""
    by_name = [F.col("no_source"), F.col("source_key")]
    named = placed(scratch, sizes, *by_name)
    place = running(named, before(named, [], place=F.count(F.lit(1))), by_name, place=F.count(F.lit(1)))
    t = place.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    t = t.withColumn("limit", cap * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight")).drop("_pid", "place")
    by_ratio = [F.col("ratio"), *by_name]
    t = placed(scratch, t, *by_ratio)
    every = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    sums = {"c": F.sum("limit"), "w": F.sum("weight")}
    t = running(t, before(t, [], **sums), by_ratio, **sums)
    # A source stops at its limit if all could have its ratio within the budget.
    t = scratch.keep(t.withColumn("stops", F.col("c") + F.col("ratio") * (every.weight - F.col("w")) <= every.size * budget))
    stopped = t.where("stops").agg(F.coalesce(F.sum("limit"), F.lit(0.0)).alias("limit"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    level = (every.size * budget - stopped.limit) / (every.weight - stopped.weight) if every.weight > stopped.weight else 0.0
    return t.select("no_source", "source_key", "source_size", F.when(F.col("stops"), F.col("limit")).otherwise(F.least("limit", F.lit(level) * F.col("weight"))).cast("double").alias("target"))


def copies_of(scratch: Scratch, base: DataFrame, seed: int, **how) -> DataFrame:
    """``base``: doc_id, no_source, source_key, size and others, written down. Adds source_size, target and copies."""
    keys = ["no_source", "source_key"]
    goal = targets(scratch, base.groupBy(*keys).agg(F.sum("size").alias("source_size")), **how)
    rows = placed(scratch, base, F.col("no_source"), F.col("source_key"), F.desc("size"), F.col("doc_id"))
    lower = scratch.keep(before(rows, keys, lower=F.count(F.lit(1))))
    w = Window.partitionBy("_pid", *keys).orderBy(F.desc("size"), "doc_id")
    ranked = rows.withColumn("_n", F.row_number().over(w)).join(lower, ["_pid", *keys]).join(goal, keys)
    # A multiple of 1/1024, so that sums with whole expectations are exact.
    offset = F.pmod(F.xxhash64("no_source", "source_key", F.lit(seed)), F.lit(1024)) / 1024.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("lower") + F.col("_n")
    return ranked.withColumn("copies", (F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)).cast("long")).drop("_pid", "_n", "lower")


def sized(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(
        "doc_id", *more, F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"),
        F.size(word_array(text_of(docs))).cast("long").alias("size"),
    )


def mix(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """Size, target and words taken of each row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    out = copies_of(scratch, scratch.keep(sized(docs)), seed, **how)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, with their columns as they were.

    Rows are numbered as they are written down; copies are found on narrow rows and joined to the texts by
    that number, so rows that share an id are judged each on its own.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(docs.withColumn("_kt_uid", F.monotonically_increasing_id()))
    out = copies_of(scratch, scratch.keep(sized(rows, "_kt_uid")), seed, **how)
    taken = scratch.keep(out.where("copies > 0").select("_kt_uid", F.col("copies").cast("int").alias("_kt_copies")))
    d = rows.join(taken, "_kt_uid")
    return d.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("_kt_copies"))).alias("_kt_copy")).drop("_kt_copy")


def op3_source_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir))
