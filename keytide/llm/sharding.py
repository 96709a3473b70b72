"""Sharding by sampled splitters.

Keys are hashes of texts, so that equal texts have one key. Keys are drawn with a chance in proportion to their rows'
sizes; quantiles of the drawn keys are the splitters of ``fine`` ranges a shard, and each row finds its range by
bisection of the splitters. The exact bytes of the ranges are summed. A range that holds more than ``tolerance`` of a
shard's share is overfull and gets splitters of its own, drawn anew from its rows, until each overfull range holds one
key (a hot text, or one large document).

Shards are then dealt. Hot texts go whole to the emptiest shard, largest first, if it has room; a hot text without room
anywhere is subdivided by rows. The other ranges, in order of keys, fill what room the shards have left, and a shard
ends at the splitter nearest to where its room ends. Law ``bytes``: a shard misses an equal share by at most half a range at
each end, that is by ``tolerance``, wherever no single document or hot text is larger. Equal texts stay together unless
shares couldn't be equal otherwise, which is so for texts that hold more than the room of any shard.

All of it is DataFrame functions; texts are read once. What comes to the driver and is sent to tasks again are splitters and
sums of ranges: about ``shards * (fine + 3 / tolerance)`` rows at any size of the table. Rows are ranked in their range
in parts of about ``part_rows``, or of a task's share of all rows if that is less, whatever the keys.

Defined cases: a null text has no bytes and shares a key with empty texts; null ids sort first; repeated
rows are rows of their own; a long text is one row; ties of size go by key; an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytide.llm.common import Scratch, documents, shuffle_partitions, text_of


def range_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters at or below ``key``, by bisection."""
    if not splitters:
        return F.lit(0)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(splitters).bit_length()))))
    cuts = F.expr(f"array({', '.join(f'{x}L' for x in splitters)})")
    return F.aggregate(steps, F.lit(0), lambda lo, d: F.when(F.coalesce(F.get(cuts, lo + d - 1) <= key, F.lit(False)), lo + d).otherwise(lo))


def drawn(base: DataFrame, total: int, keys: int, seed: int) -> list[tuple[int, int]]:
    """About ``keys`` keys of ``base``, drawn by size, with how often each was drawn; sorted."""
    u = F.pmod(F.xxhash64("h", "g", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    chosen = base.where(u * float(max(total, 1)) < F.col("size") * float(keys)).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return sorted((r.h, r.n) for r in chosen.collect())


def quantiles(keys: list[tuple[int, int]], ranges: int) -> list[int]:
    """Splitters of ``ranges`` ranges with about as many drawn keys in each."""
    every, seen, out = sum(n for _, n in keys) / ranges, 0, []
    for h, n in keys:
        if n and seen >= (len(out) + 1) * every:
            out.append(h)
        seen += n
    return out


@dataclass
class Range:
    """Exact figures of a range, and its shards: (first rank, shard, slot of that rank)."""

    number: int
    size: int
    rows: int
    low: int
    high: int
    pieces: list[tuple[int, int, int]] = field(default_factory=list)


def ranges_of(base: DataFrame, total: int, shards: int, fine: int, per_range: int, tolerance: float, seed: int) -> tuple[list[int], list[Range]]:
    """Splitters, and the ranges between them; an overfull range holds one key only."""
    most = tolerance * total / shards
    cuts = quantiles(drawn(base, total, shards * fine * per_range, seed), shards * fine)
    while True:
        sums = base.groupBy(range_of(F.col("h"), cuts).alias("r")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.min("h").alias("low"), F.max("h").alias("high"))
        found = [Range(*r) for r in sorted(map(tuple, sums.collect()))]
        over = [r for r in found if r.size > most and r.low < r.high]
        if not over:
            return cuts, found
        # The greatest key of an overfull range always becomes a splitter, so that each round divides it.
        more = {r.high for r in over} | {r.low + 1 for r in over}
        within = F.expr(f"array({', '.join(str(r.number) for r in over)})")
        seed += 1
        again = drawn(base.where(F.array_contains(within, range_of(F.col("h"), cuts))), sum(r.size for r in over), len(over) * 8 * per_range, seed)
        for r in over:
            inside = [(h, n) for h, n in again if r.low <= h <= r.high]
            often = [h for h, n in inside if n > 2 * per_range]
            more |= {h for x in often for h in (x, x + 1) if h <= r.high} | set(quantiles(inside, max(2, -(-2 * r.size // max(1, int(most))))))
        cuts = sorted(set(cuts) | more)


def dealt(ranges: list[Range], total: int, shards: int, tolerance: float) -> None:
    """Give each range its shards and slots."""
    share, most = total / shards, tolerance * total / shards
    load, order = [0] * shards, []
    hot = sorted((r for r in ranges if r.size > most), key=lambda r: (-r.size, r.number))
    split = []
    for r in hot:
        s = min(range(shards), key=lambda k: (load[k], k))
        if r.rows > 1 and load[s] + r.size > share:
            split.append(r)
            continue
        load[s] += r.size
        order.append((s, r, 0, r.rows))
    for r in split:
        each, at = r.size // r.rows, 0
        while at < r.rows:
            s = min(range(shards), key=lambda k: (load[k], k))
            n = min(r.rows - at, max(1, round((share - load[s]) / each)))
            load[s] += n * each
            order.append((s, r, at, n))
            at += n
    # Room that is left, shrunk where one document is larger than a share.
    rest = [r for r in ranges if r.size <= most]
    room = [max(0.0, share - x) for x in load]
    scale, end, seen, s = sum(r.size for r in rest) / max(sum(room), 1.0), [], 0.0, 0
    for x in room:
        end.append((end[-1] if end else 0.0) + x * scale)
    for r in rest:
        while s < shards - 1 and seen + r.size / 2 > end[s]:
            s += 1
        order.append((s, r, 0, r.rows))
        seen += r.size
    slot = [0] * shards
    for s, r, at, n in order:
        r.pieces.append((at, s, slot[s]))
        slot[s] += n


def shard(docs: DataFrame, shards: int = 8, fine: int = 128, per_range: int = 32, tolerance: float = 0.02, seed: int = 11, part_rows: int = 1 << 20) -> DataFrame:
    """Shard and place of each row of ``docs``."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    t = text_of(docs)
    base = scratch.keep(docs.select(
        "doc_id", (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(t).alias("h"), F.xxhash64("doc_id", F.lit(seed)).alias("g"),
    ))
    total = base.agg(F.sum("size")).first()[0] or 0
    cuts, ranges = ranges_of(base, total, shards, fine, per_range, tolerance, seed)
    dealt(ranges, total, shards, tolerance)
    most = max(1, min(part_rows, -(-sum(r.rows for r in ranges) // shuffle_partitions(spark))))
    plan = spark.createDataFrame(
        [(r.number, -(-r.rows // most), [{"first": a, "shard": s, "slot": n} for a, s, n in r.pieces]) for r in ranges],
        "range int, parts int, pieces array<struct<first long, shard int, slot long>>",
    )
    rows = base.withColumn("range", range_of(F.col("h"), cuts)).join(F.broadcast(plan), "range").withColumn("uid", F.monotonically_increasing_id())
    # Identical rows have one ``g``; where ranges have several parts, these are dealt by their place in the table, too.
    rows = scratch.keep(rows.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("h", "g", "uid"), F.col("parts"))).otherwise(0).cast("int")).drop("parts"))
    counts = rows.groupBy("range", "part").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lower = scratch.keep(counts.select("range", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")))
    rank = F.row_number().over(Window.partitionBy("range", "part").orderBy("h", "g", "doc_id", "uid")) - 1
    rows = rows.withColumn("_n", rank).join(lower, ["range", "part"]).withColumn("rank", F.col("before") + F.col("_n"))
    rows = rows.withColumn("_p", F.element_at(F.filter("pieces", lambda x: x["first"] <= F.col("rank")), -1))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_p.shard").alias("shard"), (F.col("_p.slot") + F.col("rank") - F.col("_p.first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_sharding(spark, sf_dir):
    return shard(documents(spark, sf_dir))
