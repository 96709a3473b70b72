"""Conflict-constrained best-fit packing of documents into bins of ``capacity`` words.

Documents are dealt at random into groups of about ``group_rows``; each group is packed on its own,
largest first. Bins stand in order of their residual room. The search starts at the tightest bin
that has room and goes on to the next until one is compatible: a bin carries a bitmap of the duplicate
clusters in it (no two texts of a cluster may meet) and bitmaps, in layers, of its sources (a source may
fill at most ``per_source`` places). If none is compatible a bin is opened. A document above the
capacity is cut into full bins and a rest, which is packed like others.

A cluster is what a column ``cluster`` names (such as the class of a near-duplicate operator; null is a cluster of the
row's own), else the texts of one sequence of words.

A group's rows are few by construction, whatever the keys: rows are ranked by (id, cluster) over the whole table, by ranges
and their counts, and a hash of the rank deals them. So groups and bins don't depend on how the table was split into
files or tasks. Texts don't leave the JVM; the packer sees ids, sizes and hashes.

Result: a row for each piece: doc_id, size, piece, words, bin, start (place of its first word in the bin).
Defined cases: a document without words (null text included) has one row with a null bin; null is a source of
its own; ids may be of any type that can be sorted; null ids and repeated rows are packed as rows of their own, repeated
rows being one cluster; ties of size go by rank; a long text is cut as said; an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keytide.llm.common import Scratch, before, documents, placed, ship, text_of, word_array

#: With a source of a third of all rows, four places a bin leave 18 % of the room empty, eight leave 4 %.
CAPACITY, PER_SOURCE, GROUP_ROWS = 4096, 8, 8192


def best_fit(items: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, start) of each item (size, source, cluster), sizes from 1 to capacity, in the order given."""
    order: list[tuple[int, int]] = []  # (room, bin) of open bins
    room: list[int] = []
    clusters: list[int] = []
    layers: list[list[int]] = []
    out = []
    for size, source, cluster in items:
        mark, twin = 1 << source, 1 << cluster
        i = bisect_left(order, (size, -1))
        while i < len(order) and (clusters[order[i][1]] & twin or layers[order[i][1]][-1] & mark):
            i += 1
        if i < len(order):
            b = order.pop(i)[1]
        else:
            b = len(room)
            room.append(capacity)
            clusters.append(0)
            layers.append([0] * per_source)
        out.append((b, capacity - room[b]))
        room[b] -= size
        clusters[b] |= twin
        for j, layer in enumerate(layers[b]):
            if not layer & mark:
                layers[b][j] |= mark
                break
        if room[b]:
            insort(order, (room[b], b))
    return out


def packer(capacity: int, per_source: int):
    def pack(group: pa.Table) -> pa.Table:
        rows = group.select(["rank", "doc_id", "size", "source_hash", "cluster"]).to_pydict()
        n = len(rows["rank"])
        by_size = sorted(range(n), key=lambda i: (-(rows["size"][i] % capacity or capacity), rows["rank"][i]))
        names = [{v: i for i, v in enumerate(dict.fromkeys(rows[c]))} for c in ("source_hash", "cluster")]
        base = group["g"][0].as_py() << 32
        rest = [i for i in by_size if rows["size"][i] % capacity]
        placed = best_fit([(rows["size"][i] % capacity, names[0][rows["source_hash"][i]], names[1][rows["cluster"][i]]) for i in rest], capacity, per_source)
        bins = max((b for b, _ in placed), default=-1) + 1
        out: dict[str, list] = {c: [] for c in ("doc_id", "size", "piece", "words", "bin", "start")}

        def put(i, piece, words, b, start):
            for c, v in zip(out, (rows["doc_id"][i], rows["size"][i], piece, words, b, start), strict=True):
                out[c].append(v)

        for i in by_size:
            for piece in range(rows["size"][i] // capacity):
                put(i, piece, capacity, base + bins, 0)
                bins += 1
            if not rows["size"][i]:
                put(i, 0, 0, None, None)
        for i, (b, start) in zip(rest, placed, strict=True):
            put(i, rows["size"][i] // capacity, rows["size"][i] % capacity, base + b, start)
        kinds = {"doc_id": group.schema.field("doc_id").type, "piece": pa.int32()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_rows: int = GROUP_ROWS, cluster: str | None = None) -> DataFrame:
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    narrow = docs.select(
        "doc_id", word_array(text_of(docs)).alias("_kt_w"), F.xxhash64(docs["source"].isNull(), docs["source"]).alias("source_hash"),
        (F.lit(None).cast("long") if cluster is None else F.xxhash64(docs[f"`{cluster}`"])).alias("cluster"), (F.lit(False) if cluster is None else docs[f"`{cluster}`"].isNull()).alias("alone"),
    )
    uid = F.monotonically_increasing_id()
    same = F.xxhash64(F.array_join("_kt_w", " ")) if cluster is None else F.when(F.col("alone"), F.xxhash64(F.lit("alone"), uid)).otherwise(F.col("cluster"))
    base = scratch.keep(narrow.select(uid.alias("uid"), "doc_id", F.size("_kt_w").cast("long").alias("size"), "source_hash", same.alias("cluster")))
    # The row's number comes last: it only orders rows that are alike in all that counts.
    order = [F.col(c) for c in ("doc_id", "cluster", "size", "source_hash", "uid")]
    rows = placed(scratch, base, *order)
    lower = before(rows, [], lower=F.count(F.lit(1)))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)).cast("long")).join(lower, "_pid")
    groups = max(1, -(-base.count() // group_rows))
    dealt = ranked.select((F.col("rank") + F.col("lower")).alias("rank"), "doc_id", "size", "source_hash", "cluster").withColumn("g", F.pmod(F.xxhash64("rank"), F.lit(groups)))
    id_type = dict(base.dtypes)["doc_id"]
    return dealt.groupBy("g").applyInArrow(packer(capacity, per_source), f"doc_id {id_type}, size long, piece int, words long, bin long, start long")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: bins, words and the share of the bins' room that is filled."""
    used = packed.where("bin is not null").agg(F.count_distinct("bin").alias("bins"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    return used.withColumn("fill", F.col("words") / F.nullif(F.col("bins") * capacity, F.lit(0)))


def op4_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))
