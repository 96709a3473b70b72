"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are scaled to unit length. A table hashes a vector by ``bits`` random projections, each shifted and
cut into steps of ``width``; vectors that agree in all of a table's steps share a bucket. Two vectors
at cosine 0.95 are 0.316 apart and agree in one step with probability 0.84 ... 0.80, hence in one of
96 tables of 12 steps with probability above 0.998; closer ones are found more surely. In each bucket
exact cosines in double precision decide.

Equal vectors are one class from the start, with a count. Buckets of one class are left out, and of buckets with the same
classes (as close classes share many tables) the one of the first table is kept. Before any vector is moved, 256 signs of
projections tell which classes of a bucket have one near them: at cosine 0.95 some 26 signs differ, and more than ``APART``
of them with a probability below 1e-9. The others are left out of the bucket. A bucket is compared in blocks of at most
``block`` classes of each side; a pair found is counted in the first table in which it meets, so blocks send sums and one
spanning link for each class instead of pairs, and nothing is capped. The blocks of a large bucket are dealt over tasks.

Result: a row for each vector: vec_id, n_links, component_id, kept. Defined cases: vectors that are null, empty,
zero or hold null or non-finite numbers link with nothing; so do vectors of different lengths with each
other; null ids and repeated rows count as vectors of their own; a tie of the smallest id (a repeated row) keeps all rows
of that id; vectors may have any length; ids are integers; an empty table gives an empty result. Other columns are not read. Classes are told apart by 64-bit hashes of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.bytehash import U, mix
from keytide.llm.common import Scratch, components, documents, ship, shuffle_partitions

LEAST, TABLES, BITS, WIDTH, BLOCK, SEED = 0.95, 96, 12, 1.25, 1024, 5
#: Signs of projections for each vector, and how many may differ for a pair to be looked at.
SIGNS, APART = 256, 55


@lru_cache(maxsize=8)
def projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, TABLES * BITS)), rng.uniform(0, WIDTH, TABLES * BITS)


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1)[:, None]
    return v / np.sqrt((v * v).sum(1))[:, None]


def buckets(v: np.ndarray) -> np.ndarray:
    """Bucket of each unit vector in each table."""
    a, b = projections(v.shape[1])
    steps = np.floor((v @ a + b) / WIDTH).astype(np.int64).view(U).reshape(len(v), TABLES, BITS)
    # Mixed at once, as steps are small numbers that could stand for another table's number.
    h = np.tile(mix(U(v.shape[1] << 32) + np.arange(TABLES, dtype=U)), (len(v), 1))
    for j in range(BITS):
        h = mix(h + steps[:, :, j])
    return h.view(np.int64)


@lru_cache(maxsize=8)
def planes(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED + 1, dim]).standard_normal((dim, SIGNS))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, v -> k, signs, bs (bucket in each table); vectors of each length on their own."""
    for batch in batches:
        keys, sizes = batch.column("k").to_numpy(), batch.column("v").value_lengths().to_numpy()
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            for i in range(0, len(at), 2048):
                part = at[i : i + 2048]
                v = unit(matrix(batch.column("v").take(pa.array(part))))
                signs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SIGNS // 8), len(part), [None, pa.py_buffer(np.packbits(v @ planes(int(d)) > 0, axis=1).tobytes())])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * TABLES), pa.array(buckets(v).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), signs.cast(pa.binary()), lists], ["k", "signs", "bs"])


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole blocks, of rows sorted by (b, i, j), and where each block starts. A block may go over batches; it is bounded by 2 * BLOCK rows."""
    rest: pa.Table | None = None

    def cuts(t: pa.Table) -> np.ndarray:
        key = np.stack([t[c].to_numpy() for c in ("b", "i", "j")])
        return np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [t.num_rows]])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        cut = cuts(t)
        rest = t.slice(cut[-2])
        if len(cut) > 2:
            yield t.slice(0, cut[-2]).combine_chunks(), cut[:-1]
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def near_in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with signs, sorted by block -> those with another near them in their block (on the other side, if it has two)."""
    for t, cut in whole_blocks(batches):
        raw = np.frombuffer(b"".join(t["signs"].chunk(0).to_pylist()), np.uint8).reshape(t.num_rows, -1)
        side, two = t["side"].to_numpy(), t["i"].to_numpy() != t["j"].to_numpy()
        near = np.zeros(t.num_rows, bool)
        size = np.diff(cut)
        pairs = cut[:-1][size == 2]
        ok = np.bitwise_count(raw[pairs] ^ raw[pairs + 1]).sum(1, dtype=np.int64) <= APART
        ok &= ~two[pairs] | (side[pairs] != side[pairs + 1])
        near[pairs], near[pairs + 1] = ok, ok
        for a in np.flatnonzero(size > 2):
            z = slice(cut[a], cut[a + 1])
            x = np.unpackbits(raw[z], axis=1).astype(np.float32) * 2 - 1
            hit = x @ x.T >= SIGNS - 2 * APART
            np.fill_diagonal(hit, False)
            if two[cut[a]]:
                hit &= side[z][:, None] != side[z][None, :]
            near[z] = hit.any(1)
        if near.any():
            yield from t.drop_columns(["signs"]).filter(pa.array(near)).to_batches()


def compared(k: np.ndarray, side: np.ndarray, n: np.ndarray, v: np.ndarray, table: int, same: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """Links of each class in one block that no earlier table has found, and a class that each leads to."""
    v = unit(v)
    hit = v @ v.T >= LEAST
    np.fill_diagonal(hit, False)
    if not same:
        hit &= side[:, None] != side[None, :]
    if not hit.any():
        return None
    h = buckets(v)
    for t in range(table):
        hit &= h[:, t][:, None] != h[:, t][None, :]
        if t % 4 == 3 and not hit.any():
            return None
    label = np.arange(len(k))
    while True:  # least position in each component of the block
        least = np.minimum(label, np.where(hit, label[None, :], len(k)).min(1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    return hit @ n, k[label]


def blocks_compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block -> k, links, other."""
    for t, cut in whole_blocks(batches):
        k, side, n, table, i, j = (t[c].to_numpy() for c in ("k", "side", "n", "t", "i", "j"))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a > 1:
                got = compared(k[a:b], side[a:b], n[a:b], matrix(t["v"].chunk(0).slice(a, b - a)), int(table[a]), i[a] == j[a])
                if got is not None:
                    on = np.flatnonzero(got[0])
                    found.append((k[a:b][on], got[0][on], got[1][on]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["k", "links", "other"])


def vector_links(table: DataFrame, block: int = BLOCK) -> DataFrame:
    ship(table.sparkSession)
    scratch = Scratch(table.sparkSession)
    e = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = e.isNotNull() & (F.size(e) > 0) & F.forall(e, finite) & F.exists(e, lambda x: x != 0)
    rows = table.select("vec_id", e.cast("array<double>").alias("v"), F.when(F.coalesce(valid, F.lit(False)), F.xxhash64(e, F.size(e))).alias("k"))
    classes = scratch.keep(rows.where("k is not null").groupBy("k").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("v").alias("v")))
    keys = scratch.keep(classes.select("k", "v").mapInArrow(hashed, "k long, signs binary, bs array<long>"))
    spread = keys.select("k", F.posexplode("bs").alias("t", "b"))
    # Two fingerprints of the classes in a bucket; a bucket's number names its table too.
    prints = [F.bit_xor(F.xxhash64("k", F.lit(s))).alias(f"p{s}") for s in (1, 2)]
    shared = spread.groupBy("b").agg(F.count(F.lit(1)).alias("g"), F.min("t").alias("t"), *prints).where("g > 1")
    first = shared.groupBy("g", "p1", "p2").agg(F.min(F.struct("t", "b")).alias("x"))
    # How many parts a bucket has; its blocks are the pairs of parts.
    first = scratch.keep(first.select("x.t", "x.b", F.ceil(F.col("g") / float(block)).cast("int").alias("parts")))
    met = scratch.keep(spread.drop("t").join(first, "b").withColumn("side", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")))
    met = met.select("k", "t", "b", "side", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    met = met.withColumn("i", F.least("side", "o")).withColumn("j", F.greatest("side", "o")).select("k", "t", "b", "side", "i", "j")
    sort = lambda df: df.repartition(shuffle_partitions(table.sparkSession), "b", "i", "j").sortWithinPartitions("b", "i", "j", "k")
    near = scratch.keep(sort(met.join(keys.select("k", "signs"), "k")).mapInArrow(near_in_block, "k long, t int, b long, side int, i int, j int"))
    found = scratch.keep(sort(near.join(classes.select("k", "n", "v"), "k")).mapInArrow(blocks_compared, "k long, links long, other long"))
    scratch.drop(keys, first, near)
    labels = components(scratch, found.select(F.col("k").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    named = scratch.keep(classes.select("k", "rep", "n").join(labels.withColumnRenamed("node", "k"), "k", "left").join(links, "k", "left").select("k", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "k").alias("label")))
    least = scratch.keep(named.groupBy("label").agg(F.min("rep").alias("component_id")))
    answer = scratch.keep(named.join(least, "label").select("k", "n_links", "component_id"))
    scratch.drop(classes, found, labels, named, least)
    out = rows.select("vec_id", "k").join(answer, "k", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def op2_embedding_dedup(spark, sf_dir):
    return vector_links(documents(spark, sf_dir, "embeddings"))
