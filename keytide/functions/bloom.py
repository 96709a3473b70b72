"""A Bloom filter as a table: one row for each block of up to 32,768 bits, so that it can be as large as its keys need.

All bits of a key are in one block, so a key moves once to be added or tested, not once for each of its bits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.functions.codec import BLOOM_BLOCK, big_endian, bloom_bits, bloom_block, bloom_positions, frame, frame_ok

#: Bits that a task sets; a filter has as many tasks as that takes.
TASK_BITS = 1 << 20
#: Places at least among which tested keys are dealt: a filter of fewer blocks is copied.
SPREAD = 256


@dataclass(frozen=True)
class Slice:
    """One filter of a table of filters: its number there, and the keys and the error that it is made for."""

    number: int
    count: int
    error: float

    def shape(self, total: int) -> Column:
        """As a struct. ``total``: keys of all slices among which keys are dealt."""
        bits, hashes = bloom_bits(self.count, self.error)
        blocks = -(-bits // BLOOM_BLOCK)
        copies = max(1, -(-SPREAD * self.count // (max(total, 1) * blocks)))
        return F.struct(*(F.lit(v).alias(k) for k, v in (("slice", self.number), ("blocks", blocks), ("width", bits // blocks), ("hashes", hashes), ("copies", copies))))


def _chosen(slices: Sequence[Slice], is_it: Callable[[Slice, int], Column]) -> Column:
    """Shape of the first slice for which ``is_it`` holds, given the slice and the keys of all up to it."""
    total, edge, out = sum(s.count for s in slices), 0, F
    for s in slices:
        edge += s.count
        out = out.when(is_it(s, edge), s.shape(total))
    return out


def _dealt(keys: DataFrame, groups: Sequence[Sequence[Slice]]) -> DataFrame:
    """For each key and group, the slice of the group that the key belongs to, its block there, and the block's copy to test it by."""
    hashed = keys.select("key", F.xxhash64("key", F.lit("slice")).alias("at"))
    shapes = []
    for g in groups:
        place = F.pmod("at", F.lit(max(1, sum(s.count for s in g))))
        shapes.append(_chosen(g, lambda s, edge, place=place, g=g: F.lit(True) if len(g) == 1 else place < edge))
    copy = F.pmod(F.xxhash64("key", F.lit("copy")), "copies").alias("copy")
    return hashed.select("key", F.explode(F.array(*shapes)).alias("s")).select("key", "s.*").select("*", bloom_block(F.col("key"), F.col("blocks")).alias("bucket"), copy)


def _build(keys: DataFrame, slices: Sequence[Slice]) -> DataFrame:
    """A group of slices as one table, from one pass over the keys."""
    tasks = max(1, -(-sum(s.count * bloom_bits(s.count, s.error)[1] for s in slices) // TASK_BITS))
    dealt = _dealt(keys.select("key").distinct(), [slices]).select("key", "slice", "bucket", "width", "hashes").repartition(tasks, "slice", "bucket")
    bits = dealt.select("slice", "bucket", F.explode(bloom_positions(F.col("key"), F.col("width"), F.col("hashes"))).alias("bit"))
    return bits.groupBy("slice", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _contains(keys: DataFrame, groups: Sequence[tuple[DataFrame, Sequence[Slice]]]) -> DataFrame:
    """A key is sought in the one slice of each group, and in the one block, that it would have been added to."""
    at = _dealt(keys.select("key").distinct(), [g for _, g in groups]).select("key", "slice", "bucket", "copy")
    shaped = (t.withColumn("s", _chosen(g, lambda s, _: F.col("slice") == s.number)).select("s.*", "bucket", "bitmap") for t, g in groups)
    word = lambda i: F.conv(F.hex(F.substring("bitmap", 8 * i + 1, F.lit(8))), 16, -10).cast("long")
    words = F.transform(F.sequence(F.lit(0), F.lit(BLOOM_BLOCK // 64 - 1)), word).alias("words")
    blocks = reduce(DataFrame.unionByName, shaped).select("slice", "bucket", "width", "hashes", "copies", words)
    blocks = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1)))
    # A word's bytes are the bitmap's in order, so its highest byte comes first.
    is_set = lambda p: F.getbit(F.get("words", F.shiftright(p, 6).cast("int")), (56 - p % 64 + 2 * (p % 8)).cast("int")) == 1
    maybe = F.coalesce(F.forall(bloom_positions(F.col("key"), F.col("width"), F.col("hashes")), is_set), F.lit(False)).alias("maybe")
    # Spark counts a binary as small, and would broadcast filters of any size.
    found = at.join(blocks.hint("merge"), ["slice", "bucket", "copy"], "left").select("key", maybe)
    return found if len(groups) == 1 else found.groupBy("key").agg(F.bool_or("maybe").alias("maybe"))


def build(keys: DataFrame, count: int, error: float = 0.01) -> DataFrame:
    return _build(keys, [Slice(0, count, error)]).drop("slice")


def contains(keys: DataFrame, bloom: DataFrame, count: int, error: float = 0.01) -> DataFrame:
    """Each key once, with ``maybe``: false only where the key was never added."""
    return _contains(keys, [(bloom.withColumn("slice", F.lit(0)), [Slice(0, count, error)])])


def size(bloom: DataFrame, count: int, error: float = 0.01) -> DataFrame:
    """One row: bits of the filter, how many are set, and the number of keys that this speaks for."""
    bits, hashes = bloom_bits(count, error)
    row = bloom.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("set"))
    free = 1 - F.least(F.col("set"), F.lit(bits - 1)) / float(bits)
    return row.select(F.lit(bits).cast("long").alias("bits"), "set", F.round(-F.log(free) * float(bits) / hashes).cast("long").alias("keys"))


def encode(bloom: DataFrame, count: int, error: float = 0.01) -> DataFrame:
    """The filter's rows as checksummed binaries, each with the filter's bits, hashes and bits of a block."""
    bits, hashes = bloom_bits(count, error)
    number = lambda c, n: big_endian(c if isinstance(c, Column) else F.lit(c), n)
    return bloom.select(frame(F.concat(number(bits, 8), number(hashes, 4), number(_width(bits), 4), number(F.col("bucket"), 8), F.col("bitmap"))).alias("encoded"))


def decode(encoded: DataFrame, count: int, error: float = 0.01) -> DataFrame:
    """The filter of :func:`encode`; fails on a broken binary and on one of a filter of other size or form."""
    number = lambda at, n: F.conv(F.hex(F.substring("encoded", at, n)), 16, 10).cast("long")
    bits, hashes = bloom_bits(count, error)
    right = frame_ok(F.col("encoded")) & (F.octet_length("encoded") == 33 + BLOOM_BLOCK // 8) & (number(9, 8) == bits) & (number(17, 4) == hashes) & (number(21, 4) == _width(bits))
    checked = encoded.withColumn("encoded", F.when(right, F.col("encoded")).otherwise(F.raise_error(F.lit("a broken filter, or one of another size")).cast("binary")))
    return checked.select(number(25, 8).alias("bucket"), F.substring("encoded", F.lit(33), F.lit(BLOOM_BLOCK // 8)).alias("bitmap"))


def _width(bits: int) -> int:
    return bits // -(-bits // BLOOM_BLOCK)


@dataclass
class ScalableBloom:
    """Filters of growing size: each holds twice as many keys as the one before, with half of its error, so that the
    errors of all add up to less than ``error`` however many keys come. (A full block's load varies: that adds 1 % to an
    error of 0.005, and 20 % to one of 1e-8.)"""

    first: int = 1 << 16
    error: float = 0.01
    groups: tuple[tuple[DataFrame, tuple[Slice, ...]], ...] = ()

    def add(self, keys: DataFrame, count: int) -> ScalableBloom:
        """With ``count`` more keys, dealt over as many further slices as they need."""
        new, k = [], sum(len(g) for _, g in self.groups)
        while sum(s.count for s in new) < max(count, 1):
            n = k + len(new)
            new.append(Slice(n, self.first << n, self.error / 2 ** (n + 1)))
        return ScalableBloom(self.first, self.error, (*self.groups, (_build(keys, new), tuple(new))))

    def contains(self, keys: DataFrame) -> DataFrame:
        """Each key once, with ``maybe``: false only where the key was never added."""
        if not self.groups:
            return keys.select("key", F.lit(False).alias("maybe")).distinct()
        return _contains(keys, self.groups)

    def capacity(self) -> int:
        return sum(s.count for _, g in self.groups for s in g)

    def false_positives(self) -> float:
        """Of each add a key meets one slice, the larger ones more often."""
        return 1 - reduce(lambda p, g: p * (1 - sum(s.count * s.error for s in g[1]) / sum(s.count for s in g[1])), self.groups, 1.0)
