"""Removal of byte strings of 200 or more that stand more than once in the corpus.

Every suffix of the corpus, cut to 200 bytes, belongs to the bucket of its cover sample: the position within
it whose 64-byte string has the least hash. The sample covers every 200-byte string at the same place
in all of its copies, and of 70 positions about one is sampled. Equal suffixes are therefore in one bucket,
and a bucket whose sample string stands only once is settled without its suffixes. In the other buckets
samples with equal whole contexts (all bytes of the suffixes that share the sample) settle these suffixes at
once. The rest is cut into blocks of 16 suffixes, counted from the sample: equal blocks settle theirs, and a block
whose core (the 185 bytes in all of its suffixes) stands only once has no repeated suffix. What remains, the ends of
repeated passages, is named suffix by suffix by 128 bits of its 200 bytes.

Distinct texts are found first and numbered as they are written down; all further steps are between them, and a text
that stands more than once counts twice, is repeated as a whole and needs no search of its own. So neither repeated
rows nor equal or null ids make a step larger.

This takes the place of a difference cover of fixed positions, which must sort one suffix in eight
(README). All steps are partial aggregates and joins of plain tables: no bucket is gathered in a task.

Defined cases: a null text has no bytes; a text under 200 bytes repeats nothing; matches don't cross texts;
repeated rows repeat each other; null ids are allowed; a very long text is read in pieces that overlap, and found whole;
of strings that tie in their hash the first is the sample; an empty table gives an empty result. Other
columns are not read. Texts are told apart by 128 bits of their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.bytehash import BLOCK, Prefix, U, blocks, mix
from keytide.llm.common import Scratch, documents, ship, text_of

LENGTH, SAMPLE, STEP = 200, 64, 16
#: A longer text is read in pieces of so many suffixes.
PIECE = 1 << 22


def pieces(offs: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Offsets of runs of texts, and how far into its text the first one starts; long texts come in overlapping pieces."""
    if offs[-1] - offs[0] <= PIECE + LENGTH:
        yield offs, 0
        return
    for d in range(len(offs) - 1):
        for at in range(offs[d], max(offs[d] + 1, offs[d + 1] - LENGTH + 1), PIECE):
            yield np.array([at, min(offs[d + 1], at + PIECE + LENGTH - 1)]), int(at - offs[d])


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` following numbers."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=U)
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Text, first and last suffix, sample, its hash and the context's hash of each run of suffixes that share a sample."""
    if len(data) < LENGTH:
        return None
    p = Prefix(data)
    at = np.arange(len(data) - SAMPLE + 1)
    h = p.of(at, at + SAMPLE)
    # 40 bits of the hash, then the place: the first of the least.
    least = window_min((h & ~U((1 << 24) - 1)) | at.astype(U), LENGTH - SAMPLE + 1)
    place = (least & U((1 << 24) - 1)).astype(np.int64)
    doc = np.searchsorted(offs, np.arange(len(place)), "right") - 1
    ok = np.arange(len(place)) + LENGTH <= offs[doc + 1]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | ~ok[:-1] | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(new & ok)
    if not len(lo):
        return None
    end = np.zeros(len(place), bool)
    end[:-1] = new[1:] | ~ok[1:]
    end[-1] = True
    hi = np.flatnonzero(end & ok)
    context = mix(p.of(lo, hi + LENGTH) + (hi - lo).astype(U) * U(0x9FB21C651E98DF25) + (place[lo] - lo).astype(U))
    begin = offs[doc[lo]]
    return doc[lo], lo - begin, hi - begin, place[lo] - begin, h[place[lo]].view(np.int64), context.view(np.int64)


def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tid, copies, text -> tid, copies, lo, hi, at, h, c."""
    for batch in batches:
        for i, j, data, offs in blocks(batch.column("text")):
            for part, shift in pieces(offs):
                got = runs(data[part[0] : part[-1]], part - part[0])
                if got is not None:
                    row = pa.array(i + got[0] if len(part) == len(offs) else np.full(len(got[0]), i))
                    yield pa.RecordBatch.from_arrays([batch.column("tid").take(row), batch.column("copies").take(row), pa.array((got[1] + shift).astype(np.int32)), pa.array((got[2] + shift).astype(np.int32)), pa.array((got[3] + shift).astype(np.int32)), pa.array(got[4]), pa.array(got[5])], ["tid", "copies", "lo", "hi", "at", "h", "c"])


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts ``n``: the number of the owner and the place within it, of each of their sum."""
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)


def suffix_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tid, text, runs (lo, hi, at, copies) -> tid, lo, hi, core, c, copies of blocks of suffixes."""
    for batch in batches:
        lists = batch.column("runs")
        for i, j, data, offs in blocks(batch.column("text")):
            p, part = Prefix(data), lists.slice(i, j - i)
            row, flat = np.repeat(np.arange(j - i), part.value_lengths().to_numpy()), part.flatten()
            lo, hi, at, copies = (flat.field(f).to_numpy().astype(np.int64) for f in ("lo", "hi", "at", "copies"))
            own, k = spread((at - lo) // STEP - (at - hi) // STEP + 1)
            k += ((at - hi) // STEP)[own]
            begin, core = offs[row[own]], at[own] - STEP * k
            a, b = np.maximum(lo[own], core - STEP + 1), np.minimum(hi[own], core)
            d = mix(p.of(begin + core, begin + core + LENGTH - STEP + 1) + k.astype(U)).view(np.int64)
            c = mix(p.of(begin + a, begin + b + LENGTH) + (b - a).astype(U) * U(0x9FB21C651E98DF25) + (core - a).astype(U)).view(np.int64)
            take = pa.array(i + row[own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("tid").take(take), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(d), pa.array(c), pa.array(copies[own].astype(np.int32))],
                ["tid", "lo", "hi", "core", "c", "copies"],
            )


def suffix_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tid, text, runs (lo, hi, copies) -> tid, s, x, y, copies of each suffix."""
    for batch in batches:
        spans = batch.column("runs")
        for i, j, data, offs in blocks(batch.column("text")):
            p, q = Prefix(data), Prefix(data, 2)
            part = spans.slice(i, j - i)
            row = np.repeat(np.arange(j - i), part.value_lengths().to_numpy())
            flat = part.flatten()
            lo, hi, copies = (flat.field(f).to_numpy().astype(np.int64) for f in ("lo", "hi", "copies"))
            n = hi - lo + 1
            for first in range(0, len(lo), 4096):
                z = slice(first, first + 4096)
                of, s = spread(n[z])
                s += lo[z][of]
                own = row[z][of]
                at = offs[own] + s
                take = pa.array(i + own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("tid").take(take), pa.array(s.astype(np.int32)), pa.array(p.of(at, at + LENGTH).view(np.int64)), pa.array(q.of(at, at + LENGTH).view(np.int64)), pa.array(copies[z][of].astype(np.int32))],
                    ["tid", "s", "x", "y", "copies"],
                )


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, rid2, copies, text, gone (lo, hi) -> the counts and the hash of the bytes kept."""
    for batch in batches:
        out: list[tuple[int, int, int, str]] = []
        for text, gone, copies in zip(batch.column("text"), batch.column("gone"), batch.column("copies").to_pylist(), strict=True):
            raw = np.frombuffer(text.as_buffer(), np.uint8)
            mark = np.zeros(len(raw) + 1, np.int32)
            if copies > 1 and len(raw) >= LENGTH:
                mark[0] = 1
            elif gone.is_valid and len(gone.values):
                np.add.at(mark, gone.values.field("lo").to_numpy(), 1)
                np.add.at(mark, gone.values.field("hi").to_numpy() + LENGTH, -1)
            cover = np.cumsum(mark[:-1]) > 0
            starts = int(cover[:1].sum()) + int(np.count_nonzero(cover[1:] & ~cover[:-1]))
            out.append((len(raw), int(cover.sum()), starts, hashlib.sha256(raw[~cover].tobytes()).hexdigest()))
        cols = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("rid2"), *cols], ["rid", "rid2", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


class RepeatedStrings:
    """``texts``: distinct texts (rid, rid2, text, copies, tid). ``gone``: for each text that stands once (tid) the runs (lo, hi)
    of its suffixes whose 200 bytes stand elsewhere too."""

    def __init__(self, docs: DataFrame) -> None:
        ship(docs.sparkSession)
        self.scratch = s = Scratch(docs.sparkSession)
        self.rows = docs.select("doc_id", text_of(docs).alias("text")).withColumn("rid", F.xxhash64("text")).withColumn("rid2", F.xxhash64(F.lit(1), "text"))
        # The texts of the rows of one text are combined before the shuffle.
        each = self.rows.groupBy("rid", "rid2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
        self.texts = s.keep(each.select("rid", "rid2", "text", F.least("n", F.lit(2)).cast("int").alias("copies"), F.monotonically_increasing_id().alias("tid")))
        samples = s.keep(self.texts.select("tid", "copies", "text").mapInArrow(sampled, "tid long, copies int, lo int, hi int, at int, h long, c long"))
        twice = s.keep(samples.groupBy("h").agg(F.sum("copies").alias("m")).where("m > 1").select("h"))
        met = s.keep(samples.join(twice, "h"))
        s.drop(samples, twice)
        runs, whole = self.settled(met, "h", "at")
        lists = s.keep(runs.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi", "at", "copies")).alias("runs")))
        s.drop(met, runs)
        parts = s.keep(self.texts.select("tid", "text").join(lists, "tid").mapInArrow(suffix_blocks, "tid long, lo int, hi int, core long, c long, copies int"))
        twice = s.keep(parts.groupBy("core").agg(F.sum("copies").alias("m")).where("m > 1").select("core"))
        s.drop(lists)
        met = s.keep(parts.join(twice, "core"))
        s.drop(parts, twice)
        parts, some = self.settled(met, "core")
        lists = s.keep(parts.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi", "copies")).alias("runs")))
        s.drop(met, parts)
        named = s.keep(self.texts.select("tid", "text").join(lists, "tid").mapInArrow(suffix_names, "tid long, s int, x long, y long, copies int"))
        s.drop(lists)
        again = s.keep(named.groupBy("x", "y").agg(F.sum("copies").alias("m")).where("m > 1").select("x", "y"))
        single = named.where("copies = 1").join(again, ["x", "y"]).select("tid", F.col("s").alias("lo"), F.col("s").alias("hi"))
        found = whole.union(some).union(single)
        self.gone = s.keep(found.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("gone")))
        s.drop(whole, some, named, again)

    def settled(self, met: DataFrame, bucket: str, *more: str) -> tuple[DataFrame, DataFrame]:
        """Of rows (tid, lo, hi, bucket, c, copies): those still open, and the spans of rows with an equal context.

        To the open rows belong, of each equal context in the bucket of an open row, the rows of one text, for two copies
        each: the others could equal them in part.
        """
        s, columns = self.scratch, ("tid", "lo", "hi", *more, "copies")
        equal = s.keep(met.groupBy(bucket, "c").agg(F.sum("copies").alias("m"), F.min("tid").alias("r")).where("m > 1").select(bucket, "c", "r"))
        judged = s.keep(met.join(equal, [bucket, "c"], "left"))
        ends = s.keep(judged.where("r is null").select(bucket).distinct())
        one = judged.where("tid = r").join(ends, bucket).withColumn("copies", F.lit(2))
        rows = s.keep(judged.where("r is null").select(*columns).union(one.select(*columns)))
        spans = s.keep(judged.where("r is not null and copies = 1").select("tid", "lo", "hi"))
        s.drop(equal, judged, ends)
        return rows, spans


def repeated_strings(docs: DataFrame) -> DataFrame:
    r = RepeatedStrings(docs)
    cut = r.texts.join(r.gone, "tid", "left").select("rid", "rid2", "copies", "text", "gone")
    answer = r.scratch.keep(cut.mapInArrow(cut_out, "rid long, rid2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    r.scratch.drop(r.texts, r.gone)
    return r.rows.select("doc_id", "rid", "rid2").join(answer, ["rid", "rid2"]).drop("rid", "rid2")


def op8_suffix_dedup(spark, sf_dir):
    return repeated_strings(documents(spark, sf_dir))
