"""Near-duplicate documents by ProbMinHash.

A document is its distinct five-word shingles. Every shingle sends a Poisson process of arrivals with
its weight as rate; an arrival falls on a register drawn at random and a register keeps the shingle that
arrived first. A document's processes end as soon as no later arrival can come first anywhere. Two
documents agree in a register with the probability Jaccard of their weighted shingles. All weights are
equal, however often a shingle is repeated: then this is the plain Jaccard, by which links are defined.
Registers are banded (25 bands of 5 find a pair at 0.8 but for one in twenty thousand), and a link needs
an exact Jaccard of 0.8 or more between the whole sets of shingles.

Texts of equal word sequences are one class from the start, so groups of copies have one row in
every later step. In a bucket, members are first compared with one member, and components are formed;
what is still apart is compared with another member; what is then still apart is compared in blocks of
bounded size, which send spanning links only. So no link is lost and no group of near copies is expanded into pairs.

Result: one row for each document with the smallest id of its group. Defined cases: a text without words
(null included) is a group of its own; a null id gives a null class unless its group has others;
repeated rows and ids share nothing but what their texts share; a tie of the smallest id (a repeated row) leaves one
row; a long text is compared whole; empty tables give empty results; texts of one to four words have one
shingle of all their words. Classes are told apart by 64 bits of their words' hash. Other columns
are not read by ``near_duplicates``; ``near_dedup`` returns all, and none may be named ``_kt_cid`` or ``_kt_want``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keytide.llm.bytehash import Prefix, U, blocks, mix, shingles, word_bounds, word_digest
from keytide.llm.common import Scratch, components, documents, extended, ship, shuffle_partitions

K, BANDS, ROWS, LEAST = 5, 25, 5, 0.8
#: Most shingles and rows of one side of a block, in which what is still apart is compared.
BLOCK_ITEMS, BLOCK_ROWS = 1 << 20, 2048


def probminhash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Registers (docs x m) of the items that arrive first."""
    first, kept = np.full(docs * m, np.inf), np.zeros(docs * m, dtype=U)
    latest = np.full(docs, np.inf)
    state, time = mix(item + U(0x2545F4914F6CDD1D)), np.zeros(len(item))
    while len(doc):
        state = mix(state + U(0x9E3779B97F4A7C15))
        time = time - np.log(((state >> U(11)) + U(1)).astype(np.float64) * 2.0**-53) / weight
        live = time < latest[doc]
        doc, item, weight, state, time = doc[live], item[live], weight[live], state[live], time[live]
        at = doc * m + (((mix(state ^ U(0x632BE59BD9B4E019)) >> U(32)) * U(m)) >> U(32)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        kept[at[won]] = item[won]
        latest = first.reshape(docs, m).max(1)
    return kept.reshape(docs, m)


def block_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, at = word_bounds(data, offs)
    return Prefix(data).of(starts, ends), at


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, th, text -> doc_id, th, cid (null without words), n (shingles), bands."""
    for batch in batches:
        for i, j, data, offs in blocks(batch.column("text")):
            words, at = block_words(data, offs)
            h, doc = shingles(words, at, K)
            # 20 bits of the text in front, so that one sort groups the shingles of each text.
            key = np.sort((doc.astype(U) << U(44)) | (h >> U(20)))
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            key = key[new]
            doc = (key >> U(44)).astype(np.int64)
            sig = probminhash(doc, key & U((1 << 44) - 1), np.ones(len(key)), j - i, BANDS * ROWS)
            band = np.zeros((j - i, BANDS), dtype=U)
            for r in range(ROWS):
                band = mix(band + sig.reshape(j - i, BANDS, ROWS)[:, :, r])
            band = mix(band + np.arange(BANDS, dtype=U)).view(np.int64)
            full = np.diff(at) > 0
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]), pa.int32()), pa.array(band[full].ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), batch.column("th").slice(i, j - i), pa.array(word_digest(words, at), mask=~full), pa.array(np.bincount(doc, minlength=j - i).astype(np.int32)), bands],
                ["doc_id", "th", "cid", "n", "bands"],
            )


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, cid -> cid and its sorted distinct shingles as bytes; rows whose text isn't the class's are left out."""
    for batch in batches:
        want = batch.column("cid").to_numpy(zero_copy_only=False)
        for i, j, data, offs in blocks(batch.column("text")):
            words, at = block_words(data, offs)
            h, doc = shingles(words, at, K)
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            ok = np.flatnonzero((word_digest(words, at) == want[i:j]) & (np.diff(at) > 0))
            sets = [np.unique(h[cut[d] : cut[d + 1]]).tobytes() for d in ok]
            yield pa.RecordBatch.from_arrays([pa.array(want[i:j][ok], pa.int64()), pa.array(sets, pa.binary())], ["cid", "items"])


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, left, right (sets) -> a, b of the pairs with enough in common."""
    for batch in batches:
        left, right = batch.column("left"), batch.column("right")
        keep = np.zeros(len(left), bool)
        for r in range(len(left)):
            x, y = (np.frombuffer(v[r].as_buffer(), U) for v in (left, right))
            if min(len(x), len(y)) >= LEAST * max(len(x), len(y)):
                both = np.concatenate([x, y])
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[r] = same >= LEAST * (len(both) - same) - 1e-9
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many items each two of the sets share; columns in portions, so that memory depends on the number of sets."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    items, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    place = np.cumsum(often) - 1
    row, column = row[often[column]], place[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, (first, first + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        out += part @ part.T
    return out


def block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows h, i, j, cid, label, items sorted by block -> for each row with a link to another component one link a, b."""
    rest: pa.Table | None = None

    def of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cid, label = t["cid"].to_numpy(), t["label"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), U) for x in t["items"]]
        n = np.array([len(x) for x in sets], np.float32)
        same = common(sets)
        hit = (same >= LEAST * (n[:, None] + n[None, :] - same) - 1e-6) & (label[:, None] != label[None, :])
        near = np.arange(len(cid))
        while True:  # the least row of each component that links make of the block
            least = np.minimum(near, np.where(hit, near[None, :], len(cid)).min(1))
            least = least[least]
            if (least == near).all():
                break
            near = least
        on = np.flatnonzero(near != np.arange(len(cid)))
        # Rows of a component are linked to its least row: they are of one group, though perhaps not alike.
        yield pa.RecordBatch.from_arrays([pa.array(cid[on]), pa.array(cid[near[on]])], ["a", "b"])

    def cut(t: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
        key = np.stack([t[c].to_numpy() for c in ("h", "i", "j")])
        ends = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [t.num_rows]])
        for a, b in zip(ends[:-1], ends[1:] if whole else ends[1:-1], strict=False):
            if b - a > 1:
                yield from of(t.slice(a, b - a))
        nonlocal rest
        rest = None if whole else t.slice(ends[-2])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if t.num_rows:
            yield from cut(t, False)
    if rest is not None and rest.num_rows:
        yield from cut(rest, True)


def passed_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Any columns and text -> the same and _kt_cid."""
    for batch in batches:
        text = batch.column("text")
        cids = [pa.array(word_digest(w, at), mask=np.diff(at) == 0) for _, _, data, offs in blocks(text) for w, at in [block_words(data, offs)]]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(cids) if cids else pa.array([], pa.int64())], [*batch.schema.names, "_kt_cid"])


class NearDuplicates:
    """The steps over ``docs`` (doc_id, text); ``rows`` has (doc_id, cid), ``groups`` has (cid, class_id)."""

    def __init__(self, docs: DataFrame) -> None:
        ship(docs.sparkSession)
        self.scratch = s = Scratch(docs.sparkSession)
        narrow = docs.select("doc_id", docs["text"].cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
        id_type = dict(narrow.dtypes)["doc_id"]
        self.rows = s.keep(narrow.select("doc_id", "th", "text").mapInArrow(signatures, f"doc_id {id_type}, th long, cid long, n int, bands array<long>"))
        # Ids may be null or repeated: with the text's hash they name one row, or rows that are alike.
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th"))
        reps = s.keep(self.rows.where("cid is not null").groupBy("cid").agg(first.alias("r")).select("cid", F.col("r.doc_id").alias("rep"), F.col("r.th").alias("rep_th")))
        spread = self.rows.where("cid is not null").select("cid", "n", F.explode("bands").alias("h"))
        shared = s.keep(spread.groupBy("h").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi"))
        self.members = s.keep(spread.join(shared, "h").distinct())
        s.drop(shared)
        near = self.members.select("cid").distinct().join(reps, "cid")
        texts = narrow.join(near, (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "cid")
        self.sets = s.keep(texts.mapInArrow(shingle_sets, "cid long, items binary").groupBy("cid").agg(F.any_value("items").alias("items")))
        links = s.keep(self.verified(self.members.where("cid != lo").select(F.col("cid").alias("a"), F.col("lo").alias("b")).distinct()))
        labels = components(s, links)
        for pairs in (self.star, self.across):
            apart = self.apart(labels)
            more = s.keep(pairs(apart))
            s.drop(apart)
            if more.limit(1).count():
                was, labels = labels, extended(s, labels, more)
                s.drop(was)
            s.drop(more)
        s.drop(self.sets, self.members)
        named = s.keep(reps.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "rep", F.coalesce("label", "cid").alias("label")))
        least = s.keep(named.groupBy("label").agg(F.min("rep").alias("class_id")))
        self.groups = s.keep(named.join(least, "label").select("cid", "rep", "class_id"))
        s.drop(reps, labels, links, named, least)

    def verified(self, pairs: DataFrame) -> DataFrame:
        left = self.sets.select(F.col("cid").alias("a"), F.col("items").alias("left"))
        right = self.sets.select(F.col("cid").alias("b"), F.col("items").alias("right"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(linked, "a long, b long")

    def apart(self, labels: DataFrame) -> DataFrame:
        """Members of the buckets that still hold several components."""
        named = self.members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("h", "cid", "n", F.coalesce("label", "cid").alias("label"))
        named = self.scratch.keep(named)
        open_ = self.scratch.keep(named.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max_by("cid", "label").alias("center")).where("x < y").select("h", "y", "center"))
        out = self.scratch.keep(named.join(open_, "h"))
        self.scratch.drop(named, open_)
        return out

    def star(self, apart: DataFrame) -> DataFrame:
        """Links of the members to one member of another component."""
        return self.verified(apart.where("label != y").select(F.col("cid").alias("a"), F.col("center").alias("b")).distinct())

    def across(self, apart: DataFrame) -> DataFrame:
        """Links between components of a bucket, found in blocks of bounded size; a block sends a spanning set of its links."""
        parts = apart.groupBy("h").agg(F.greatest(F.ceil(F.sum("n") / float(BLOCK_ITEMS)), F.ceil(F.count(F.lit(1)) / float(BLOCK_ROWS))).cast("int").alias("parts"))
        met = apart.select("h", "cid", "label").join(self.scratch.keep(parts), "h").withColumn("side", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
        met = met.select("h", "cid", "label", "side", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")).join(self.sets, "cid")
        met = met.select("h", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "cid", "label", "items")
        dealt = met.repartition(shuffle_partitions(apart.sparkSession), "h", "i", "j").sortWithinPartitions("h", "i", "j")
        return dealt.mapInArrow(block_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    d = NearDuplicates(docs)
    return d.rows.select("doc_id", "cid").join(d.groups, "cid", "left").select(
        "doc_id", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("cid").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )


def near_dedup(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with one of each group, that of the smallest id, and all rows without words. Of repeated rows one stays."""
    d = NearDuplicates(docs)
    chosen = d.groups.where(F.col("rep").eqNullSafe(F.col("class_id"))).select("cid", "class_id")
    chosen = d.rows.select("doc_id", "cid").join(chosen, "cid").where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    chosen = d.scratch.keep(chosen.groupBy("cid", "class_id").agg(F.count(F.lit(1)).alias("_kt_n")).select(F.col("cid").alias("_kt_want"), F.col("class_id").alias("_kt_id"), "_kt_n"))
    schema = T.StructType([*docs.schema.fields, T.StructField("_kt_cid", T.LongType())])
    marked = docs.mapInArrow(passed_digest, schema)
    none = marked.where("_kt_cid is null").drop("_kt_cid")
    kept = marked.join(chosen, (F.col("_kt_cid") == F.col("_kt_want")) & F.col("doc_id").eqNullSafe(F.col("_kt_id")))
    out = kept.where("_kt_n = 1").select(*docs.columns).union(none)
    if chosen.where("_kt_n > 1").limit(1).count():
        out = out.union(kept.where("_kt_n > 1").dropDuplicates(["_kt_want", "_kt_id"]).select(*docs.columns))
    return out


def op9_minhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
