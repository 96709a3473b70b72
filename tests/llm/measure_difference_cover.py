"""What the difference cover named for op8 costs: ``python -m tests.llm.measure_difference_cover DIR [BUCKETS]`` (not a test).

The cover is {2^i mod 73}, in which each difference modulo 73 stands once. Two suffixes with equal first and last 73 of their 200
bytes are equal if the ranks of their 128-byte samples agree at the first place, at most 72 on, that is sampled in both.
Measured are the ranks of the whole sample (strings combined, sorted by range, joined back to their places) and one of
``BUCKETS`` buckets of suffixes, sorted by their ends; both over the distinct texts. Ties aren't resolved, so this is a lower bound.
"""

import json
import sys
import tempfile
import time
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from keytide.llm.bytehash import blocks
from keytide.llm.common import Scratch, documents, ship, text_of

CYCLE, SAMPLE, LENGTH = 73, 128, 200
COVER = sorted({pow(2, i, CYCLE) for i in range(CYCLE)})


def strings(data: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    rows = np.lib.stride_tricks.sliding_window_view(data, size)[at]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(at), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def places(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places at which ``size`` bytes of one text begin, their texts, and their distance from the text's start."""
    at = np.arange(max(0, len(data) - size + 1))
    doc = np.searchsorted(offs, at, "right") - 1
    ok = at + size <= offs[doc + 1]
    return at[ok], doc[ok], (at - offs[doc])[ok]


def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside = np.isin(np.arange(CYCLE), COVER)
    for batch in batches:
        for i, _, data, offs in blocks(batch.column("text")):
            at, doc, pos = places(data, offs, SAMPLE)
            on = np.flatnonzero(inside[pos % CYCLE])
            if len(on):
                yield pa.RecordBatch.from_arrays([batch.column("tid").take(pa.array(i + doc[on])), pa.array(pos[on].astype(np.int32)), strings(data, at[on], SAMPLE)], ["tid", "pos", "s"])


def bucket(splits: np.ndarray, number: int):
    """Suffixes whose first eight bytes lie in one range of the splitters: tid, pos, ends."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offs in blocks(batch.column("text")):
                at, doc, pos = places(data, offs, LENGTH)
                if not len(at):
                    continue
                head = np.zeros(len(data) - LENGTH + 1, np.uint64)
                for j in range(8):
                    head = (head << np.uint64(8)) | data[j : j + len(head)]
                on = np.flatnonzero(np.searchsorted(splits, head[at], "right") == number)
                if len(on):
                    ends = pa.compute.binary_join_element_wise(strings(data, at[on], CYCLE), strings(data, at[on] + LENGTH - CYCLE, CYCLE), b"")
                    yield pa.RecordBatch.from_arrays([batch.column("tid").take(pa.array(i + doc[on])), pa.array(pos[on].astype(np.int32)), ends], ["tid", "pos", "ends"])

    return of


def cpu() -> float:
    return int(Path("/sys/fs/cgroup/cpu.stat").read_text().split()[1]) / 1e6 if Path("/sys/fs/cgroup/cpu.stat").exists() else sum(map(int, Path("/proc/stat").read_text().split("\n")[0].split()[1:4])) / 100


def main(folder: str, buckets: int) -> None:
    local = tempfile.mkdtemp(prefix="keytide-")
    spark = (
        SparkSession.builder.master("local[6]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "48").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.local.dir", local).config("spark.cleaner.referenceTracking", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    scratch = Scratch(spark)
    shuffled = lambda: sum(f.stat().st_size for f in Path(local).rglob("shuffle_*.data"))
    docs = documents(spark, folder)
    texts = scratch.keep(docs.select(text_of(docs).alias("text")).distinct().withColumn("tid", F.monotonically_increasing_id()).repartition(48))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] / 1e9

    def measured(name, run):
        c, w, t = cpu(), shuffled(), time.perf_counter()
        rows = run()
        print(json.dumps({"step": name, "GB": round(size, 3), "rows": rows, "seconds": round(time.perf_counter() - t, 1), "cpu_seconds_a_GB": round((cpu() - c) / size), "shuffle_x": round((shuffled() - w) / 1e9 / size, 2)}), flush=True)

    def ranks():
        rows = scratch.keep(texts.mapInArrow(sample, "tid long, pos int, s binary"))
        # Numbers of range-sorted rows grow with the strings, as ranks do.
        ranked = scratch.keep(rows.select("s").distinct().orderBy("s").withColumn("rank", F.monotonically_increasing_id()))
        return scratch.keep(rows.join(ranked, "s").select("tid", "pos", "rank")).count()

    def one_bucket():
        # Quantiles of the first eight bytes of a thousandth of the texts.
        some = "".join(r.text for r in texts.where("pmod(xxhash64(text), 1000) = 0").select("text").collect()).encode()
        data = np.frombuffer(some, np.uint8).astype(np.uint64)
        head = sum(data[j : len(data) - 7 + j] << np.uint64(56 - 8 * j) for j in range(8))
        splits = np.quantile(np.sort(head), np.arange(1, buckets) / buckets, method="nearest")
        rows = texts.mapInArrow(bucket(splits, buckets // 2), "tid long, pos int, ends binary")
        return scratch.keep(rows.orderBy("ends").select("tid", "pos")).count()

    measured("ranks of the cover sample", ranks)
    measured(f"one of {buckets} buckets", one_bucket)


if __name__ == "__main__":
    differences = {(a - b) % CYCLE for a in COVER for b in COVER}
    assert differences == set(range(CYCLE)) and len(COVER) == 9
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 32)
