"""Every query of the corpus operators and the pipeline over one odd table: nulls in any column, empty and very long texts, ties,
repeated rows, clashing columns; and over empty tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e

LONG = 10**6
TEXTS = [
    None, "", " \t\n", "one", " " * LONG, "\n" * LONG, "a" * LONG, "日本 " * 1000, "word " * (LONG // 5), "tie one two three four five six", "tie one two three four five six",
    "jo@mail.com and 10.0.0.1 " * 50, "#" * LONG, " ".join(f"w{i}" for i in range(LONG // 8)), "Released under the MIT License.", "plain text of twenty words and more " * 9,
]
CLASH = "lang string, source string, n_chars long, h long, g long, t string, size string, bin int, label string, cid long, rank int, _t string, _row int, _w string, _l int, stratum string, range int, part int, copies int, text_hash long, spans string, base string, uid long, rid long, tid long, piece int, target double"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("odd")
    extra = [None] * (len(CLASH.split(",")) - 3)
    rows = [(i if i % 5 else None, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, len(t) if t else None, *extra) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows + rows[:4] + rows[9:12], f"doc_id long, text string, {CLASH}")
    docs.repartition(3).write.parquet(str(base / "documents.parquet"))
    spark.createDataFrame([(1, 1, None), (None, 1, 0), (3, None, 0), (1, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(base / "labels.parquet"))
    vectors = [(1, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [2.0, 4.1]), (9, [1.0, 2.0, 3.0])]
    spark.createDataFrame([(i, v, i, "x") for i, v in vectors], "vec_id long, embedding array<float>, k long, label string").write.parquet(str(base / "embeddings.parquet"))
    return str(base)


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    base = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(str(base / f"{t}.parquet"))
    return str(base)


ONE_ROW_EACH = ("op3_source_mixing", "op5_quality_rules", "op7_pii", "op8_suffix_dedup", "op9_minhash", "op10_sharding")


@pytest.mark.parametrize("name", [n for n in e.CORPUS if n != "pipeline"])
def test_odd_rows(name, spark, odd):
    rows = e.queries()[name](spark, odd).collect()
    table = spark.read.parquet(f"{odd}/{'embeddings' if name.startswith('op2') else 'documents'}.parquet")
    n = table.count()
    if name in ONE_ROW_EACH or name.startswith("op2"):
        assert len(rows) == n
    if name.startswith("op2"):
        assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == {1: (3, 1), None: (3, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (3, 1), 9: (0, 9)}
    if name.startswith("op1_"):
        assert sum(r.n_tokens > 0 for r in rows) and len({r.doc_id for r in rows}) == table.select("doc_id").distinct().count()
    if name.startswith("op4"):
        words = table.select(F.sum(F.size(F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), x -> x != '')")))).first()[0]
        assert sum(r.words for r in rows) == words and {r.doc_id for r in rows} == {r.doc_id for r in table.collect()}
    if name.startswith("op6"):
        assert {(r.doc_id, r.license) for r in rows} == {(14, "MIT-line")}
    if name.startswith("op10"):
        for s in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


@pytest.mark.parametrize("name", list(e.CORPUS))
def test_empty_tables(name, spark, empty):
    assert e.queries()[name](spark, empty).count() == 0


def test_pipeline_over_odd_rows(spark, odd):
    """Nulls, repeats and long texts go through all stages."""
    rows = e.queries()["pipeline"](spark, odd).collect()
    assert sum(r.words for r in rows) > 0
