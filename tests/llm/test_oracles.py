"""The SQL of corpus operators and the operators themselves over small odd tables, in which links and repeats are many."""

import random

import duckdb
import numpy as np
import pytest

from keytide.llm import embeddings, minhash, oracles, substrings

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


def both(df, name, table, operator, path):
    df.write.parquet(str(path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    want = c.execute(oracles.ORACLES[name])
    names = [d[0] for d in want.description]
    got = operator(df)
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(r[n] for n in names) for r in got.collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)
    return rows


@pytest.fixture(scope="module")
def odd_documents(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["é", "語", "a b"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = line(90), [line(60).split() for _ in range(12)]
    texts = [None, "", " \t\n", "one", "one two three", "one two three", "a" * 1500, "a" * 199, "a" * 200, "\n" * 700]
    for b in base:
        texts += [" ".join(b), " ".join(b), "  ".join(b)]
        for swaps in (1, 2, 3):
            near = list(b)
            for i in r.sample(range(60), swaps):
                near[i] = "new"
            texts.append(" ".join(near))
        texts.append(line(r.randrange(5, 40)) + " " + passage + " " + line(r.randrange(5, 40)))
    texts.append(" ".join(line(200) + passage for _ in range(30)))
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], TEXT)


def test_strings(odd_documents, tmp_path):
    rows = both(odd_documents, "op8_suffix_dedup", "documents", substrings.repeated_strings, tmp_path / "d")
    assert sum(r[2] for r in rows) > 10_000 and max(r[3] for r in rows) >= 30


def test_near_duplicates(odd_documents, tmp_path):
    rows = both(odd_documents, "op9_minhash", "documents", minhash.near_duplicates, tmp_path / "d")
    assert sum(not r[2] for r in rows) >= 12 * 3


def test_vectors(spark, tmp_path):
    g = np.random.default_rng(4)
    kinds: list = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 3, [2.0] * 3]
    for _ in range(6):
        center = g.standard_normal(16)
        kinds += [(s * (center + g.standard_normal(16) * e)).tolist() for s, e in ((1, 0), (3, 0.05), (1, 0.1), (0.5, 0.15), (1, 0.2), (1, 0.25))]
    kinds.append(kinds[-1])
    rows = both(spark.createDataFrame([(i, v, 0) for i, v in enumerate(kinds)], "vec_id long, embedding array<float>, label int"), "op2_embedding_dedup", "embeddings", embeddings.vector_links, tmp_path / "v")
    assert sum(r[1] for r in rows) > 40


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], TEXT)
    assert both(none, "op8_suffix_dedup", "documents", substrings.repeated_strings, tmp_path / "a") == []
    assert both(none, "op9_minhash", "documents", minhash.near_duplicates, tmp_path / "b") == []
    assert both(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), "op2_embedding_dedup", "embeddings", embeddings.vector_links, tmp_path / "c") == []
