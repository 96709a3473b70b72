"""Each operator against a brute-force version, over odd rows: null and empty texts, copies, repeated rows, clashing columns."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keytide.llm import embeddings, licenses, minhash, mixing, packing, pii, quality, sharding, substrings, tokens
from keytide.llm.common import Scratch
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, h string, bin string, label string, size string"
DOCS = brute.corpus()
EXTRA = (1, "x", "y", "z", "s")
SOURCES = ["b", "a", None, "hot", "hot", "hot", "é"]


def frame(spark, docs, more=()):
    rows = [(i, t, "en", SOURCES[i % 7] if i is not None else None, len(t or ""), *EXTRA) for i, t in [*docs, *more]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DOCS).repartition(3).cache()


def test_near_duplicates(docs):
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert found == brute.near(DOCS)
    assert len(set(found.values())) < len(found)


def test_near_duplicates_keep_every_link(spark):
    """A chain whose ends are unlike, and a star of edits: groups need links between different members."""
    base = [f"t{i}" for i in range(300)]
    docs = []
    for i in range(60):
        w = list(base)
        for k in range(i, i + 4):
            w[(k * 5) % 300] = f"e{k}"
        docs.append((i, " ".join(w)))
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(frame(spark, docs)).collect()}
    assert found == brute.near(docs)


def test_near_duplicates_with_repeated_lines(spark):
    """Pairs above the bound, of which one text repeats a third of its lines a hundred times."""
    docs = []
    for p in range(40):
        lines = [" ".join(f"p{p}l{i}w{j}" for j in range(12)) for i in range(40)]
        other = ["\n".join([x] * 100) if i < 13 else x for i, x in enumerate(lines[:38])] + [f"new{p} {x}" for x in lines[38:]]
        docs += [(2 * p, "\n".join(lines)), (2 * p + 1, "\n".join(other))]
    want = brute.near(docs)
    assert all(want[2 * p + 1] == 2 * p for p in range(40))
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(frame(spark, docs)).collect()}
    assert found == want


def test_near_dedup_returns_rows(spark, docs):
    kept = minhash.near_dedup(docs)
    assert kept.schema == docs.schema
    want = {i for i, c in brute.near(DOCS).items() if i == c}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    twice = minhash.near_dedup(docs.where("doc_id < 12").union(docs.where("doc_id < 12")))
    assert sorted(r.doc_id for r in twice.collect()) == sorted(i for i in want if i < 12)


def test_null_ids(spark):
    rows = frame(spark, [(5, "a b c d e f g")], [(None, "a b c d e f g"), (None, "only a null id here")])
    assert Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(rows).collect()) == {(5, 5): 1, (None, 5): 1, (None, None): 1}
    assert minhash.near_dedup(rows).count() == 2


def test_repeated_strings(docs):
    found = {r.doc_id: tuple(r)[1:] for r in substrings.repeated_strings(docs).collect()}
    assert found == brute.repeats(DOCS)
    assert any(0 < f[1] < f[0] for f in found.values())


def test_repeated_rows_cost_no_more(spark):
    """Rows of one text with one id, or none: results of brute force, and lists that don't grow with the repeats."""
    words = " ".join(f"w{i}" for i in range(300))
    docs = [(i, words[i * 7 :] if i % 3 else f"own {i} text " * 5) for i in range(9)]
    rows = frame(spark, docs).select("doc_id", "text")
    many = rows.crossJoin(spark.range(300)).select(F.when(F.col("doc_id") < 6, F.lit(None)).otherwise(5).cast("long").alias("doc_id"), "text")
    want = Counter(brute.repeats([(k, t) for k, (_, t) in enumerate(docs * 2)])[k] for k in range(9))
    assert Counter(tuple(r)[1:] for r in substrings.repeated_strings(many).collect()) == Counter({k: 300 * n for k, n in want.items()})
    assert sum(substrings.RepeatedStrings(many).texts.select("copies").toPandas()["copies"]) == 18
    got = minhash.near_duplicates(many)
    assert got.count() == 2700 and got.select("class_id").distinct().count() == 2


def test_repeated_strings_in_pieces(spark, monkeypatch):
    parts = list(substrings.pieces(np.array([0, 10, 5000, 5100])))
    assert len(parts) == 1
    monkeypatch.setattr(substrings, "PIECE", 1000)
    seen = defaultdict(set)
    for offs, shift in substrings.pieces(np.array([0, 10, 5000, 5100])):
        for s in range(offs[0], offs[1] - substrings.LENGTH + 1):
            assert s - offs[0] + shift not in seen[shift]
            seen[0 if shift else s].add(s - offs[0] + shift)
    assert {x for v in seen.values() for x in v if x <= 4990 - 200} >= set(range(4990 - 200 + 1))


def test_quality_counts(docs):
    labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int")
    for r in quality.quality_verdicts(docs, labels).collect():
        n, chars, symbols, dup, repeat, failed = brute.quality(dict(DOCS)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed)
        assert r.kept == (not failed)  # no label, no proof, no further rejection


def test_quality_thresholds(spark):
    """The bound is the exact binomial one, and rejected good documents stay below it."""
    import math

    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 5 == 0
        share = rng.uniform(0.3, 0.6) if bad else rng.uniform(0, 0.05)
        words = [f"v{k}" + ("###" if rng.random() < share else "") for k in range(60)]
        rows.append((i, " ".join(words), "en", "s", 0, *EXTRA))
        labels.append((i, 0 if bad else 1))
    docs, labs = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    rules = quality.QualityRules()
    feats = Scratch(spark).keep(quality.features(docs.select("doc_id", "text", quality.stratum().alias("stratum")), ["doc_id", "stratum"]))
    p, judged = rules.alpha, rules.judged(feats, labs)
    units = rules.units(judged)
    assert set(units) == {"symbols"}
    table = rules.candidates(judged, units).collect()
    assert {r.stratum for r in table} == {"en"} and any(r.proven for r in table)
    for r in table:
        want = 1.0 if r.k > p * r.n else sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
        assert r.p_value == pytest.approx(want, rel=1e-6)
    verdicts = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, labs).collect()}
    assert sum(not verdicts[i] for i in range(0, 3000, 5)) > 550
    assert sum(not verdicts[i] for i in range(3000) if i % 5) <= 0.05 * 2400
    assert {r.doc_id for r in quality.quality_filter(docs, labs).collect()} == {i for i, k in verdicts.items() if k}


ODD = [
    "a@b.c_d@e.f x@y z@1.2 .@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.1.1 99999999999.1.1.1", "4111 1111 1111 1111-4111-1111 4111111111111111 5",
    "4111 1111-1111 1111, x", "+1 (743) 555-3824 4465758382889437 +49 30 1234567. +1+2 333 4444 55555", "é𝒳é@ x𝒳foo.bar@ex.com 😀 1.2.3.4", "a" * 30000 + "@", "1" * 30000,
    "1 " * 30000, "mail a.b@c.de, ip 10.0.0.1, card 4111111111111111, tel +1 743 555 3824", None, "",
]


def test_quality_counts_copies_of_labelled_rows_once(spark):
    """Eighty good documents prove nothing, however often they are repeated; other labels of a copy make all of them bad."""
    text = lambda i, sign: " ".join(f"d{i}w{k}" + (sign if k < 30 else "") for k in range(60))
    rows = [(i, text(i, "###" if i % 2 else ""), "en", "s", 0, *EXTRA) for i in range(160)]
    many = rows + [(1000 + 160 * n + i, t, *rest) for n in range(4) for i, t, *rest in rows]
    labels = [(r[0], 1 - r[0] % 2) for r in many]
    docs, labs = spark.createDataFrame(many + rows, SCHEMA), spark.createDataFrame(labels + labels, "doc_id long, quality int")
    rules = quality.QualityRules()
    feats = Scratch(spark).keep(quality.features(docs.select("doc_id", "text", quality.stratum().alias("stratum")), ["doc_id", "stratum"]))
    assert rules.judged(feats, labs).count() == 160
    units, cutoffs = rules.fit(feats, labs)
    assert set(units) == {"symbols"} and not cutoffs
    odd = rules.judged(feats, labs.union(spark.createDataFrame([(1160, 0)], "doc_id long, quality int")))
    assert odd.where("good > 0").count() == 79


def test_quality_holdout_stays_below_alpha(spark, sf):
    """On test tables with labels enough: cutoffs in three strata at least, and false rejections in held-out splits below alpha."""
    from pathlib import Path

    big = Path("/root/testdata/sf0.1")
    if not big.exists():
        pytest.skip("no large test tables here")
    docs, labs = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    labelled = docs.join(labs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text", quality.stratum().alias("stratum"))
    feats = Scratch(spark).keep(quality.features(labelled, ["doc_id", "stratum"]))
    rules = quality.QualityRules()
    assert len(rules.fit(feats, labs)[1]) >= 3
    for split in range(2):
        held = F.pmod(F.xxhash64("doc_id", F.lit(90 + split)), F.lit(3)) == 0
        model = rules.fit(feats, labs.where(~held))
        for r in feats.where(~quality.base_failed()).join(labs.where(held & (F.col("quality") == 1)), "doc_id").groupBy("stratum").agg(F.avg(rules.passes(*model).cast("int")).alias("kept")).collect():
            assert r.kept >= 1 - rules.alpha


def test_pii_base_spans(spark):
    rows = list(enumerate(ODD)) + [(100 + i, t) for i, t in DOCS[:20]]
    for r in pii.pii_spans(frame(spark, rows)).collect():
        base = brute.base_spans(dict(rows)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        kinds = Counter(k for k, *_ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.BASE)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_pii_added_spans_and_redaction(spark):
    texts = ["please call (743) 555-3824 now", "mail jo [at] mail [dot] com", "his ssn 123-45-6789", "part no 743-555-3824x", "plain", None, "x a.b@c.de y 10.0.0.1"]
    docs = frame(spark, list(enumerate(texts)))
    spans = {r.doc_id: r.spans for r in pii.pii_spans(docs).collect()}
    assert spans[0] == "phone:12:26" and spans[1].startswith("email:5:") and spans[2] == "ssn:8:19" and spans[3] == spans[4] == spans[5] == ""
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[6].text == "x <EMAIL> y <IP>" and clean[6].n_chars == len(clean[6].text)
    assert clean[5].text is None and clean[4].text == "plain" and pii.redact(docs).columns == docs.columns


def test_calling_codes():
    import re

    known = re.compile(f"^(?:{pii.CALLING})")
    for digits in ("14155550123", "4930123456", "447700900123", "351211234567", "861012345678", "9720312345678", "79161234567", "390612345"):
        assert known.match(digits), digits
    for digits in ("0123456789", "1155501234", "155512345", "2101234567", "9991234567", "8391234567", "3841234567"):
        assert not known.match(digits), digits


def test_pii_work_grows_with_matches(spark):
    """Thousands of spans in one text: places and redaction stay right."""
    n = 3000
    text = " ".join(f"mail jo{i} [at] mail [dot] com or x{i}@y.org é 𝒳 10.0.0.{i % 200}" for i in range(n))
    docs = frame(spark, [(1, text)])
    spans = [x.split(":") for x in pii.pii_spans(docs).first().spans.split(",")]
    assert len(spans) == 3 * n and all(text[int(a) : int(b)].startswith({"email": ("jo", "x"), "ip": "10."}[k]) for k, a, b in spans)
    want = " ".join("mail <EMAIL> or <EMAIL> é 𝒳 <IP>" for _ in range(n))
    assert pii.redact(docs).first().text == want


def test_pii_em_tells_reliable_labelers():
    """On votes drawn from known reliabilities EM ranks the labelers right and its classifier agrees with the truth."""
    rng = np.random.default_rng(1)
    counts = Counter()
    truth = []
    p = dict(zip(pii.LABELERS, (0.95, 0.8, 0.9, 0.85, 0.6), strict=True))
    for _ in range(5000):
        real = rng.random() < 0.5
        votes = tuple((1 if real else -1) * (1 if rng.random() < p[n] else -1) for n in pii.LABELERS)
        counts[("phone", votes)] += 1
        truth.append((votes, real))
    model = pii.train([(k, v, c) for (k, v), c in counts.items()])
    mean = {n: sum(model.reliability[n]) / 2 for n in pii.LABELERS}
    assert mean["strict"] > mean["parts"] > mean["alone"]
    score = lambda v: model.bias["phone"] + sum(model.weight[n, s] for n, s in zip(pii.LABELERS, v, strict=True))
    assert np.mean([(score(v) > 0) == real for v, real in truth]) > 0.95


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    size = {i: len(brute.WORD.findall(t or "")) for i, t in DOCS}
    total, largest = Counter(), Counter()
    for i, n in size.items():
        s = SOURCES[i % 7]
        total[s] += n
        largest[s] = max(largest[s], n)
    goal, taken = brute.targets(total), Counter()
    for r in rows:
        s = SOURCES[r.doc_id % 7]
        assert (r["size"], r.source_size) == (size[r.doc_id], total[s]) and r.target == pytest.approx(goal[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in total)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == sorted(map(tuple, rows))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in rows})


def test_mixed_documents_with_repeated_ids(spark, docs):
    """Rows that share an id, or have none, are taken as often as the mix says of each; rows and words add up."""
    rows = docs.withColumn("doc_id", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("doc_id") % 20)).unionByName(docs.where("doc_id < 5"))
    want = Counter((r.doc_id, r.source_size, r["size"]) for r in mixing.mix(rows).collect() for _ in range(r.copies))
    sizes = {r.source: r.n for r in mixing.sized(rows, "source").groupBy("source").agg(F.sum("size").alias("n")).collect()}
    assert Counter((r.doc_id, sizes[r.source], len(brute.WORD.findall(r.text or ""))) for r in mixing.mixed_documents(rows).collect()) == want


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(3)
    sizes = {f"s{i:03d}": int(rng.integers(0, 2000)) for i in range(300)} | {None: 77}
    table = spark.createDataFrame([(k is None, k or "", n) for k, n in sizes.items()], "no_source boolean, source_key string, source_size long")
    goal = brute.targets(sizes)
    for r in mixing.targets(Scratch(spark), table).collect():
        assert r.target == pytest.approx(goal[None if r.no_source else r.source_key])


def test_sharding(docs):
    rows = sharding.shard(docs).collect()
    text = dict(DOCS)
    import zlib

    load, slots = Counter(), defaultdict(list)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "bytes")
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = docs.where("length(text) < 2000").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("text", F.concat("text", "k")).withColumn("doc_id", F.col("doc_id") * 100 + F.col("k"))
    hot = many.union(many.withColumn("text", F.lit("all the same " * 30)).withColumn("doc_id", F.lit(None).cast("long")))
    warm = hot.union(many.withColumn("text", F.lit("a twentieth " * 12)).where("k < 20"))
    for part_rows in (1 << 20, 100):
        load, where, slots = Counter(), defaultdict(set), defaultdict(list)
        for r in sharding.shard(warm, part_rows=part_rows).collect():
            load[r.shard] += r["size"]
            where[r.text_crc32, r["size"]].add(r.shard)
            slots[r.shard].append(r.slot)
        mean = sum(load.values()) / 8
        assert len(load) == 8 and all(abs(v - mean) < 0.02 * mean for v in load.values())
        # Only the text that no shard can hold is in several.
        assert {k: len(v) > 1 for k, v in where.items() if len(v) > 1} == {(zlib.crc32(("all the same " * 30).encode()), 391): True}
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_splitters_decide_the_shards(spark, docs, monkeypatch):
    """Other draws move rows, and every shard of the ranges that aren't hot is an interval of keys between splitters."""
    many = docs.where("length(text) between 20 and 2000").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(60)))).withColumn("text", F.concat("text", "k")).withColumn("doc_id", F.col("doc_id") * 100 + F.col("k"))
    how = {"fine": 8, "per_range": 4, "tolerance": 0.3}
    shards = lambda **k: {r.doc_id: r.shard for r in sharding.shard(many, **how, **k).collect()}
    first = shards()
    assert first == shards() and any(first[i] != s for i, s in shards(seed=99).items())
    keys = {r.doc_id: r.h for r in many.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    inside = sorted((keys[i], s) for i, s in first.items())
    assert [s for _, s in inside] == sorted(s for _, s in inside)
    real = sharding.quantiles
    monkeypatch.setattr(sharding, "quantiles", lambda k, n: real(k, n)[::7])
    assert any(first[i] != s for i, s in shards().items())


def test_packing(docs):
    rows = packing.pack(docs, capacity=500, per_source=2, group_rows=64).collect()
    size = {i: len(brute.WORD.findall(t or "")) for i, t in DOCS}
    words, bins = Counter(), defaultdict(list)
    for r in rows:
        words[r.doc_id] += r.words
        if r.bin is not None:
            bins[r.bin].append(r)
    assert words == Counter(size) and {r.doc_id for r in rows} == set(size)
    for b in bins.values():
        b.sort(key=lambda r: r.start)
        assert [r.start for r in b] == list(np.cumsum([0] + [r.words for r in b])[:-1]) and sum(r.words for r in b) <= 500
        if b[0].words < 500:
            assert max(Counter(SOURCES[r.doc_id % 7] for r in b).values()) <= 2
            assert max(Counter(dict(DOCS)[r.doc_id] for r in b).values()) == 1


def test_packing_groups_do_not_depend_on_files(spark, docs):
    """Bins are the same however the table is dealt, with string ids, null ids and repeated rows; clusters may be given."""
    odd = docs.select(F.when(F.col("doc_id") % 5 > 0, F.col("doc_id").cast("string")).alias("doc_id"), "text", "source").union(docs.where("doc_id < 20").select(F.lit(""), "text", "source"))
    pieces = lambda df, **k: sorted(map(str, packing.pack(df, capacity=300, group_rows=50, **k).collect()))
    assert pieces(odd) == pieces(odd.repartition(5))
    # One group costs no more than a few bins.
    one, many = (packing.fill(packing.pack(docs, capacity=300, group_rows=n), 300).first() for n in (10**6, 50))
    assert one.words == many.words and one.bins <= many.bins < 1.1 * one.bins and 0 < many.fill <= 1
    given = docs.where("doc_id < 12").withColumn("class", F.when(F.col("doc_id") < 8, F.lit("one")))
    bins = defaultdict(list)
    for r in packing.pack(given, capacity=4096, cluster="class").collect():
        bins[r.bin].append(r.doc_id)
    assert all(sum(i < 8 for i in b) <= 1 for b in bins.values()) and any(sum(i >= 8 for i in b) > 1 for b in bins.values())


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(2)
    items = [(int(rng.integers(1, 60)), int(rng.integers(0, 3)), int(rng.integers(0, 40))) for _ in range(400)]
    room, inside, want = [], [], []
    for size, source, cluster in items:
        fits = [(room[b], b) for b in range(len(room)) if room[b] >= size and sum(s == source for s, _ in inside[b]) < 2 and all(c != cluster for _, c in inside[b])]
        b = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(100)
            inside.append([])
        want.append((b, 100 - room[b]))
        room[b] -= size
        inside[b].append((source, cluster))
    assert packing.best_fit(items, 100, 2) == want


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.1, 0.2, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 3])], 1))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [1.0, None] * 8, 1), (404, [], 1), (405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1), (407, rows[0][1], 1), (408, rows[0][1], 1)]
    good = [(i, np.array(v, float)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(i, j) for a, (i, x) in enumerate(good) for j, y in good[a + 1 :] if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95]
    n = Counter(k for p in links for k in p)
    least = brute.groups([r[0] for r in rows], links)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    for block in (1024, 8):
        found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.vector_links(table, block).collect()}
        assert found == {i: (n[i], least[i], least[i] == i) for i, *_ in rows}


def test_token_counts(spark):
    coder, _ = tokens.encoding(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    texts = ["one\n\n\n\n  two\nthree", "", None, "über 𝒳𝒴 日本\nx\n", "\n\n\n", "no line end", "long " * 5000]
    for rule in ("first", "last", "most"):
        rows = defaultdict(list)
        for r in tokens.section_tokens(frame(spark, list(enumerate(texts))), rule).collect():
            rows[r.doc_id].append(r)
        for i, t in enumerate(texts):
            got, ids = sorted(rows[i], key=lambda r: r.section), coder.encode_ordinary(t or "")
            parts = (t or "").splitlines(keepends=True) or [""]
            assert [(t or "")[r.start : r.end] for r in got] == parts and sum(r.n_tokens for r in got) == len(ids)
            if t:
                begin, want, at = [r.start for r in got], Counter(), 0
                # The character of each byte: a token may begin or end inside one.
                char = [c for c, x in enumerate(t) for _ in x.encode()]
                for token in ids:
                    n = len(coder.decode_single_token_bytes(token))
                    span = range(char[at], char[at + n - 1] + 1)
                    at += n
                    where = [max(k for k, s in enumerate(begin) if s <= c) for c in span]
                    want[{"first": where[0], "last": where[-1], "most": Counter(where).most_common(1)[0][0]}[rule]] += 1
                assert [r.n_tokens for r in got] == [want[k] for k in range(len(got))]
        assert rows[0][0].n_crossing + sum(r.n_crossing for r in rows[4]) > 0


def test_token_counts_of_given_sections(spark):
    coder, _ = tokens.encoding(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    text = "title one\nand a body 日本語 that goes on"
    rows = [(1, text, [(10, 18), (0, 5), (4, 9)]), (2, None, [(0, 3)]), (3, "plain", None), (4, "abc def", [(0, 7)]), (5, "abc", [None, (0, None), (2, 90)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s array<struct<start:int,end:int>>")
    found = defaultdict(dict)
    for r in tokens.section_tokens(docs, sections="s").collect():
        found[r.doc_id][r.section] = (r.start, r.end, r.n_tokens)
    assert {k: v[:2] for k, v in found[1].items()} == {0: (0, 5), 1: (5, 9), 2: (10, 18), None: (0, len(text))}
    assert sum(v[2] for v in found[1].values()) == len(coder.encode_ordinary(text))
    assert found[2] == {0: (0, 0, 0)} and found[3] == {None: (0, 5, 1)} and found[4] == {0: (0, 7, 2)} and found[5] == {0: (2, 3, 0), None: (0, 3, 1)}
    fields = tokens.with_fields(spark.createDataFrame([(1, "über", None, "x y")], "doc_id long, a string, b string, c string"), ["a", "b", "c"])
    assert fields.first().text == "über\n\nx y" and [tuple(x) for x in fields.first().sections] == [(0, 4), (5, 5), (6, 9)]


def test_token_counts_of_long_white_space():
    """Runs that the encoder can't take are encoded as whole-document encoding has them, which short ones show."""
    import random
    import re

    coder, sizes = tokens.encoding(path := f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    for t in (" " * 10**6, "\n" * 10**6, "x" + "\t \u3000" * 400_000 + "y", "a" * 10**6, "日" * 10**6, "#" * 10**6):
        ids = tokens.encode(coder, t)
        assert b"".join(coder.decode_single_token_bytes(x) for x in ids) == t.encode()
        assert tokens.attribute(t, path)["n_tokens"].sum() == len(ids)
    r, gap = random.Random(4), tokens.GAP
    try:
        tokens.GAP = re.compile(f"[{tokens.BLANK}]{{3,}}")
        for _ in range(2000):
            t = "".join(r.choice(["a", "b1", " ", "  ", "\n", "\t", "\x85", "\x1c", "'s", "é", "日", "!", "\r\n"]) for _ in range(r.randrange(40)))
            assert tokens.encode(coder, t) == coder.encode_ordinary(t)
    finally:
        tokens.GAP = gap


def test_license_scan(spark):
    t = licenses.TEMPLATES
    cut = t["MIT"].replace("free of charge, ", "").replace("merge, ", "fuse, ")
    texts = ["Über alles.\n" + t["MIT-line"] + " more text", "noise " * 50 + t["Apache-2.0"].upper() + " noise" * 50, "We follow this: " + cut, "the software and the license of a version", None, "", t["GPL-3.0-line"] + " " + t["GPL-3.0-line"]]
    found = defaultdict(list)
    for r in licenses.license_matches(frame(spark, list(enumerate(texts)))).collect():
        found[r.doc_id].append(r)
    assert [r.license for r in found[0]] == ["MIT-line"] and texts[0][found[0][0].start : found[0][0].end] == "Released under the MIT License"
    assert [(r.license, r.coverage) for r in found[1]] == [("Apache-2.0", 1.0)]
    assert [r.license for r in found[2]] == ["MIT"] and 0.9 < found[2][0].coverage < 1 and found[2][0].start == len("We follow this: ")
    assert not found[3] and not found[4] and not found[5] and len(found[6]) == 2


def test_banded_alignment_equals_brute_force():
    """Parts with words changed, left out and put in, at both ends of the text and in the middle, on diagonals that are off."""
    rng = np.random.default_rng(8)
    for _ in range(40):
        parts = sorted((rng.integers(1, 9, rng.integers(1, 60)) for _ in range(5)), key=len, reverse=True)
        text = []
        for p in parts[: rng.integers(1, 5)]:
            for w in p:
                roll = rng.random()
                text += [w] if roll < 0.8 else [9] if roll < 0.86 else [w, 10] if roll < 0.93 else []
            text += list(rng.integers(20, 29, rng.integers(0, 6)))
        text = np.array(text, np.uint64)
        flat, size = np.concatenate(parts).astype(np.uint64), np.array([len(p) for p in parts])
        diagonal = rng.integers(-20, len(text) + 1, len(parts))
        got = licenses.align(text, (flat, np.cumsum(size) - size, size), diagonal)
        for k, p in enumerate(parts):
            assert tuple(int(g[k]) for g in got) == brute.banded(text.tolist(), p.tolist(), int(diagonal[k]), licenses.BAND)


def test_license_bodies_and_parts(spark):
    """Whole texts, bodies without their first paragraph, and notices cut in half."""
    t = licenses.all_templates()
    words = lambda name, a, b: " ".join(t[name].split()[a:b])
    noise = "some other words that stand here "
    cases = {
        "Apache-2.0-text": (words("Apache-2.0-text", 300, 900), 0.3, 0.5),
        "GPL-3.0-text": (t["GPL-3.0-text"], 1, 1),
        "GPL-2.0-text": (words("GPL-2.0-text", 1000, 1500), 0.1, 0.3),
        "BSD-3-Clause-text": (t["BSD-3-Clause-text"], 1, 1),
        "MIT-text": (words("MIT-text", 80, 166), 0.4, 0.6),
        "ISC-text": (t["ISC-text"], 1, 1),
        "Unlicense-text": (t["Unlicense-text"], 1, 1),
        "CC0-1.0-text": (t["CC0-1.0-text"], 1, 1),
        "EPL-1.0-text": (words("EPL-1.0-text", 500, 900), 0.2, 0.3),
        "GPL-3.0": (words("GPL-3.0", 0, 25), 0.5, 0.7),
        "GPL-3.0-line": ("this work is licensed under the GNU General", 0.6, 0.7),
        "GPL-3.0-short": ("licensed under the GNU General Public License v3", 1, 1),
        "Apache-2.0-line": (t["Apache-2.0-line"] + " the", 1, 1),
    }
    found = defaultdict(list)
    for r in licenses.license_matches(frame(spark, [(i, noise + x + "\n" + noise) for i, (x, _, _) in enumerate(cases.values())])).collect():
        found[r.doc_id].append(r)
    for i, (name, (x, low, high)) in enumerate(cases.items()):
        assert [r.license for r in found[i]] == [name], (name, found[i])
        assert low <= found[i][0].coverage <= high and found[i][0].end - found[i][0].start >= 0.9 * len(x.rstrip(" the")) - 20


def test_pipeline(spark, sf):
    """Each stage against brute force over all that the stage before kept."""
    import corpus_pipeline as p

    docs, steps = spark.read.parquet(f"{sf}/documents.parquet"), []
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    verdict = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, labels).collect()}
    for i, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf)
        rows = out.collect()
        if i < len(p.STAGES) - 1:
            assert out.columns == docs.columns
        steps.append((docs.collect(), rows))
        docs = spark.createDataFrame(rows, out.schema)
    (raw, good), (_, unique), (_, clean), (_, mixed), (_, packed) = steps
    # Quality rules: the base rule as defined, and the verdict of the query.
    assert sorted(good) == sorted(r for r in raw if verdict[r.doc_id]) and len(good) < len(raw)
    assert not any(brute.quality(r.text)[-1] for r in good)
    # Near-duplicates: the smallest id of each group of all pairs.
    group = brute.near([(r.doc_id, r.text) for r in good])
    assert sorted(unique) == sorted(r for r in good if group[r.doc_id] == r.doc_id) and len(unique) < len(good)
    # Personal data: no base span is left where one was, other texts and columns stay.
    was = {r.doc_id: r for r in unique}
    assert {r.doc_id for r in clean} == set(was)
    for r in clean:
        assert not brute.base_spans(r.text) and (r.lang, r.source) == (was[r.doc_id].lang, was[r.doc_id].source)
        kinds = {k.upper() for k, *_ in brute.base_spans(was[r.doc_id].text)}
        assert r.text != was[r.doc_id].text if kinds else True
        assert "<" in r.text or r.text == was[r.doc_id].text
    # Mixing: rows are those of the stage before, none more than twice, and sources come near their targets.
    size, copies = {r.doc_id: len(brute.WORD.findall(r.text or "")) for r in clean}, Counter(r.doc_id for r in mixed)
    assert set(mixed) <= set(clean) and max(copies.values()) <= 2
    total, taken, largest = Counter(), Counter(), Counter()
    for r in clean:
        total[r.source] += size[r.doc_id]
        taken[r.source] += size[r.doc_id] * copies[r.doc_id]
        largest[r.source] = max(largest[r.source], size[r.doc_id])
    goal = brute.targets(total)
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in total)
    # Packing: all words of all rows, gapless in bins that hold no more than they can.
    words, bins = Counter(), defaultdict(list)
    for r in packed:
        words[r.doc_id] += r.words
        if r.bin is not None:
            bins[r.bin].append(r)
    assert words == Counter({i: size[i] * n for i, n in copies.items()})
    for b in bins.values():
        b.sort(key=lambda r: r.start)
        assert [r.start for r in b] == list(np.cumsum([0] + [r.words for r in b])[:-1]) and sum(r.words for r in b) <= packing.CAPACITY
        assert len(b) == 1 or max(Counter(r.doc_id for r in b).values()) == 1


def test_common_counts_and_blocks():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 400))).astype(np.uint64) for _ in range(40)] + [np.arange(9000, dtype=np.uint64)] * 2
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    got = minhash.common(sets)
    assert all(got[i, j] == want[i][j] for i in range(len(sets)) for j in range(len(sets)) if i != j)
    base = np.arange(100, dtype=np.uint64)
    rows = [(h, 0, 0, 10 * h + k, 10 * h + k, (base + np.uint64(5 * k)).tobytes()) for h in range(3) for k in range(6)]
    schema = pa.schema([("h", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("cid", pa.int64()), ("label", pa.int64()), ("items", pa.binary())])
    table = pa.table([list(c) for c in zip(*rows, strict=True)], schema=schema)
    found = [(r["a"], r["b"]) for b in minhash.block_links(iter(table.to_batches(max_chunksize=4))) for r in b.to_pylist()]
    assert brute.groups([r[3] for r in rows], found) == {10 * h + k: 10 * h for h in range(3) for k in range(6)}


def test_extended_components(spark):
    """Labels extended by further links are those of all links together; nodes may be new, loops and repeats stand among the links."""
    from keytide.llm.common import Scratch, components, extended

    rng = np.random.default_rng(8)
    first = [(int(a), int(b)) for a, b in rng.integers(0, 60, (30, 2))] + [(7, 7), (1, 2), (2, 1)]
    more = [(int(a), int(b)) for a, b in rng.integers(0, 90, (25, 2))] + [(80, 80), (1, 2)]
    schema, scratch = "a long, b long", Scratch(spark)
    labels = components(scratch, spark.createDataFrame(first, schema))
    found = {r.node: r.label for r in extended(scratch, labels, spark.createDataFrame(more, schema)).collect()}
    want = brute.groups(range(90), first + more)
    assert all(found.get(i, i) == want[i] for i in range(90))
    assert len(found) == len(set(found)) and {r.node: r.label for r in extended(scratch, labels, spark.createDataFrame([], schema)).collect()} == {r.node: r.label for r in labels.collect()}
