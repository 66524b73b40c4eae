"""Operators for corpora: brute force, SQL, and every defined odd case on small tables."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from test_near_copies import brute_kept
from canoply.llm import chat, embedding_dedup, mixing, packing, quality_classifier, queries, quality_rules, simhash, store, suffix_dedup, token_files, warc

WORDS = "the of and le la der die el los tree crown height canopy window forest smooth raster seed edge ring hole band cell".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Tables with nulls in every column, empty and long texts, ties, repeated rows and further columns."""
    rng, base = random.Random(5), tmp_path_factory.mktemp("odd")
    long = text(rng, 30_000)
    docs = [(i, text(rng, rng.randint(1, 120)), f"s{i % 4}") for i in range(60)]
    docs += [(60, None, "s1"), (61, "", "s2"), (62, " \n\t ", None), (None, "a b c", "s1"), (64, long, None), (65, long, "s0"), (3, docs[3][1], "s3"), (3, docs[3][1], "s3"), (66, docs[5][1].upper() + " end", "ß"), (67, "one\none\none\ntwo", "s1")]
    docs += [(68, "é日本 <|endoftext|> x  y\n\nz's 12 ", "s1"), (69, "# % $ | <> &", "s2"), (70, "x\x0by\x0cz\r\nw\xa0v", "s2")]
    cols = {"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs], "source": [d[2] for d in docs], "lang": [None] * len(docs), "n_chars": [None if d[1] is None else len(d[1]) for d in docs]}
    more = {"_fp": [1] * len(docs), "n_bytes": ["x"] * len(docs), "score": [0.5] * len(docs), "size": [None] * len(docs)}
    kinds = {"doc_id": pa.int64(), "lang": pa.string(), "n_chars": pa.int64(), "size": pa.int32()}
    pq.write_table(pa.table({k: pa.array(v, kinds.get(k)) for k, v in (cols | more).items()}), base / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([*range(50), None, 1, 2], pa.int64()), "quality": pa.array([i % 2 for i in range(50)] + [1, 0, None], pa.int32()), "toxic": pa.array([0] * 53, pa.int32())}), base / "labels.parquet")
    vecs = [[1.0, 0.0], [2.0, 0.0], [1.0, 0.05], [0.0, 1.0], None, [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [], [1.0], [-0.0, 1.0], [1.0, 0.0], [float("inf"), 0.0], [1e38, 1e38], [1.0, 1.0]]
    rows = [(i if (i, label) != (3, 1) else None, v, label) for label in (0, 1, None) for i, v in enumerate(vecs)]
    rows = [(None if i is None else i + 100 * (label or 0) + (1000 if label is None else 0), v, label) for i, v, label in rows]
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())}), base / "embeddings.parquet")
    pages = [(1, "u", "abc"), (2, None, "abc"), (3, "x\r\ny", None), (4, "z", ""), (5, "é", "日本\r\n\r\nWARC/1.0\r\nx"), (6, "q", "abc"), (7, "r", "long" * 20_000), (8, None, "long" * 20_000)]
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": [p[1] for p in pages], "html": [p[2] for p in pages]}), base / "pages.parquet")
    items = [(1, " ".join(docs[5][1].split()[3:16])), (1, "other words that are nowhere"), (2, None), (3, ""), (4, "!"), (None, "Tree  CROWN"), (5, "ring"), (6, text(rng, 9)), (7, docs[7][1]), (7, docs[7][1]), (8, long[:50_000]), (9, "ONE two")]
    pq.write_table(pa.table({"item_id": pa.array([i[0] for i in items], pa.int64()), "text": [i[1] for i in items]}), base / "benchmark.parquet")
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", "more"), (4, 2, "user", "more"), (4, 1, "bot", "yo"), (4, 0, "user", "hi"), (5, 0, None, None), (6, None, "user", "x"), (6, 0, "user", "y"), (7, 0, "user", "h"), (7, 0, "user", "h")]
    pq.write_table(pa.table({"conv_id": pa.array([t[0] for t in turns], pa.int64()), "turn": pa.array([t[1] for t in turns], pa.int64()), "role": [t[2] for t in turns], "text": [t[3] for t in turns]}), base / "conversations.parquet")
    return str(base)


@pytest.fixture(scope="module")
def empty(tmp_path_factory, odd):
    base = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "embeddings", "pages", "conversations", "benchmark"):
        pq.write_table(pq.read_table(f"{odd}/{name}.parquet").slice(0, 0), base / f"{name}.parquet")
    return str(base)


def docs_of(folder):
    t = pq.read_table(f"{folder}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


ORACLES = sorted(queries.ORACLES)


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, compare, data, name):
    folder = f"{data}/sf0.001"
    assert compare(queries.QUERIES[name](spark, folder), queries.ORACLES[name], folder)


@pytest.mark.parametrize("name", [n for n in ORACLES if n != "op5_embedding_dedup"])
def test_sql_on_odd_tables(spark, compare, odd, name):
    assert compare(queries.QUERIES[name](spark, odd), queries.ORACLES[name], odd)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in entry.queries()} and "pipeline" in entry.queries()


def test_mix_meets_targets(spark, data):
    folder = f"{data}/sf0.01"
    got = mixing.op1_mixing(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source"), "doc_id")
    by = got.groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t"), F.sum("size").alias("s"), F.max("size").alias("m"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r.k - r.t) <= r.m / 2 + 1 and r.over <= 0 and r.t <= 2 * r.s for r in by)
    assert abs(sum(r.t for r in by) - 1.5 * sum(r.s for r in by)) < 1
    again = mixing.op1_mixing(spark, folder).select("doc_id", "taken")
    assert again.exceptAll(got.select("doc_id", "taken")).count() == 0


def brute_pack(rows, capacity):
    bins, out = [], []
    for size, source, cluster in rows:
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= size and source not in b[1] and not (cluster >= 0 and cluster in b[2])]
        at = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), set()])
        bins[at][0] -= size
        bins[at][1].add(source)
        bins[at][2].add(cluster)
        out.append(at)
    return sorted(b[0] for b in bins)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit(seed):
    rng = random.Random(seed)
    rows = sorted(((rng.randint(0, 60), rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([-1, -1, 1, 2])) for _ in range(300)), reverse=True)
    bins = packing.best_fit(*map(list, zip(*rows)), 100)
    left = collections.defaultdict(lambda: 100)
    for (size, _, _), b in zip(rows, bins, strict=True):
        left[b] -= size
    assert sorted(left.values()) == brute_pack(rows, 100)


def test_bins_hold(spark, odd):
    docs = packing.measured(spark.read.parquet(f"{odd}/documents.parquet"))
    got = packing.pack(docs, 100, shard=40).toPandas()
    assert got.groupby("bin_id").n_tokens.sum().max() <= 100
    assert got.n_tokens.sum() == docs.agg(F.sum("size")).first()[0]
    assert len(got.drop_duplicates(["doc_id", "piece"])) <= len(got)
    for _, b in got.groupby("bin_id"):
        b = b.sort_values(["bin_start", "n_tokens"])
        assert (b.bin_start.values == np.r_[0, b.n_tokens.cumsum().values[:-1]]).all()


def test_isotonic():
    x, y = quality_classifier.isotonic(np.arange(6.0), np.array([0, 1, 0, 0.5, 1, 0.8]), np.ones(6))
    assert (np.diff(y) > 0).all() and y[0] == 0 and y[-1] == pytest.approx(0.9) and len(x) == len(y)


def test_classifier_on_held_out(spark, data):
    folder = f"{data}/sf0.01"
    got = quality_classifier.op3_quality_classifier(spark, folder)
    j = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert got.count() == 1000 and got.where("score < 0 or score > 1 or score is null").count() == 0
    held = j[j.held_out]
    assert set(held.doc_id) == {i for i in j.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held.predicted == held.quality).mean() > 0.95
    again = {r.doc_id: r.score for r in quality_classifier.op3_quality_classifier(spark, folder).collect()}
    assert all(again[r.doc_id] == r.score for r in got.collect())


def test_classifier_odd(spark, odd):
    got = quality_classifier.op3_quality_classifier(spark, odd).collect()
    assert len(got) == len(docs_of(odd)) and all(0 <= r.score <= 1 for r in got)
    none = spark.read.parquet(f"{odd}/labels.parquet").where("false")
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    assert quality_classifier.keep_good(docs, none).count() == docs.count()


def test_warc_salvage(spark, odd, tmp_path):
    pages = spark.read.parquet(f"{odd}/pages.parquet").where("page_id < 7").coalesce(1)
    warc.write(pages, f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("part*")
    data = file.read_bytes()
    whole = list(warc.salvage(data))
    assert [x[0] for x in whole] == ["record"] * 6 and whole[0][1] == 0 and whole[-1][2] == len(data)
    bad = bytearray(data)
    at = whole[2][1]
    bad[at + 30 : at + 33] = b"\n\nX"
    got = list(warc.salvage(bytes(bad)))
    assert [x[0] for x in got].count("record") == 5 and ("gap", at, whole[2][2]) in [x[:3] for x in got]
    cut = list(warc.salvage(data[: whole[-1][2] - 9]))
    assert cut[-1][0] == "gap" and len(cut) == 6
    zipped = [gzip.compress(data[x[1] : x[2]]) for x in whole]
    zipped[1] = zipped[1][:40] + b"????" + zipped[1][44:]
    got = list(warc.salvage(b"".join(zipped)))
    assert [x[0] for x in got].count("record") == 5 and len(zipped[1]) in [x[2] - x[1] for x in got if x[0] == "gap"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/a.warc").write_bytes(bytes(bad))
    rows = warc.read(spark, f"file://{tmp_path}/bad", payloads=True).collect()
    assert collections.Counter(r.kind for r in rows) == {"record": 5, "gap": 1}
    assert warc.digest(b"abc") == base64.b32encode(hashlib.sha1(b"abc").digest()).decode()


def test_embedding_links(spark, odd):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.op5_embedding_dedup(spark, odd).where("vec_id is not null").collect()}
    same = [0, 1, 2, 11]
    assert all(got[i][:2] == (3, 0) for i in same) and [i for i in same if got[i][2]] == [0]
    assert got[3][:2] == got[10][:2] == (1, 3) and got[13][:2] == got[14][:2] == (1, 13)
    assert got[110][:2] == (1, 110)  # its partner has no id
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 12, 1000, 1001))


@pytest.mark.parametrize("block", [16, 1000])
def test_embedding_tiles(spark, compare, tmp_path, block):
    rng, rows = np.random.default_rng(1), []
    for label in (0, 0, 1, None):
        for c in rng.normal(size=(6, 12)):
            rows += [(c * s + rng.normal(size=12) * 0.12 * j).astype("f4").tolist() for j, s in ((0, 1), (0, 1), (0, 2), (1, 1), (1, 1), (1, 3))]
    labels = np.repeat([0, 0, 1, None], 36).tolist()
    pq.write_table(pa.table({"vec_id": range(len(rows)), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}), tmp_path / "embeddings.parquet")
    compare(embedding_dedup.near_duplicates(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), block=block), embedding_dedup.OP5_SQL, tmp_path)


def test_quantisation_bound():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 24)) * 10.0 ** rng.integers(-30, 30, (200, 1))
    unit, codes, scale, norm, miss = embedding_dedup.quantised(x)
    product = (codes.astype(float) @ codes.T) * scale[:, None] * scale
    assert (np.abs(product - unit @ unit.T) <= norm[:, None] * miss + miss[:, None] * (norm + miss) + 1e-12).all()


def brute_ids(docs):
    e, out, at = token_files.encoder(token_files.TOKENIZER), [], 0
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = e.tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out, at


def test_token_files(spark, odd):
    got = token_files.op6_token_files(spark, odd).toPandas()
    want, total = brute_ids(docs_of(odd))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    ours = [(None if i != i else int(i), n, c) for i, n, c in zip(got.doc_id, got.n_tokens, got.ids_crc32, strict=True)]
    assert sorted(ours, key=key) == sorted(want, key=key)
    got = got.sort_values("start")
    assert got.start.iloc[0] == 0 and (got.start.values[1:] == np.cumsum(got.n_tokens.values)[:-1]).all()
    ids = [(-1 if i != i else int(i)) for i in got.doc_id]
    assert ids == sorted(ids)


def test_encoder_equals_library():
    e, rng = token_files.encoder(token_files.TOKENIZER), random.Random(1)
    bits = ["a", "B ", "  ", " ", "\n", "\n\n", "\t", "é", "'s ", "1", "<|endoftext|>", " ", "　", "日", "!", "\r\n", "\x1c", "​", "word ", "Foo", "bar,", "é.", "don't", "\nNew", "\x85", "\xa0"]
    for _ in range(2000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        assert e.one(t) == e.whole(t)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000)).view(np.uint64)
    h = token_files.PerfectHash.of(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    index = token_files.Index(token_files.index_bytes(3, np.r_[keys, keys[:2]], *np.arange(3 * (len(keys) + 2)).reshape(3, -1)))
    hit, shard, _, _ = index.find(np.r_[keys[5:6], keys[:1], keys[7:8] + np.uint64(1)])
    assert hit.tolist() == [0, 1, 1] and shard.tolist() == [5, 0, len(keys)]


def brute_fingerprint(t):
    words = bytes(t or "", "utf-8").lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, near):
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(values):
            for j, y in enumerate(values):
                if near(x, y) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_simhash(spark, odd, data):
    docs = docs_of(odd)
    got = simhash.op7_simhash(spark, odd).collect()
    fps = [brute_fingerprint(t) for _, t in docs]
    root = brute_components(fps, lambda x, y: (x ^ y).bit_count() <= 3)
    least = {r: min((i for (i, _), q in zip(docs, root, strict=True) if q == r and i is not None), default=None) for r in set(root)}
    want = sorted(((str(i), f"{f:016x}", least[r]) for (i, _), f, r in zip(docs, fps, root, strict=True)))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.keep_one(spark.read.parquet(f"{odd}/documents.parquet"))
    assert kept.columns == spark.read.parquet(f"{odd}/documents.parquet").columns and kept.count() == len(set(root))


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.unique([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False))) for b in base for _ in range(20)])
    d = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    assert set(zip(*(v.tolist() for v in simhash.near_pairs(x, None, radius)), strict=True)) == set(zip(*map(list, np.nonzero(np.triu(d, 1))), strict=True))
    assert set(zip(*(v.tolist() for v in simhash.near_pairs(x, x[:300], radius)), strict=True)) == set(zip(*map(list, np.nonzero(d[:, :300])), strict=True))
    for n in (10, 10**7, 10**12):
        masks = simhash.choices(n, 3)
        for _ in range(300):
            flip = sum(1 << int(k) for k in rng.choice(64, 3, replace=False))
            assert any(not flip & m for m in masks)


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 60)
    x = np.unique(np.array([sum(1 << int(k) for k in np.random.default_rng(i).choice(20, 6, replace=False)) for i in range(400)], np.int64))
    got = {r._fp: r.component for r in simhash.classes_of(spark.createDataFrame([(int(v), int(v)) for v in x], "_fp long, v long"), "v").collect()}
    root = brute_components(x.tolist(), lambda a, b: (a ^ b).bit_count() <= 3)
    assert [got[int(v)] for v in x] == [int(x[r]) for r in root]


def brute_repeats(docs, length):
    count = collections.Counter(t[i : i + length] for t in docs for i in range(len(t) - length + 1))
    out = []
    for t in docs:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "gram", "chunk"), [(20, 8, 1500), (31, 4, 1 << 20)])
def test_repeats(spark, length, gram, chunk):
    rng = random.Random(3)
    big = "".join(rng.choice("abcdefgh éñ") for _ in range(400))
    texts = []
    for _ in range(80):
        t = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 150)))
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, 380)
            t += big[i : i + rng.randint(5, 120)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30)))
        texts.append(t)
    texts += ["a" * 90, "ab" * 60, texts[3], None, "", "q" * 19, "zq" * 3 + "q" * 20 + "r" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    suffix_dedup._roller.clear()
    got = sorted(tuple(r) for r in suffix_dedup.dedup(df, length, gram, chunk_bytes=chunk).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == brute_repeats([(t or "").encode() for t in texts], length)


def test_repeats_odd(spark, odd):
    docs = [(t or "").encode() for _, t in docs_of(odd)]
    got = suffix_dedup.op10_suffix_dedup(spark, odd).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute_repeats(docs, 200)


def test_levels():
    rng, index, seen = np.random.default_rng(0), suffix_dedup.Levels(), []
    for n in (5, 4000, 1, 4000, 9000, 300):
        batch = rng.integers(0, 20_000, n).astype(np.uint64)
        index.add(batch)
        seen.append(batch)
    every = np.concatenate(seen)
    assert (index.matched == (np.bincount(every.astype(int), minlength=20_000)[every.astype(int)] > 1)).all()


def test_chat_keeps_maximal(spark, odd):
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.op8_chat(spark, odd).collect()}
    assert got == {3: (3, 2), 5: (1, 1), 6: (2, 1), 7: (2, 1)}


def test_rules_table(spark):
    docs = spark.createDataFrame([(1, "the tree of the forest and the crown " * 1 + " ".join(f"w{i}" for i in range(20))), (2, "WORD! " * 30)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert got == {1: True, 2: False}
    none = quality_rules.judge(docs, rules=(("n_words", None, 5),)).where("kept").count()
    assert none == 0


def test_pipeline_stages(spark, odd, data):
    for folder in (odd, f"{data}/sf0.001"):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        names, kinds = docs.columns, docs.dtypes
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = store.save(stage(spark, docs, folder), "test")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == names and docs.dtypes == kinds
    assert docs.count() > 0 and docs.columns == ["doc_id", "piece", "n_tokens", "bin_id", "bin_start"]


def test_pipeline_equals_brute_force(spark, data):
    """Later stages against plain versions on what the classifier keeps."""
    folder = f"{data}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = store.save(stages["quality_classifier"](spark, docs, folder), "test")
    scores = quality_classifier.op3_quality_classifier(spark, folder).where("predicted = 1")
    assert sorted(r[0] for r in good.select("doc_id").collect()) == sorted(r[0] for r in scores.select("doc_id").collect())
    rows = [(r.doc_id, r.text) for r in good.orderBy("doc_id").collect()]
    unique = store.save(stages["simhash"](spark, good, folder), "test")
    assert sorted(r[0] for r in unique.select("doc_id").collect()) == sorted(rows[i][0] for i in brute_kept([t for _, t in rows]))
    clean = store.save(stages["suffix_dedup"](spark, unique, folder), "test")
    kept = sorted(len((r[0] or "").encode()) for r in unique.select("text").collect())
    gone = brute_repeats([(r[0] or "").encode() for r in unique.select("text").collect()], 200)
    assert clean.count() == unique.count() and kept == sorted(x[0] for x in gone)
    left = clean.agg(F.sum(F.octet_length("text"))).first()[0]
    assert 0 <= sum(x[0] - x[1] for x in gone) - left <= 4 * sum(x[2] for x in gone)
