"""Operators against plain versions in Python, and columns whose names clash in every table."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_llm import brute_pack, brute_repeats, empty, odd  # noqa: F401
from test_near_copies import brute_kept

import corpus_pipeline
from canoply.llm import mixing, packing, quality_classifier, queries, quality_rules, store, token_files, warc


def plain_scores(docs, labels):
    """The classifier in plain numpy: doubles instead of fixed point, all rows at once."""
    crc = lambda i: zlib.crc32(str(i).encode())
    marks = collections.defaultdict(list)
    for i, q in labels:
        if i is not None and q is not None:
            marks[i].append(q)
    stats = np.array([quality_classifier.statistics(t) for _, t in docs])
    rows = [(k, np.mean(marks[i]), crc(i) // 4 % 4 == 0) for k, (i, _) in enumerate(docs) if i in marks and crc(i) % 4 != 2]
    at, y, fold = (np.array(c) for c in zip(*rows))
    x = stats[at]
    mean = x.mean(axis=0)
    scale = np.sqrt(np.maximum((x * x).mean(axis=0) - mean**2, 1e-4))
    n = quality_classifier.FEATURES
    rng = np.random.default_rng(quality_classifier.SEED)
    w = rng.standard_normal((x.shape[1], n)) / np.sqrt(x.shape[1])
    phase = rng.uniform(0, 2 * np.pi, n)
    z = lambda s: np.hstack([np.cos(np.clip((s - mean) / scale, -6, 6) @ w + phase), np.ones((len(s), 1))])
    a, b = z(x[~fold]), y[~fold]
    ridge = quality_classifier.RIDGE * len(b) * np.eye(n + 1)
    ridge[-1, -1] = 0
    beta = np.linalg.solve(a.T @ a + ridge, a.T @ b)
    raw = z(x[fold]) @ beta
    order = np.argsort(raw, kind="stable")
    px, py = quality_classifier.isotonic(raw[order], y[fold][order].astype(float), np.ones(len(order)))
    return np.interp(z(stats) @ beta, px, py)


@pytest.mark.parametrize("parts", [1, 7])
def test_classifier_equals_plain_numpy(spark, data, parts):
    """Fixed point and bins move scores a little, and the more where isotonic steps are steep."""
    folder = f"{data}/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    stats = store.save(quality_classifier.with_statistics(docs.repartition(parts)), "test")
    got = {r.doc_id: r.score for r in quality_classifier.score(stats, quality_classifier.fit(stats, labels)).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_scores(rows, [tuple(r) for r in labels.collect()])
    gap = np.abs(np.array([got[i] for i, _ in rows]) - want)
    assert np.median(gap) < 0.01 and (gap < 0.1).mean() > 0.97
    assert ((np.array([got[i] for i, _ in rows]) >= quality_classifier.CUT) == (want >= quality_classifier.CUT)).mean() > 0.98


def test_scores_do_not_depend_on_partitions(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{data}/sf0.001/labels.parquet")
    found = []
    for parts in (1, 5):
        stats = store.save(quality_classifier.with_statistics(docs.repartition(parts)), "test")
        found.append({r.doc_id: r.score for r in quality_classifier.score(stats, quality_classifier.fit(stats, labels)).collect()})
    assert found[0] == pytest.approx(found[1], abs=1e-6)


@pytest.mark.parametrize("copies", [100, 1000])
def test_part_of_tied_rows_is_taken(spark, copies):
    rows = [(None, "one two three four five", "c")] * copies + [(i, "a b c", "a") for i in range(400)] + [(1000 + i, "x y " * (i % 9), "b") for i in range(300)]
    docs = store.save(mixing.keyed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)), "test")
    for _ in range(2):
        cut = mixing.cuts(docs)
        by = mixing.mix(docs, cut).groupBy("source").agg(F.sum(F.col("_mix_copies") * F.col("_mix_size")).alias("taken"), F.first("_mix_target").alias("target"), F.max("_mix_size").alias("m")).collect()
        assert all(abs(r.taken - r.target) <= r.m / 2 + 1 for r in by) and len(by) == 3


def plain_mix(rows):
    """How often each of (doc_id, source, text) is taken, straight from the definition."""
    import hashlib
    import math
    import re

    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    symbols = [len(re.findall(r"[#*$%&|<>]", t or "")) for _, _, t in rows]
    key = []
    for (i, _, _), n, s in zip(rows, size, symbols, strict=True):
        u = (int(hashlib.md5(f"mix-1|{'null' if i is None else i}|{n}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        key.append(-math.log(u) / (n / (n + s) if n else 1.0))
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    own = {s: sum(n for n, r in zip(size, rows, strict=True) if r[1] == s) for s in sources}
    target, open_, left = {}, set(sources), 1.5 * sum(own.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * own[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * own[s]
            left -= target[s]
        open_ -= over
    target |= share
    taken = [0] * len(rows)
    for s in sources:
        at = sorted((k for k, r in enumerate(rows) if r[1] == s), key=lambda k: (key[k], str(rows[k][0]) if rows[k][0] is not None else "", size[k]))
        epochs = int(target[s] // own[s]) if own[s] else 1
        rest, before = target[s] - epochs * own[s], 0
        for k in at:
            taken[k] = epochs + (rest > 0 and before + size[k] / 2 <= rest)
            before += size[k]
    return size, taken


def test_pipeline_equals_plain_stages(spark, data):
    """run()'s rows against plain versions of every stage after the classifier, whose plain version is above."""
    folder = f"{data}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = sorted((r.doc_id, r.source, r.text) for r in stages["quality_classifier"](spark, docs, folder).collect())
    rows = [rows[k] for k in brute_kept([t for _, _, t in rows])]
    cut = brute_cut([t.encode() for _, _, t in rows])
    rows = [(i, s, t) for (i, s, _), t in zip(rows, cut, strict=True)]
    size, taken = plain_mix(rows)
    mixed = [r for r, n in zip(rows, taken, strict=True) for _ in range(n)]
    code = token_files.encoder(token_files.TOKENIZER)
    want = collections.Counter()
    for i, _, t in mixed:
        n = len(code.whole(t)) // code.kind.itemsize + 1
        for k in range(-(-n // packing.CAPACITY)):
            want[i, k, min(n - k * packing.CAPACITY, packing.CAPACITY)] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter((r.doc_id, r.piece, r.n_tokens) for r in got) == want
    # one shard: the bins are those of a plain best fit
    source = {i: s for i, s, _ in rows}
    words = {i: tuple(t.lower().split()) for i, _, t in rows}
    number = {w: k for k, w in enumerate(dict.fromkeys(words.values()))}
    pieces = sorted(((-n, i, k) for (i, k, n), times in want.items() for _ in range(times)))
    plain = brute_pack([(-n, source[i], number[words[i]] if words[i] else -1) for n, i, _ in pieces], packing.CAPACITY)
    used = collections.Counter()
    for r in got:
        used[r.bin_id] += r.n_tokens
    assert abs(len(used) - len(plain)) <= 2 and sum(used.values()) == len(plain) * packing.CAPACITY - sum(plain)


def brute_cut(texts, length=200):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        keep, at = b"", 0
        for i, j in edges.reshape(-1, 2).tolist():
            keep, at = keep + t[at:i], j
        out.append((keep + t[at:]).decode("utf-8", "ignore"))
    return out


def test_fill_is_near_that_of_one_shard(spark, data):
    docs = packing.measured(spark.read.parquet(f"{data}/sf0.01/documents.parquet"))
    whole, dealt = (packing.pack(docs, shard=n).agg(F.countDistinct("bin_id"), F.sum("n_tokens")).first() for n in (10**9, 250))
    assert whole[1] == dealt[1] and whole[0] >= 0.95 * dealt[0]


def test_sequences_hold_the_ids(spark, odd):  # noqa: F811
    docs = packing.measured(spark.read.parquet(f"{odd}/documents.parquet"))
    packed = store.save(packing.pack(docs, 300, shard=40), "test")
    ids = {r.row: np.frombuffer(bytes(r.ids), "<u2").tolist() for r in docs.collect()}
    bins = {r.bin_id: r for r in packing.sequences(packed, docs, 300).collect()}
    rows = packed.collect()
    assert {r.bin_id for r in rows} == set(bins) and sum(len(b.ids) for b in bins.values()) == sum(map(len, ids.values()))
    for r in rows:
        b = bins[r.bin_id]
        assert len(b.ids) <= 300 and b.ids[r.bin_start : r.bin_start + r.n_tokens] == ids[r.row][300 * r.piece : 300 * r.piece + r.n_tokens]
        assert (r.bin_start, r.doc_id) in set(zip(b.starts, b.doc_ids, strict=True))


def test_pack_repeated_rows_and_other_ids(spark):
    rows = [("id", "s", "tree crown")] * 500 + [(None, None, None)] * 3
    docs = packing.measured(spark.createDataFrame(rows, "doc_id string, source string, text string"))
    got = packing.pack(docs, 50, shard=40).collect()
    assert len(got) == 503 and max(collections.Counter(r.bin_id >> 32 for r in got).values()) < 80


CLASHES = ("_w", "_l", "_upper", "_stats", "_copy", "_mix_size", "_mix_key", "_mix_row", "_mix_copies", "_set", "_n", "_fp", "_rid", "_value", "_sketch", "_posts", "component", "row", "piece", "cluster", "ids", "cid", "docs", "part", "g", "kept", "score", "n_removed", "_col0", "_payload", "_digest", "_refers", "_first", "_label", "vector", "count", "n_copies", "node", "tampered", "w", "_at", "_key", "n_words", "hits", "id", "word")


@pytest.fixture(scope="module")
def clashing(spark, odd, tmp_path_factory):  # noqa: F811
    """The odd tables with further columns under the operators' working names."""
    base = tmp_path_factory.mktemp("clash")
    for name in ("documents", "labels", "embeddings", "pages", "conversations", "benchmark"):
        t = pq.read_table(f"{odd}/{name}.parquet")
        for k, c in enumerate(CLASHES):
            if c not in t.column_names:
                t = t.append_column(c, [[(None, "x", "y")[(i + k) % 3] for i in range(t.num_rows)]])
        pq.write_table(t, base / f"{name}.parquet")
    return str(base)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_clashing_columns_change_nothing(spark, odd, clashing, name):  # noqa: F811
    if name in ("op2_packing", "op3_quality_classifier"):  # ids of rows and shards may differ: compare what counts
        pick = {"op2_packing": ["doc_id", "piece", "n_tokens"], "op3_quality_classifier": ["doc_id", "held_out", "predicted"]}[name]
    else:
        pick = None
    found = []
    for folder in (odd, clashing):
        df = queries.QUERIES[name](spark, folder)
        found.append(sorted(map(repr, (df.select(*pick) if pick else df).collect())))
    assert found[0] == found[1]


def test_stages_keep_clashing_columns(spark, clashing, empty):  # noqa: F811
    docs = every = spark.read.parquet(f"{clashing}/documents.parquet")
    names, kinds = docs.columns, docs.dtypes
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = store.save(stage(spark, docs if k != 1 else every, clashing), "test")  # the labels there teach to reject all
        assert k == len(corpus_pipeline.STAGES) - 1 or (docs.columns == names and docs.dtypes == kinds)
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0
    judged = quality_rules.judge(spark.read.parquet(f"{clashing}/documents.parquet"))
    assert set(names) <= set(judged.columns) and judged.count() > 0


def test_lengths_beyond_reason():
    """Numbers that no integer parser takes are faults of a record, never of the reader."""
    head = "WARC/1.0\r\nWARC-Type: {}\r\nContent-Type: application/http\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    good = head.format("response", 3, "abc").encode()
    got = list(warc.salvage(head.format("response", "9" * 5000, "abc").encode() + good))
    assert [x[0] for x in got] == ["gap", "record"] and got[0][3] == "bad content length"
    block = f"HTTP/1.1 200 OK\r\nContent-Length: {'9' * 5000}\r\n\r\n"
    (one,) = warc.salvage(head.format("revisit", len(block), block).encode())
    assert one[0] == "record" and warc.payload_of(*one[3:]) == (b"", 0)


def test_files_are_bounded_by_bytes(spark, compare, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"u{i}", rng.choice("ab") * rng.choice([0, 5, 900, 1100, 9000, 80_000])) for i in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"file://{tmp_path}/pages.parquet")
    pages = spark.read.parquet(f"file://{tmp_path}/pages.parquet")
    warc.write(pages, f"file://{tmp_path}/w", records_a_file=64, small=1000)
    files = [f.stat().st_size for f in (tmp_path / "w").glob("part*")]
    assert max(files) <= 64 * (1000 + 800) + 80_000
    assert sorted(r.record_id for r in warc.read(spark, f"file://{tmp_path}/w").where("kind = 'record'").collect()) == sorted(f"<urn:page:{i}>" for i, _, _ in rows)
