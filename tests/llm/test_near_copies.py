"""Near copies against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from canoply.llm import near_copies, simhash


def brute_shingles(t):
    words = (t or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(texts):
    """The least index of each component of Jaccard 0.8 or more."""
    sets, label = [brute_shingles(t) for t in texts], list(range(len(texts)))
    near = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 5 * len(x & y) >= 4 * len(x | y)]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = low
    return sorted(set(label))


def corpus(seed):
    """Copies with up to many changed words, a passage in many texts, a chain, and odd texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    passage, base, out = make(30), make(90), []
    for _ in range(40):
        t = make(rng.randint(1, 150))
        out.append(t)
        for _ in range(rng.randint(0, 3)):
            t = list(t)
            for _ in range(rng.randint(1, 1 + len(t) // 25)):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(t)
    for _ in range(60):
        out.append(passage + make(rng.randint(0, 25)))
        t = list(base)
        t[rng.randrange(90)] = rng.choice(words)
        out.append(t)
    for _ in range(12):  # a chain whose ends are far apart
        base = base[5:] + make(5)
        out.append(base)
    texts = [" ".join(t) for t in out] + [None, "", " \n", "a b c d", "A  b c d", "a b c d e f g h", "a b c d e f g h i"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(2))
def test_keep_one_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 100)
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in simhash.keep_one(df).collect())
    assert got == brute_kept(texts) and len(got) < len(texts) - 60


def test_keep_one_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [rows[i][0] for i in brute_kept([t for _, t in rows])]


def test_no_similar_pair_is_ruled_out():
    rng = np.random.default_rng(0)
    often = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    for n in (4, 5, 9, 10, 45, 400):
        for _ in range(40):
            x = np.unique(np.r_[rng.choice(often, n // 3), rng.integers(0, 2**63, n, dtype=np.uint64)])
            y = np.unique(np.r_[rng.permutation(x)[rng.integers(0, len(x) // 5 + 1) :], rng.integers(0, 2**63, rng.integers(0, len(x) // 5 + 1), dtype=np.uint64)])
            if near_copies.similar(x, y):
                assert set(near_copies.prefix(x, often, np.arange(len(often)) + 1)) & set(near_copies.prefix(y, often, np.arange(len(often)) + 1))
                sk = np.frombuffer(near_copies.sketch(x) + near_copies.sketch(y), np.uint64).reshape(2, -1)
                assert near_copies.passing(np.array([len(x), len(y)]), sk, np.array([0]), np.array([1])).all()
                assert near_copies.may_be_similar(near_copies.wide_sketch(x), near_copies.wide_sketch(y), len(x) + len(y))
