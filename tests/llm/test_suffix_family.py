"""Batches of a family against brute force over all that came before, common anchors, and collisions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_llm import brute_repeats

from canoply.llm import store, suffix_dedup

COLUMNS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def corpus(seed, n):
    rng = random.Random(seed)
    shared = "".join(random.Random(1).choice("abcdefgh éñ") for _ in range(300))
    out = []
    for _ in range(n):
        t = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 120)))
        for _ in range(rng.randint(0, 2)):
            i = rng.randint(0, 280)
            t += shared[i : i + rng.randint(5, 90)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 20)))
        out.append(t)
    return out


def test_family_over_sessions(spark):
    path, before, levels = store.new_path(spark, "family"), [], []
    batches = [corpus(k, 25) for k in range(4)] + [[], corpus(2, 25)[:9]]
    for texts in batches:
        family = suffix_dedup.Family(spark, path, 20, 8, base=40, bits=3)  # nothing is kept but what lies under path
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in family.add(docs, chunk_bytes=500).collect()}
        ours = brute_repeats_of(before, texts)
        assert [got[i] for i in range(len(texts))] == ours
        before += texts
        levels.append(sorted(x[0] for x in family._named()["levels"]))
    assert all(len(set(x)) == len(x) for x in levels) and max(map(len, levels)) > 1 and max(map(max, levels)) > min(map(max, levels))


def brute_repeats_of(before, texts):
    """Of texts only, in their order; what counts as a repeat comes from all."""
    every = [t.encode() for t in before + texts]
    return [brute_one(every, len(before) + i, 20) for i in range(len(texts))]


def brute_one(every, at, length):
    import collections
    import hashlib

    count = collections.Counter(t[i : i + length] for t in every for i in range(len(t) - length + 1))
    t = every[at]
    gone = np.zeros(len(t), bool)
    for i in range(len(t) - length + 1):
        if count[t[i : i + length]] > 1:
            gone[i : i + length] = True
    return (len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())


@pytest.mark.parametrize("hot", [2, 10**9])
def test_common_anchors(spark, hot, monkeypatch):
    """A passage shorter than a match in every document: its anchor is common, and its windows go by their own hashes."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh") for _ in range(18))
    texts = []
    for i in range(150):
        head, tail = ("".join(rng.choice("xyz") for _ in range(n)) for n in (12, 12))
        texts.append(head + passage + tail)
        if i % 5 == 0:
            texts.append("q" + head[-6:] + passage + tail[:3] + "w" * (i % 3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    suffix_dedup._roller.clear()
    got = sorted(tuple(r) for r in suffix_dedup.dedup(docs, 24, 8, chunk_bytes=700).select(*COLUMNS).collect())
    assert got == brute_repeats([t.encode() for t in texts], 24)
    chunks = suffix_dedup.chunks(docs, 700)
    found = suffix_dedup.common(chunks, chunks.count(), 24, 8)
    assert (len(found) > 0) == (hot == 2)
    index = suffix_dedup._index(chunks, found, 4, 24, 8).toPandas()
    own = index[index.g < suffix_dedup._WINDOWS].groupby("g").data.apply(lambda x: sum(map(len, x)))
    assert hot > 2 or own.max() < 0.5 * own.sum()


def test_collisions_are_told_apart():
    text = np.frombuffer(b"abcdefghijabcdefghijabXdefghij", np.uint8)
    at, keys = np.array([0, 10, 20]), np.array([5, 5, 5], np.uint64)
    assert suffix_dedup.confirmed(text, at, keys, np.ones(3, bool), 10).tolist() == [True, True, False]
    assert suffix_dedup.confirmed(text, at[:2], keys[:2], np.ones(2, bool), 10).tolist() == [True, True]
