"""Bins of op2_packing keep the conflicts of source and cluster."""

from __future__ import annotations

import random

from canoply.llm import packing


def test_bins_keep_conflicts(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    rows = [(i, f"s{rng.randrange(6)}" if i % 7 else None, rng.choice(texts)) for i in range(160)]
    docs = packing.measured(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    known = {r.doc_id: r for r in docs.collect()}
    got = packing.pack(docs, 60, shard=60).collect()
    assert sorted(r.doc_id for r in got) == list(range(160)) and len({r.bin_id for r in got}) < 160
    for kind in ("source", "cluster"):
        seen = [(r.bin_id, known[r.doc_id][kind]) for r in got]
        assert len(seen) == len(set(seen))
