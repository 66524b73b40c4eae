"""Keyed access to token shards, and shards of a hot id."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from canoply.llm import store, token_files


def test_keyed_reader(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 7, *range(100, 400)]), " ".join(rng.choice(["tree", "crown", "Höhe", "x  y", "12"]) for _ in range(rng.randint(0, 60)))) for _ in range(500)]
    rows += [(7, "hot " * i) for i in range(300)]
    rows.append((None, "none"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path, index = store.new_path(spark, "ids"), store.new_path(spark, "index")
    tasks = token_files.write(docs, path, shard_ids=1500, task_bytes=20_000)
    read = token_files.read(spark, path).toPandas()
    assert tasks > 3 and read.shard.nunique() > tasks
    hot = read[read.doc_id == 7]
    assert len(hot) == sum(i == 7 for i, _ in rows) and hot.shard.map(lambda x: x >> 24).nunique() > 1  # not in one task
    token_files.write_index(token_files.read(spark, path), index, 4)
    reader, code = token_files.Reader(spark, path, index, 4), token_files.encoder(token_files.TOKENIZER)
    want: dict = {}
    for i, t in rows:
        want.setdefault(i, []).append([*np.frombuffer(code.whole(t), code.kind).tolist(), 2])
    for i in [None, 7, *list(want)[:6]]:
        assert sorted(x.tolist() for x in reader.get(i)) == sorted(want[i])
    assert reader.get(-5) == [] and reader.get(10**12) == []
    starts = token_files.with_starts(token_files.read(spark, path), tasks).toPandas().sort_values("start")
    assert (starts.start.values == np.r_[0, np.cumsum(starts.n_tokens.values)[:-1]]).all()
    got = token_files.lookup(spark.createDataFrame([(7,), (-5,), (None,)], "doc_id long"), index, 4).toPandas()
    assert len(got) == len(want[7]) + len(want[None])


def test_other_tokenizers_are_not_cut():
    code = token_files.encoder("word_bpe_49k.json")
    for t in ("The Tree  of\nthe crown, é!", "", " a"):
        assert not code.plain and code.one(t) == code.whole(t)


def test_new_words_are_encoded_together(monkeypatch):
    rng = random.Random(2)
    code = token_files.Encoder(token_files.TOKENIZER)
    word = lambda: "".join(rng.choice("abcdefgXYZéßøɏÀ") for _ in range(rng.randint(1, 14)))
    texts = [" ".join(word() + rng.choice(["", "", ",", "."]) for _ in range(200)) for _ in range(20)] + ["", " ", None, "a\nb  c", "don't it's", "x 12 <|y|> z\n\n"]
    want = [np.frombuffer(code.whole(t or ""), code.kind).tolist() for t in texts]
    calls, one = [], code.model_ids
    monkeypatch.setattr(code, "model_ids", lambda t: calls.append(t) or one(t))
    ids, n = code.batch(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    assert len(calls) < 100 < code.pieces.n  # what begins a line, and marks
    code.forget()
    code.begins[:] = False  # no cut is sure: one by one
    ids, n = code.batch(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want and len(calls) > 1000
