"""Spelling variants, decontamination and the Merkle manifest against plain versions."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from canoply.llm import decontamination, merkle, spelling


def plain_near(words):
    """Near words of each, by trying every deletion and pairing words of equal length."""
    known, near = set(words), collections.defaultdict(set)
    for w in known:
        for i in range(len(w)):
            x = w[:i] + w[i + 1 :]
            if x in known:
                near[w].add(x)
                near[x].add(w)
    for a, b in itertools.combinations(sorted(known), 2):
        if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1:
            near[a].add(b)
            near[b].add(a)
    return near


@pytest.mark.parametrize("seed", range(4))
def test_composition(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(300)})
    a, b = spelling.Acceptor(words).pairs()
    got = [frozenset((words[i], words[j])) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    want = {frozenset((w, x)) for w, near in plain_near(words).items() for x in near}
    assert len(got) == len(set(got)) and set(got) == want


def test_acceptor_is_minimal():
    found = spelling.Acceptor(sorted(a + b + "ing" for a in "xyz" for b in "pqr"))
    assert len(found.arcs) == 6 and found.size[found.start] == 9


def plain_variants(rows):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            n[low if h % 97 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = plain_near(n)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x))
        if n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), k, len(near.get(w, ())), n.get(form.get(w))) for w, k in n.items())


@pytest.mark.parametrize("group", [3, 40])
def test_variants(spark, group):
    """Small groups split the composition's first states; some words are prefixes that are split."""
    rng = random.Random(group)
    stems = ["aaaaa", "aaaaaa", "aaaab", "crown", "crowns", "crwn", "crowned", "Éclair", "eclair", "éclair", "a" * 40, "a" * 39 + "b", "a" * 41, "x" * 3000]
    stems += ["".join(rng.choice("abc") for _ in range(rng.randint(5, 7))) for _ in range(60)]
    rows = [(i if i % 7 else None, " ".join(rng.choices(stems, weights=[len(stems) - k for k in range(len(stems))], k=60)) + rng.choice(["", " Crown", "\tCROWNS"])) for i in range(60)] + [(1, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs, group).collect())
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=key) == sorted(plain_variants(rows), key=key)


def plain_hits(docs, items, span=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - span + 1) if w else 0):
            windows[tuple(w[k : k + span])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("span", "k"), [(10, 8), (10, 5), (4, 2), (3, 3), (1, 1)])
def test_winnowing(spark, span, k):
    rng = random.Random(span)
    text = lambda n, some: " ".join(rng.choice(some) for _ in range(n))
    few, many = ["Aa", "bb"], [f"w{i}" for i in range(30)]
    docs = [(i, text(rng.randint(0, 60), few if i % 5 == 0 else many)) for i in range(80)] + [(None, None), (3, "?!"), (4, "é É aa. BB-bb")]
    items = [(i, text(rng.randint(1, 25), many)) for i in range(30)] + [(40, "AA bb aa"), (None, "é"), (41, None), (42, "")]
    items += [(50 + i, " ".join((docs[i][1] or "").split()[2:20])) for i in range(0, 40, 3)]
    docs += [(100 + i, f"{text(4, many)} {t}, {text(3, many)}") for i, t in items[:20]] * 2
    found = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), span, k)
    got = [(r.doc_id, r.n_words, r.n_hit, list(r.hit_items)) for r in found.collect()]
    assert sorted(got, key=str) == plain_hits(docs, items, span)


def test_spans_are_told(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(["x", *words[5:20], "y", *words[:12]]), "kept")], "doc_id long, text string, hits string")
    items = spark.createDataFrame([("q", " ".join(words))], "item_id string, text string")
    got = decontamination.contamination(docs, items).first()
    assert [tuple(s) for s in got.hit_spans] == [(1, 15), (17, 12)] and got.hit_items == ["q"] and got.hits == "kept"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(field, r))
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        for nodes in levels[:-1]:
            lo = i // 16 * 16
            yield nodes[lo:i], nodes[i + 1 : lo + 16]
            i //= 16

    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top, out = tree([trees[s][-1][0] for s in sources]), []
    for k, s in enumerate(sources):
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = [*path(trees[s], i), *path(top, k)]
            node = leaf((*r[:4], low(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else own
            for left, right in steps:
                node = H(*left, node, *right)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], H(*(x for step in steps for side in step for x in side)), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("sizes", "parts"), [([1], 1), ([16, 17, 1, 2], 3), ([4100, 300, 256, 257, 15], 7), ([3] * 290 + [600], 5)])
def test_manifest(spark, tmp_path, sizes, parts):
    rows, at = [], itertools.count()
    for k, n in enumerate(sizes):
        for _ in range(n):
            i = next(at)
            rows.append((i * 7 % 5003, None if k == 1 else f"s{k}é", None if i % 3 else "en", i if i % 11 else None, None if i % 13 == 0 else f"Tree {i} É"))
    rows += [rows[0]] * 20 + [(None, "s0é", None, None, None)] * 2
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_merkle(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows)


def test_paths_verify_and_levels_are_skipped(spark):
    leaves = spark.range(70_000).selectExpr("'g' AS _g", "id AS _pos", "70000L AS _n", "sha2(cast(id AS string), 256) AS node")
    levels = merkle.build(leaves)
    assert [x.count() for x in levels] == [70_000, 274, 2, 1]
