"""Near copies by the exact Jaccard similarity of five-word shingles, found by SimHash and completed by a prefix join.

Rows of one shingle set form a class. Three searches bring classes together, and what they bring is decided
on the whole shingle sets:

1. SimHash: fingerprints of the sets within the radius, by the bit-sliced comparison.
2. Prefix lists: all shingles have one order over the corpus (those that a sample shows often come last, else
   the hash decides; the sample touches only the order, so never the result). Of n shingles a class posts the
   first n - ceil(0.8 n) + 1, and two sets of similarity 0.8 or more share one of these. Neighbours in a list meet.
3. All other pairs in a list whose classes lie in different components after 1 and 2. So no pair is lost, and
   large groups need no squares.

Pairs of 2 and 3 first pass sizes and a parity sketch (a bit for each shingle that falls on it, added mod 2),
whose distance is never above the symmetric difference. Long lists are cut into chunks that meet pairwise.

Defined cases: texts are split at white space and lower-cased in ASCII, as for SimHash; texts of fewer
than five words are one shingle; null and empty texts and texts of white space are one class; very long
texts are hashed in segments; shingles and classes are told apart by 64-bit hashes; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, rooted
from .rolling import Roller, mix
from .store import drop, save

SEED, SHINGLE, BITS, SAMPLE, OFTEN, ORDERED, SLOTS, BLOCK, CHUNK, PAIRS = 42, 5, 512, 10_000, 3, 1 << 17, 1 << 22, 1 << 18, 2000, 1 << 18
_SPAN, _WORD = 1 << 18, 1 << 14  # bytes hashed at once; longest word of the rolling hash
_U = np.uint64
_SEEN = 1 << 20
_tools: list = []


def _hasher() -> tuple[Roller, np.ndarray]:
    """The rolling hash with upper-case letters coded as lower-case ones, and which bytes are part of words."""
    if not _tools:
        r, solid = Roller(_SPAN + _WORD), np.ones(256, bool)
        r.codes[65:91] = r.codes[97:123]
        solid[[32, *range(9, 14)]] = False
        _tools[:] = [r, solid]
    return tuple(_tools)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and how many words each text has."""
    r, solid = _hasher()
    text = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64, len(text) + 1, 8 * text.offset)
    if data is None or at[0] == at[-1]:
        return np.empty(0, np.uint64), np.zeros(len(text), np.int64)
    data, at = np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
    inside = solid[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[:-1][at[:-1] < len(data)]
    first[edge] |= inside[edge]
    edge = at[1:][at[1:] > 0] - 1
    last[edge] |= inside[edge]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(lo), np.uint64)
    cuts = np.searchsorted(lo, np.arange(0, len(data) + _SPAN, _SPAN))
    with np.errstate(over="ignore"):
        for x, i, j in zip(range(0, len(data), _SPAN), cuts[:-1].tolist(), cuts[1:].tolist(), strict=False):
            part = data[x : x + _SPAN + _WORD]
            out[i:j] = r.between(r.sums(part), lo[i:j] - x, np.minimum(hi[i:j] - x, len(part)))
    for w in np.flatnonzero(hi - lo > _WORD).tolist():
        out[w] = xxhash.xxh64_intdigest(data[lo[w] : hi[w]].tobytes().lower(), SEED)
    return out, np.bincount(np.searchsorted(at[1:], lo, "right"), minlength=len(text))


def _joined(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n words in a row."""
    with np.errstate(over="ignore"):
        h = words[: max(0, len(words) - n + 1)].copy()
        for k in range(1, n):
            h = mix(h) + words[k : len(words) - n + 1 + k]
        return mix(h + _U(n))


def sets_of(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each lower-cased text."""
    words, sizes = words_of(texts)
    every, at, out = _joined(words, n), 0, []
    for k in sizes.tolist():
        if k >= n:
            h = np.sort(every[at : at + k - n + 1])
            out.append(h[np.r_[True, h[1:] != h[:-1]]])
        else:
            out.append(_joined(words[at : at + k], k) if k else np.empty(0, np.uint64))
        at += k
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard of sorted distinct values is 0.8 at least."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def sketch(h: np.ndarray) -> bytes:
    return np.packbits(np.bincount((h % np.uint64(BITS)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def majority(h: np.ndarray) -> int:
    """The SimHash of a set: a bit is 1 if set in over half of h."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def prefix(h: np.ndarray, often: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The shingles that a set posts; often (sorted) come last, by rising count."""
    n = len(h)
    if not n:
        return h
    post = n - (4 * n + 4) // 5 + 1
    if not len(often):
        return h[:post]
    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
    hit = often[at] == h
    rare = h[~hit]
    if len(rare) >= post:
        return rare[:post]
    late = np.lexsort((h[hit], count[at[hit]]))[: post - len(rare)]
    return np.concatenate([rare, h[hit][late]])


def with_sets(docs: DataFrame, often: np.ndarray, count: np.ndarray) -> DataFrame:
    """docs with _set (a hash of the shingle set), _n (its size), _fp (its SimHash), _sketch and _posts."""
    names = docs.columns
    kinds = {"_set": pa.int64(), "_n": pa.int64(), "_fp": pa.int64(), "_sketch": pa.binary(), "_posts": pa.list_(pa.int64())}
    schema = docs.withColumns({"_set": F.lit(0).cast("long"), "_n": F.lit(0).cast("long"), "_fp": F.lit(0).cast("long"), "_sketch": F.lit(b""), "_posts": F.array(F.lit(0).cast("long"))}).schema

    def batches(it):
        for b in it:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                sets = sets_of(part.column("text"))
                posts = [prefix(h, often, count).view(np.int64) for h in sets]
                ends = np.cumsum([0, *map(len, posts)]).astype(np.int32)
                made = {
                    "_set": np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64),
                    "_n": [len(h) for h in sets],
                    "_fp": np.array([majority(h) for h in sets], np.uint64).view(np.int64),
                    "_sketch": [sketch(h) for h in sets],
                    "_posts": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *posts]))),
                }
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(v if isinstance(v, pa.Array) else pa.array(v, kinds[c]) for c, v in made.items())], names=[*names, *made])

    return docs.mapInArrow(batches, schema)


def frequent(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts shows often, and their counts there."""
    step = max(1, rows // SAMPLE)

    def batches(it):
        for b in it:
            for lo in range(0, b.num_rows, 1024):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sets_of(b.slice(lo, 1024).column("text"))]).view(np.int64))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).select("text").distinct().mapInArrow(batches, "h long")
    top = some.groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(ORDERED).toArrow()
    h, count = top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


def postings(known: DataFrame, often: np.ndarray, count: np.ndarray, step: int) -> DataFrame:
    """(h, _set) for the posted shingles of each class, where two classes at least post h; what is posted often is salted."""
    parts = -(-count * step // CHUNK)

    def posted(it):
        seen = set()  # copies post once a task
        for b in it:
            new = []
            for i, s in enumerate(b.column("_set").to_pylist()):
                if s not in seen:
                    seen.add(s)
                    new.append(i)
            if len(seen) > _SEEN:
                seen.clear()
            b = b.take(pa.array(new, pa.int64()))
            posts = b.column("_posts")
            h = posts.flatten().to_numpy()
            ids = np.repeat(b.column("_set").to_numpy(), pc.list_value_length(posts).to_numpy(zero_copy_only=False))
            salt = np.zeros(len(h), np.int32)
            if len(often) and len(h):
                at = np.minimum(np.searchsorted(often, h.view(np.uint64)), len(often) - 1)
                hot = np.flatnonzero((often[at] == h.view(np.uint64)) & (parts[at] > 1))
                salt[hot] = 1 + ids[hot] % parts[at[hot]]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(salt), pa.array(ids)], names=["h", "salt", "_set"])

    def shared(it):
        """Of sorted rows those that another one shares h with; the last one waits for its successor."""
        h, s, salt = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        told = False  # the row that waits shares its h with one before it
        for b in it:
            h, s, salt = (np.concatenate([x, b.column(c).to_numpy()]) for x, c in ((h, "h"), (s, "_set"), (salt, "salt")))
            new = np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])][: len(h)]
            h, s, salt = h[new], s[new], salt[new]
            if not len(h):
                continue
            same = (h[1:] == h[:-1]) & (salt[1:] == salt[:-1])
            many = np.r_[told, same] | np.r_[same, False] | (salt > 0)
            yield pa.RecordBatch.from_arrays([pa.array(h[:-1][many[:-1]]), pa.array(s[:-1][many[:-1]])], names=["h", "_set"])
            told = bool(same[-1]) if len(same) else told
            h, s, salt = h[-1:], s[-1:], salt[-1:]
        if len(h) and (told or salt[0] > 0):
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(s)], names=["h", "_set"])

    return known.select("_set", "_posts").mapInArrow(posted, "h long, salt int, _set long").repartition("h", "salt").sortWithinPartitions("h", "salt", "_set").mapInArrow(shared, "h long, _set long")


def passing(n: np.ndarray, sk: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """False only where sizes or sketches rule a similarity of 0.8 out."""
    a, b = n[i], n[j]
    ok = 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)
    return ok & (9 * np.bitwise_count(sk[i] ^ sk[j]).sum(axis=-1, dtype=np.int64) <= a + b)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def neighbours(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that stand next to each other in a chunk of a list (h, _set, parts, own) by size, and may be similar."""

    def batches(it):
        held = None
        for b in it:
            t = pa.Table.from_batches([b] if held is None else [held, b])
            h, own, s, n = (t.column(c).to_numpy() for c in ("h", "own", "_set", "_n"))
            i = np.flatnonzero((h[1:] == h[:-1]) & (own[1:] == own[:-1]))
            i = i[passing(n, _sketches(t.column("_sketch")), i, i + 1)]
            held = b.slice(b.num_rows - 1, 1) if b.num_rows else held
            if len(i):
                yield _pairs(s[i], s[i + 1])

    return lists.join(classes.select("_set", "_n", "_sketch"), "_set").repartition("h", "own").sortWithinPartitions("h", "own", "_n", "_set").mapInArrow(batches, "a long, b long").distinct()


def others(lists: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that share a list, may be similar and have different roots."""
    rooted = save(lists.join(roots.toDF("_set", "_root"), "_set", "left").withColumn("_root", F.coalesce("_root", "_set")), "rooted")
    mixed = rooted.groupBy("h").agg(F.min("_root").alias("lo"), F.max("_root").alias("hi"), F.min("_set").alias("head")).where("lo <> hi").select("h", "head")
    dealt = (
        rooted.join(mixed, "h")
        .join(classes.select("_set", "_n", "_sketch"), "_set")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("head", "h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "_set", "_n", "_sketch", "_root")
        .repartition("head", "lo", "hi")  # lists of the same classes mostly begin with the same one: their pairs meet in one task, which tells each once
        .sortWithinPartitions("head", "lo", "hi", "h", "own", "_n", "_set")
    )

    def met(t: pa.Table):
        h, lo, hi, own, s, n, root = (t.column(c).to_numpy() for c in ("h", "lo", "hi", "own", "_set", "_n", "_root"))
        sk = _sketches(t.column("_sketch"))
        group = np.cumsum(np.r_[0, (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        size = np.bincount(group)
        small = (size <= 8)[group]
        for d in range(1, 8):
            i = np.flatnonzero(small[:-d] & (group[d:] == group[:-d]) & (root[d:] != root[:-d]) & (own[d:] + own[:-d] == lo[:-d] + hi[:-d]))
            i = i[passing(n, sk, i, i + d)]
            if len(i):
                yield _pairs(s[i], s[i + d])
        ends = np.cumsum(size)
        for g in np.flatnonzero(size > 8).tolist():
            end = int(ends[g])
            start = end - int(size[g])
            mid = start if lo[start] == hi[start] else start + int((own[start:end] == lo[start]).sum())
            rows = max(1, BLOCK // (end - start))
            for k in range(start, end if mid == start else mid, rows):
                left = np.arange(k, min(k + rows, end if mid == start else mid))
                i, j = np.meshgrid(left, np.arange(k if mid == start else mid, end), indexing="ij")
                apart = (j > i) & (root[i] != root[j])
                i, j = i[apart], j[apart]
                ok = passing(n, sk, i, j)
                if ok.any():
                    yield _pairs(s[i[ok]], s[j[ok]])

    def tables(it):
        """Whole groups."""
        held: list[pa.RecordBatch] = []
        for b in it:
            if not b.num_rows:
                continue
            h, lo, hi = (b.column(c).to_numpy() for c in ("h", "lo", "hi"))
            cut = np.flatnonzero((h[1:] != h[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
            cut = int(cut[-1]) + 1 if len(cut) else 0  # the last group may go on
            if cut:
                yield pa.Table.from_batches([*held, b.slice(0, cut)])
                held = []
            elif held and any(held[-1].column(c)[0].as_py() != b.column(c)[0].as_py() for c in ("h", "lo", "hi")):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(cut))
        if held:
            yield pa.Table.from_batches(held)

    def batches(it):
        found = np.empty((2, 0), np.int64)
        for t in tables(it):
            new = [np.stack([p.column("a").to_numpy(), p.column("b").to_numpy()]) for p in met(t)]
            if new:
                found = np.unique(np.concatenate([found, *new], axis=1), axis=1)
                if found.shape[1] > PAIRS:
                    yield _pairs(found[0], found[1])
                    found = found[:, :0]
        if found.shape[1]:
            yield _pairs(found[0], found[1])

    return dealt.mapInArrow(batches, "a long, b long").distinct()


def by_simhash(classes: DataFrame, search) -> DataFrame:
    """Pairs (a, b) of classes whose fingerprints are equal or that search(fingerprints, n) links."""
    fps = save(classes.groupBy("_fp").agg(F.min("_set").alias("_head")), "fingerprints")
    equal = classes.join(fps, "_fp").where("_set <> _head").select(F.col("_set").alias("a"), F.col("_head").alias("b"))
    near = save(search(fps.select("_fp"), fps.count()).select(F.col("a").alias("x"), F.col("b").alias("y")), "near")
    near = near.join(fps.toDF("x", "a"), "x").join(fps.toDF("y", "b"), "y").select("a", "b")
    return equal.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def wide_sketch(h: np.ndarray) -> bytes:
    """A parity sketch of four bits a shingle or more, a power of two; the halves of one added mod 2 are the next smaller one."""
    bits = 1 << min(20, max(9, (4 * len(h) - 1).bit_length()))
    return np.packbits(np.bincount((h % _U(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def may_be_similar(x: bytes, y: bytes, sizes: int) -> bool:
    """False only where wide sketches rule a similarity of 0.8 out."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return 9 * int(np.bitwise_count(a ^ b).sum(dtype=np.int64)) <= sizes


def verified(pairs: DataFrame, known: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose whole shingle sets are similar. Wide sketches go first, so that few texts have to meet."""
    slot = F.pmod(F.xxhash64("_rid"), F.lit(SLOTS))
    wanted = save(pairs.select(F.explode(F.array("a", "b")).alias("_set")).distinct().join(classes.select("_set", "_first._rid"), "_set"), "wanted")
    marks = wanted.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()  # SLOTS bits at most
    bits = np.zeros((SLOTS // 32768 + 2, 4096), np.uint8)
    for r in marks:
        bits[r.k] = np.frombuffer(bytes(r.bits), np.uint8)

    def marked(it):  # few texts besides the wanted ones get past the bits
        mark = np.unpackbits(bits.ravel(), bitorder="little")
        for b in it:
            yield b.filter(pa.array(mark[b.column("_at").to_numpy()] == 1))

    def sketches(it):
        for b in it:
            sets = sets_of(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("_set"), pa.array([len(h) for h in sets], pa.int64()), pa.array([wide_sketch(h) for h in sets], pa.binary())], names=["_set", "n", "w"])

    def sifted(it):
        for b in it:
            sizes = pc.add(b.column("na"), b.column("nb")).to_pylist()
            ok = [may_be_similar(x, y, n) for x, y, n in zip(b.column("wa").to_pylist(), b.column("wb").to_pylist(), sizes, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def judged(it):
        for b in it:
            ok = [similar(x, y) for x, y in zip(sets_of(b.column("ta")), sets_of(b.column("tb")), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    place = F.bitmap_bucket_number(slot) * 32768 + F.bitmap_bit_position(slot)
    some = known.select("_rid", "text", place.alias("_at"))
    texts = save(some.mapInArrow(marked, some.schema).join(wanted, "_rid").select("_set", "text"), "texts")
    wide = save(texts.mapInArrow(sketches, "_set long, n long, w binary"), "sketches")
    met = pairs.join(wide.toDF("a", "na", "wa"), "a").join(wide.toDF("b", "nb", "wb"), "b").select("a", "b", "na", "nb", "wa", "wb")
    left = save(met.mapInArrow(sifted, "a long, b long"), "sifted")
    met = left.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    found = save(met.mapInArrow(judged, "a long, b long"), "links")
    drop(wanted, texts, wide, left)
    return found


def firsts(docs: DataFrame, value, search) -> tuple[DataFrame, DataFrame]:
    """docs (text, _rid and more) as a saved table, and as column component the least value (with a field _rid) of each component of near copies.

    search(fingerprints, n) links distinct fingerprints (_fp) as edges (a, b).
    """
    rows = docs.count()
    often, count = frequent(docs, rows)
    known = save(with_sets(docs, often, count).withColumn("_value", value), "shingled")
    classes = save(known.groupBy("_set").agg(F.min("_value").alias("_first"), F.first("_n").alias("_n"), F.first("_fp").alias("_fp"), F.first("_sketch").alias("_sketch")), "classes")
    shared = save(postings(known, often, count, max(1, rows // SAMPLE)), "shared")
    sizes = shared.groupBy("h").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    lists = save(shared.join(sizes, "h").withColumn("own", F.pmod(F.xxhash64("_set"), F.col("parts")).cast("int")), "lists")
    drop(shared)
    pairs = save(by_simhash(classes, search).unionByName(neighbours(lists, classes)).distinct(), "pairs")
    edges = verified(pairs, known, classes)
    roots = save(components(edges), "roots")
    rest = save(others(lists, roots, classes).join(pairs, ["a", "b"], "left_anti"), "pairs")
    drop(lists, roots, pairs)
    more = verified(rest, known, classes)
    return known, rooted(classes, edges.unionByName(more), "_set", "_first").select("component").distinct()
