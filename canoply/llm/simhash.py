"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are made in Arrow batches from whole texts. Equal fingerprints form a class by an
aggregation with map-side combine; only distinct ones are compared. Two fingerprints within the radius
agree on some choice of bit blocks, so rows meet by the bits of each choice; the number of blocks rises
with the number of classes, which keeps buckets small at any size and loses nothing. Inside a tile the
bits stand vertically (a plane for each bit, a lane for each fingerprint): one XOR and a carry-save
counter advance the distances of 64 lanes, and a query's lanes are abandoned once all exceed the radius.
Buckets over a tile are cut into chunks that meet pairwise in tasks of their own.

Defined cases: null and empty texts and texts of white space have fingerprint zero and link like any
other; very long texts are hashed whole; repeated rows share a class; null ids are ignored as smallest id
unless a component has no other; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .components import forest, rooted
from .store import save, shielded, table

SEED, SHINGLE, RADIUS, TILE, CHUNK, HELD = 42, 3, 3, 512, 1500, 1 << 18


def fingerprint(text: str | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """64 majority bits over the XXH64 of the n-word shingles of the lower-cased text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = (end - size + 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[i:j], seed) for i, j in zip(start, end[n - 1 :].tolist(), strict=False)), np.uint64, len(words) - n + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, keep: list[str], n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs' columns in keep, with _fp long."""
    schema = docs.select(*keep).withColumn("_fp", F.lit(0).cast("long")).schema

    def batches(it):
        for b in it:
            fps = np.fromiter((fingerprint(t, n, seed) for t in b.column("text").to_pylist()), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fps)], names=[*keep, "_fp"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(batches, schema)


def near_pairs(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of uint64 a and b within the radius; b None: pairs i < j of a."""
    own, b = b is None, a if b is None else b
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lanes = -len(b) % 64
    bits = np.unpackbits(b.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    share = bits.mean(axis=1)
    order = np.argsort(-share * (1 - share), kind="stable")  # planes that tell lanes apart come first
    planes = np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, lanes))), axis=1, bitorder="little")).view(np.uint64)
    width, levels = planes.shape[1], int(radius).bit_length()
    found_i, found_j = [], []
    for lo in range(0, len(a), 1024):
        rows = np.arange(lo, min(lo + 1024, len(a)))
        over = np.zeros((len(rows), width * 64), np.uint8)
        over[:, len(b) :] = 1
        if own:
            over[:, : len(b)] = np.arange(len(b)) <= rows[:, None]
        over = np.ascontiguousarray(np.packbits(over, axis=1, bitorder="little")).view(np.uint64)
        count = [np.zeros_like(over) for _ in range(levels)]
        for nth, p in enumerate(order.tolist()):
            mask = -((a[rows] >> np.uint64(p)) & np.uint64(1)).astype(np.int64)
            carry = planes[p] ^ mask.view(np.uint64)[:, None]
            for c in count:
                carry, _ = c & carry, np.bitwise_xor(c, carry, out=c)
            over |= carry
            if nth % 4 == 3 and nth > 8:
                alive = ~(over == np.uint64(0xFFFFFFFFFFFFFFFF)).all(axis=1)
                if not alive.any():
                    rows = rows[:0]
                    break
                if alive.mean() < 0.7:
                    rows, over, count = rows[alive], over[alive], [c[alive] for c in count]
        if len(rows):
            i, j = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
            i = rows[i]
            near = np.bitwise_count(a[i] ^ b[j]) <= radius
            found_i.append(i[near])
            found_j.append(j[near])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.empty(0, np.int64), np.empty(0, np.int64))


def choices(n: int, radius: int = RADIUS, bucket: int = 256) -> list[int]:
    """Masks: any two 64-bit values within the radius agree on one of them at least."""
    for blocks in range(radius + 1, 2 * radius + 2):
        cuts = np.linspace(0, 64, blocks + 1).astype(int)
        block = [((1 << int(j - i)) - 1) << int(i) for i, j in zip(cuts, cuts[1:], strict=False)]
        masks = [reduce(int.__or__, c) for c in combinations(block, blocks - radius)]
        if n >> min(m.bit_count() for m in masks) <= bucket:
            break
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that join all distinct _fp within the radius, as spanning forests of tiles."""
    masks = [_signed(m) for m in choices(n, radius)]
    met = fps.select("_fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("_fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)))).alias("x")).select("x.t", "x.key", "_fp")
    sizes = save(met.groupBy("t", "key").count().where("count > 1"), "buckets")
    met = met.join(sizes, ["t", "key"])
    parts = F.ceil(F.col("count") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("_fp"), F.col("parts")).cast("int")
    dealt = (
        met.withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.col("own").alias("c"), "_fp")
        .repartition("t", "key", "lo", "hi")
        .sortWithinPartitions("t", "key", "lo", "hi", "c")
    )

    def met(all_: pa.Table):
        t, key, lo, hi, c = (all_.column(x).to_numpy() for x in ("t", "key", "lo", "hi", "c"))
        fp = all_.column("_fp").to_numpy().view(np.uint64)
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        ends = np.r_[new[1:], len(fp)]
        left, right = [], []

        def within(i, j):
            x = np.unique(fp[i:j])
            p, q = near_pairs(x, None, radius)
            left.append(x[p])
            right.append(x[q])

        at = 0  # start of a tile of whole small buckets
        for i, j in zip(new.tolist(), ends.tolist(), strict=True):
            if lo[i] != hi[i]:  # two chunks of a large bucket
                if i > at:
                    within(at, i)
                at = j
                mid = i + int((c[i:j] == lo[i]).sum())
                p, q = near_pairs(fp[i:mid], fp[mid:j], radius)
                left.append(fp[i:mid][p])
                right.append(fp[mid:j][q])
            elif j - at > TILE:
                if i > at:
                    within(at, i)
                at = i
        if len(fp) > at:
            within(at, len(fp))
        a, b = np.concatenate(left), np.concatenate(right)
        if len(a):
            a, b = forest(a.view(np.int64), b.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def batches(it):
        """Whole buckets, HELD rows or so at a time."""
        held, rows = [], 0
        for b in it:
            if not b.num_rows:
                continue
            names = ("t", "key", "lo", "hi")
            if rows >= HELD:
                before, own = ({c: x.column(c).to_numpy() for c in names} for x in (held[-1], b))
                differs = np.zeros(b.num_rows, bool)
                for c in names:
                    differs |= np.diff(own[c], prepend=before[c][-1]) != 0
                cut = np.flatnonzero(differs)
                if len(cut):
                    held.append(b.slice(0, int(cut[-1])))
                    yield from met(pa.Table.from_batches(held))
                    held, rows, b = [], 0, b.slice(int(cut[-1]))
            held.append(b)
            rows += b.num_rows
        if held:
            yield from met(pa.Table.from_batches(held))

    return dealt.mapInArrow(batches, "a long, b long")


def classes_of(fps: DataFrame, value: str, radius: int = RADIUS) -> DataFrame:
    """(_fp, component): the least value over each component of fingerprints."""
    classes = save(fps.groupBy("_fp").agg(F.min(value).alias("_least")), "classes")
    edges = save(links(classes.select("_fp"), classes.count(), radius), "links")
    return save(rooted(classes, edges, "_fp", "_least").select("_fp", "component"), "components")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    docs = save(with_fingerprints(table(spark, sf_dir, "documents"), ["doc_id"]), "fingerprints")
    found = classes_of(docs, "doc_id")
    return docs.join(found, "_fp").select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies (Jaccard of five-word shingles 0.8 at least): of each component the one with the smallest doc_id stays.

    Null ids come last; among equal ids, rows in the order of the table. Further columns are kept whatever their names.
    """
    docs, undo = shielded(docs, ("doc_id", "text"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rid")
    known, found = near_copies.firsts(docs.withColumn("_rid", F.monotonically_increasing_id()), first, links)
    kept = save(found.select(F.col("component._rid").alias("_rid")), "kept")
    # what is kept grows with the corpus, so it is never broadcast: the plan is the same at every size
    return known.join(kept.hint("merge"), "_rid", "left_semi").select(*undo)
