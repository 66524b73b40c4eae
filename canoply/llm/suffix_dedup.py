"""Removal of long repeats with a logarithmic family of sorted suffix indexes, kept as tables.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else too. Sorting all
suffixes of a corpus would take many times its size in disk and time, so the search narrows first, and
exactly:

1. The *anchor* of a window of ``length`` bytes is the place of the least hash among its ``gram``-byte
   substrings (leftmost of equals). Equal windows have equal anchors at equal distance, so windows fall
   into runs by anchor, and only runs with equal anchor grams need comparing. The bytes a run spans are
   its context. A row is (anchor hash, context hash); equal contexts inside a chunk of text are one row.
2. A batch's rows, sorted by anchor, are its index; it is written as a table and merge-scanned against the levels
   of earlier batches. Contexts that occur twice match wholly: nothing else moves. Only where an anchor gram has several
   different contexts does one context of each kind travel, to the task of its anchor hash. Levels of equal size class
   merge geometrically (``Family``).
3. There each arriving batch gets an array of its suffixes (every window start), sorted by the hash of
   the window's bytes; the batch is merge-scanned against the levels at hand for windows of full
   length, and levels of equal size merge geometrically. Equal hashes are confirmed byte by byte.

An anchor gram with very many contexts (a license line in every document) would gather them in one task. Anchors that a sample
of chunks shows often therefore send the hashes of their windows instead, dealt by the hash, so that they spread over all
tasks. The sample only chooses the way, never the result.

Two deviations from the textbook method, for the limits on disk and CPU: suffixes are sorted by the
64-bit hash of their first ``length`` bytes rather than by the bytes, as only matches of that length
count; and only suffixes that can have a match reach the index. Whole contexts are told apart by 64 bits of two unlike hashes joined into one,
windows of common anchors by 64 bits.

Chunks of text are compressed once into the shared folder; later passes read them there.

Defined cases: a null text is empty; texts shorter than ``length`` have no match; repeated rows match
each other and lose what matches; very long texts are scanned in segments; an empty table gives an
empty result; further columns are carried along.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import Roller, mix
from .store import save, table

LENGTH, GRAM = 200, 64
SEGMENT, CHUNK_BYTES, TEXT_A_GROUP = 1 << 17, 4 << 20, 64 << 20
_BITS = np.uint64(18)  # of a place in a segment
_U = np.uint64
SAMPLED, HOT, HOTS = 16, 64, 1 << 17  # least chunks of the sample (else a thousandth), contexts there of an anchor that is common, most of these
_WINDOWS = 1 << 40  # groups from here on hold hashes of windows


_roller: list[Roller] = []


def roller(length: int) -> Roller:
    if not _roller or len(_roller[0].power) < SEGMENT + length:
        _roller[:] = [Roller(SEGMENT + length)]
    return _roller[0]


def runs(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after the other: first and last window start of each run, anchor and context hashes."""
    r, w, out = roller(length), length - gram + 1, []
    with np.errstate(over="ignore"):
        for x in range(0, max(0, len(data) - length + 1), SEGMENT):
            d = data[x : x + SEGMENT + length - 1]
            sums = r.sums(d)
            grams = r.all(sums, gram)
            least = (grams >> _BITS << _BITS) | np.arange(len(grams), dtype=np.uint64)
            span = 1
            while span < w:
                step = min(span, w - span)
                least = np.minimum(least[:-step], least[step:])
                span += step
            start = np.arange(x, x + len(least))
            first = np.searchsorted(ends, start, "right")
            at = np.flatnonzero(ends[np.minimum(first, len(ends) - 1)] - start >= length)
            if not len(at):
                continue
            anchor = (least[at] & ((_U(1) << _BITS) - _U(1))).astype(np.int64)
            new = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(at) != 1)])
            a, b, s = at[new], at[np.r_[new[1:], len(at)] - 1], anchor[new]
            context = mix(r.between(sums, a, b + length) + ((s - a) * 256 + (b - a)).astype(np.uint64) * _U(0xA0761D6478BD642F))
            out.append((a + x, b + x, mix(grams[s]), context))  # least hashes lie close together: mixed, they spread over groups
    if not out:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    return tuple(np.concatenate(c) for c in zip(*out))


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Of every window start."""
    r = roller(length)
    with np.errstate(over="ignore"):
        parts = [r.all(r.sums(data[x : x + SEGMENT + length - 1]), length) for x in range(0, max(0, len(data) - length + 1), SEGMENT)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


class Levels:
    """Sorted suffix arrays of geometric sizes. add() finds and marks what a batch shares with all before."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray] | None] = []
        self.matched = np.zeros(0, bool)

    def add(self, keys: np.ndarray) -> None:
        base = len(self.matched)
        self.matched = np.concatenate([self.matched, np.zeros(len(keys), bool)])
        order = np.argsort(keys, kind="stable")
        batch = keys[order], order + base
        same = np.flatnonzero(batch[0][1:] == batch[0][:-1])
        self.matched[batch[1][same]] = self.matched[batch[1][same + 1]] = True
        for level in self.levels:
            if level is not None:
                at = np.searchsorted(level[0], batch[0])
                at[at == len(level[0])] = 0
                hit = level[0][at] == batch[0]
                self.matched[batch[1][hit]] = True
                self.matched[level[1][at[hit]]] = True  # if a level holds a key twice, all its places are marked already
        j = max(0, int(len(keys)).bit_length() - 12)
        while True:
            while len(self.levels) <= j:
                self.levels.append(None)
            if self.levels[j] is None:
                self.levels[j] = batch
                return
            old, self.levels[j] = self.levels[j], None
            merged = np.concatenate([old[0], batch[0]])
            order = np.argsort(merged, kind="stable")
            batch = merged[order], np.concatenate([old[1], batch[1]])[order]
            j += 1


def confirmed(text: np.ndarray, at: np.ndarray, keys: np.ndarray, matched: np.ndarray, length: int) -> np.ndarray:
    """matched, without windows (text from at on, of hash keys) that equal no other one byte by byte."""
    some = np.flatnonzero(matched)
    if not len(some):
        return matched
    order = some[np.argsort(keys[some], kind="stable")]
    new = np.r_[True, keys[order][1:] != keys[order][:-1]]
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    same = np.ones(len(order), bool)
    for i in range(0, len(order), 1 << 14):
        p, q = at[order[i : i + (1 << 14)]], at[first[i : i + (1 << 14)]]
        for k in range(0, length, 8):
            d = np.arange(k, min(k + 8, length))
            same[i : i + (1 << 14)] &= (text[p[:, None] + d] == text[q[:, None] + d]).all(axis=1)
    if same.all():
        return matched
    out = matched.copy()
    for key in np.unique(keys[order[~same]]):  # a collision: this class by its bytes
        own = order[keys[order] == key]
        _, kind, n = np.unique([text[a : a + length].tobytes() for a in at[own].tolist()], return_inverse=True, return_counts=True)
        out[own] = n[kind] > 1
    return out


# Chunks: compressed record batches of documents.


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.RecordBatch:
    t = pa.ipc.open_stream(data).read_all().combine_chunks()
    return t.to_batches()[0]


def _bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after the other, and where each ends."""
    text = pc.fill_null(batch.column("text"), "").cast(pa.large_binary())
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64, len(text) + 1, 8 * text.offset)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return data, at[1:] - at[0]


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, batch: int = 0, path: str | None = None) -> DataFrame:
    """(cid, size, docs): whole documents of about chunk_bytes of text, compressed; batch makes cids of their own."""

    def pack(it):
        cid, held, size = (batch << 48) + (TaskContext.get().partitionId() << 24), [], 0

        def row():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array([cid]), pa.array([size]), pa.array([_pack(whole)], pa.binary())], names=["cid", "size", "docs"])

        for b in it:
            sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
            lo = 0
            for i, n in enumerate(sizes.tolist()):
                size += n
                if size >= chunk_bytes:
                    held.append(b.slice(lo, i + 1 - lo))
                    yield row()
                    cid, held, size, lo = cid + 1, [], 0, i + 1
            if lo < b.num_rows:
                held.append(b.slice(lo))
        if held:
            yield row()

    return save(docs.mapInArrow(pack, "cid long, size long, docs binary"), "chunks", path)


def _local(context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's runs: first of each context, whether it repeats there, and which runs repeat."""
    _, first, inverse, n = np.unique(context, return_index=True, return_inverse=True, return_counts=True)
    return first, n > 1, (n > 1)[inverse]


def _rows(groups: np.ndarray, cid: int, pack) -> pa.RecordBatch:
    """A row (g, cid, data) for each group number; pack(where) makes the data of its rows."""
    order = np.argsort(groups, kind="stable")
    g, at = np.unique(groups[order], return_index=True)
    blobs = [pack(order[i:j]) for i, j in zip(at, [*at[1:], len(order)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(np.full(len(g), cid)), pa.array(blobs, pa.binary())], names=["g", "cid", "data"])


_ROW = np.dtype([("a", "<u8"), ("c", "<u8"), ("cid", "<i8"), ("i", "<u4"), ("twice", "u1")])


def _places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All window starts of runs from a to b."""
    n = b - a + 1
    return np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in sorted known."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def common(store: DataFrame, n: int, length: int, gram: int) -> np.ndarray:
    """Sorted hashes of anchors that have HOT contexts or more in a sample of chunks; HOTS of them at most, the commonest."""
    step = max(1, min(n // SAMPLED, 1000))

    def scan(it):
        for b in it:
            for blob in b.column("docs"):
                _, _, anchor, context = runs(*_bytes(_unpack(blob.as_buffer())), length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[_local(context)[0]].view(np.int64))], names=["a"])

    some = store.where(F.pmod(F.xxhash64("cid"), F.lit(step)) == 0).select("docs").mapInArrow(scan, "a long")
    top = some.groupBy("a").count().where(F.col("count") >= HOT).orderBy(F.desc("count"), "a").limit(HOTS).toArrow()
    return np.sort(top.column("a").to_numpy().view(np.uint64))


def _index(store: DataFrame, hot: np.ndarray, bits: int, length: int, gram: int) -> DataFrame:
    """(g, cid, data): a chunk's distinct contexts by the top bits of their anchor hash; of common anchors the distinct window hashes, by their own top bits."""

    def scan(it):
        for b in it:
            for cid, blob in zip(b.column("cid").to_pylist(), b.column("docs"), strict=True):
                data, ends = _bytes(_unpack(blob.as_buffer()))
                lo, hi, anchor, context = runs(data, ends, length, gram)
                if not len(anchor):
                    continue
                first, twice, _ = _local(context)
                often = _among(anchor[first], hot)
                own = first[~often]
                rec = np.zeros(len(own), _ROW)
                text = memoryview(data)
                rec["c"] = [xxhash.xxh3_64_intdigest(text[i:j]) for i, j in zip(lo[own].tolist(), (hi[own] + length).tolist(), strict=True)]
                rec["a"], rec["cid"], rec["i"], rec["twice"] = anchor[own], cid, own, twice[~often]
                rec["c"] ^= context[own]  # it also knows the anchor's place
                if len(own):
                    yield _rows((rec["a"] >> _U(64 - bits)).astype(np.int64), cid, lambda x: rec[x].tobytes())  # noqa: B023
                at = np.flatnonzero(_among(anchor, hot))
                if len(at):
                    h, n = np.unique(window_hashes(data, length)[_places(lo[at], hi[at])], return_counts=True)
                    more = (n > 1).astype(np.uint8)
                    yield _rows(_WINDOWS + (h >> _U(64 - bits)).astype(np.int64), cid, lambda x: h[x].tobytes() + more[x].tobytes())  # noqa: B023

    return store.select("cid", "docs").mapInArrow(scan, "g long, cid long, data binary")


def _sorted(index: DataFrame) -> DataFrame:
    """(g, data): an index's rows, or those of several, one table of rows sorted by (anchor, context) for each g: a level."""

    def merge(t: pa.Table) -> pa.Table:
        rec = np.concatenate([np.frombuffer(x.as_buffer(), _ROW) for x in t.column("data")])
        rec = rec[np.lexsort((rec["cid"], rec["c"], rec["a"]))]
        cuts = np.searchsorted(rec["a"], _part_borders(rec["a"], len(rec)))
        parts = [rec[i:j] for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rec)], strict=True) if j > i]
        return pa.table({"g": pa.array([t.column("g")[0].as_py()] * len(parts), pa.int64()), "data": pa.array([p.tobytes() for p in parts], pa.binary())})

    return index.where(F.col("g") < _WINDOWS).select("g", "data").groupBy("g").applyInArrow(merge, "g long, data binary")


def _part_borders(a: np.ndarray, n: int, most: int = 1 << 20) -> np.ndarray:
    """Anchor hashes at which a sorted table is cut into values of about most rows."""
    return a[most::most] if n > most else a[:0]


def _answers(parts: DataFrame) -> DataFrame:
    """(cid, data, must) from rows (g, data) of a batch and of levels: of each context row (run, code); code 1: it repeats, 2: its context must travel."""

    def meet(t: pa.Table) -> pa.Table:
        rec = np.concatenate([np.frombuffer(x.as_buffer(), _ROW) for x in t.column("data")])
        rec = rec[np.lexsort((rec["c"], rec["a"]))]  # the merge-scan
        new = np.r_[True, rec["a"][1:] != rec["a"][:-1]]
        kind = new | np.r_[True, rec["c"][1:] != rec["c"][:-1]]
        size = np.diff(np.r_[np.flatnonzero(kind), len(rec)])
        code = ((np.repeat(size, size) > 1) | (rec["twice"] > 0)).astype(np.uint8)
        kinds = np.bincount(np.cumsum(new) - 1, kind)
        code[kind & (kinds[np.cumsum(new) - 1] > 1)] |= 2
        some = np.flatnonzero(code)
        some = some[np.argsort(rec["cid"][some], kind="stable")]
        owner = rec["cid"][some]
        at = np.flatnonzero(np.r_[True, np.diff(owner) != 0]) if len(owner) else np.empty(0, np.int64)
        out, must = [], []
        for i, j in zip(at, [*at[1:], len(owner)], strict=False):
            must.append(bool((code[some[i:j]] & 2).any()))
            out.append(rec["i"][some[i:j]].tobytes() + code[some[i:j]].tobytes())
        return pa.table({"cid": pa.array(owner[at], pa.int64()), "data": pa.array(out, pa.binary()), "must": pa.array(must, pa.bool_())})

    return parts.where(F.col("g") < _WINDOWS).select("g", "data").groupBy("g").applyInArrow(meet, "cid long, data binary, must boolean")


def _alike(parts: DataFrame) -> DataFrame:
    """(cid, data): the window hashes of common anchors that occur twice, of each chunk."""

    def meet(t: pa.Table) -> pa.Table:
        blobs = [x.as_buffer() for x in t.column("data")]
        n = np.array([x.size // 9 for x in blobs])
        h = np.concatenate([np.frombuffer(x, "<u8", k) for x, k in zip(blobs, n, strict=True)])
        more = np.concatenate([np.frombuffer(x, np.uint8, k, 8 * k) for x, k in zip(blobs, n, strict=True)])
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        hit = (count[inverse] > 1) | (more > 0)
        ends = np.cumsum(n)
        found = [h[j - k : j][hit[j - k : j]].tobytes() for j, k in zip(ends.tolist(), n.tolist(), strict=True)]
        t = pa.table({"cid": t.column("cid"), "data": pa.array(found, pa.binary())})
        return t.filter(pc.greater(pc.binary_length(t.column("data")), 0))

    return parts.where(F.col("g") >= _WINDOWS).select("g", "cid", "data").groupBy("g").applyInArrow(meet, "cid long, data binary")


def _codes(t: pa.Table, n: int) -> np.ndarray:
    """The code of each run of a chunk."""
    out = np.zeros(n, np.uint8)
    for x in t.column("data"):
        x = x.as_buffer()
        k = x.size // 5
        out[np.frombuffer(x, "<u4", k)] = np.frombuffer(x, np.uint8, k, 4 * k)
    return out


def _contexts(store: DataFrame, answers: DataFrame, shift: int, length: int, gram: int) -> DataFrame:
    """(g, cid, data): the contexts that must travel."""
    schema = "g long, cid long, data binary"

    def cut(chunk: pa.Table, codes: pa.Table) -> pa.Table:
        none = pa.table({"g": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        if not chunk.num_rows or not codes.num_rows:
            return none
        data, ends = _bytes(_unpack(chunk.column("docs")[0].as_buffer()))
        a, b, anchor, _ = runs(data, ends, length, gram)
        run = np.flatnonzero(_codes(codes, len(a)) & 2)
        if not len(run):
            return none

        def pack(x):
            own = run[x]
            text = b"".join(data[i:j].tobytes() for i, j in zip(a[own].tolist(), (b[own] + length).tolist(), strict=True))
            windows = (b[own] - a[own] + 1).astype("<u2")
            return np.uint32(len(own)).tobytes() + own.astype("<u4").tobytes() + windows.tobytes() + zstandard.ZstdCompressor(level=1).compress(text)

        return pa.Table.from_batches([_rows((anchor[run] >> _U(shift)).astype(np.int64), chunk.column("cid")[0].as_py(), pack)])

    wanted = answers.where("must").select("cid", "data")
    return store.select("cid", "docs").groupBy("cid").cogroup(wanted.groupBy("cid")).applyInArrow(cut, schema)


def _partial(contexts: DataFrame, length: int) -> DataFrame:
    """(cid, data): matched stretches (run, first, last window) of contexts, by the index family."""

    def meet(t: pa.Table) -> pa.Table:
        index, cids, owners, texts, places, keys, base = Levels(), t.column("cid").to_pylist(), [], [], [], [], 0
        for x in t.column("data"):
            x = x.as_buffer()
            k = int(np.frombuffer(x, "<u4", 1)[0])
            run, windows = np.frombuffer(x, "<u4", k, 4), np.frombuffer(x, "<u2", k, 4 + 4 * k).astype(np.int64)
            text = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[4 + 6 * k :].to_pybytes()), np.uint8)
            first = np.cumsum(windows + length - 1) - (windows + length - 1)
            inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            at = np.repeat(first, windows) + inside
            keys.append(window_hashes(text, length)[at])
            index.add(keys[-1])
            owners.append((run, windows))
            texts.append(text)
            places.append(at + base)
            base += len(text)
        matched = confirmed(np.concatenate(texts), np.concatenate(places), np.concatenate(keys), index.matched, length)
        out_cid, out, at = [], [], 0
        for cid, (run, windows) in zip(cids, owners, strict=True):
            n = int(windows.sum())
            hit = np.flatnonzero(matched[at : at + n])
            at += n
            if len(hit):
                own = np.repeat(np.arange(len(run)), windows)[hit]
                inside = hit - (np.cumsum(windows) - windows)[own]
                new = np.r_[True, (np.diff(own) != 0) | (np.diff(hit) != 1)]
                last = np.r_[np.flatnonzero(new)[1:], len(hit)] - 1
                out_cid.append(cid)
                out.append(np.array([run[own[new]], inside[new], inside[last]], "<u4").tobytes())
        return pa.table({"cid": pa.array(out_cid, pa.int64()), "data": pa.array(out, pa.binary())})

    return contexts.groupBy("g").applyInArrow(meet, "cid long, data binary")


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of stretches lo..hi as maximal ones."""
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.r_[True, lo[1:] > top[:-1]])
    return lo[new], top[np.r_[new[1:], len(lo)] - 1]


def _judged(docs: DataFrame, own: DataFrame, store: DataFrame, fresh: DataFrame, levels: DataFrame | None, hot: np.ndarray, batch: int, bits: int, length: int, gram: int, texts: bool) -> DataFrame:
    """The documents of a batch (chunks own, index fresh) against themselves and the levels of earlier batches; store: the chunks of all."""
    both = fresh.select("g", "data")
    known = save(_answers(both if levels is None else both.unionByName(levels)), "answers")
    parts = save(_partial(_contexts(store, known, 64 - bits, length, gram), length), "partial")
    alike = save(_alike(fresh), "alike")
    keep = [c for c in docs.columns if c not in ("text", "n_bytes", "n_removed", "n_spans", "kept_sha256")]
    extra = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * texts
    schema = docs.select(*keep).schema
    for field in extra.split(", "):
        schema = schema.add(*field.split())

    def remove(chunk: pa.Table, found: pa.Table) -> pa.Table:
        batch = _unpack(chunk.column("docs")[0].as_buffer())
        data, ends = _bytes(batch)
        a, b, anchor, context = runs(data, ends, length, gram)
        whole, part, alike = (found.filter(pc.field("part") == k) for k in range(3))
        full = np.flatnonzero((_codes(whole, len(a)) & 1).astype(bool) | _local(context)[2])
        lo, hi = [a[full]], [b[full] + length]
        for x in part.column("data"):
            run, first, last = np.frombuffer(x.as_buffer(), "<u4").reshape(3, -1).astype(np.int64)
            lo.append(a[run] + first)
            hi.append(a[run] + last + length)
        if alike.num_rows:
            at = np.flatnonzero(_among(anchor, hot))
            at = _places(a[at], b[at])
            known = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in alike.column("data")]))
            at = at[_among(window_hashes(data, length)[at], known)]
            lo.append(at)
            hi.append(at + length)
        lo, hi = np.concatenate(lo), np.concatenate(hi)
        own = np.searchsorted(ends, lo, "right")
        lo, hi = _spans(lo + own, hi + own) if len(lo) else (lo, hi)  # a gap between documents
        starts = np.r_[0, ends[:-1]]
        own = np.searchsorted(ends + np.arange(len(ends)), lo, "right")
        first = np.searchsorted(own, np.arange(len(ends) + 1))
        rows: list[tuple] = []
        for d, (i, j) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            cuts, at, kept = range(int(first[d]), int(first[d + 1])), i, []
            for c in cuts:
                kept.append(data[at : int(lo[c]) - d].tobytes())
                at = int(hi[c]) - d
            kept = b"".join([*kept, data[at:j].tobytes()])
            rows.append((j - i, j - i - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "ignore")] * texts))
        cols = [pa.array(x) for x in zip(*rows)]
        return pa.table([*(batch.column(c) for c in keep), *cols], names=[*keep, *(x.split()[0] for x in extra.split(", "))])

    part = lambda df, k: df.select("cid", "data", F.lit(k).alias("part"))
    found = part(known, 0).unionByName(part(parts, 1)).unionByName(part(alike, 2)).where(F.shiftright("cid", 48) == batch)
    return own.select("cid", "docs").groupBy("cid").cogroup(found.groupBy("cid")).applyInArrow(remove, schema)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs without text, with n_bytes, n_removed, n_spans, kept_sha256 (in place of columns of these names) and, if asked for, the kept bytes as text.

    What the removal leaves of a character that it cuts is dropped from text, not from kept_sha256.
    """
    store = chunks(docs, chunk_bytes)
    total, n = store.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bits, hot = max(6, (total // TEXT_A_GROUP).bit_length()), common(store, n, length, gram)
    fresh = save(_index(store, hot, bits, length, gram), "index")
    return _judged(docs, store, store, fresh, None, hot, 0, bits, length, gram, texts)


class Family:
    """Batches that arrive one after the other, in any session: each is judged against itself and all before it.

    Under path lie the chunks of every batch and the levels of the index, and a table that names them. A level holds the rows of
    about 2**level batches of ``base`` rows; a batch's own level merges with one of equal size as long as there is one.
    """

    def __init__(self, spark, path: str, length: int = LENGTH, gram: int = GRAM, base: int = 1 << 20, bits: int = 10):
        self.spark, self.path, self.length, self.gram, self.base, self.bits = spark, path.rstrip("/"), length, gram, base, bits  # the same in every session

    def _named(self) -> dict:
        """What the latest manifest names: batches, and [level, rows, table] of each level."""
        fs, jvm = self.spark._jsc.hadoopConfiguration(), self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not at.getFileSystem(fs).exists(at):
            return {"batches": 0, "levels": []}
        rows = self.spark.read.parquet(f"{self.path}/manifest").where("table is not null or level is null")
        last = rows.agg(F.max("batches")).first()[0]
        return {"batches": last, "levels": [(r.level, r.rows, r.table) for r in rows.where((F.col("batches") == last) & F.col("level").isNotNull()).collect()]}

    def _name(self, batches: int, levels: list[tuple]) -> None:
        rows = [(batches, *x) for x in levels] + [(batches, None, None, None)]
        self.spark.createDataFrame(rows, "batches long, level long, rows long, table string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def add(self, docs: DataFrame, texts: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
        """As dedup() gives it, for the documents of a new batch; an earlier batch is not judged again."""
        named = self._named()
        batch = named["batches"] + 1
        own = chunks(docs, chunk_bytes, batch, f"{self.path}/chunks-{batch}-{uuid.uuid4().hex}")
        store = own
        every = [own.inputFiles()[0].rpartition("/")[0]] if own.inputFiles() else []
        for _, _, table in named["levels"]:
            every += [x for x in table.split("|")[1:] if x]
        if every:
            store = self.spark.read.schema(own.schema).parquet(*every)
        none = np.empty(0, np.uint64)  # all anchors stay in the index, so that later batches find them
        fresh = save(_index(own, none, self.bits, self.length, self.gram), "index")
        levels = None
        for _, _, table in named["levels"]:
            level = self.spark.read.parquet(table.split("|")[0])
            levels = level if levels is None else levels.unionByName(level)
        out = save(_judged(docs, own, store, fresh, levels, none, batch, self.bits, self.length, self.gram, texts), "judged")
        self._keep(batch, fresh, named["levels"], every[:1])
        return out

    def _keep(self, batch: int, fresh: DataFrame, levels: list[tuple], chunks_of: list[str]) -> None:
        rows = fresh.select(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0] // _ROW.itemsize
        level, data, tables = max(0, (rows // self.base).bit_length()), fresh, chunks_of
        left = list(levels)
        while same := [x for x in left if x[0] == level]:  # equal levels merge
            left.remove(same[0])
            table, *more = same[0][2].split("|")
            data, tables, rows, level = data.select("g", "data").unionByName(self.spark.read.parquet(table)), tables + more, rows + same[0][1], level + 1
        path = f"{self.path}/level-{level}-{uuid.uuid4().hex}"
        _sorted(data).write.parquet(path)
        self._name(batch, [*left, (level, rows, "|".join([path, *tables]))])


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, unnest(range(octet_length(b) - 199)) AS i, b FROM d WHERE octet_length(b) >= 200),
s AS (SELECT rid, i, hash(array_slice(b, i + 1, i + 200)) AS k FROM w),
m AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS n FROM s) WHERE n > 1),
f AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM m),
g AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS island FROM f),
r AS (SELECT rid, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY rid, island),
q AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS before FROM r),
a AS (SELECT rid, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(CASE WHEN lo > before THEN hex(array_slice(b, before + 1, lo)) ELSE '' END, '' ORDER BY lo) AS kept FROM q JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || CASE WHEN octet_length(b) > coalesce(last, 0) THEN hex(array_slice(b, coalesce(last, 0) + 1, octet_length(b))) ELSE '' END)) AS kept_sha256 FROM d LEFT JOIN a USING (rid)
"""
