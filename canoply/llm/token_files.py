"""Token ids in binary shards with a minimal perfect hash index.

Documents are encoded where they lie, in Arrow batches; only ids travel. They are dealt to ranges of doc_id,
of which a hot id may fill several, and sorted; each task cuts its run into shards of bounded size. A shard is one raw file: header, the documents' ids and starts, then the token ids
as little-endian integers. Spark's text writer puts a shard's bytes down as one value, so files go to any
file system under its commit protocol. Keys are hashed into buckets of bounded size; each bucket has
a minimal perfect hash (levels of bit arrays, slot = rank of the key's bit) whose slots hold a stored
fingerprint and the places (shard, row, byte, ids) of the key: a lookup costs a constant number of probes,
and ``Reader`` then seeks to the bytes of that document alone.

Encoding works on the distinct pieces of a batch: as no token of the byte-level pre-tokenizer's pattern runs
from a character that isn't white space into a blank or line break after it, a text may be cut there and its
pieces encoded alone; texts where such a cut isn't certain are cut elsewhere or encoded whole, and so are all texts of a
tokenizer with another pre-tokenizer or a normaliser. The cache of pieces only saves work.

Defined cases: a null text is encoded as the empty one (only the end id); null ids come first and share
a key; documents with equal ids stand next to each other, and a lookup of the id gives all of them; very long
texts are encoded whole and may fill a shard alone; an empty table gives no shards and an empty result;
further columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import lean, new_path, save, table

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
DOCS_AT_ONCE, IDS_A_SHARD, BYTES_A_TASK, KEYS_A_BUCKET, CACHED, WORDS_AT_ONCE = 1024, 1 << 22, 64 << 20, 1 << 14, 500_000, 512
MAGIC, INDEX_MAGIC = b"CNPIDS02", b"CNPMPH02"

#: Characters that are white space for no engine; a blank after one of them begins a token.
_SOLID = "!-~¡-ᙿ⁰-⿿、-퟿"
_ENDS = re.compile(f"[{_SOLID}]")
_CUTS = re.compile(f"(?<=[{_SOLID}])(?=[ \n])")
#: A word of Latin letters and then marks: two tokens of the pre-tokenizer's pattern.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ɏ]", "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_PLAIN = f"^{_LETTERS}+[{re.escape(_MARKS)}]*$"


class Pieces:
    """Ids of known pieces, one after the other."""

    def __init__(self, kind: np.dtype):
        self.ids, self.used = np.empty(1 << 16, kind), 0
        self.start, self.size, self.whole, self.n = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), np.empty(1 << 14, bool), 0
        self.known: dict[str, int] = {}

    def add(self, flat: np.ndarray, size: np.ndarray, whole: list[bool]) -> int:
        """The number of the first of these, size ids each; whole: a cut may follow."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.n + len(size) > len(self.start):
            self.start, self.size, self.whole = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size, self.whole))
        self.ids[self.used : self.used + len(flat)] = flat
        new = slice(self.n, self.n + len(size))
        self.start[new], self.size[new], self.whole[new] = self.used + np.cumsum(size) - size, size, whole
        self.used += len(flat)
        self.n += len(size)
        return new.start

    def joined(self, codes: np.ndarray) -> np.ndarray:
        size = self.size[codes]
        return self.ids[np.repeat(self.start[codes] - np.cumsum(size) + size, size) + np.arange(size.sum())]


class Encoder:
    """Encodes texts to arrays of ids of type .kind."""

    def __init__(self, name: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        size = max(self.tok.get_vocab(with_added_tokens=True).values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        made = json.loads(self.tok.to_str())
        before = made["pre_tokenizer"] or {}
        self.plain = made["normalizer"] is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        # byte-level alphabet: a byte that prints stands for itself, the others follow from 256 on
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in prints)}
        self.begins = np.zeros(size, bool)  # tokens that begin with a blank
        self.begins[[i for t, i in self.tok.get_vocab(with_added_tokens=True).items() if t.startswith(chr(self.alphabet[32]))]] = True
        self.blank, self.line, self.model = chr(self.alphabet[32]), chr(self.alphabet[10]), self.tok.model
        self.forget()

    def forget(self) -> None:
        self.pieces = Pieces(self.kind)
        self.loose: dict[str, list[int]] = {}  # pieces with all their white space

    def all(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        return np.array(self.all([text])[0], self.kind).tobytes()

    def slow(self, text: str) -> list[int]:
        """Cut before white space that follows something solid; pieces keep their white space."""
        if not self.plain or any(s in text for s in self.special):
            return self.all([text])[0]
        parts = _CUTS.split(text)
        new = [p for p in dict.fromkeys(parts) if p not in self.loose]
        self.loose.update(zip(new, self.all(new), strict=True))
        return [i for p in parts for i in self.loose[p]]

    def model_ids(self, text: str) -> list[int]:
        """Ids of one token of the pre-tokenizer."""
        if text.isascii():  # only the blank or line break before a word isn't its own sign
            signs = self.blank + text[1:] if text[:1] == " " else self.line if text == "\n" else text
        else:
            signs = text.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.model.tokenize(signs)]

    def laid(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The lists one after the other, and their sizes."""
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), self.kind, int(size.sum())), size

    def worded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, a blank and then letters alone each: as one text, which is cut where a token begins with a blank."""
        texts = ["".join(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        if not any(s in t for s in self.special for t in texts):
            flat, _ = self.laid(self.all(texts))
            at = np.flatnonzero(self.begins[flat])
            if len(at) == len(words):
                return flat, np.diff(at, append=len(flat))
        return self.laid([self.model_ids(w) for w in words])

    def codes(self, texts: pa.Array, single: bool) -> np.ndarray:
        """The numbers of texts among the known pieces; single: each is one token of the pre-tokenizer (letters alone, if it begins with a blank), or empty."""
        keys, known = texts.to_numpy(zero_copy_only=False).tolist(), self.pieces.known
        found = np.fromiter(map(known.get, keys, repeat(-1)), np.int64, len(keys))
        miss = np.flatnonzero(found < 0)
        if len(miss):
            wanted = [keys[i] for i in miss.tolist()]
            new = list(dict.fromkeys(wanted))
            if single:
                words = [k for k in new if k[:1] == " "]
                rest = [k for k in new if k[:1] != " "]
                new, whole = words + rest, [True] * len(words) + [k != "\n" for k in rest]
                flat, size = (np.concatenate(x) for x in zip(self.worded(words), self.laid([self.model_ids(k) for k in rest]), strict=True))
            else:
                whole = [not k or bool(_ENDS.match(k, len(k) - 1)) for k in new]
                flat, size = self.laid(self.all(new))
            first = self.pieces.add(flat, size, whole)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            found[miss] = np.fromiter(map(known.__getitem__, wanted), np.int64, len(wanted))
        return found

    def parts(self, pieces: pa.Array, head: bool) -> np.ndarray:
        """Of pieces (what follows a blank or begins with a line break; head: what begins a text) a row of three numbers: line break, word, marks."""
        line = pc.and_(pc.starts_with(pieces, "\n"), not head)
        body = pc.if_else(line, pc.utf8_slice_codeunits(pieces, 1), pieces)
        simple = pc.match_substring_regex(body, _PLAIN)
        blank = pc.if_else(pc.or_(line, head), "", " ")
        out = np.empty((len(pieces), 3), np.int32)
        out[:] = self.codes(pa.array([""]), True)
        at = np.flatnonzero(simple.to_numpy(zero_copy_only=False))
        own = body.take(pa.array(at))
        marks = pc.replace_substring_regex(own, f"^{_LETTERS}+", "")
        word = pc.utf8_rtrim(own, _MARKS)
        out[at[line.take(pa.array(at)).to_numpy(zero_copy_only=False)], 0] = self.codes(pa.array(["\n"]), True)
        out[at, 1] = self.codes(pc.binary_join_element_wise(blank.take(pa.array(at)), word, ""), True)
        named = marks.dictionary_encode()  # few
        out[at, 2] = self.codes(named.dictionary, True)[named.indices.to_numpy()]
        at = np.flatnonzero(~simple.to_numpy(zero_copy_only=False))
        own = pieces.take(pa.array(at))
        if not head:
            own = pc.binary_join_element_wise(blank.take(pa.array(at)), own, "")
        full = np.flatnonzero(pc.not_equal(own, "").to_numpy(zero_copy_only=False))
        out[at[full], 1] = self.codes(own.take(pa.array(full)), False)
        return out

    def batch(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has; end is put after each text."""
        if self.pieces.n + len(self.loose) > CACHED:
            self.forget()
        texts = pc.fill_null(texts, "")
        odd = np.array([not self.plain] * len(texts), bool)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        easy = pc.if_else(pa.array(odd), "", texts)
        cut = pc.split_pattern(pc.replace_substring(easy, "\n", " \n"), " ")
        named = cut.flatten().dictionary_encode()
        size = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = self.parts(named.dictionary, False)[named.indices.to_numpy()]
        last = np.cumsum(size) - 1
        first = last - size + 1
        codes[first] = self.parts(named.dictionary.take(named.indices.take(pa.array(first))), True)
        doc = np.repeat(np.arange(len(size)), size)
        unsure = ~self.pieces.whole[codes[:, 1]]
        unsure[last] = False  # nothing follows
        odd[doc[unsure]] = True
        n = np.bincount(doc, self.pieces.size[codes].sum(axis=1), len(size)).astype(np.int64)
        ids = self.pieces.joined(codes.ravel())
        if end is not None:
            ids, n = np.insert(ids, np.cumsum(n), end), n + 1
        if odd.any():
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i in np.flatnonzero(odd).tolist():
                parts[i] = np.array(self.slow(texts[i].as_py()) + ([] if end is None else [end]), self.kind)
            ids, n = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, n

    def one(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].tobytes()


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


_HEAD = struct.calcsize("<8sqQQQ")


def shard_bytes(shard: int, width: int, keys: pa.Array, sizes: np.ndarray, payload: bytes) -> bytes:
    null = keys.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    ids = keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    head = struct.pack("<8sqQQQ", MAGIC, shard, len(keys), int(starts[-1]), width)
    return b"".join([head, ids.tobytes(), null.tobytes(), starts.tobytes(), payload])


def open_shard(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """shard, keys, null flags, starts (one more than documents) and ids."""
    magic, shard, n, total, width = struct.unpack_from("<8sqQQQ", data)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at = _HEAD
    keys = np.frombuffer(data, "<i8", n, at)
    null = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(bool)
    starts = np.frombuffer(data, "<u8", n + 1, at + 9 * n).astype(np.int64)
    return shard, keys, null, starts, np.frombuffer(data, f"<u{width}", total, at + 9 * n + 8 * (n + 1))


def as_bytes(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """The ids of each text as a binary value."""
    at = pa.py_buffer(np.concatenate([[0], np.cumsum(n) * ids.itemsize]).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, at, pa.py_buffer(ids)]).cast(pa.binary())


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, place=None) -> DataFrame:
    """(doc_id, row, ids, n, task) of docs (doc_id, text): ids as bytes, the end id last; place(doc_id, row) gives the task."""
    schema = "doc_id long, row long, ids binary, n long, task int"

    def batches(it):
        code = encoder(tokenizer)
        for b in it:
            for lo in range(0, b.num_rows, DOCS_AT_ONCE):
                part = b.slice(lo, DOCS_AT_ONCE)
                ids, n = code.batch(part.column("text"), end_id)
                task = place(part.column("doc_id"), part.column("row").to_numpy()) if place else np.zeros(len(n))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), as_bytes(ids, n), pa.array(n), pa.array(task.astype(np.int32))], names=["doc_id", "row", "ids", "n", "task"])

    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(batches, schema)


def ranges(docs: DataFrame, task_bytes: int) -> tuple[int, Callable]:
    """The number of tasks, of about task_bytes of text, and what deals ids to them in ascending order (null first).

    Borders between tasks come from a sample of the ids; an id that is a border goes to the tasks on both sides of it, and null to
    as many tasks as its share asks for, so that no id is too much for a task.
    """
    size, n, none = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    tasks = max(1, -(-size // task_bytes))
    for_null = -(-tasks * none // n) if n else 0
    share = [(i + 1) / (tasks - for_null) for i in range(tasks - for_null - 1)]
    some = docs.select("doc_id").where("doc_id is not null").sample(min(1.0, 200 * tasks / max(n, 1)), seed=1)
    got = some.agg(F.percentile_approx("doc_id", share, 100 * tasks)).first()[0] if share else None
    borders = np.array(got or [], np.int64)

    def place(ids: pa.Array, row: np.ndarray) -> np.ndarray:
        key = ids.fill_null(0).to_numpy(zero_copy_only=False)
        lo, hi = np.searchsorted(borders, key, "left"), np.searchsorted(borders, key, "right")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), row % max(for_null, 1), for_null + lo + row % (hi - lo + 1))

    return for_null + len(borders) + 1, place


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_ids: int = IDS_A_SHARD, task_bytes: int = BYTES_A_TASK) -> int:
    """Shards of docs (doc_id, text) under path, in ascending doc_id order (null first); gives the number of tasks."""
    tasks, place = ranges(docs, task_bytes)
    rows = encoded(docs, tokenizer, end_id, place).repartitionById(tasks, "task")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row").select("doc_id", "ids", "n")

    def shards(it):
        kind = encoder(tokenizer).kind
        number = TaskContext.get().partitionId() << 24
        held, have = [], 0

        def done():
            t = pa.Table.from_batches(held)
            data = shard_bytes(number, kind.itemsize, t.column("doc_id").combine_chunks(), t.column("n").to_numpy(), b"".join(t.column("ids").to_pylist()))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([data], pa.binary())], names=["shard", "value"])

        for b in it:
            total = have + np.cumsum(b.column("n").to_numpy())
            lo = 0
            while lo < b.num_rows and total[-1] >= shard_ids:
                cut = int(np.searchsorted(total, shard_ids)) + 1
                held.append(b.slice(lo, cut - lo))
                yield done()
                number, held, total, lo = number + 1, [], total - total[cut - 1], cut
            if lo < b.num_rows:
                held.append(b.slice(lo))
            have = int(total[-1]) if len(total) else have
        if held:
            yield done()

    _put(rows.mapInArrow(shards, "shard long, value binary"), "shard", path)
    return tasks


def _put(files: DataFrame, by: str, path: str) -> None:
    """Each value (bytes) as a file in a folder of its number."""
    with lean(files.sparkSession):
        files.select(by, F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").partitionBy(by).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the shards: doc_id, shard, row, byte (where its ids begin in the file), local (ids before it in its shard), n_tokens, ids_crc32."""
    schema = "doc_id long, shard long, row long, byte long, local long, n_tokens long, ids_crc32 long"

    def rows(it):
        for b in it:
            for data in b.column("content"):
                shard, keys, null, starts, ids = open_shard(data.as_buffer())
                wide = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(wide[4 * i : 4 * j]) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                n = len(keys)
                cols = [pa.array(keys, mask=null), np.full(n, shard), np.arange(n), _HEAD + 17 * n + 8 + starts[:-1] * ids.itemsize, starts[:-1], np.diff(starts), np.array(crc, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[x.split()[0] for x in schema.split(", ")])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content").mapInArrow(rows, schema)


# The index.


def _mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """64 well mixed bits of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct keys to 0..n-1. A key's slot is the rank of its bit in the first level where no other key fell on it."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.base = np.concatenate([[0], np.cumsum([int(x.sum()) for x in levels])])
        self.ranks = [np.cumsum(x) - 1 for x in levels]

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            at = (_mix(left, len(levels) + 1) % np.uint64(2 * len(left) + 1)).astype(np.int64)
            once = np.bincount(at, minlength=2 * len(left) + 1) == 1
            levels.append(once)
            left = left[~once[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that surely are not in it."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, level in enumerate(self.levels):
            at = (_mix(keys[left], i + 1) % np.uint64(len(level))).astype(np.int64)
            hit = level[at]
            out[left[hit]] = self.base[i] + self.ranks[i][at[hit]]
            left = left[~hit]
        return out


def index_bytes(bucket: int, keys: np.ndarray, *places: np.ndarray) -> bytes:
    """An index bucket; keys may repeat, with a place each: here (shard, row, byte, ids)."""
    distinct = np.unique(keys)
    h = PerfectHash.of(distinct)
    slot = h.slots(keys)
    order = np.argsort(slot, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=len(distinct)))]).astype("<u8")
    prints = np.zeros(len(distinct), "<u4")
    prints[slot] = _mix(keys, 0) >> np.uint64(32)
    head = struct.pack("<8sqQQQQ", INDEX_MAGIC, bucket, len(distinct), len(keys), len(h.levels), len(places))
    bits = [np.packbits(x).tobytes() for x in h.levels]
    sizes = np.array([len(x) for x in h.levels], "<u8").tobytes()
    return b"".join([head, sizes, *bits, prints.tobytes(), first.tobytes(), *(x[order].astype("<i8").tobytes() for x in places)])


class Index:
    """Opened index bucket."""

    def __init__(self, data: bytes):
        magic, self.bucket, n, m, levels, places = struct.unpack_from("<8sqQQQQ", data)
        if magic != INDEX_MAGIC:
            raise ValueError("not an index bucket")
        at = _HEAD + 8
        sizes = np.frombuffer(data, "<u8", levels, at).tolist()
        at += 8 * levels
        bits = []
        for size in sizes:
            width = -(-size // 8)
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size).astype(bool))
            at += width
        self.hash = PerfectHash(bits)
        self.prints = np.frombuffer(data, "<u4", n, at)
        self.first = np.frombuffer(data, "<u8", n + 1, at + 4 * n).astype(np.int64)
        at += 4 * n + 8 * (n + 1)
        self.places = [np.frombuffer(data, "<i8", m, at + 8 * m * i) for i in range(places)]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of keys: the number of each hit, and its place."""
        slot = self.hash.slots(keys)
        hit = np.flatnonzero(slot >= 0)
        hit = hit[self.prints[slot[hit]] == (_mix(keys[hit], 0) >> np.uint64(32))]
        lo, n = self.first[slot[hit]], np.diff(self.first)[slot[hit]]
        place = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n) + np.arange(n.sum())
        return np.repeat(hit, n), *(p[place] for p in self.places)


def key_bits(column) -> np.ndarray:
    """Ids as 64-bit keys; null has a key of its own that no other id is given in practice."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).view(np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(keys, 1 << 20) % np.uint64(buckets)).astype(np.int64)


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """rows with their index bucket."""

    def batches(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(key_bits(b.column("doc_id")), buckets)), *b.columns], names=["bucket", *b.schema.names])

    schema = rows.select(F.lit(0).cast("long").alias("bucket"), "*").schema
    return rows.mapInArrow(batches, schema)


_PLACE = ["shard", "row", "byte", "n_tokens"]


def write_index(places: DataFrame, path: str, buckets: int) -> None:
    """Index buckets of places (doc_id, shard, row, byte, n_tokens) under path. Places of one id are one key of one bucket, by which they are held."""
    dealt = _dealt(places.select("doc_id", *_PLACE), buckets).repartition("bucket").sortWithinPartitions("bucket", "doc_id", "shard", "row")

    def build(it):
        held: list[pa.RecordBatch] = []

        def done():
            t = pa.Table.from_batches(held)
            number = t.column("bucket")[0].as_py()
            data = index_bytes(number, key_bits(t.column("doc_id")), *(t.column(c).to_numpy() for c in _PLACE))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([data], pa.binary())], names=["bucket", "value"])

        for b in it:
            at = b.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    if held and held[-1].column("bucket")[0].as_py() != int(at[i]):
                        yield done()
                        held = []
                    held.append(b.slice(i, j - i))
        if held:
            yield done()

    _put(dealt.mapInArrow(build, "bucket long, value binary"), "bucket", path)


def lookup(keys: DataFrame, path: str, buckets: int) -> DataFrame:
    """(doc_id, shard, row, byte, n_tokens) of every document whose doc_id is in keys (distinct), by the index under path."""
    index = keys.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select(F.regexp_extract("path", "bucket=([0-9]+)", 1).cast("long").alias("bucket"), "content")
    kinds = pa.schema([(c, pa.int64()) for c in ["doc_id", *_PLACE]])

    def find(own: pa.Table, blob: pa.Table) -> pa.Table:
        if not own.num_rows or not blob.num_rows:
            return kinds.empty_table()
        hit, *places = Index(blob.column("content")[0].as_py()).find(key_bits(own.column("doc_id")))
        return pa.table([own.column("doc_id").take(pa.array(hit)), *map(pa.array, places)], schema=kinds)

    return _dealt(keys.select("doc_id"), buckets).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(find, ", ".join(f"{c} long" for c in kinds.names))


class Reader:
    """Keyed access to shards: a probe of one index bucket, then a seek to the ids of the document alone."""

    def __init__(self, spark: SparkSession, path: str, index: str, buckets: int, tokenizer: str = TOKENIZER):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path, self.index, self.buckets, self.kind = path, index, buckets, encoder(tokenizer).kind
        self.bucket = lru_cache(maxsize=64)(self._bucket)

    def _file(self, folder: str):
        """The file system and the one file with content in a folder; None if there is no such folder."""
        at = self.jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(self.conf)
        files = [f for f in fs.listStatus(at) if f.getLen() and f.getPath().getName().startswith("part-")] if fs.exists(at) else []
        return (fs, files[0]) if files else None

    def _bytes(self, fs, file, start: int, size: int) -> bytes:
        stream = fs.open(file.getPath())
        try:
            stream.seek(start)
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
        finally:
            stream.close()

    def _bucket(self, number: int) -> Index | None:
        got = self._file(f"{self.index}/bucket={number}")
        return Index(self._bytes(*got, 0, got[1].getLen())) if got else None

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of that id."""
        key = key_bits(pa.array([doc_id], pa.int64()))
        bucket = self.bucket(int(bucket_of(key, self.buckets)[0]))
        if bucket is None:
            return []
        out, width = [], self.kind.itemsize
        for shard, _, byte, n in zip(*(x.tolist() for x in bucket.find(key)[1:]), strict=True):
            data = self._bytes(*self._file(f"{self.path}/shard={shard}"), byte, n * width)
            out.append(np.frombuffer(data, self.kind))
        return out


def with_starts(rows: DataFrame, tasks: int) -> DataFrame:
    """rows with start: ids in all shards before, plus local. Sums run over the tasks of a group, then over about sqrt(tasks) groups."""
    size = max(1, int(tasks**0.5))
    totals = save(rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")), "shards").withColumn("group", F.floor(F.shiftright("shard", 24) / size))
    groups = totals.groupBy("group").agg(F.sum("n").alias("n")).select(F.col("group").alias("g"), F.coalesce(F.sum("n").over(W.orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = totals.withColumn("inside", F.coalesce(F.sum("n").over(W.partitionBy("group").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    starts = save(local.join(groups, F.col("group") == F.col("g")).select(F.col("shard").alias("_shard"), (F.col("before") + F.col("inside")).alias("before")), "starts")
    return rows.join(starts, F.col("shard") == F.col("_shard")).withColumn("start", F.col("before") + F.col("local")).drop("_shard", "before")


def build(docs: DataFrame, path: str, index: str) -> tuple[DataFrame, int, int]:
    """Shards and index of docs; a row for each document as read back from the shards, the number of tasks and of index buckets."""
    tasks = write(docs, path)
    rows = save(read(docs.sparkSession, path), "rows")
    buckets = max(1, -(-rows.count() // KEYS_A_BUCKET))
    write_index(rows, index, buckets)
    return rows, tasks, buckets


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, index = new_path(spark, "ids"), new_path(spark, "index")
    rows, tasks, buckets = build(docs, path, index)
    found = save(lookup(docs.select("doc_id").distinct(), index, buckets).select("shard", "row"), "found")
    return with_starts(rows, tasks).join(found, ["shard", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")
