"""Best-fit packing of token ids with conflicts.

Documents are measured in token ids (the end id included) and cut into full bins and a rest where they are longer
than a bin. Pieces are dealt into shards of bounded size by a hash of their place in the table, so that repeated rows
spread; in a shard, pieces in descending size each go to the tightest open bin that fits and
that holds neither a document of the same source nor one of the same duplicate cluster. Bins stand in
lists by residual; a bit set of residuals in use gives the successor of a size, and the search goes on
through successors until a bin is compatible. A bin carries a bitmap of its sources and one of its
clusters; a residual keeps the intersection of its bins' source bitmaps, so that lists without any
compatible bin are passed in one step.

To find bins, only places and sizes travel; ``sequences`` then brings the token ids of each bin together. The conflict
over sources means that there are at least as many bins as pieces of the largest source in a shard;
``sources=False`` lifts it.

Defined cases: null and empty texts have the end id alone, conflict like others, and are in no cluster; null sources
are one source; repeated rows are one cluster, so they never share a bin; ties are broken by doc_id, then by the
number of the piece; ids may be of any type; very long texts become many pieces, which never share a bin; further
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies, token_files
from .store import save, table

CAPACITY, SHARD = 2048, 8192


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each piece, in the order given; sources and clusters are small numbers, -1: no conflict."""
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    common = [-1] * (capacity + 1)  # intersection of the source bitmaps of a residual's bins
    used = 0  # bit r: some bin has residual r
    bin_sources: list[int] = []
    bin_clusters: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 1 << source if source >= 0 else 0
        c = 1 << cluster if cluster >= 0 else 0
        found, left = -1, used >> size << size
        while left:
            r = (left & -left).bit_length() - 1
            if not common[r] & s:
                for at, b in enumerate(by_residual[r]):
                    if not bin_sources[b] & s and not bin_clusters[b] & c:
                        found = b
                        break
                if found >= 0:
                    break
            left &= left - 1
        if found < 0:
            found, r = len(bin_sources), capacity
            bin_sources.append(0)
            bin_clusters.append(0)
        else:
            by_residual[r].pop(at)
            if by_residual[r]:
                both = -1
                for b in by_residual[r]:
                    both &= bin_sources[b]
                common[r] = both
            else:
                used &= ~(1 << r)
                common[r] = -1
        bin_sources[found] |= s
        bin_clusters[found] |= c
        r -= size
        by_residual[r].append(found)
        common[r] &= bin_sources[found]
        used |= 1 << r
        out.append(found)
    return out


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """docs (doc_id, source, cluster, size) cut: with piece and n_tokens."""
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("long"))
    return docs.withColumn("piece", F.explode(cut)).withColumn("n_tokens", F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)).cast("long"))


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, sources: bool = True) -> DataFrame:
    """doc_id, row, piece, n_tokens, bin_id, bin_start for each piece of docs (doc_id, row, source, cluster, size)."""
    whole = save(pieces(docs.select("doc_id", "row", "source", "cluster", "size"), capacity).withColumn("_nth", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-whole.count() // shard))
    dealt = whole.withColumn("_shard", F.pmod(F.xxhash64("_nth"), F.lit(shards))).select("_shard", "doc_id", "row", "piece", "n_tokens", "source", "cluster")
    dealt = dealt.repartition("_shard").sortWithinPartitions("_shard", F.desc("n_tokens"), "doc_id", "piece", "cluster", "source", "row")
    zero = F.lit(0).cast("long")
    schema = whole.select("doc_id", "row", "piece", "n_tokens", zero.alias("bin_id"), zero.alias("bin_start")).schema

    def packed(t: pa.Table) -> pa.RecordBatch:
        size = t.column("n_tokens").to_numpy()
        small = [t.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in ("source", "cluster")]
        again = np.bincount(small[1])[small[1]] > 1  # a cluster of one conflicts with nothing
        rank = np.cumsum(np.bincount(small[1]) > 1) - 1
        cluster = np.where(again, rank[small[1]], -1)
        source = small[0] if sources else np.full(len(size), -1)
        bins = np.array(best_fit(size.tolist(), source.tolist(), cluster.tolist(), capacity), np.int64)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(size[order]) - size[order]
        new = np.r_[True, np.diff(bins[order]) != 0]
        start = np.empty(len(size), np.int64)
        start[order] = before - np.repeat(before[new], np.diff(np.r_[np.flatnonzero(new), len(size)]))
        cols = [*(t.column(c).combine_chunks() for c in ("doc_id", "row", "piece", "n_tokens")), pa.array(bins + (t.column("_shard")[0].as_py() << 32)), pa.array(start)]
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    def batches(it):
        held: list[pa.RecordBatch] = []
        for b in it:
            at = b.column("_shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j > i:
                    if held and held[-1].column("_shard")[0].as_py() != int(at[i]):
                        yield packed(pa.Table.from_batches(held))
                        held = []
                    held.append(b.slice(i, j - i))
        if held:
            yield packed(pa.Table.from_batches(held))

    return dealt.mapInArrow(batches, schema)


def measured(docs: DataFrame, tokenizer: str = token_files.TOKENIZER, end_id: int = token_files.END_ID) -> DataFrame:
    """A saved table: doc_id, row, source, ids (bytes), size (of them) and cluster, a hash of the words in lower case that exact copies share."""
    schema = docs.select("doc_id", "source", F.lit(None).cast("long").alias("cluster"), F.lit(0).cast("long").alias("size"), F.lit(b"").alias("ids")).schema

    def batches(it):
        code = token_files.encoder(tokenizer)
        for b in it:
            for lo in range(0, b.num_rows, token_files.DOCS_AT_ONCE):
                part = b.slice(lo, token_files.DOCS_AT_ONCE)
                ids, n = code.batch(part.column("text"), end_id)
                words, sizes = near_copies.words_of(part.column("text"))
                ends = np.cumsum(sizes).tolist()
                cluster = [xxhash.xxh64_intdigest(words[j - k : j].tobytes()) for j, k in zip(ends, sizes.tolist(), strict=True)]
                cluster = pa.array(np.array(cluster, np.uint64).view(np.int64), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), cluster, pa.array(n), token_files.as_bytes(ids, n)], names=schema.names)

    return save(docs.select("doc_id", "source", "text").mapInArrow(batches, schema).withColumn("row", F.monotonically_increasing_id()), "measured")


def sequences(packed: DataFrame, docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = token_files.TOKENIZER) -> DataFrame:
    """A row for each bin of what pack() made of docs: bin_id, ids (the token ids of its pieces, one after the other), doc_ids and starts (of the pieces)."""
    kind = token_files.encoder(tokenizer).kind
    at = F.col("piece") * capacity * kind.itemsize + 1
    cut = F.substring("ids", at.cast("int"), (F.col("n_tokens") * kind.itemsize).cast("int"))
    own = packed.join(docs.select("row", "ids"), "row").select("bin_id", F.struct("bin_start", "n_tokens", "doc_id", cut.alias("ids")).alias("p"))
    bins = own.groupBy("bin_id").agg(F.array_sort(F.collect_list("p")).alias("p"))  # a bin is bounded
    bins = bins.select("bin_id", F.aggregate("p.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.bin_start").alias("starts"))
    schema = bins.withColumn("ids", F.array(F.lit(0))).schema

    def batches(it):
        for b in it:
            data = b.column("ids")
            ends = np.cumsum([0, *(len(x.as_buffer()) // kind.itemsize for x in data)]).astype(np.int32)
            flat = np.frombuffer(b"".join(data.to_pylist()), kind).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("bin_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), b.column("doc_ids"), b.column("starts")], names=schema.names)

    return bins.mapInArrow(batches, schema)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(measured(table(spark, sf_dir, "documents"))).drop("row")
