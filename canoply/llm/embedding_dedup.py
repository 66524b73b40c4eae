"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Vectors that are equal in label and components form a class (an aggregation with map-side combine), so
groups of copies cost one row. The classes of a label are dealt into blocks by hash; every pair of
blocks is a task. There unit vectors x are held as s*q, q in int8, with e = |x - s*q|. As
|x.y - s*t*q.r| <= |s*q|*f + e*|t*r| + e*f for vectors (s, q, e) and (t, r, f), only pairs whose int8
product lies within that bound of the threshold can reach it; those alone are computed in double
precision. Tasks return counts and spanning forests, not pairs.

Work inside a label grows with the square of its distinct vectors, as an exact search by this method
does; it is spread over tasks of bounded memory.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors
with a null label, link with nothing; vectors of different length don't link; repeated rows link with
each other; null ids count as links but are no component id unless there is no other; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import forest, rooted
from .store import save, table

THRESHOLD, BLOCK = 0.98, 2048


def quantised(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows x: unit rows, int8 codes, scales, norms of the coded vectors and of what they miss."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return unit, codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def linked(x: np.ndarray, y: np.ndarray | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of rows of x and y with cosine >= threshold; y None: pairs i < j of x."""
    own, y = y is None, x if y is None else y
    a, b = quantised(x), quantised(y)
    wide = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # both hold the products exactly
    right = b[1].astype(wide)
    found_i, found_j = [], []
    for lo in range(0, len(x), 1024):
        _, codes, scale, norm, miss = (v[lo : lo + 1024] for v in a)
        product = (codes.astype(wide) @ right.T) * scale[:, None] * b[2]
        bound = norm[:, None] * b[4] + miss[:, None] * (b[3] + b[4])
        i, j = np.nonzero(product + bound >= threshold - 1e-6)
        i += lo
        if own:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 18):
            p, q = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            exact = np.einsum("nd,nd->n", a[0][p], b[0][q]) >= threshold
            found_i.append(p[exact])
            found_j.append(q[exact])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.empty(0, np.int64), np.empty(0, np.int64))


def tile_links(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Of classes (_id, label, _dim, vector, _n): rows (a, b, n), where b null counts n links of a and others are a forest."""
    sizes = save(classes.groupBy(F.col("label").alias("_label"), F.col("_dim").alias("_d")).agg(F.ceil(F.count("*") / block).cast("int").alias("_parts")), "labels")
    met = classes.join(sizes, (F.col("label") == F.col("_label")) & (F.col("_dim") == F.col("_d")))
    dealt = (
        met.withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .select("label", "_dim", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), F.col("_own").alias("own"), "_id", "_n", "vector")
    )

    def tile(t: pa.Table) -> pa.Table:
        ids, n, own = (t.column(c).to_numpy() for c in ("_id", "_n", "own"))
        x = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        if lo == hi:
            i, j = linked(x, None, threshold)
        else:
            p, q = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            i, j = linked(x[p], x[q], threshold)
            i, j = p[i], q[j]
        count = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
        some = np.flatnonzero(count)
        u, v = forest(ids[i], ids[j]) if len(i) else (ids[:0], ids[:0])
        a = pa.array(np.concatenate([ids[some], u]))
        b = pa.array(np.concatenate([np.zeros(len(some), np.int64), v]), mask=np.arange(len(a)) < len(some))
        return pa.table({"a": a, "b": b, "n": np.concatenate([count[some].astype(np.int64), np.zeros(len(u), np.int64)])})

    return dealt.groupBy("label", "_dim", "lo", "hi").applyInArrow(tile, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    e = F.col("embedding")
    zero = F.lit(0.0).cast(vectors.schema["embedding"].dataType.elementType)  # vectors travel as they are stored, tiles compute in double
    odd = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & ~odd & F.exists(e, lambda v: v != 0), F.lit(False))
    v = vectors.select("vec_id", "label", F.when(good, F.transform(e, lambda x: x + zero)).alias("vector"))  # -0.0 becomes 0.0
    classes = v.where("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("_least"), F.count("*").alias("_n"))
    classes = save(classes.withColumn("_dim", F.size("vector")).withColumn("_id", F.monotonically_increasing_id()), "vectors")
    found = save(tile_links(classes, threshold, block), "tiles")
    counts = save(found.where("b is null").groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("_links")), "counts")
    known = rooted(classes, found.where("b is not null"), "_id", "_least")
    known = known.join(counts, F.col("_id") == F.col("_a"), "left").select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), (F.col("_n") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"), "component")
    known = save(known, "linked")
    out = v.join(known, (v["label"] == F.col("_label")) & (v["vector"] == F.col("_vector")), "left")
    component = F.when(F.col("_label").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
