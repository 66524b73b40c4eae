"""Quality classifier: random Fourier features, ridge from partition sums, isotonic calibration.

A text becomes a fixed vector of statistics (never its label, language, source or id). Cosines of random
projections of the standardised vector approximate a Gaussian kernel. Each partition sums its normal
equations over the labelled rows that may be learned from; sums are whole numbers (fixed point), so they
do not depend on the order of rows or partitions and reruns agree. Only sums of fixed size reach the
driver. Isotonic calibration pools training scores in BINS bins before the driver sees them.

All labelled rows outside the held-out fold are used; there is no sample.

Defined cases: null texts count as empty, and empty texts have statistics like any other; rows with a
null id are neither learned from nor held out; of several labels of a document the mean counts; without
any label every score is 1.0 (nothing speaks against a text); an empty table gives an empty result;
further columns are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import save, table

FEATURES, RIDGE, SEED, BINS, CUT = 256, 1e-4, 7, 4096, 0.7
_FIX, _STAT = 1 << 12, 1 << 16
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_OTHERS = np.frombuffer(b"\"'()-/:;?@[]_{}~`^\\+=", np.uint8)
_ENDED = re.compile(rb"[.!?,](?=\s|$)")
N_STATS = 20


def statistics(text: str | None) -> np.ndarray:
    """N_STATS numbers about a whole text, all from -20 to 20 or so."""
    data = (text or "").encode("utf-8", "surrogatepass")
    byte = np.zeros(256, np.int64)
    for i in range(0, len(data), 1 << 20):
        byte += np.bincount(np.frombuffer(data, np.uint8, min(1 << 20, len(data) - i), i), minlength=256)
    words = data.lower().split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, size, m = max(len(words), 1), max(len(data), 1), max(len(lines), 1)
    upper, lower, high = byte[65:91].sum(), byte[97:123].sum(), byte[128:].sum()
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    return np.array(
        [
            np.log1p(len(words)), np.log1p(len(data)), np.log(size / n), len(set(words)) / n, pairs / max(n - 1, 1),
            np.log1p(len(lines)), np.log(n / m), 1 - len(set(lines)) / m, upper / max(upper + lower, 1), high / size,
            byte[48:58].sum() / n, np.log1p(byte[_SYMBOLS].sum() / n), np.log1p(byte[33] / n), byte[46] / n, byte[44] / n,
            np.log1p(byte[124] / n), np.log1p(byte[_OTHERS].sum() / n), byte[32] / size, len(_ENDED.findall(data)) / n, float(not words),
        ]
    )


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray | None
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Rows of whole numbers: FEATURES cosines and a one, times _FIX."""
        rng = np.random.default_rng(SEED)
        w = rng.standard_normal((stats.shape[1], FEATURES)) / np.sqrt(stats.shape[1])
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.rint(np.cos(x @ w + phase) * _FIX), np.full((len(x), 1), float(_FIX))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta / _FIX

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.ones(len(stats))
        return np.round(np.interp(self.raw(stats), *self.steps), 9)


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs without text but with _stats."""
    keep = [c for c in docs.columns if c not in ("text", "_stats")]
    schema = docs.select(*keep, F.array(F.lit(0.0)).alias("_stats")).schema

    def batches(it):
        for b in it:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_STATS, dtype=np.int32), x.ravel())], names=[*keep, "_stats"])

    return docs.select(*keep, "text").mapInArrow(batches, schema)


def _matrix(b) -> np.ndarray:
    return b.column("_stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def _partition_sums(rows: DataFrame, per_batch) -> np.ndarray | None:
    """The sum of per_batch(stats, y), a vector of whole numbers, over all rows; partitions add up first."""

    def part(it):
        total = None
        for b in it:
            if b.num_rows:
                x = per_batch(_matrix(b), b.column("y").to_numpy())
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["v"])

    def whole(it):
        total = None
        for b in it:
            for v in b.column("v"):
                x = np.frombuffer(v.as_buffer(), "<i8")
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    parts = rows.mapInArrow(part, "v binary")
    for n in (64, 1):
        parts = parts.repartition(n).mapInArrow(whole, "v binary")
    found = parts.collect()
    return np.frombuffer(bytes(found[0].v), "<i8") if found else None


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the mean of each pool at its mean x."""
    pools: list[list[float]] = []
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist(), strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """From stats (doc_id, _stats) and labels (doc_id, quality), outside the held-out fold."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.avg("quality").alias("y"))
    rows = save(stats.where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("_id")).select("_stats", "y", calibrates(F.col("doc_id")).alias("fold")), "labelled")

    def moments(x, y):
        v = np.rint(x * _STAT)
        return np.concatenate([[len(x)], v.sum(0), np.rint(x * x * _STAT).sum(0)])

    sums = _partition_sums(rows, moments)
    if sums is None:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), None, (np.zeros(1), np.ones(1)))
    n, mean = sums[0], sums[1 : N_STATS + 1] / _STAT / sums[0]
    scale = np.sqrt(np.maximum(sums[N_STATS + 1 :] / _STAT / n - mean**2, 1e-4))
    model = Model(mean, scale, None, (np.zeros(1), np.ones(1)))
    d = FEATURES + 1

    def normal(x, y):
        z = model.features(x)
        out = np.zeros((d, d + 1), np.int64)
        for i in range(0, len(z), 1 << 16):  # whole numbers that a double holds
            p = z[i : i + (1 << 16)]
            out += np.hstack([p.T @ p, (p.T @ np.rint(y[i : i + (1 << 16)] * _FIX))[:, None]]).astype(np.int64)
        return out.ravel()

    sums = _partition_sums(rows.where("not fold"), normal)
    halves = sums is not None and not rows.where("fold").isEmpty()
    if not halves:
        sums = _partition_sums(rows, normal)
    sums = sums.reshape(d, d + 1) / float(_FIX * _FIX)
    ridge = RIDGE * sums[-1, -2] * np.eye(d)
    ridge[-1, -1] = 0
    beta = np.linalg.solve(sums[:, :d] + ridge, sums[:, d])
    model = Model(mean, scale, beta, (np.zeros(1), np.ones(1)))

    def binned(it):
        for b in it:
            at = np.clip(np.floor((model.raw(_matrix(b)) + 0.5) * (BINS / 2)), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.rint(b.column("y").to_numpy() * _FIX).astype(np.int64))], names=["bin", "y"])

    pooled = (rows.where("fold") if halves else rows).select("_stats", "y").mapInArrow(binned, "bin int, y long").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()  # BINS rows at most
    x, y, w = np.array([[(r.bin + 0.5) * 2 / BINS - 0.5, r.y / _FIX / r.n, r.n] for r in pooled]).T
    return Model(mean, scale, beta, isotonic(x, y, w))


def calibrates(doc_id: Column) -> Column:
    """A quarter of the rows, by other bits than those of the held-out fold."""
    return F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 4) % 4 == 0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(stats: DataFrame, model: Model) -> DataFrame:
    """stats without _stats but with score."""
    keep = [c for c in stats.columns if c not in ("_stats", "score")]
    schema = stats.select(*keep, F.lit(0.0).alias("score")).schema

    def batches(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(model.scores(_matrix(b)))], names=[*keep, "score"])

    return stats.select(*keep, "_stats").mapInArrow(batches, schema)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    stats = save(with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    model = fit(stats, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs whose score reaches cut; texts stay where they lie."""
    model = fit(with_statistics(docs.select("doc_id", "text")), labels.select("doc_id", "quality"))

    def batches(it):
        for b in it:
            if b.num_rows:
                x = np.array([statistics(t) for t in b.column("text").to_pylist()])
                yield b.filter(pa.array(model.scores(x) >= cut))

    return docs.mapInArrow(batches, docs.schema)
