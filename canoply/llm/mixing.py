"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the exponential key -ln(u)/w, where u comes from a hash of its id and w is its
quality weight (words over words plus symbol characters). A source takes whole epochs while its
target allows, then documents in ascending key order whose prefix sum of sizes comes nearest to
what is left.

No source is sorted in one task. Keys fall into ordered buckets by their leading bits (4096 a power of
two, so that the keys of light documents spread as well); the cumulated bucket sizes name the one
bucket in which the budget ends, the next 12 bits cut that one again, and only what is left is sorted.
What follows is a cut (bucket, key, id, size, row) a source, which documents are compared with where
they lie, so texts are never shuffled.

Defined cases: a null text has size 0 and follows its source's epochs; null sources are one source,
the last; of rows equal in key, id and size the mix takes as many as the target asks for, the first in the
order of the table; very long texts are measured whole, and the one on which a budget ends is taken if more than half of
it fits; an empty table gives an empty result; all further columns are kept, and the working columns carry the prefix
``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import n_symbols, n_words, save

WEIGHTS = (5, 2, 1)
SEED = "mix-1"


def quality_weight(text: Column, size: Column) -> Column:
    return F.when(size > 0, size.cast("double") / (size + n_symbols(text)).cast("double")).otherwise(F.lit(1.0))


def uniform(doc_id: Column, size: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of an MD5 of seed, id and size."""
    text = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def keyed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with _mix_size, _mix_key and _mix_row (the place in the table). Save it before it is cut and mixed, as places may differ from scan to scan."""
    size = F.col("_mix_size")
    sized = docs.withColumn("_mix_size", n_words(F.col("text")))
    return sized.withColumn("_mix_key", -F.log(uniform(F.col("doc_id"), size, seed)) / quality_weight(F.col("text"), size)).withColumn("_mix_row", F.monotonically_increasing_id())


def targets(sizes: DataFrame, weights=WEIGHTS, total=(3, 2), most: int = 2) -> DataFrame:
    """sizes(source, n, source_size) with target.

    Water filling: sources ordered by size over weight are capped at most times their size as long as
    the level of the rest lies above that; all sums are whole numbers, one division makes a target.
    The windows run over one row a source.
    """
    num, den = total
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("long"))
    order = W.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    size, w = F.col("source_size"), F.col("w")
    return (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("w_left", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("s_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("room", num * F.col("total") - den * most * F.col("s_before"))
        .withColumn("capped", F.lit(most * den) * size * F.col("w_left") <= F.col("room") * w)
        .withColumn("open", F.min(F.when(~F.col("capped"), F.struct(size / w, F.col("source").isNull(), "source", "room", "w_left"))).over(everything))
        .withColumn("target", F.when(F.col("capped"), (most * size).cast("double")).otherwise((w * F.col("open.room")).cast("double") / (den * F.col("open.w_left")).cast("double")))
        .select("source", "n", "source_size", "target")
    )


def buckets(key: Column) -> tuple[Column, Column]:
    """Ascending with the key: a bucket by the power of two below it and 12 bits more, and a part of it by the next 12 bits."""
    power = F.floor(F.log2(key))
    place = (key / F.pow(F.lit(2.0), power) - 1) * 4096  # rounding of the logarithm may give -1 or 4096, still in order
    return (power * 8192 + F.floor(place) + 1).cast("long"), F.floor((place - F.floor(place)) * 4096).cast("long")


def _row() -> Column:
    return F.struct(F.col("_mix_key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("_mix_size"))


def _ends(rows: DataFrame, by: list[str], at: str, tag: str) -> DataFrame:
    """Of rows (source, left, before, _mix_size): the value of ``at`` in which left is reached, with the words before it."""
    totals = rows.groupBy("source", "left", "before", *by, at).agg(F.sum("_mix_size").alias("words"))
    cum = F.sum("words").over(W.partitionBy("source").orderBy(at).rowsBetween(W.unboundedPreceding, -1))
    prior = totals.withColumn("prior", F.col("before") + F.coalesce(cum, F.lit(0)))
    return save(prior.where("prior < left and left <= prior + words").select("source", *by, at, F.col("prior").alias("before")), tag)


def cuts(keyed_docs: DataFrame, weights=WEIGHTS, total=(3, 2), most: int = 2) -> DataFrame:
    """A row for each source: source, source_size, target, epochs, cut_bucket, cut_part, cut, cut_row (null: all rows equal to cut are taken)."""
    base = keyed_docs.select("source", "_mix_key", "_mix_size", "_mix_row", _row().alias("row"))
    sizes = base.groupBy("source").agg(F.count("*").alias("n"), F.sum("_mix_size").alias("source_size"))
    t = (
        targets(sizes, weights, total, most)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)))
        .withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    t = save(t, "mix-targets")
    bucket, part = buckets(F.col("_mix_key"))
    b = base.alias("b").join(t.alias("t"), F.expr("b.source <=> t.source")).select("t.source", "left", "row", "_mix_row", "_mix_size", bucket.alias("bucket"), part.alias("part"), F.lit(0).cast("long").alias("before"))
    last = _ends(b, [], "bucket", "mix-last")
    inside = b.drop("before").alias("b").join(last.alias("l"), F.expr("b.source <=> l.source and b.bucket = l.bucket")).select("b.*", "l.before")
    last = _ends(inside, ["bucket"], "part", "mix-part")
    inside = inside.drop("before").alias("b").join(last.alias("l"), F.expr("b.source <=> l.source and b.bucket = l.bucket and b.part = l.part")).select("b.*", "l.before")
    ties = inside.groupBy("source", "bucket", "part", "before", "left", "row").agg(F.sum("_mix_size").alias("words"), F.count("*").alias("copies"))
    prior = F.sum("words").over(W.partitionBy("source").orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    size = F.col("row._mix_size")
    room = F.col("left") - F.col("prior") - size / 2
    found = (
        ties.withColumn("prior", F.col("before") + F.coalesce(prior, F.lit(0)))
        .withColumn("some", F.when(room >= 0, F.when(size > 0, F.least(F.floor(room / size) + 1, F.col("copies"))).otherwise(F.col("copies"))))
        .groupBy("source", F.col("bucket").alias("cut_bucket"), F.col("part").alias("cut_part"))
        .agg(F.max(F.when(F.col("some").isNotNull(), F.struct("row", "some", "copies"))).alias("top"))
        .select("source", "cut_bucket", "cut_part", F.col("top.row").alias("cut"), F.col("top.some").alias("some"), F.col("top.copies").alias("copies"))
    )
    found = save(found, "mix-found")
    rows = _last_copies(base, found.where("some < copies"))
    found = found.alias("f").join(rows.alias("r"), F.expr("f.source <=> r.source"), "left").select("f.source", "cut_bucket", "cut_part", "cut", "cut_row")
    return save(t.alias("t").join(found.alias("f"), F.expr("t.source <=> f.source"), "left").select("t.source", "source_size", "target", "epochs", "cut_bucket", "cut_part", "cut", "cut_row"), "mix-cuts")


def _last_copies(base: DataFrame, tied: DataFrame) -> DataFrame:
    """(source, cut_row): the place of the last copy that is taken of the rows on which a source's budget ends. Only the copies of one slice of the table are sorted."""
    copies = base.alias("b").join(tied.select("source", "cut", "some").alias("c"), F.expr("b.source <=> c.source and b.row = c.cut")).select("c.source", "some", "_mix_row", F.shiftright("_mix_row", 33).alias("slice"))
    counts = copies.groupBy("source", "some", "slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slices = counts.withColumn("before", before).where("before < some and some <= before + n").select("source", "slice", "before")
    own = copies.alias("b").join(slices.alias("s"), F.expr("b.source <=> s.source and b.slice = s.slice")).select("s.source", "_mix_row", (F.col("some") - F.col("before")).alias("nth"))
    return own.withColumn("at", F.row_number().over(W.partitionBy("source").orderBy("_mix_row"))).where("at = nth").select("source", F.col("_mix_row").alias("cut_row"))


def mix(keyed_docs: DataFrame, cut: DataFrame) -> DataFrame:
    """keyed_docs with _mix_source_size, _mix_target and _mix_copies (how often the mix takes the row)."""
    c = cut.select(*(F.col(x).alias(f"_mix_{x}") for x in cut.columns))
    bucket, part = buckets(F.col("_mix_key"))
    last = F.coalesce(F.col("_mix_row") <= F.col("_mix_cut_row"), F.lit(True))
    within = (_row() < F.col("_mix_cut")) | ((_row() == F.col("_mix_cut")) & last)
    at, of = F.struct(bucket.alias("bucket"), part.alias("part")), F.struct(F.col("_mix_cut_bucket").alias("bucket"), F.col("_mix_cut_part").alias("part"))
    some = F.when(F.col("_mix_cut_bucket").isNull(), False).otherwise((at < of) | ((at == of) & F.coalesce(within, F.lit(False))))
    return keyed_docs.join(c, F.col("source").eqNullSafe(F.col("_mix_source"))).withColumn("_mix_copies", F.col("_mix_epochs") + some.cast("long"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = save(keyed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).drop("text"), "mix-keys")
    return mix(docs, cuts(docs)).select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0)::BIGINT AS symbols FROM documents),
k AS (
  SELECT *, -ln(((('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, 'null'), size::VARCHAR)), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
    / (CASE WHEN size > 0 THEN size::DOUBLE / (size + symbols)::DOUBLE ELSE 1.0 END) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
f AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
    (sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_left,
    coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s_before,
    row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS nth FROM r),
c AS (SELECT *, 3 * total - 4 * s_before AS room, 4 * source_size * w_left <= (3 * total - 4 * s_before) * w AS capped FROM f),
o AS (SELECT room AS o_room, w_left AS o_left FROM c WHERE NOT capped ORDER BY nth LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE (w * o_room)::DOUBLE / (2 * o_left)::DOUBLE END AS target
      FROM c LEFT JOIN o ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 1 END AS epochs FROM t),
j AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        coalesce(doc_id::VARCHAR, '') AS id FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
p AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY key, id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM j)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN rest > 0 AND upto - size + size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
