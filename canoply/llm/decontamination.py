"""Benchmark decontamination by winnowing.

Items and documents are cut into words, k-grams of words are hashed, and of every window of ``span - k + 1``
k-grams the least hash is kept. Equal spans of ``span`` words have equal windows and so keep an equal hash: each shared span
that long is among the documents' fingerprints that join the items'. A document's fingerprint stands for the window
starts from its own place up to the next one, at most ``span - k`` words on. Hits extend to the spans at those starts, and
spans meet the items' spans as text, so no hash decides a result.

Items of fewer words than a span are one span of their own length; documents send every gram of such lengths (only of lengths that
items have), which is winnowing with windows of one.

All of it is built-in functions. Spark broadcasts the items' tables if their size in the shared folder allows, and
else shuffles; documents take part by the checksum of their text, so copies are looked at once, and the text of a document
is read again only if it has a hit.

Defined cases: null and empty texts have no words and no hits, as documents and as items; items with equal ids count as one, and a
null id is written as an empty string; very long texts are processed whole; repeated documents are judged alike; an
empty table on either side gives no hits; further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import let, save, shielded, sifted, table, text_of

SPAN, K = 10, 8
#: What stands between words of lower-cased texts, and of others.
BETWEEN, BETWEEN_ANY = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "".join(map(chr, range(65, 91)))


def words_of(text: Column) -> Column:
    """The words of a text with A-Z in lower case."""
    ascii_ = F.octet_length(text) == F.length(text)
    low = F.when(ascii_, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(low, BETWEEN), "")


def _with(step: int, f):
    """Of an array: f of each element and the one step places on (null over the end)."""
    return lambda array: F.zip_with(array, F.slice(array, 1 + step, F.size(array)), f)


def grams(words: Column, k: int) -> Column:
    """At every word the hash of the k words from there on; what runs over the end is no gram."""
    one, pair = F.transform(words, lambda w: F.xxhash64(w)), lambda a, b: F.xxhash64(a, b)
    if k == 1:
        return one

    def grown(single: Column) -> Column:
        out, have = single, 1
        while have < k:
            if 2 * have <= k:
                out, have = let(out, _with(have, pair)), 2 * have
            else:
                out, have = F.zip_with(out, F.slice(single, 1 + have, F.size(single)), pair), have + 1
        return out

    return let(one, grown)


def minima(values: Column, n: int) -> Column:
    """At every place the least of the n values from there on."""
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out = let(out, _with(step, lambda a, b: F.least(a, b)))
        have += step
    return out


def fingerprints(words: Column, span: int = SPAN, k: int = K) -> Column:
    """What winnowing keeps: at the starts of spans where another hash is the least than before, and at every (span - k + 1)-th, that hash; null at other words."""
    step = span - k + 1
    return let(minima(grams(words, k), step), lambda m: F.transform(m, lambda h, i: F.when((i <= F.size(words) - span) & ((i % step == 0) | (h != F.get(m, i - 1))), h)))


def sent(words: Column, short: list[int], span: int = SPAN, k: int = K) -> Column:
    """What a document sends: its fingerprints; then for each length in short every gram. Place p is word p % n of part p / n."""
    own = fingerprints(words, span, k)


    def whole(m: int) -> Column:
        return F.transform(grams(words, m), lambda h, i: F.when(i <= F.size(words) - m, h))

    return F.concat(own, *map(whole, short)) if short else own


class Items:
    """The benchmark's spans as tables: keys (hash), spans (words, span_id) and members (span_id, item)."""

    def __init__(self, items: DataFrame, span: int = SPAN, k: int = K):
        self.span, self.k = span, k
        worded = save(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(text_of(F.col("text"))).alias("w")).where("size(w) > 0"), "items")
        sizes = worded.where(F.size("w") < span).select(F.size("w").alias("m")).distinct()
        self.short = sorted(r.m for r in sizes.collect())  # fewer than span numbers
        long = worded.where(F.size("w") >= span)
        keys = [long.select(F.explode_outer(fingerprints(F.col("w"), span, k)).alias("hash"))]
        keys += [worded.where(F.size("w") == m).select(F.get(grams(F.col("w"), m), F.lit(0)).alias("hash")) for m in self.short]
        found = keys[0]
        for x in keys[1:]:
            found = found.unionByName(x)
        self.keys = save(found.where("hash is not null").distinct(), "item-keys")
        starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - span + 1, F.lit(1)))).alias("i")
        texts = worded.select("item", "w", starts).select("item", F.array_join(F.slice("w", F.col("i"), span), " ").alias("words")).distinct()
        texts = save(texts, "item-spans")
        self.spans = save(texts.select("words").distinct().withColumn("span_id", F.monotonically_increasing_id()), "spans")
        self.members = save(texts.join(self.spans, "words").select("span_id", "item"), "span-items")


def key_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def shared_spans(docs: DataFrame, items: Items) -> DataFrame:
    """(key, start, n, span_id) of every span of the items in texts of docs (key, text): once for each distinct text."""
    # the outer forms of explode keep Spark from filtering by the size of what is exploded, which would make all of it twice
    places = docs.select("key", let(words_of(F.col("text")), lambda w: sent(w, items.short, items.span, items.k)).alias("h"))
    places = places.select("key", F.posexplode_outer("h").alias("p", "hash")).where("hash is not null")
    hits = save(places.join(items.keys, "hash").groupBy("key").agg(F.collect_set("p").alias("hits")), "hits")
    p, n, last = F.col("p"), F.size("w"), F.size("w") - items.span
    spans = F.array(F.lit(items.span), *map(F.lit, items.short))
    texts = docs.join(hits.where("size(hits) > 0"), "key").select("key", words_of(F.col("text")).alias("w"), "hits")
    reach = F.transform("hits", lambda x: F.when(x < n, F.sequence(x, F.least(x + (items.span - items.k), last))).otherwise(F.array(x)))
    starts = texts.select("key", "w", F.array_distinct(F.flatten(reach)).alias("starts")).select("key", "w", F.explode_outer("starts").alias("p"))
    size = F.get(spans, F.floor(p / n).cast("int"))
    spans_at = starts.select("key", (p % n).alias("start"), size.alias("n"), F.array_join(F.slice("w", p % n + 1, size), " ").alias("words"))
    return save(spans_at.distinct().join(items.spans, "words").select("key", "start", "n", "span_id"), "shared", more=sifted(hits.count()))


def _union(spans: Column) -> Column:
    """Maximal runs (start, n) of the words in spans (start, n), in order."""

    def runs(words: Column) -> Column:
        starts = F.filter(words, lambda w, i: (i == 0) | (w - F.get(words, i - 1) > 1))
        ends = F.filter(words, lambda w, i: (i == F.size(words) - 1) | (F.get(words, i + 1) - w > 1))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("n")))

    return let(F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))), runs)


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (runs of hit words: start, n) and hit_items (sorted ids)."""
    docs, undo = shielded(docs, ("text",))
    text = text_of(F.col("text"))
    bench = Items(items, span, k)
    found = shared_spans(docs.select(key_of(text).alias("key"), text.alias("text")), bench)
    runs = found.groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("s")).select("key", _union(F.col("s")).alias("hit_spans"))
    named = found.select("key", "span_id").distinct().join(bench.members, "span_id").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("hit_items"))
    known = save(runs.join(named, "key").withColumnRenamed("key", "_key"), "contaminated")
    n_words = F.size(F.array_remove(F.split(text, BETWEEN_ANY), "")).cast("long")
    rows = docs.select("*", key_of(text).alias("_at"), n_words.alias("_n_words")).join(known, F.col("_at") == F.col("_key"), "left")
    n_hit = F.aggregate(F.coalesce("hit_spans", F.expr("cast(array() as array<struct<start:int,n:int>>)")), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return rows.select(*undo, F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), "hit_spans", F.coalesce("hit_items", F.expr("cast(array() as array<string>)")).alias("hit_items"))


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(list_slice(w, i, i + 9), ' ') AS words FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
f AS (SELECT DISTINCT rid, i, dw.m, item FROM dw JOIN bw ON dw.m = bw.m AND dw.words = bw.words),
h AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS pos FROM (SELECT DISTINCT rid, i, m FROM f)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM f) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
""".replace("{UPPER}", UPPER).replace("{LOWER}", UPPER.lower())
