"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every metric is counted over the whole text. Repeated 8-word windows are found inside the row: the
windows' hashes are compared by a hash set, and only where some hash repeats are positions sorted and
their coverage summed, so the work is n log n in a text's words and nothing is shuffled.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; lines without
words count neither as lines nor as repeats; repeated rows are judged one by one; very long texts are
judged whole; an empty table gives an empty result; input columns are kept whatever their names, and only the
metric names are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import SPACE, WORD, let, n_symbols, shielded, table, text_of

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that for was with as on are this an at by "
    "le la les de des du et un une en que qui dans pour est au sur pas par ce "
    "der die das und in den von zu mit sich auf ist ein eine für nicht dem im als "
    "el la los las de del y en un una que es por con para su se al lo"
).split()
WINDOW = 8
#: (metric, least, most); None: no bound. A document is kept if every metric lies in its bounds.
RULES = (
    ("n_words", 20, None),
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.3),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.4),
    ("upper_ratio", None, 0.5),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_repeated(words: Column, k: int = WINDOW) -> Column:
    """Words that lie in a k-word window found at least twice."""

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.lit(k), b - a))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    def repeats(hashed: Column) -> Column:
        ordered = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        pairs = let(ordered, lambda o: F.zip_with(o, F.slice(o, 2, F.size(o)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
        return let(F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))), covered)

    def shifted(step: int):
        return lambda h: F.zip_with(h, F.slice(h, 1 + step, F.size(h)), lambda a, b: F.xxhash64(a, b))

    def windows(w: Column) -> Column:
        # windows of 1, 2, 4, 8 words; what runs over the end is cut off below
        hashed, span = F.transform(w, lambda x: F.xxhash64(x)), 1
        while span < k:
            step = min(span, k - span)
            hashed = let(hashed, shifted(step))
            span += step
        return let(F.slice(hashed, 1, F.size(w) - (k - 1)), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeats(h)).otherwise(F.lit(0)))

    return F.when(F.size(words) > k, windows(words)).otherwise(F.lit(0)).cast("long")


def metrics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the table's ratios."""
    text = text_of(F.col("text"))
    stop = [*dict.fromkeys(STOP_WORDS)]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    by_words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            n_repeated(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*stop))).alias("stop"),
        ),
    )
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    docs, undo = shielded(docs.select(*(c for c in docs.columns if c not in METRICS)), ("text",))
    df = docs.select(*docs.columns, by_words.alias("_w"), by_lines.alias("_l"), F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"), n_symbols(F.col("text")).alias("n_symbols"), (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).alias("_upper"))
    n = F.greatest(F.col("_w.n_words"), F.lit(1))
    return df.select(
        *undo,
        F.col("_w.n_words").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_l.dup").alias("n_dup_lines"),
        F.col("_w.n_repeat_words").alias("n_repeat_words"),
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbol_ratio"),
        (F.col("_w.stop") / n).alias("stop_word_ratio"),
        (F.col("_l.dup") / F.greatest(F.col("_l.n"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("_upper") / F.greatest(F.col("word_chars"), F.lit(1))).alias("upper_ratio"),
    )


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio", "upper_ratio", "base_failed", "kept")


def compiled(rules=RULES) -> Column:
    """The conjunction of all bounds."""
    parts = [F.col(m) >= low for m, low, _ in rules if low is not None] + [F.col(m) <= high for m, _, high in rules if high is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return metrics(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) > 8),
h AS (SELECT rid, i, array_to_string(list_slice(words, i, i + 7), ' ') AS gram FROM g),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS n FROM h) WHERE n > 1),
c AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS rep FROM (SELECT *, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: list_contains(string_split('{STOP}', ' '), lower(x)))) AS stop,
    length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS upper
  FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 20 AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 14.0 AND n_symbols / greatest(n_words, 1) <= 0.3
  AND stop / greatest(n_words, 1) >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.4 AND upper / greatest(word_chars, 1) <= 0.5 AS kept FROM b
""".replace("{STOP}", " ".join(dict.fromkeys(STOP_WORDS)))
