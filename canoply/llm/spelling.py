"""Spelling variants by finite-state composition.

The words of a corpus are an acceptor; composed with a transducer that makes exactly one edit (a symbol more, less
or another) and with the acceptor again, it accepts the pairs of near words. The composition starts in one
state, so it is partitioned there: by prefixes, each long enough that at most ``GROUP`` words begin with it. A task takes a
prefix's words, minimises their acceptor and enumerates what the composition accepts from that state: both sides
walk together until the edit, and then the two states they are in must accept a common rest. Equal
states accept equal rests, so the walk ends there.

An edit that lies inside a prefix leads from a state above the partitions, of which there are few: there the word's rest
behind the edit is all that counts, and words meet by it. Such a meeting holds a word for each symbol of the alphabet at most.
So every near pair is found once, at its first difference; tasks tell sums for each word, not pairs.

Forms are pointers to a word at least twice as frequent; roots follow by pointer jumping.

Defined cases: null and empty texts have no words; a null id counts as an empty string in the checksum; very long texts are processed
whole and very long runs are words like others; repeated rows count each time; equally frequent near words are ordered by
code points; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import save, table

LETTERS, LEAST_LENGTH, LEAST_COUNT, EVERY, TIMES = "A-Za-zÀ-ÿ", 5, 3, 97, 2
GROUP, DEPTHS = 1 << 14, 32
_UPPER = "".join(map(chr, range(65, 91)))


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of docs (doc_id, text): runs of letters with A-Z in lower case; where EVERY divides the checksum of id and run, a symbol of it is left out."""
    # the outer explode keeps Spark from filtering by the size of the split text, which would split it twice
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode_outer(F.split(F.col("text"), f"[^{LETTERS}]+")).alias("run")).where("run <> ''")
    ascii_ = F.octet_length("run") == F.length("run")
    low = runs.select("id", F.when(ascii_, F.lower("run")).otherwise(F.translate("run", _UPPER, _UPPER.lower())).alias("run"))
    h = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % EVERY == 0, F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))).otherwise(F.col("run"))
    return h.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Acceptor:
    """The minimal acceptor of sorted distinct words; a state's words are numbered in order, so an arc has the number of words before it."""

    def __init__(self, sorted_words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self.known: dict[tuple, int] = {}
        open_, last = [(False, [])], ""
        for word in sorted_words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            self._close(open_, last, same)
            open_.extend((False, []) for _ in word[same:])
            open_[-1] = (True, open_[-1][1])
            last = word
        self._close(open_, last, 0)
        self.start = self._state(*open_[0])

    def _close(self, open_: list, last: str, to: int) -> None:
        while len(open_) > to + 1:
            state = self._state(*open_.pop())
            open_[-1][1].append((last[len(open_) - 1], state))

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.arcs)
            at, out = int(final), {}
            for symbol, to in arcs:
                out[symbol] = (to, at)
                at += self.size[to]
            self.arcs.append(out)
            self.final.append(final)
            self.size.append(at)
        return found

    def common(self, a: int, b: int, i: int, j: int, out: list[tuple[int, int]]) -> None:
        """Adds the numbers (i + ..., j + ...) of each rest that states a and b both accept."""
        todo = [(a, b, i, j)]
        while todo:
            a, b, i, j = todo.pop()
            if a == b:
                out.extend(zip(range(i, i + self.size[a]), range(j, j + self.size[a])))
                continue
            if self.final[a] and self.final[b]:
                out.append((i, j))
            left, right = self.arcs[a], self.arcs[b]
            if len(left) <= len(right):
                for symbol, (x, before) in left.items():
                    if symbol in right:
                        y, after = right[symbol]
                        todo.append((x, y, i + before, j + after))
            else:
                for symbol, (y, after) in right.items():
                    if symbol in left:
                        x, before = left[symbol]
                        todo.append((x, y, i + before, j + after))

    def edits(self, state: int) -> list[tuple[int, int]]:
        """Pairs of the state's words that first differ here, by one edit."""
        out: list[tuple[int, int]] = []
        arcs = self.arcs[state]
        each = list(arcs.items())
        for k, (symbol, (to, at)) in enumerate(each):
            for _, (other, there) in each[k + 1 :]:
                self.common(to, other, at, there, out)
            if self.final[to] and self.final[state]:  # the symbol left out
                out.append((at, 0))
            for after, (x, more) in self.arcs[to].items():
                if after != symbol and after in arcs:
                    y, there = arcs[after]
                    self.common(x, y, at + more, there, out)
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all near pairs, each once: the composition's accepted pairs."""
        known: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        todo = [(self.start, 0)]
        while todo:
            state, base = todo.pop()
            if state not in known:
                found = self.edits(state)
                known[state] = tuple(np.array(found, np.int64).T) if found else None
            if known[state] is not None:
                left.append(known[state][0] + base)
                right.append(known[state][1] + base)
            todo.extend((to, base + at) for to, at in self.arcs[state].values())
        return np.concatenate(left), np.concatenate(right)


def near_in(group: list[str], counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one group, sorted: which have near ones, how many, and which of those is the most frequent (of equals the first)."""
    a, b = Acceptor(group).pairs()
    n = len(group)
    near = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    order = np.lexsort((np.arange(n), -np.array(counts, np.int64)))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    best = np.full(n, n, np.int64)
    np.minimum.at(best, a, rank[b])
    np.minimum.at(best, b, rank[a])
    has = np.flatnonzero(near)
    return has, near[has], order[best[has]]


def _prefixes(known: DataFrame, least: int, most: int) -> DataFrame:
    """known with each prefix of least to most - 1 symbols, no longer than the word."""
    d = F.explode(F.sequence(F.lit(least), F.least(F.length("word"), F.lit(most - 1)))).alias("d")
    return known.where(F.length("word") >= least).select("*", d).withColumn("prefix", F.substring("word", F.lit(1), F.col("d")))


def split(known: DataFrame, group: int = GROUP) -> DataFrame:
    """known (word, n) with depth: the least length of a prefix that at most ``group`` words have; one more than the word's length if it has none."""
    depths, active, at = [], known, 0
    while True:
        hot = save(_prefixes(active, at, at + DEPTHS).groupBy("prefix", "d").count().where(F.col("count") > group).select("prefix", "d"), "hot")
        found = _prefixes(active, at, at + DEPTHS).join(hot, ["prefix", "d"]).groupBy("word").agg(F.max("d").alias("d"))
        depths.append(save(found, "depths"))
        at += DEPTHS
        last = hot.where(F.col("d") == at - 1)
        if last.isEmpty():
            break
        active = active.withColumn("prefix", F.substring("word", F.lit(1), F.lit(at - 1))).join(last.select("prefix"), "prefix", "left_semi").select("word", "n")
    found = depths[0]
    for x in depths[1:]:
        found = found.unionByName(x)
    found = found.groupBy("word").agg(F.max("d").alias("d"))
    return known.join(found, "word", "left").select("word", "n", F.coalesce(F.col("d") + 1, F.lit(0)).alias("depth"))


_NEAR = "word string, n_near long, best struct<less:long,word:string>"


def below(placed: DataFrame) -> DataFrame:
    """Near words with the first difference behind the prefix: a composition for each prefix."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.struct([("less", pa.int64()), ("word", pa.string())]))])

    def compose(t: pa.Table) -> pa.Table:
        t = t.sort_by("word")  # by bytes, which is by code points
        own, counts = t.column("word").to_pylist(), t.column("n").to_numpy()
        at = t.column("depth")[0].as_py()
        has, near, best = near_in([w[at:] for w in own], counts.tolist())
        best_word = pa.array([own[i] for i in best.tolist()], pa.string())
        return pa.table([pa.array([own[i] for i in has.tolist()], pa.string()), pa.array(near), pa.StructArray.from_arrays([pa.array(-counts[best]), best_word], fields=list(schema.field("best").type))], schema=schema)

    own = placed.where(F.length("word") >= F.col("depth"))
    return own.select("word", "n", "depth", F.expr("substring(word, 1, depth)").alias("prefix")).groupBy("prefix").applyInArrow(compose, _NEAR)


def above(placed: DataFrame) -> DataFrame:
    """Near words with the first difference inside the prefix: words meet by their place and rest."""
    d = F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("d")
    each = placed.where("depth > 0").select("word", "n", d)
    start, d = F.substring("word", F.lit(1), F.col("d")), F.col("d")
    without = F.struct(F.concat(start, F.substring("word", d + 2, F.length("word"))).alias("rest"), F.substring("word", d + 1, F.lit(1)).alias("symbol"))
    whole = F.struct(F.col("word").alias("rest"), F.lit(None).cast("string").alias("symbol"))
    sent = each.select("d", "n", F.explode(F.when(d < F.length("word"), F.array(whole, without)).otherwise(F.array(whole))).alias("x")).select("d", "n", "x.*")
    met = sent.groupBy("d", "rest").agg(F.collect_list(F.struct("n", "symbol")).alias("all")).where("size(all) > 1")
    follows = F.substring("rest", d + 1, F.lit(1))

    def word(symbol: Column) -> Column:
        return F.when(symbol.isNull(), F.col("rest")).otherwise(F.concat(F.substring("rest", F.lit(1), d), symbol, F.substring("rest", d + 1, F.length("rest"))))

    def is_near(y: Column) -> Column:
        x = F.col("x.symbol")
        longer = F.coalesce(y["symbol"], x)
        return ~x.eqNullSafe(y["symbol"]) & ((x.isNotNull() & y["symbol"].isNotNull()) | (longer != follows))

    one = met.select("d", "rest", "all", F.explode("all").alias("x"))
    near = one.select("d", "rest", "x", F.filter("all", is_near).alias("near")).where("size(near) > 0")
    best = F.array_min(F.transform("near", lambda y: F.struct((-y["n"]).alias("less"), word(y["symbol"]).alias("word"))))
    return near.select(word(F.col("x.symbol")).alias("word"), F.size("near").cast("long").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, to) of forms (word, to): to is the last word that forms lead to. They lead to ever more frequent words, so chains are short and end."""
    known = save(forms, "forms")
    while True:
        on = known.select(F.col("word").alias("via"), F.col("to").alias("next"))
        known = save(known.join(on, F.col("to") == F.col("via"), "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "forms")
        if known.where("moved").isEmpty():
            return known.select("word", "to")
        known = known.select("word", "to")


def variants(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """A row for each word of docs (doc_id, text): word, n, n_near, form, form_n, root."""
    placed = save(split(save(words(docs), "words"), group), "placed")
    near = below(placed).unionByName(above(placed)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    known = placed.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    known = save(known, "variants")
    last = roots(known.where("form is not null").select("word", F.col("form").alias("to")))
    return known.join(last, "word", "left").withColumn("root", F.coalesce("to", "word")).drop("to")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = f"""
WITH RECURSIVE crc_table AS MATERIALIZED (SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{_UPPER}', '{_UPPER.lower()}') AS run FROM documents),
counted AS MATERIALIZED (SELECT id, run, count(*) AS n FROM runs GROUP BY 1, 2),
bytes AS (SELECT *, list_concat([4294967295], list_transform(range(1, 2 * strlen(id || ':' || run), 2), lambda i: ('0x' || substr(hex(id || ':' || run), i, 2))::BIGINT)) AS b FROM counted),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h FROM bytes, crc_table),
made AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM w) UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM w)),
near AS (SELECT p.word, count(*) AS n_near, min({{less: -o.n, word: p.other}}) AS best FROM pairs p JOIN w o ON o.word = p.other GROUP BY 1),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.less >= {TIMES} * n THEN best.word END AS form, CASE WHEN -best.less >= {TIMES} * n THEN (-best.less)::BIGINT END AS form_n FROM w LEFT JOIN near USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL),
r AS (SELECT c.word, c.at AS root FROM chain c JOIN f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN r USING (word)
"""
