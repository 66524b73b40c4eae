"""Merkle manifest of a table, with checkpointed levels.

A leaf is the hash of a row's fields. The leaves of a source stand in ascending order; runs of 16 become their
hash until one node, the subroot, is left, and the subroots in order of their sources become the root alike.

Only every second level is stored. A stored node and the 256 nodes below it that are stored too form an aligned
subtree; its middle level is made again from them whenever the subtree is needed, and dropped after. ``build`` goes up,
a subtree a row; ``proofs`` goes down: the nodes of a level take the path of the subtree's top from the level above, put the siblings
inside the subtree before it, and hand it on. Nothing holds more than one subtree and one path, no source is
ordered or held in one task, and each level is a table that a lost executor finds again.

Defined cases: null fields are hashed as ``-``; null ids come first in their source and null sources first of all; rows with
equal ids stand in the order of their leaves, so equal rows are interchangeable; a null id is never tampered with; very
long texts are hashed whole; an empty table gives an empty result and no root; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import save, table

ARITY, STRIDE = 16, 2
SUBTREE = ARITY**STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "".join(map(chr, range(65, 91)))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(**changed: Column) -> Column:
    """The hash of a row's fields; changed: other values for some of them."""

    def part(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(F.concat(*map(part, FIELDS)))


def tampered_leaf() -> Column:
    """The leaf with the text's A-Z in lower case, where 5 divides the checksum of the id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, leaf(text=F.translate("text", _UPPER, _UPPER.lower())))


def ranked(rows: DataFrame, group: str, order: list[str], tag: str) -> DataFrame:
    """rows with _pos (from 0) in the order of a group, and _n, the rows of the group. Ranges of (group, order) are sorted in tasks of their own; the windows run over a row for each task and group."""
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(*(F.col(k).asc_nulls_first() for k in [group, *order, "_row"])).sortWithinPartitions(*(F.col(k).asc_nulls_first() for k in [group, *order]))
    placed = save(spread.drop("_row").withColumn("_at", F.monotonically_increasing_id()), tag)
    task = F.shiftright("_at", 33)
    parts = placed.groupBy(F.col(group).alias("_of"), task.alias("_task")).agg(F.count("*").alias("_count"), F.min("_at").alias("_first"))
    before = W.partitionBy("_of").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    parts = save(parts.select("_of", "_task", "_first", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"), F.sum("_count").over(W.partitionBy("_of")).alias("_n")), tag)
    joined = placed.join(parts, (F.col(group) == F.col("_of")) & (task == F.col("_task")))
    return joined.withColumn("_pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_of", "_task", "_first", "_before", "_at")


def _above(nodes: Column) -> Column:
    """The nodes over nodes: a hash for each run."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int")), lambda i: digest(F.array_join(F.slice(nodes, i * ARITY + 1, ARITY), "")))


def _subtrees(level: DataFrame, *more: str) -> DataFrame:
    """A row for each aligned subtree of a level (_g, _pos, _n, node): its group, _up (its place on the next stored level), _n and members in order."""
    of = level.select("_g", "_n", F.floor(F.col("_pos") / SUBTREE).alias("_up"), F.struct("_pos", "node", *more).alias("m"))
    return of.groupBy("_g", "_up").agg(F.first("_n").alias("_n"), F.array_sort(F.collect_list("m")).alias("members"))


def build(leaves: DataFrame) -> list[DataFrame]:
    """The stored levels over leaves (_g, _pos, _n, node), these first; a group is on levels until it has one node, its top."""
    levels, most = [leaves], leaves.agg(F.max("_n")).first()[0] or 0
    while most > 1:
        below = _subtrees(levels[-1].where("_n > 1")).withColumn("mids", _above(F.col("members.node")))
        top = F.get(F.when(F.col("_n") > ARITY, _above(F.col("mids"))).otherwise(F.col("mids")), F.lit(0))
        levels.append(save(below.select("_g", F.col("_up").alias("_pos"), F.ceil(F.col("_n") / SUBTREE).alias("_n"), top.alias("node")), "merkle-level"))
        most = -(-most // SUBTREE)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(_g, node): the top of each group."""
    return reduce(DataFrame.unionByName, (x.where("_n = 1").select("_g", "node") for x in levels))


def _siblings(nodes: Column, i: Column) -> Column:
    """What stands left and right of node i in its run."""
    start = F.floor(i / ARITY).cast("int") * ARITY
    return F.struct(F.array_join(F.slice(nodes, start + 1, i - start), "").alias("l"), F.array_join(F.slice(nodes, i + 2, start + (ARITY - 1) - i), "").alias("r"))


def proofs(levels: list[DataFrame], above: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The leaves with their columns more and what above (_g, path, ...) has for their groups; path grows by the siblings inside the group, from the leaf up: array of (l, r)."""
    given = [c for c in above.columns if c not in ("_g", "path")]
    over = None
    for depth in reversed(range(len(levels))):
        own = more if depth == 0 else ()
        level = levels[depth]
        found = level.where("_n = 1").select("_g", "_pos", "node", *own).join(above, "_g")
        if over is not None:
            trees = _subtrees(level.where("_n > 1"), *own).join(over.drop("node").withColumnRenamed("_pos", "_up"), ["_g", "_up"])
            nodes = F.col("members.node")

            def steps(m: Column, i: Column) -> Column:
                low = F.array(_siblings(F.col("nodes"), i))
                high = F.array(_siblings(F.col("mids"), F.floor(i / ARITY).cast("int")))
                return F.struct(m.alias("m"), F.when(F.col("_n") > ARITY, F.concat(low, high)).otherwise(low).alias("s"))

            told = trees.withColumn("nodes", nodes).withColumn("mids", _above(F.col("nodes")))
            told = told.select("_g", "path", *given, F.explode(F.transform("members", steps)).alias("x"))
            told = told.select("_g", "x.m._pos", "x.m.node", *(F.col(f"x.m.{c}").alias(c) for c in own), F.concat("x.s", "path").alias("path"), *given)
            found = told.unionByName(found)
        over = save(found, "merkle-paths") if depth else found
    return over.drop("_pos")


def folded(node: Column, path: Column) -> Column:
    """The root that follows from a node and the siblings on its path."""
    return F.aggregate(path, node, lambda acc, s: digest(F.concat(s["l"], acc, s["r"])))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""))


def manifest(docs: DataFrame, tampered: bool = False) -> DataFrame:
    """A row for each document: doc_id, leaf, tampered (null unless asked for and hit), subroot, root and path (siblings from the leaf to the root)."""
    changed = tampered_leaf() if tampered else F.lit(None).cast("string")
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("x"), F.col("source").cast("string")), F.lit("")).alias("_g"), leaf().alias("node"), changed.alias("tampered"))
    by_source = build(ranked(rows, "_g", ["doc_id", "node"], "merkle-leaves"))
    subroots = save(tops(by_source), "merkle-subroots")
    of_all = ranked(subroots.withColumnRenamed("_g", "_source").withColumn("_g", F.lit("all")), "_g", ["_source"], "merkle-sources")
    upper = build(of_all)
    root = tops(upper).first()
    start = docs.sparkSession.range(1).select(F.lit("all").alias("_g"), F.lit(root and root["node"]).cast("string").alias("root"), F.array().cast("array<struct<l:string,r:string>>").alias("path"))
    sources = save(proofs(upper, start, ("_source",)).select(F.col("_source").alias("_g"), F.col("node").alias("subroot"), "root", "path"), "merkle-sources")
    return proofs(by_source, sources, ("doc_id", "tampered")).select("doc_id", F.col("node").alias("leaf"), "tampered", "subroot", "root", "path")


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents").select(*FIELDS), tampered=True)
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))



def _levels_sql(name: str, base: str, depth: int) -> str:
    """CTEs name0, name1, ... of (g, pos, n, node): every level of every group, up to 16^depth nodes; name_l: all of them."""
    out = [f"{name}0 AS ({base})"]
    out += [f"{name}{k + 1} AS (SELECT g, pos // 16 AS pos, (n + 15) // 16 AS n, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM {name}{k} WHERE n > 1 GROUP BY 1, 2, 3)" for k in range(depth)]
    every = " UNION ALL ".join(f"SELECT {k} AS level, * FROM {name}{k}" for k in range(depth + 1))
    return ",\n".join([*out, f"{name}_l AS ({every})"])


def _paths_sql(name: str, start: str, depth: int) -> str:
    """name_p: (id, level, l, r) for each level a node of start (id, g, pos) passes."""
    up = " UNION ALL ".join(f"SELECT id, {k} AS level, g, pos // {16**k} AS pos FROM {start}" for k in range(depth + 1))
    return f"""{name}_p AS (SELECT u.id, u.level, coalesce(string_agg(x.node, '' ORDER BY x.pos) FILTER (x.pos < u.pos), '') AS l, coalesce(string_agg(x.node, '' ORDER BY x.pos) FILTER (x.pos > u.pos), '') AS r
  FROM ({up}) u JOIN {name}_l x ON x.level = u.level AND x.g = u.g AND x.pos // 16 = u.pos // 16 WHERE x.n > 1 GROUP BY u.id, u.level, u.pos)"""


_PART = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF_SQL = "sha256(" + " || ".join(_PART.format(c) for c in FIELDS) + ")"
OP13_SQL = f"""
WITH crc_table AS MATERIALIZED (SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
c AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce('x' || source, '') AS g, {_LEAF_SQL} AS leaf,
    CASE WHEN xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 5 = 0
      THEN {_LEAF_SQL.replace("text::VARCHAR", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_LEAF_SQL} END AS tampered FROM documents, crc_table),
d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM c),
{_levels_sql("s", "SELECT g, pos, n, leaf AS node FROM d", 5)},
tops AS MATERIALIZED (SELECT g, node, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM s_l WHERE n = 1),
{_levels_sql("r", "SELECT 1 AS g, pos, n, node FROM tops", 5)},
{_paths_sql("s", "d", 5)},
top_ids AS (SELECT g AS id, 1 AS g, pos FROM tops),
{_paths_sql("r", "top_ids", 5)},
steps AS (SELECT id, level, l, r FROM s_p UNION ALL SELECT d.id, 100 + r.level, r.l, r.r FROM d JOIN r_p r ON r.id = d.g),
paths AS (SELECT id, list({{l: l, r: r}} ORDER BY level) AS path FROM steps GROUP BY id),
f AS (SELECT d.doc_id, d.leaf, tops.node AS subroot, (SELECT node FROM r_l WHERE n = 1) AS root, coalesce(path, []) AS path, d.tampered FROM d JOIN tops USING (g) LEFT JOIN paths USING (id)),
x AS (SELECT doc_id, leaf, subroot, root, sha256(list_reduce(list_concat([''], list_transform(path, lambda s: s.l || s.r)), lambda a, b: a || b)) AS proof_sha256,
  list_reduce(list_concat([{{l: tampered, r: ''}}], path), lambda a, s: {{l: sha256(s.l || a.l || s.r), r: ''}}).l AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM x
"""
