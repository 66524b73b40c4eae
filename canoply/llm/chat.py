"""Chat formatting with collapse of cumulative snapshots.

Each conversation's turns, in order, give a rolling hash of every turn prefix. A logged conversation
whose last hash is a proper prefix hash of some other one is a snapshot of it; an anti-join drops it.
Equal conversations are one, with the smallest conv_id. What remains is rendered with role markers.

Turns are streamed in sorted partitions for the hashes; prefix hashes are made distinct by an
aggregation with map-side combine before they meet anything, so a common first turn or a conversation
that many copies share is one row. Only a rendered conversation's own turns are gathered, in its row.

Defined cases: turns are ordered by number (null first), then role and text; null roles read
"unknown", null texts are empty; rows with a null conv_id are one conversation; repeated rows are
repeated turns; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save, table

ORDER = ("turn", "role", "text")


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, h, last): the hash of the first k turns of each conversation."""
    rows = conversations.select("conv_id", *ORDER).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)

    def batches(it):
        at, h, k, held = object(), b"", 0, None
        for b in it:
            ids, ks, hs, last = [], [], [], []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                new = conv != at
                if held:
                    for x, y in zip((ids, ks, hs, last), (*held, new), strict=True):
                        x.append(y)
                if new:
                    at, h, k = conv, b"", 0
                role, text = (role or "unknown").encode(), (text or "").encode()
                h = hashlib.blake2b(b"%b%d:%b%d:%b" % (h, len(role), role, len(text), text), digest_size=16).digest()
                k += 1
                held = conv, k, h
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.int64()), pa.array(hs, pa.binary()), pa.array(last, pa.bool_())], names=["conv_id", "k", "h", "last"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held, True), (pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=["conv_id", "k", "h", "last"])

    return rows.mapInArrow(batches, "conv_id long, k long, h binary, last boolean")


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of conversations that prefix no longer one."""
    seen = save(prefixes(conversations), "prefixes")
    whole = seen.where("last").groupBy("h", "k").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = seen.where("not last").select("h", "k").distinct()
    return whole.join(inner, ["h", "k"], "left_anti").select("conv_id", F.col("k").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) of the conversations in kept."""
    k = kept.select(F.col("conv_id").alias("_c"), "n_turns", "n_copies")
    rows = conversations.join(k, F.col("conv_id").eqNullSafe(F.col("_c")))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    line = lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), t["text"], F.lit("\n<|end|>\n"))
    return rows.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_join(F.transform(turns, line), "").alias("text"))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", *ORDER)
    return render(conversations, save(maximal(conversations), "maximal"))


OP8_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
             row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
p AS (SELECT conv_id, k, n, string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY k) AS prefix,
        string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY k) AS text FROM t),
f AS (SELECT prefix, k, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(text) AS text FROM p WHERE k = n GROUP BY prefix, k)
SELECT conv_id, k::BIGINT AS n_turns, n_copies::BIGINT AS n_copies, text FROM f
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = f.prefix AND p.k < p.n)
"""
