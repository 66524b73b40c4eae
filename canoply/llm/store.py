"""Tables in the shared folder that the cluster names, and small helpers of the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one on a machine that runs all of Spark itself, as in tests; an error on a cluster."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="canoply-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/canoply-{tag}-{uuid.uuid4().hex}"


#: For what the library itself writes: shuffle files go with the end of a write, and Python gets batches of bounded bytes.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def sifted(n: int) -> dict[str, str]:
    """Settings for a join of many large rows with the few that match n keys: Spark filters the large side by a Bloom filter of the keys, at any size of the table, with about ten bits a key."""
    name, bits = "spark.sql.optimizer.runtime.bloomFilter", min(max(1 << 13, 10 * n), 1 << 27)
    sizes = {"expectedNumItems": max(n, 1), "maxNumItems": max(n, 4_000_000), "numBits": bits, "maxNumBits": max(bits, 1 << 26)}
    return {f"{name}.enabled": "true", f"{name}.applicationSideScanSizeThreshold": "0"} | {f"{name}.{k}": str(v) for k, v in sizes.items()}


@contextmanager
def lean(spark: SparkSession, more: dict[str, str] = {}) -> Iterator[None]:
    """LEAN and more hold inside."""
    held = LEAN | more
    was = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def save(df: DataFrame, tag: str, path: str | None = None, more: dict[str, str] = {}) -> DataFrame:
    """Write df as a shared table (in a new folder unless one is named) under the settings more, and read it again: lineage ends, a lost executor costs nothing."""
    path = path or new_path(df.sparkSession, tag)
    with lean(df.sparkSession, more):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove saved tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if not folder.rpartition("/")[2].startswith("canoply-"):
                raise ValueError(f"not a table of this library: {folder}")
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def let(value: Column, body) -> Column:
    """body(v) with v bound to value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_symbols(text: Column) -> Column:
    t = text_of(text)
    return (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long")


def shielded(docs: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but the needed ones renamed, so that no working column can clash; and the columns that undo it."""
    names = [c if c in needed else f"_col{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
