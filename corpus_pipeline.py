"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of documents; the last returns the bins.

Defined cases of every stage: an empty table gives an empty one; further columns of docs are kept as they are, whatever their
names (the last stage drops them); null and empty texts, very long texts, ties and repeated rows are what the docstring of
the stage's operator says, and in short:

* quality_classifier: null texts count as empty ones; without any label nothing is rejected.
* simhash: null and empty texts and texts of white space are copies of each other; null ids come last.
* suffix_dedup: null texts become empty; repeated rows lose all that is as long as a match.
* mixing: null and empty texts follow the whole epochs of their source; null sources are one source.
* packing: null and empty texts have the end id alone; repeated rows never share a bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canoply.llm import mixing, packing, quality_classifier, simhash, suffix_dedup
from canoply.llm.store import save, shielded, table


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every long passage that is anywhere else too; n_chars follows."""
    names, kind = docs.columns, docs.schema["n_chars"].dataType
    docs, undo = shielded(docs, ("text", "n_chars"))
    kept = suffix_dedup.dedup(docs, texts=True).withColumn("n_chars", F.length("text").cast(kind))
    return kept.select(*undo).select(*names)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document."""
    docs, undo = shielded(docs, ("doc_id", "source", "text"))
    keyed = save(mixing.keyed(docs), "mix-keys")
    mixed = mixing.mix(keyed, mixing.cuts(keyed))
    return mixed.where("_mix_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*undo)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: its bin and its place there."""
    return packing.pack(packing.measured(docs)).drop("row")


STAGES = [
    ("quality_classifier", quality_classifier_stage),
    ("simhash", simhash_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Random Fourier features, isotonic steps and best-fit bins aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
