"""Connected components by alternating large-star and small-star rounds.

Edges stay in tables of the shared folder; the driver sees one checksum row a round. Every round is an
aggregation with map-side combine and an equi-join whose skewed keys adaptive execution may split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, save


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: neighbours above u move to u's least neighbour; small: those below."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        moved = edges.join(least, F.col("v") == F.col("k")).select("u", F.col("m").alias("v"))
    else:
        least = edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        joined = edges.join(least, F.col("u") == F.col("k"))
        moved = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of edges; root is the least node of its component."""
    known = save(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = known.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while mark[0]:
        half = save(_stars(known, large=False), "edges")
        drop(known)
        known = save(_stars(half, large=True), "edges")
        drop(half)
        was, mark = mark, known.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == was:
            break
    tops = known.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return known.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops)


def rooted(classes: DataFrame, edges: DataFrame, node: str, value: str) -> DataFrame:
    """classes with the least value of the component of each node, as column component."""
    roots = save(components(edges), "roots")
    joined = classes.join(roots, classes[node] == roots["node"], "left").withColumn("_root", F.coalesce("root", F.col(node))).drop("node", "root")
    joined = save(joined, "rooted")
    least = save(joined.groupBy(F.col("_root").alias("_r")).agg(F.min(value).alias("component")), "least")
    return joined.join(least, F.col("_root") == F.col("_r")).drop("_root", "_r")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs (a, b): every node but a component's least, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
