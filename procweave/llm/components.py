"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_staged, stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on (a, b) edges, both ways looked at; returns (a, b) with b the smaller end."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    root = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = near.join(root, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = (linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(root.select("a", F.col("m").alias("b"))))
    return out.where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    return tuple(row)


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root): every node of the edge table with the smallest node of its component.

    ``edges`` has two comparable columns ``a`` and ``b``. Each round is written
    to the shared folder, so a lost executor costs a part of one round; the
    files of finished rounds are deleted.
    """
    current = stage(edges.select("a", "b").where("a <> b").distinct(), tag)
    before = _mark(current)
    while before[0]:
        following = stage(_stars(_stars(current, True), False), tag)
        delete_staged(current)
        current, after = following, _mark(following)
        if after == before:
            break
        before = after
    ends = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
