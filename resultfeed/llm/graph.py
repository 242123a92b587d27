"""Connected components of an undirected graph, by DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Copies of a lookup row, so that one that many rows look up is met in several tasks.
SALTS = 16


def _looked_up(rows: DataFrame, key: str, labels: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out`` = the label of ``key``.  A key may be in a third of all rows: both sides carry salt,
    and only the labels that are looked up are multiplied."""
    wanted = labels.join(rows.select(F.col(key).alias("node")).distinct(), "node", "left_semi")
    many = wanted.select(F.col("node").alias("_node"), F.col("label").alias(out), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt_r"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    return salted.join(many, (F.col(key) == F.col("_node")) & (F.col("_salt") == F.col("_salt_r"))).drop("_node", "_salt", "_salt_r")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b), label = smallest node of its component.

    Rounds of hooking (each end takes the smaller label of its neighbours) and jumping (each label is
    replaced by its own label) until nothing changes: about the logarithm of the longest path.  Labels
    are checkpointed every round, so that lineage stays short and a lost executor costs one round.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    labels = cut(
        edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
    )
    while True:
        up = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("l")), "a").select(F.col("b").alias("node"), F.col("l").alias("label"))
        down = _looked_up(edges, "b", labels, "l").select(F.col("a").alias("node"), F.col("l").alias("label"))
        hooked = labels.unionByName(up).unionByName(down).groupBy("node").agg(F.min("label").alias("label"))
        hooked = cut(hooked)
        jumped = _looked_up(hooked, "label", hooked, "l").select("node", F.least("label", "l").alias("label"))
        new = cut(jumped)
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where(F.col("label") != F.col("old")).limit(1).count()
        labels = new
        if not changed:
            return labels
