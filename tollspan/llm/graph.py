"""Connected components by contraction, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollspan.session import durable


def _ranked(node: str, turn: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(turn)).alias("r"), F.col(node).alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """`(node, label)` for every node of the edges `(a, b)`; nodes of a component share a label.

    Every round sends each node to the neighbour (or itself) that comes first in a random order, renames
    the edges and drops those inside one node, so a constant share of the nodes goes each round: chains
    take a logarithmic number of rounds too. The driver sees one edge count a round.
    """
    edges = durable(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = durable(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    turn = 0
    while edges.limit(1).count():
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        step = durable(
            both.select("e.a", "e.b")
            .groupBy("a")
            .agg(F.min(_ranked("b", turn)).alias("first"))
            .select(F.col("a").alias("node"), F.least("first", _ranked("a", turn))["n"].alias("to"))
        )
        moved = (
            edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .filter("ta != tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        )
        labels = durable(
            labels.join(step.withColumnRenamed("node", "label"), "label", "left").select(
                "node", F.coalesce("to", "label").alias("label")
            )
        )
        edges = durable(moved.distinct())
        turn += 1
    return labels
