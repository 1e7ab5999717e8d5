"""Connected components by contraction, in joins and aggregates that any executor can redo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayout.llm.shared import stored


def contract(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after the components joined by ``edges`` (a, b: comps) became one.

    Each round gives every component its least neighbour and contracts; names are hashes, so the number of
    components with edges left falls by a constant factor a round, in expectation.
    """
    edges = stored(edges.select("a", "b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("b"))
        parent = stored(parent.select("a", F.least("a", "b").alias("p")), "parents")
        of_a, of_b = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        moved = edges.join(of_a, "a").join(of_b, "b").where("pa <> pb")
        edges = stored(
            moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges"
        )
        named = parent.toDF("comp", "p")
        labels = labels.join(named, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
        labels = stored(labels, "labels")
    return labels
