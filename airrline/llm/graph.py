"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airrline.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """``node, class`` for every node of edges (a, b): the smallest node it is connected with.

    Each round, a node takes the smallest class around it, and then that
    class's own class, so long chains halve. Work is joins and minima; what a
    round makes is stored, and one count a round reaches the driver.
    """
    both = store(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    state = store(least.select(F.col("a").alias("node"), F.least("a", "m").alias("class")))
    while True:
        around = both.join(state, both["b"] == state["node"]).groupBy("a").agg(F.min("class").alias("near")).withColumnRenamed("a", "node")
        near = state.join(around, "node").select("node", F.col("class").alias("was"), F.least("class", "near").alias("class"))
        up = state.select(F.col("node").alias("class"), F.col("class").alias("up"))
        moved = store(near.join(up, "class", "left").select("node", "was", F.least("class", F.coalesce("up", "class")).alias("class")))
        state = moved.select("node", "class")
        if moved.filter(F.col("was") != F.col("class")).isEmpty():
            return state
