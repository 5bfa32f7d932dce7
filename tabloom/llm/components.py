"""Connected components of a link table by alternating stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import dropped, written


def star_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(a, b) links between comparable nodes -> (node, root): the smallest node that each linked node reaches.

    Each round hangs larger neighbours on the smallest one, then smaller neighbours likewise, until the
    links are stars; the number of rounds grows with the logarithm of the longest path. Minima combine
    before the shuffle, and a node with very many links is only the larger side of a join, which adaptive
    execution can split. Null ends and self links are left out; no links give no rows.
    """
    edges = written(links.where("a is not null and b is not null and a <> b")
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        after = written(small)
        state = after.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        dropped(edges, large)
        edges, done = after, state == before
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"links did not settle in {rounds} rounds")
