"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsift.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour to its larger ones."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour to its smaller ones and to itself."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    moved = down.join(least, "u").where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least)


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node with a link: ``root`` is the smallest node it can reach.

    ``edges`` has two columns of ids; self-links and rows with nulls are ignored. Rounds grow
    with the logarithm of the largest component. Each round is written to the shared folder; only
    a count and a checksum of it come to the driver.
    """
    edges = materialize(edges.toDF("u", "v").where("u <> v").distinct())
    last = None
    for _ in range(most_rounds):
        edges = materialize(_small_star(_large_star(edges).distinct()).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle; raise most_rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select("v", "v").distinct()
    )
