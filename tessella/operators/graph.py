"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..tables import cut, release


def _with_least(sides: DataFrame) -> DataFrame:
    """Adds to each (u, v) the least of u and all its v. Aggregated before the join, so that a node with very many links is no more than a skewed join side."""
    least = sides.groupBy("u").agg(F.min("v").alias("__m")).select("u", F.least("u", "__m").alias("m"))
    return sides.join(least, "u")


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of every node in links(a, b): root is the least node of its component.

    Rounds of large star (hang a node's larger neighbours on its least one) and small star (hang its
    smaller neighbours and itself on the least) until nothing changes; their number grows with the
    logarithm of the longest path. Null ends and loops are left out. The links stay on the executors
    and are written to the checkpoint folder each round.
    """
    edges = cut(links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Links are told apart where they are grouped next; equal ones do no harm before that.
        large = cut(_with_least(both).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        starred = _with_least(large).filter("u <> m")
        small = starred.select(F.explode(F.when(F.col("v") != F.col("m"), F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).otherwise(F.array(F.struct("u", F.col("m").alias("v"))))).alias("e")).select("e.u", "e.v")
        edges = cut(small.filter("u <> v").distinct())
        del both, large, starred, small
        release(edges.sparkSession)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
