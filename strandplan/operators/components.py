"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.plans.session import remove, written, written_at


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(low, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them; edges run from large to small."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    onward = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onward.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable.

    Alternating large-star and small-star rounds: each round is two grouped minima and two equi-joins, so no
    node's neighbourhood is gathered in a task, and the rounds grow with the logarithm of the longest chain
    rather than with its length. Lineage is cut each round in the shared folder. Rows with a null end and
    self-loops give the node itself; an empty table gives an empty result. Raises if ``max_rounds`` rounds do
    not settle it.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    loops = pairs.where(F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == F.col("b")))
    alone = loops.select(F.coalesce("a", "b").alias("u")).where("u is not null")
    everyone = written(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    now, state, last = everyone, None, None
    for _ in range(max_rounds):
        now, path = written_at(_small_star(_large_star(now)), "stars")
        if last:
            remove(edges.sparkSession, last)
        last = path
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    rest = (
        alone.distinct()
        .join(everyone.select("u").union(everyone.select("v")).distinct(), "u", "left_anti")
        .select(F.col("u").alias("node"), F.col("u").alias("component"))
    )
    return found.union(roots).union(rest)
