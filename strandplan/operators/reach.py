"""Trees within a route budget.

A tree over the streets may lead to a node by a way that is longer than the budget, though a shorter one exists.
Then some node above is hung on its shortest way instead: every node on that way takes its predecessor of the
shortest-path tree as parent, all others keep theirs, which is a tree again and lengthens nobody's way. A round
hangs the topmost nodes that gain what the worst node below them lacks, so one way mends a whole branch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.operators.steiner import marked_back
from strandplan.operators.trees import euler_tour
from strandplan.plans.session import remove, written, written_at


def subtree_most(tree: DataFrame, values: DataFrame) -> DataFrame:
    """``(node_id, most)``: the greatest ``value`` of each node and its descendants, null if none has one; pointer doubling."""
    spark = tree.sparkSession
    now, at = written_at(tree.join(values, "node_id", "left").select("node_id", F.col("parent").alias("up"), F.col("value").cast("long").alias("most")), "most")
    while not now.where("up is not null").isEmpty():
        passed = now.where("up is not null").groupBy(F.col("up").alias("to")).agg(F.max("most").alias("more"))
        above = now.select(F.col("node_id").alias("mid"), F.col("up").alias("next"))
        step = now.join(passed, now["node_id"] == passed["to"], "left").join(above, now["up"] == above["mid"], "left")
        nxt, nxt_at = written_at(step.select("node_id", F.col("next").alias("up"), F.greatest("most", "more").alias("most")), "most")
        remove(spark, at)
        now, at = nxt, nxt_at
    return now.select("node_id", "most")


def topmost(tree: DataFrame, marked: DataFrame) -> DataFrame:
    """The ``marked (node_id)`` that have no marked node above them: marks handed down by pointer doubling."""
    spark = tree.sparkSession
    flag = marked.select("node_id", F.lit(True).alias("mark"))
    now, at = written_at(tree.join(flag, "node_id", "left").select("node_id", F.col("parent").alias("up"), F.lit(False).alias("below"), F.coalesce("mark", F.lit(False)).alias("mark")), "topmost")
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("node_id").alias("mid"), F.col("up").alias("next"), (F.col("below") | F.col("mark")).alias("over"))
        step = now.join(above, now["up"] == above["mid"], "left")
        nxt, nxt_at = written_at(step.select("node_id", F.col("next").alias("up"), (F.col("below") | F.coalesce("over", F.lit(False))).alias("below"), "mark"), "topmost")
        remove(spark, at)
        now, at = nxt, nxt_at
    return now.where("mark and not below").select("node_id")


def within_budget(edges: DataFrame, tree: DataFrame, shortest: DataFrame, root: int, tails: DataFrame, limit: int, log: list | None = None, max_rounds: int = 10_000) -> DataFrame:
    """Edges ``(edge_id)``, written, of a tree whose ways, with ``tails (node_id, tail)``, are within ``limit`` wherever any tree's could be.

    ``edges`` have ``len_m``; ``tree (edge_id)`` reaches every node of ``tails`` from ``root``, and ``shortest`` are
    the paths from the root by ``len_m``. No way gets longer. The result costs at most the tree plus, for each
    node that was hung (counted a round in ``log``), its shortest way. Streets that lead to no tail stay in it.
    """
    spark = edges.sparkSession
    best = written(shortest.select("node_id", F.col("dist").alias("best"), "prev", "prev_edge"), "shortest")
    now, at = written_at(edges.join(tree, "edge_id", "left_semi"), "budget-tree")
    for _ in range(max_rounds):
        rooted = euler_tour(now, root)
        ways = written(rooted.join(best, "node_id").select("node_id", "parent", "parent_edge", "path_m", (F.col("path_m") - F.col("best")).alias("gain"), "best"), "ways")
        lack = ways.join(tails, "node_id").where((F.col("path_m") + F.col("tail") > limit) & (F.col("best") + F.col("tail") <= limit))
        lack = written(lack.select("node_id", (F.col("path_m") + F.col("tail") - limit).alias("value")), "lack")
        if lack.isEmpty():
            return now.select("edge_id")
        enough = ways.join(subtree_most(rooted, lack), "node_id").where(F.col("most") <= F.col("gain")).select("node_id")
        hung = written(topmost(rooted, enough), "hung")
        if log is not None:
            log.append(hung.count())
        onto = marked_back(best.select("node_id", "prev", "prev_edge"), hung).select("node_id", F.col("prev_edge").alias("edge_id"))
        onto = written(onto, "onto")
        kept = ways.join(onto.select("node_id"), "node_id", "left_anti").select(F.col("parent_edge").alias("edge_id"))
        taken = kept.unionByName(onto.select("edge_id")).where("edge_id is not null").distinct()
        nxt, nxt_at = written_at(edges.join(taken, "edge_id", "left_semi"), "budget-tree")
        remove(spark, at)
        now, at = nxt, nxt_at
    raise RuntimeError("the budget did not settle")
