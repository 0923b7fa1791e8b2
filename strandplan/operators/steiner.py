"""Trees of streets that join required nodes.

Every required node starts as a tree of its own. A round labels all nodes with the tree they are nearest to, so the
nodes fall into regions; each tree then takes the cheapest street that leads from its region to another (a
street's price is the way back to both trees with the street itself), and marks the ways that this uses. Trees
that met are one in the next round, which starts from all their nodes, so ways are shared. The number of trees at
least halves a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandplan.operators.graph import linked
from strandplan.operators.overlay import overlay_paths, pack_cells
from strandplan.plans.session import remove, written, written_at


def marked_back(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """``(node_id, prev_edge)`` of all nodes on the ways back from ``ends`` to their starts, starts included.

    Pointer doubling: marks jump 1, 2, 4, ... predecessors at once, so rounds grow with the logarithm of the
    longest way.
    """
    spark = labels.sparkSession
    jump, jump_at = written_at(labels.select("node_id", F.col("prev").alias("to")), "jump")
    marks, at = written_at(ends.select("node_id").distinct(), "marks")
    while True:
        # Marks that have no further predecessor so far back have marked all there is.
        further = marks.join(jump.where("to is not null"), "node_id").select(F.col("to").alias("node_id"))
        if further.isEmpty():
            break
        new, new_at = written_at(marks.unionByName(further).distinct(), "marks")
        far = jump.select("node_id", F.col("to").alias("mid")).join(jump.select(F.col("node_id").alias("mid"), "to"), "mid", "left").select("node_id", "to")
        nxt, nxt_at = written_at(far, "jump")
        for old in (at, jump_at):
            remove(spark, old)
        marks, at, jump, jump_at = new, new_at, nxt, nxt_at
    remove(spark, jump_at)
    return labels.join(marks, "node_id", "left_semi").select("node_id", "prev_edge")


def steiner_tree(edges: DataFrame, cells: DataFrame, required: DataFrame, weight: Column, log: list | None = None) -> DataFrame:
    """``(edge_id)``, written: streets that join all ``required (node_id)`` that can be joined, a tree for each part of the network.

    Ties go to the lower label and the lower street, so a round's choices are ordered and close no circle. A
    single required node needs no street. ``log`` gets the number of trees of each round.
    """
    spark = edges.sparkSession
    packed = pack_cells(edges, cells, weight)
    priced = written(edges.select("edge_id", "src", "dst", weight.cast("long").alias("w")), "priced")
    trees, trees_at = written_at(required.select(F.col("node_id").cast("long").alias("node_id")).distinct().withColumn("tree", F.col("node_id")), "trees")
    taken = []
    while True:
        labels = overlay_paths(edges, cells, trees.select(F.lit(0).alias("source"), "node_id", F.col("tree").alias("owner")), weight, packed=packed)
        side = lambda end: labels.select(F.col("node_id").alias(end), F.col("dist").alias(f"{end}_d"), F.col("owner").alias(f"{end}_o"))
        between = priced.join(side("src"), "src").join(side("dst"), "dst").where("src_o <> dst_o")
        cost = (F.col("src_d") + F.col("w") + F.col("dst_d")).alias("cost")
        both = between.select(F.explode(F.array("src_o", "dst_o")).alias("tree"), F.struct(cost, "edge_id", "src", "dst", "src_o", "dst_o").alias("street"))
        picks = written(both.groupBy("tree").agg(F.min("street").alias("street")).select("street.*").distinct(), "picks")
        if picks.isEmpty():
            break
        if log is not None:
            log.append(trees.select("tree").distinct().count())
        ways = written(marked_back(labels, picks.select(F.explode(F.array("src", "dst")).alias("node_id"))), "ways")
        taken.append(picks.select("edge_id").unionByName(ways.where("prev_edge is not null").select(F.col("prev_edge").alias("edge_id"))))
        joined = written(linked(picks.select(F.col("src_o").alias("src"), F.col("dst_o").alias("dst"))), "joined")
        grown = trees.unionByName(ways.join(labels.select("node_id", F.col("owner").alias("tree")), "node_id").select("node_id", "tree")).distinct()
        grown = grown.join(joined, grown["tree"] == joined["node"], "left").select("node_id", F.coalesce("component", "tree").alias("tree"))
        nxt, nxt_at = written_at(grown, "trees")
        remove(spark, trees_at)
        trees, trees_at = nxt, nxt_at
    if not taken:
        return edges.select("edge_id").limit(0)
    every = taken[0]
    for part in taken[1:]:
        every = every.unionByName(part)
    return written(every.distinct(), "steiner")
