"""Trees of any size: rooting by an Euler tour, lowest common ancestors by doubled steps, loads as differences.

A level-by-level walk takes as many rounds as the tree is deep; here rounds grow with the logarithm of its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandplan.operators.graph import half_edges, subtree_sums
from strandplan.operators.numbering import sums_before
from strandplan.plans.session import remove, written, written_at


def euler_tour(edges: DataFrame, root: int) -> DataFrame:
    """``(node_id, parent, parent_edge, depth, path_m, first, last)``, written, of the forest edges (with ``len_m``) reachable from ``root``.

    The tour walks every edge down and up again, neighbours in order. Each half edge is followed by the one after
    its twin at the node it leads to; the list that this makes is ranked by pointer doubling. An edge is walked
    down first. ``first`` and ``last`` number the half edges from 1 (the root has 0 and their number + 1), so a
    node's descendants are those whose interval lies in its own. Trees without the root are left out.
    """
    spark = edges.sparkSession
    half = half_edges(edges, "len_m", "src").select("u", "v", "edge_id", "len_m", (F.col("edge_id") * 2 + (F.col("u") != F.col("src")).cast("int")).alias("h"))
    around = Window.partitionBy("u").orderBy("v", "edge_id")
    ring = Window.partitionBy("u").orderBy("v", "edge_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    half = written(half.withColumns({"after": F.coalesce(F.lead("h").over(around), F.first("h").over(ring)), "start": (F.col("u") == root) & F.lag("h").over(around).isNull()}), "half-edges")
    begin = half.where("start").select(F.col("h").alias("begin"))
    twin = half.select(F.col("h").bitwiseXOR(F.lit(1)).alias("h"), F.col("after").alias("next"))
    # The tour ends where it would begin again.
    listed = half.select("h").join(twin.hint("merge"), "h").join(begin, F.col("next") == F.col("begin"), "left")
    listed = listed.select("h", F.when(F.col("begin").isNull(), F.col("next")).alias("next"), F.when(F.col("begin").isNull(), 1).otherwise(0).cast("long").alias("left"))
    now, at = written_at(listed, "tour")
    for _ in range(max(1, now.count()).bit_length() + 1):
        ahead = now.select(F.col("h").alias("mid"), F.col("next").alias("beyond"), F.col("left").alias("more"))
        moved = now.join(ahead.hint("merge"), now["next"] == ahead["mid"], "left")
        nxt, nxt_at = written_at(moved.select("h", F.when(F.col("next").isNotNull(), F.col("beyond")).alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "tour")
        remove(spark, at)
        now, at = nxt, nxt_at
        if now.where("next is not null").isEmpty():
            break
    ranked = now.where("next is null")  # what still runs in a circle is not the root's tree
    total = ranked.count()
    order = ranked.select("h", (F.lit(total) - F.col("left")).alias("pos"))
    steps = half.join(order.hint("merge"), "h").join(order.select(F.col("h").bitwiseXOR(F.lit(1)).alias("h"), F.col("pos").alias("back")).hint("merge"), "h")
    down = F.col("pos") < F.col("back")
    steps = written(steps.select("u", "v", "edge_id", "pos", "back", down.alias("down"), F.when(down, 1).otherwise(-1).cast("long").alias("one"), F.when(down, F.col("len_m")).otherwise(-F.col("len_m")).alias("metres")), "tour-steps")
    above = sums_before(steps, {"one": "depth", "metres": "path_m"}, "pos").where("down")
    tree = above.select(
        F.col("v").alias("node_id"), F.col("u").alias("parent"), F.col("edge_id").alias("parent_edge"), (F.col("depth") + 1).alias("depth"), (F.col("path_m") + F.col("metres")).alias("path_m"), F.col("pos").alias("first"), F.col("back").alias("last"),
    )
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    top = spark.range(1).select(F.lit(root).cast("long").alias("node_id"), none.alias("parent"), none.alias("parent_edge"), zero.alias("depth"), zero.alias("path_m"), zero.alias("first"), F.lit(total + 1).cast("long").alias("last"))
    return written(tree.unionByName(top), "tree")


def common_ancestors(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs (pair, a, b)`` with ``ancestor``, ``path_m`` and ``hops`` of the way between them on a rooted tree.

    Binary lifting: a table of each node's ancestor 2^k steps up, k up to the logarithm of the depth; the deeper
    end is lifted to the other's depth, then both are lifted while their ancestors differ. Every step is an
    equi-join of the pairs with one level of the table. Pairs with an end outside the tree are left out.
    """
    spark = tree.sparkSession
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    up, at = written_at(tree.select("node_id", F.coalesce("parent", "node_id").alias("up")), "lift")
    levels = [up]
    for _ in range(1, max(1, int(deepest).bit_length())):
        last = levels[-1]
        levels.append(written(last.select("node_id", F.col("up").alias("mid")).join(last.select(F.col("node_id").alias("mid"), "up").hint("merge"), "mid").select("node_id", "up"), "lift"))
    at = tree.select("node_id", F.col("depth").cast("long").alias("depth"), F.col("path_m").cast("long").alias("path_m"))
    for end in ("a", "b"):
        pairs = pairs.join(at.select(F.col("node_id").alias(end), F.col("depth").alias(f"d{end}"), F.col("path_m").alias(f"m{end}")).hint("merge"), end)
    low = F.col("da") >= F.col("db")
    now, path = written_at(pairs.withColumns({"u": F.when(low, F.col("a")).otherwise(F.col("b")), "v": F.when(low, F.col("b")).otherwise(F.col("a")), "over": F.abs(F.col("da") - F.col("db"))}), "pairs")
    for k in reversed(range(len(levels))):
        step = levels[k].select(F.col("node_id").alias("u"), F.col("up").alias("_u"))
        lifted = now.join(step.hint("merge"), "u").withColumn("u", F.when(F.shiftright("over", k).bitwiseAND(F.lit(1)) == 1, F.col("_u")).otherwise(F.col("u"))).drop("_u")
        now, path = _kept(spark, lifted, path)
    for k in reversed(range(len(levels))):
        a, b = (levels[k].select(F.col("node_id").alias(e), F.col("up").alias(f"_{e}")) for e in ("u", "v"))
        apart = F.col("_u") != F.col("_v")
        lifted = now.join(a.hint("merge"), "u").join(b.hint("merge"), "v").withColumns({"u": F.when(apart, F.col("_u")).otherwise(F.col("u")), "v": F.when(apart, F.col("_v")).otherwise(F.col("v"))}).drop("_u", "_v")
        now, path = _kept(spark, lifted, path)
    above = levels[0].select(F.col("node_id").alias("u"), F.col("up").alias("_up"))
    found = now.join(above.hint("merge"), "u").withColumn("ancestor", F.when(F.col("u") == F.col("v"), F.col("u")).otherwise(F.col("_up"))).drop("_up", "u", "v", "over")
    found = found.join(at.select(F.col("node_id").alias("ancestor"), F.col("depth").alias("d"), F.col("path_m").alias("m")).hint("merge"), "ancestor")
    return found.withColumns({"path_m": F.col("ma") + F.col("mb") - 2 * F.col("m"), "hops": F.col("da") + F.col("db") - 2 * F.col("d")}).drop("da", "db", "ma", "mb", "d", "m")


def _kept(spark, df: DataFrame, old: str) -> tuple[DataFrame, str]:
    now, path = written_at(df, "pairs")
    remove(spark, old)
    return now, path


def path_loads(tree: DataFrame, paths: DataFrame, value: str) -> DataFrame:
    """``(edge_id, load)``: what all ``paths (a, b, ancestor, value)`` together put on each tree edge, edges without any left out.

    A path adds its value at both ends and takes it off twice at the ancestor; an edge's load is the sum below it.
    """
    ends = F.explode(F.array(*[F.struct(F.col(c).alias("node_id"), (F.col(value) * k).cast("long").alias("value")) for c, k in (("a", 1), ("b", 1), ("ancestor", -2))]))
    at = paths.select(ends.alias("e")).select("e.*").groupBy("node_id").agg(F.sum("value").alias("value"))
    sums = subtree_sums(tree, at)
    return tree.where("parent_edge is not null").select("node_id", F.col("parent_edge").alias("edge_id")).join(sums, "node_id").where("total <> 0").select("edge_id", F.col("total").alias("load"))


def pruned(edges: DataFrame, required: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """Tree edges without the branches that end in no required node: ``subtree_sums`` from a required root, not leaf by leaf."""
    root = required.agg(F.min("node_id")).first()[0]
    if root is None:
        return edges.limit(0)
    tree = euler_tour(edges, root)
    below = subtree_sums(tree, required.select("node_id", F.lit(1).alias("value")).distinct())
    empty = tree.join(below.where("total = 0"), "node_id").select(F.col("parent_edge").alias("edge_id"))
    return edges.join(tree.select(F.col("parent_edge").alias("edge_id")), "edge_id", "left_semi").join(empty, "edge_id", "left_anti")
