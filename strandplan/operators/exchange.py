"""Exchange of key paths: a tree over required nodes made cheaper by rounds.

A key node is required, or a tree's streets branch or end there; between two of them the tree is a plain chain.
Every street that leads from one tree node's region to another's closes, with the ways back to the two, a cycle
with the tree; it is worth taking if it costs less than the dearest stretch of that cycle between key nodes (the
two ends count as such). All streets ask at once. A tree that a task can hold is walked there, from chain to chain,
and the exchanges are taken in the order of their gain where no chain of their cycle was touched yet. A larger tree
is rooted by its Euler tour, its chains are one edge each of a smaller tree, and the dearest stretch on a way is read
by doubled steps; a round takes the exchanges that gain most of all that share a chain with their cycle. Either way
the cycles have no edge in common, so what is left is a tree, and the gains add up.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandplan.operators.choice import best_of_rivals
from strandplan.operators.graph import TASK_EDGES, degrees, half_edges
from strandplan.operators.overlay import overlay_paths, pack_cells
from strandplan.operators.steiner import marked_back
from strandplan.operators.trees import common_ancestors, euler_tour
from strandplan.plans.session import remove, written, written_at


def _settled(spark, pointers: DataFrame, final: DataFrame) -> DataFrame:
    """``(node_id, to)`` with every pointer followed until it stands on a ``final (node_id)``: pointer doubling."""
    now, at = written_at(pointers, "pointers")
    while not now.join(final.select(F.col("node_id").alias("to")), "to", "left_anti").isEmpty():
        onward = now.select(F.col("node_id").alias("to"), F.col("to").alias("next"))
        nxt, nxt_at = written_at(now.join(onward, "to").select("node_id", F.col("next").alias("to")), "pointers")
        remove(spark, at)
        now, at = nxt, nxt_at
    return now


def chains(tour: DataFrame, keys: DataFrame) -> DataFrame:
    """``tour`` with ``key``, the nearest key node at or above, and ``chain``, the node just below the chain's upper end; written.

    ``keys`` holds the root, every node with other than two tree edges and whatever else ends a chain.
    """
    spark = tour.sparkSession
    flagged = tour.join(keys.select("node_id", F.lit(True).alias("is_key")).distinct(), "node_id", "left").withColumn("is_key", F.coalesce("is_key", F.lit(False)))
    flagged = written(flagged, "flagged")
    tops = flagged.select(F.col("node_id").alias("parent"), F.col("is_key").alias("below_key"))
    flagged = flagged.join(tops, "parent", "left").withColumn("top", F.col("parent").isNull() | F.col("below_key")).drop("below_key")
    flagged = written(flagged, "flagged")
    key = _settled(spark, flagged.select("node_id", F.when(F.col("is_key"), F.col("node_id")).otherwise(F.col("parent")).alias("to")), flagged.where("is_key"))
    chain = _settled(spark, flagged.select("node_id", F.when(F.col("top"), F.col("node_id")).otherwise(F.col("parent")).alias("to")), flagged.where("top"))
    named = flagged.join(key.withColumnRenamed("to", "key"), "node_id").join(chain.withColumnRenamed("to", "chain"), "node_id")
    return written(named.select("node_id", "parent", "parent_edge", "depth", "path_m", "is_key", "key", "chain"), "chains")


def _lifts(at: DataFrame) -> list[DataFrame]:
    """Level k: ``(node_id, up, up_depth, best)`` of key nodes: the key node 2^k chains up, and the dearest chain on the way."""
    keys = at.where("is_key")
    upper = at.select(F.col("node_id").alias("parent"), F.col("key").alias("up")).join(keys.select(F.col("node_id").alias("up"), F.col("depth").alias("up_depth"), F.col("path_m").alias("up_m")), "up")
    own = keys.join(upper, "parent", "left")
    up = F.coalesce("up", "node_id")
    first = own.select("node_id", up.alias("up"), F.coalesce("up_depth", "depth").alias("up_depth"), F.struct((F.col("path_m") - F.coalesce("up_m", "path_m")).alias("len"), F.col("node_id").alias("lower"), up.alias("upper")).alias("best"))
    levels = [written(first, "lift")]
    while not levels[-1].where("up_depth > 0").isEmpty():
        last = levels[-1]
        ahead = last.select(F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("up_depth").alias("_depth"), F.col("best").alias("_best"))
        levels.append(written(last.join(ahead, "up").select("node_id", F.col("_up").alias("up"), F.col("_depth").alias("up_depth"), F.greatest("best", "_best").alias("best")), "lift"))
    return levels


def _climbed(sides: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``sides (street, x, m, s, l, l_depth, l_m, best)`` with ``s`` lifted as far as the ancestor allows, and the dearest stretch so far."""
    for k in reversed(range(len(levels))):
        step = levels[k].select(F.col("node_id").alias("s"), F.col("up").alias("_up"), F.col("up_depth").alias("_d"), F.col("best").alias("_b"))
        fits = F.col("_d") >= F.col("l_depth")
        sides = sides.join(step, "s").withColumns({"best": F.when(fits, F.greatest("best", "_b")).otherwise(F.col("best")), "s": F.when(fits, F.col("_up")).otherwise(F.col("s"))}).drop("_up", "_d", "_b")
        sides = written(sides, "climbed")
    return sides


def _chains_between(sides: DataFrame, at: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``(street, chain)``: all chains that a way from ``x`` up to ``l`` touches; blocks of 2^k chains first, which are halved."""
    spark = sides.sparkSession
    rest = sides.where("s is not null").select("street", "s", "l_depth")
    blocks = [spark.createDataFrame([], "street long, s long") for _ in levels]
    for k in reversed(range(len(levels))):
        step = levels[k].select(F.col("node_id").alias("s"), F.col("up").alias("_up"), F.col("up_depth").alias("_d"))
        met = written(rest.join(step, "s"), "blocks")
        whole = (F.col("_d") >= F.col("l_depth")) & (F.col("_up") != F.col("s"))
        blocks[k] = met.where(whole).select("street", "s")
        rest = met.select("street", F.when(whole, F.col("_up")).otherwise(F.col("s")).alias("s"), "l_depth")
    found = rest.join(at.select(F.col("node_id").alias("s"), "depth"), "s").where("depth > l_depth").select("street", "s")
    for k in reversed(range(1, len(levels))):
        half = levels[k - 1].select(F.col("node_id").alias("s"), F.col("up").alias("_up"))
        blocks[k - 1] = written(blocks[k - 1].unionByName(blocks[k].join(half, "s").select("street", F.explode(F.array("s", "_up")).alias("s"))), "blocks")
    nodes = found.unionByName(blocks[0]).unionByName(sides.select("street", F.col("x").alias("s")))
    return nodes.join(at.where("depth > 0").select(F.col("node_id").alias("s"), "chain"), "s").select("street", "chain").distinct()


CHOSEN = "street long, src long, dst long, gain long, gone array<long>"


def _rooted(edges: list, root: int, required: set) -> tuple[dict, dict]:
    """(``(parent, edge, depth, metres)`` by node, the key node at the upper end of its chain and the chain's number by node)."""
    near: dict[int, list] = {}
    for u, v, e, w in edges:
        near.setdefault(u, []).append((v, e, w))
        near.setdefault(v, []).append((u, e, w))
    at, order = {root: (None, None, 0, 0)}, [root]
    for u in order:
        for v, e, w in near.get(u, ()):
            if v not in at:
                at[v] = (u, e, at[u][2] + 1, at[u][3] + w)
                order.append(v)
    chain = {}
    for n in order[1:]:
        up = at[n][0]
        chain[n] = (up, n) if up == root or up in required or len(near[up]) != 2 else chain[up]
    return at, chain


def _dearest(a: int, b: int, at: dict, chain: dict) -> tuple[tuple[int, int, int], set]:
    """The dearest stretch between key nodes on the tree's way from ``a`` to ``b`` as (metres, lower, upper), and the way's chains."""
    worst, touched = (-1, -1, -1), set()
    while a != b:
        if a in chain and b in chain and chain[a] == chain[b]:
            low, up = (a, b) if at[a][2] > at[b][2] else (b, a)
            worst = max(worst, (at[low][3] - at[up][3], low, up))
            touched.add(chain[low])
            break
        # Who stands in the chain that hangs lower climbs it.
        if b in chain and (a not in chain or at[chain[b][0]][2] > at[chain[a][0]][2]):
            a, b = b, a
        up = chain[a][0]
        worst = max(worst, (at[a][3] - at[up][3], a, up))
        touched.add(chain[a])
        a = up
    return worst, touched


def _chosen(table: pa.Table) -> pa.Table:
    """The exchanges of a round from rows of three kinds: the tree's edges (0), required nodes (1), and streets that close a cycle (2)."""
    kinds: list[list] = [[], [], []]
    for kind, *row in zip(*(table.column(c).to_pylist() for c in ("kind", "edge_id", "src", "dst", "len_m", "a", "b")), strict=True):
        kinds[kind].append(row)
    required = {r[1] for r in kinds[1]}
    at, chain = _rooted([(u, v, e, w) for e, u, v, w, _, _ in kinds[0]], min(required), required)
    offers = []
    for street, src, dst, cost, a, b in kinds[2]:
        if a in at and b in at:
            worst, touched = _dearest(a, b, at, chain)
            if worst[0] > cost:
                offers.append((cost - worst[0], street, src, dst, worst, touched))
    used, out = set(), []
    for minus, street, src, dst, (_, low, up), touched in sorted(offers, key=lambda x: x[:2]):
        if used.isdisjoint(touched):
            used |= touched
            gone = []
            while low != up:
                gone.append(at[low][1])
                low = at[low][0]
            out.append((street, src, dst, -minus, gone))
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table([pa.array(list(c), pa.int64()) for c in columns[:4]] + [pa.array(list(columns[4]), pa.list_(pa.int64()))], names=["street", "src", "dst", "gain", "gone"])


def _chosen_in_task(kept: DataFrame, need: DataFrame, pairs: DataFrame) -> DataFrame:
    """``CHOSEN``, written: a round's exchanges of a tree ``kept`` that one task holds."""
    none = F.lit(None).cast("long")
    tree = kept.select(F.lit(0).alias("kind"), "edge_id", "src", "dst", "len_m", none.alias("a"), none.alias("b"))
    ends = need.select(F.lit(1).alias("kind"), none.alias("edge_id"), F.col("node_id").cast("long").alias("src"), none.alias("dst"), none.alias("len_m"), none.alias("a"), none.alias("b"))
    asks = pairs.select(F.lit(2).alias("kind"), F.col("street").alias("edge_id"), "src", "dst", F.col("cost").alias("len_m"), "a", "b")
    return written(tree.unionByName(ends).unionByName(asks).withColumn("whole", F.lit(0)).groupBy("whole").applyInArrow(_chosen, CHOSEN), "chosen")


def _closing(priced: DataFrame, now: DataFrame, labels: DataFrame) -> DataFrame:
    """``(a, b, cost, street, src, dst)``: the cheapest street, with the ways back, between two tree nodes' regions."""
    side = lambda end: labels.select(F.col("node_id").alias(end), F.col("dist").alias(f"{end}_d"), F.col("owner").alias(f"{end}_o"))
    between = priced.join(now, "edge_id", "left_anti").join(side("src"), "src").join(side("dst"), "dst").where("src_o <> dst_o")
    cost = (F.col("src_d") + F.col("len_m") + F.col("dst_d")).alias("cost")
    return between.groupBy(F.least("src_o", "dst_o").alias("a"), F.greatest("src_o", "dst_o").alias("b")).agg(F.min(F.struct(cost, F.col("edge_id").alias("street"), "src", "dst")).alias("p")).select("a", "b", "p.*")


def _chosen_in_rounds(kept: DataFrame, root: int, need: DataFrame, pairs: DataFrame) -> DataFrame:
    """``CHOSEN``, written, without the order of gains: exchanges that gain most at every chain of their cycle; for a tree of any size."""
    tour = euler_tour(kept, root)
    ends = need.unionByName(degrees(kept).where("degree <> 2").select("node_id"))
    at = chains(tour, ends)
    levels = _lifts(at)
    pairs = written(common_ancestors(tour, pairs).select("street", "a", "b", "cost", "src", "dst", F.col("ancestor").alias("l")), "closing")
    place = at.select(F.col("node_id").alias("l"), F.col("depth").alias("l_depth"), F.col("path_m").alias("l_m"))
    each = pairs.select("street", "l", F.explode(F.array("a", "b")).alias("x")).where("x <> l").join(place, "l")
    each = each.join(at.select(F.col("node_id").alias("x"), F.col("path_m").alias("m"), F.col("key").alias("s")), "x")
    each = each.join(at.select(F.col("node_id").alias("s"), F.col("depth").alias("s_depth"), F.col("path_m").alias("s_m")), "s")
    stretch = lambda length, lower, upper: F.struct(length.alias("len"), F.col(lower).alias("lower"), F.col(upper).alias("upper"))
    inside = F.col("s_depth") < F.col("l_depth")
    each = written(each.withColumn("best", F.when(inside, stretch(F.col("m") - F.col("l_m"), "x", "l")).otherwise(stretch(F.col("m") - F.col("s_m"), "x", "s"))), "sides")
    climbing = each.where(~inside)
    up = _climbed(climbing.select("street", "x", "s", "l", "l_depth", "l_m", "best"), levels)
    last = at.select(F.col("node_id").alias("s"), F.col("path_m").alias("e_m"))
    up = up.join(last, "s").select("street", F.greatest("best", stretch(F.col("e_m") - F.col("l_m"), "s", "l")).alias("best"))
    worst = up.unionByName(each.where(inside).select("street", "best")).groupBy("street").agg(F.max("best").alias("best"))
    offers = pairs.join(worst, "street").withColumn("gain", F.col("best.len") - F.col("cost")).where("gain > 0")
    offers = written(offers.select("street", "src", "dst", "best.lower", "best.upper", "gain"), "offers")
    ways = each.join(offers.select("street"), "street", "left_semi").withColumn("s", F.when(F.col("s_depth") >= F.col("l_depth"), F.col("s")))
    items = written(_chains_between(written(ways.select("street", "x", "s", "l_depth"), "ways"), at, levels).join(offers.select("street", "gain"), "street"), "items")
    chosen = written(offers.join(best_of_rivals(items, "street", "chain", -F.col("gain")), "street", "left_semi"), "chosen")
    ends_of = lambda c: at.select(F.col("node_id").alias(c), F.col("chain").alias(f"{c}_chain"), F.col("depth").alias(f"{c}_depth"))
    cut = chosen.join(ends_of("lower"), "lower").join(ends_of("upper"), "upper").select("street", F.col("lower_chain").alias("chain"), "lower_depth", "upper_depth")
    gone = at.join(cut, "chain").where((F.col("depth") <= F.col("lower_depth")) & (F.col("depth") > F.col("upper_depth"))).groupBy("street").agg(F.collect_list("parent_edge").alias("gone"))
    return written(chosen.join(gone, "street").select("street", "src", "dst", "gain", "gone"), "chosen")


def exchanged(edges: DataFrame, cells: DataFrame, taken: DataFrame, required: DataFrame, weight: Column, log: list | None = None, max_rounds: int = 10_000, task_edges: int = TASK_EDGES) -> DataFrame:
    """``(edge_id)``, written: a tree over ``required`` made from ``taken`` by exchanges until none helps.

    ``taken`` is one tree with no loose ends; up to ``task_edges`` edges of it, with the streets that ask, are walked
    in one task a round. ``log`` gets what each round gained at least (ways that two exchanges share gain more); the
    cost never rises.
    """
    spark = edges.sparkSession
    priced = written(edges.select("edge_id", "src", "dst", weight.cast("long").alias("len_m")), "priced")
    packed = pack_cells(priced, cells, F.col("len_m"))
    need = written(required.select("node_id").distinct(), "required")
    root = need.agg(F.min("node_id")).first()[0]
    now, now_at = written_at(taken.select("edge_id"), "tree")
    for _ in range(max_rounds):
        kept = written(priced.join(now, "edge_id", "left_semi"), "kept")
        size = kept.count()
        if not size:
            return now
        labels = overlay_paths(priced, cells, half_edges(kept).select(F.lit(0).alias("source"), F.col("u").alias("node_id"), F.col("u").alias("owner")).distinct(), F.col("len_m"), packed=packed)
        pairs = written(_closing(priced, now, labels), "pairs")
        chosen = _chosen_in_task(kept, need, pairs) if size <= task_edges and pairs.count() <= 4 * task_edges else _chosen_in_rounds(kept, root, need, pairs)
        if not (gain := chosen.agg(F.sum("gain")).first()[0]):
            return now
        if log is not None:
            log.append(gain)
        back = marked_back(labels, chosen.select(F.explode(F.array("src", "dst")).alias("node_id"))).where("prev_edge is not null").select(F.col("prev_edge").alias("edge_id"))
        gone = chosen.select(F.explode("gone").alias("edge_id"))
        new = now.join(gone, "edge_id", "left_anti").unionByName(chosen.select(F.col("street").alias("edge_id"))).unionByName(back).distinct()
        nxt, nxt_at = written_at(new, "tree")
        remove(spark, now_at)
        now, now_at = nxt, nxt_at
    raise RuntimeError("exchanges did not settle")
