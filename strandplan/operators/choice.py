"""Greedy choices made side by side: packing, coverage and seeds.

A sequential greedy takes the best offer, drops what it used up, and looks again. Here a round takes every offer
that is the best of all offers that share something with it, or may come to. Such an offer's rivals can only get worse as
others are taken, so the sequential greedy would have taken it too: the result is the same, the rounds are as many
as the longest chain of offers that wait for each other, and a round is grouped minima and equi-joins.
"""

from __future__ import annotations

import heapq
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandplan.operators.graph import Labels
from strandplan.operators.overlay import _near, pack_cells
from strandplan.plans.session import batches_of, remove, written, written_at
from strandplan.rules import RULES, TERMINALS


def best_of_rivals(members: DataFrame, offer: str, item: str, rank: Column, rivals: DataFrame | None = None) -> DataFrame:
    """``(offer)`` of the offers that have the least ``rank`` (then the lower offer) at every one of their items.

    ``members`` has a row for each offer and item; ``rivals`` has one for each offer and item that it may come to
    want, if those are more. An item's best is a grouped minimum, so an item that most offers want is reduced
    before it is shuffled.
    """
    bid = F.struct(rank.alias("rank"), F.col(offer).alias("offer")).alias("bid")
    wins = (members if rivals is None else rivals).select(item, bid).groupBy(item).agg(F.min("bid").alias("win"))
    kept = members.select(offer, item, bid).join(wins, item).groupBy(offer).agg(F.min((F.col("bid") == F.col("win")).cast("int")).alias("all"))
    return kept.where("all = 1").select(offer)


def _rounds(spark, rest: DataFrame, at: str, step, name: str, log: list | None, max_rounds: int) -> DataFrame | None:
    """The written results of ``step(rest) -> (taken, rest)`` until nothing is left, together."""
    taken = None
    for _ in range(max_rounds):
        if rest.isEmpty():
            return taken
        got, left = step(rest)
        got = written(got, name)
        if log is not None:
            log.append(got.count())
        nxt, nxt_at = written_at(left(got), f"{name}-rest")
        remove(spark, at)
        rest, at = nxt, nxt_at
        taken = got if taken is None else taken.unionByName(got)
    raise RuntimeError(f"{name} did not settle in {max_rounds} rounds")


#: Pairs that a task of the packing sorts, about.
TASK_PAIRS = 500_000


def pack_terminals(pairs: DataFrame, sizes: tuple = TERMINALS, metre: int = RULES.drop_cable_m, log: list | None = None, max_rounds: int = 10_000) -> DataFrame:
    """``(prem_id, node_id, terminal, dist_m)`` of ``pairs (prem_id, node_id, dist_m)``: every premises in one terminal at a node in its reach.

    A node offers the terminal that is cheapest a premises: its nearest premises that are still open, up to the
    largest size, at their drops' and the terminal's cents; of equal prices the larger terminal. The cheapest
    offer a premises goes first, ties to the lower node. Exactly what the sequential greedy takes, side by side.
    ``terminal`` is the node with the round, as a node may be taken again. Premises without a pair are left out.
    """
    spark, ports = pairs.sparkSession, max(s for s, _ in sizes)
    each = lcm(*range(1, ports + 1))
    cost = F.coalesce(*[F.when(F.col("k") <= size, F.lit(price)) for size, price in sorted(sizes)])
    order = Window.partitionBy("node_id").orderBy("dist_m", "prem_id")
    rounds = iter(range(max_rounds))

    def step(rest):
        k = next(rounds)
        if (tasks := -(-rest.count() // TASK_PAIRS)) > 1:
            # A task's part doesn't grow with the input, whatever number of partitions is set.
            rest = rest.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "node_id")
        near = rest.withColumn("k", F.row_number().over(order)).where(F.col("k") <= ports)
        near = near.withColumn("drops", F.sum("dist_m").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        price = (F.col("drops") * metre + cost) * F.element_at(F.array(*[F.lit(each // n) for n in range(1, ports + 1)]), F.col("k"))
        near = written(near.withColumn("price", price), "offers")
        best = near.groupBy("node_id").agg(F.min(F.struct("price", (-F.col("k")).alias("minus"))).alias("b"))
        best = written(best.select("node_id", "b.price", (-F.col("b.minus")).alias("size")), "best")
        members = written(near.drop("price").join(best, "node_id").where("k <= size"), "offered")
        # A node whose nearest are taken turns to others in its reach, so it rivals for all of them.
        chosen = best_of_rivals(members, "node_id", "prem_id", F.col("price"), rest.join(best, "node_id"))
        got = members.join(chosen, "node_id", "left_semi").select("prem_id", "node_id", F.concat_ws("/", "node_id", F.lit(k)).alias("terminal"), "dist_m")
        return got, lambda got: rest.join(got.select("prem_id"), "prem_id", "left_anti")

    first, at = written_at(pairs.select("prem_id", "node_id", F.col("dist_m").cast("long").alias("dist_m")), "pack-rest")
    found = _rounds(spark, first, at, step, "packed", log, max_rounds)
    return spark.createDataFrame([], "prem_id long, node_id long, terminal string, dist_m long") if found is None else found


def cover_sites(reach: DataFrame, log: list | None = None, max_rounds: int = 10_000) -> DataFrame:
    """``(site, client, rank)``: sites that cover all clients of ``reach (site, client, weight)``, and whom each takes.

    Coverage greedy: the site with the greatest weight of clients still uncovered goes first, ties to the lower
    site. Gains are counted anew for what is left alone. A round takes every site whose gain beats that of all
    sites it shares a client with. ``rank`` is the round.
    """
    spark = reach.sparkSession
    rounds = iter(range(max_rounds))

    def step(rest):
        k = next(rounds)
        gains = written(rest.groupBy("site").agg(F.sum("weight").alias("gain")), "gains")
        chosen = best_of_rivals(rest.join(gains, "site"), "site", "client", -F.col("gain"))
        got = rest.join(chosen, "site", "left_semi").select("site", "client", F.lit(k).cast("long").alias("rank"))
        return got, lambda got: rest.join(got.select("client"), "client", "left_anti")

    first, at = written_at(reach.select("site", "client", F.col("weight").cast("long").alias("weight")), "cover-rest")
    found = _rounds(spark, first, at, step, "covered", log, max_rounds)
    return spark.createDataFrame([], "site long, client long, rank long") if found is None else found


def _improved(batches):
    """A cell's labels that a new seed makes better, and what they offer beyond; standing labels stop the search."""
    for batch in batches:
        for r in batch.to_pylist():
            near, standing = _near(r["inner"] or []), {x["node_id"]: x["dist"] for x in r["standing"] or ()}
            found = _nearer(near, [(x["node_id"], x["dist"]) for x in r["entries"]], standing)
            rows = [(n, r["cell"], d, True) for n, d in found.items()]
            out: dict[tuple[int, int], int] = {}
            for x in r["outer"] or ():
                if x["u"] in found:
                    key = x["v"], x["cell"]
                    out[key] = min(out.get(key, 1 << 62), found[x["u"]] + x["w"])
            rows += [(*key, d, False) for key, d in out.items()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["node_id", "cell", "dist", "own"])


def _nearer(near: dict, starts: list, standing: dict) -> dict[int, int]:
    """Distances by node that are under the standing ones; nodes that gain nothing are not passed."""
    best: dict[int, int] = {}
    heap: list = []

    def offer(n, d):
        if d < standing.get(n, 1 << 62) and d < best.get(n, 1 << 62):
            best[n] = d
            heapq.heappush(heap, (d, n))

    for n, d in starts:
        offer(n, d)
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for v, _, w in near.get(u, ()):
            offer(v, d + w)
    return best


def farthest_seeds(edges: DataFrame, cells: DataFrame, weight: Column, stops: DataFrame, k: int, log: list | None = None) -> DataFrame:
    """``(seed, node_id, dist)``: ``k`` nodes of ``stops (stop, node_id)``, each the farthest from those before it.

    The first is the lowest stop's node; of equal distances the lowest stop's node goes first, and nodes that no
    seed reaches come before all others. ``dist`` is the distance to the seeds before (null for the first and for
    unreached ones). Labels of all nodes stand from seed to seed: a new seed is spread over cells only where it
    is nearer than what stands, so a seed's work shrinks with its region. ``log`` gets the labels each one changed.
    """
    spark = edges.sparkSession
    packed = pack_cells(edges, cells, weight)
    stops = written(stops.groupBy("node_id").agg(F.min("stop").alias("stop")).join(cells, "node_id"), "stops")
    labels, seeds = Labels(spark, ("node_id", "cell"), ("dist", "one", "two")), []
    one, two = F.lit(0).alias("one"), F.lit(0).alias("two")
    for seed in range(k):
        if not labels.parts:
            far = stops.select(F.lit(None).cast("long").alias("dist"), "stop", "node_id", "cell").orderBy("stop").limit(1)
        else:
            near = stops.join(labels.all().select("node_id", "dist"), "node_id", "left")
            far = near.select("dist", "stop", "node_id", "cell").orderBy(F.col("dist").desc_nulls_first(), "stop").limit(1)
        top = far.first()
        if top is None:
            break
        seeds.append((seed, top["node_id"], top["dist"]))
        front = spark.createDataFrame([(top["node_id"], top["cell"], 0)], "node_id long, cell long, dist long")
        changed = 0
        while True:
            entries = front.groupBy("cell").agg(F.collect_list(F.struct("node_id", "dist")).alias("entries"))
            touched = entries.join(packed, "cell", "left")
            if labels.parts:
                standing = labels._least(labels._union().join(entries.select("cell"), "cell", "left_semi"))
                standing = standing.groupBy("cell").agg(F.collect_list(F.struct("node_id", "dist")).alias("standing"))
                touched = touched.join(standing, "cell", "left")
            else:
                touched = touched.withColumn("standing", F.lit(None).cast("array<struct<node_id:long,dist:long>>"))
            with batches_of(spark, 1):  # a row is a cell
                got, got_at = written_at(touched.select("cell", "inner", "outer", "entries", "standing").mapInArrow(_improved, "node_id long, cell long, dist long, own boolean"), "nearer")
            inside, at = written_at(got.where("own").select("node_id", "cell", "dist", one, two), "seed-labels")
            rows = inside.count()
            if not rows:
                break
            changed += rows
            labels.add(inside, at, rows)
            offers = written(got.where(~F.col("own")).groupBy("node_id", "cell").agg(F.min("dist").alias("dist")).select("node_id", "cell", "dist", one, two), "offers")
            front = written(labels.against(offers).select("node_id", "cell", "dist"), "front")
            remove(spark, got_at)
            if front.isEmpty():
                break
        if log is not None:
            log.append(changed)
    return spark.createDataFrame(seeds, "seed long, node_id long, dist long")
