"""Graph operators as iterative DataFrame jobs; each round is a join and a grouped minimum, with lineage cut."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandplan.functions.exprs import dist_m
from strandplan.operators.components import connected_components
from strandplan.plans.session import remove, written, written_at


def edge_lengths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with ``len_m`` and the end points ``ax, ay, bx, by``."""
    a = nodes.select(F.col("node_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    joined = edges.join(a, "src").join(b, "dst")
    return joined.withColumn("len_m", dist_m("ax", "ay", "bx", "by").cast("long"))


def half_edges(edges: DataFrame, *columns: str) -> DataFrame:
    """Both directions of each edge as ``(u, v, edge_id, ...)``."""
    there = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "edge_id", *columns)
    back = edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), "edge_id", *columns)
    return there.unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """``(node_id, degree)`` of nodes with an edge."""
    return half_edges(edges).groupBy(F.col("u").alias("node_id")).agg(F.count("*").alias("degree"))


def key_nodes(edges: DataFrame, required: DataFrame) -> DataFrame:
    """Nodes where a tree branches or ends, or that are required."""
    ends = degrees(edges).where("degree <> 2").select("node_id")
    return ends.union(required.select("node_id")).distinct()


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """``(a, b, n)``: unordered pairs that stand more than once."""
    pair = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pair.agg(F.count("*").alias("n")).where("n > 1")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge a pair; the lower surface class wins, self-loops go."""
    pair = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return pair.agg(F.min("surface").alias("surface"))


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    known = nodes.select("node_id")
    lost = half_edges(edges).join(known, F.col("u") == F.col("node_id"), "left_anti").select("edge_id").distinct()
    return edges.join(lost, "edge_id", "left_semi")


#: Edges of a network that a task may hold; larger ones are worked on round by round.
TASK_EDGES = 500_000


def _adjacency(table) -> dict[int, list[tuple[int, int, int]]]:
    """(neighbour, edge, weight) by node from an array of (src, dst, edge, weight)."""
    near: dict[int, list[tuple[int, int, int]]] = {}
    for u, v, e, w in table.tolist():
        near.setdefault(u, []).append((v, e, w))
        near.setdefault(v, []).append((u, e, w))
    return near


def _small(edges: DataFrame, weight: Column, most: int):
    """The edges as an array broadcast to all tasks, or None if there are more than ``most``: the size is checked first."""
    rows = edges.select("src", "dst", "edge_id", weight.cast("long").alias("w")).limit(most + 1)
    if rows.count() > most:
        return None
    return edges.sparkSession.sparkContext.broadcast(rows.toPandas().to_numpy(np.int64))


#: One label of a search: what it costs, how many streets it takes, whose start it comes from, and the last step (-1: a start).
RANK = ("dist", "hops", "owner", "prev", "prev_edge")


def label_nodes(near, starts, limit) -> dict[int, tuple[int, int, int, int, int]]:
    """``RANK`` by node from ``starts`` (node, *RANK); the least label wins in every part, in this order.

    Distance first, then hops, then the lower owner, then the lower predecessor, then the lower edge. Hops grow
    along a path even where streets weigh nothing, so predecessors lead back to a start.
    """
    best: dict[int, tuple] = {}
    heap = []
    for node, *label in starts:
        label = tuple(label)
        if node not in best or label < best[node]:
            best[node] = label
            heap.append((*label[:3], node))
    heapq.heapify(heap)
    done = set()
    while heap:
        *_, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        d, hops, owner = best[u][:3]
        for v, e, w in near.get(u, ()):
            if v in done or (limit is not None and d + w > limit):
                continue
            label, old = (d + w, hops + 1, owner, u, e), best.get(v)
            if old is None or label < old:
                best[v] = label
                if old is None or label[:3] < old[:3]:
                    heapq.heappush(heap, (*label[:3], v))
    return best


PATHS = "source long, node_id long, dist long, hops long, owner long, prev long, prev_edge long"


def path_rows(source: int, found: dict) -> pa.RecordBatch:
    """``label_nodes`` as rows of ``PATHS``; starts have a null predecessor."""
    rows = [(source, n, d, h, o, None if e < 0 else u, None if e < 0 else e) for n, (d, h, o, u, e) in found.items()]
    names = ["source", "node_id", "dist", "hops", "owner", "prev", "prev_edge"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names=names)


def _pathfinder(shared, limit):
    def run(batches):
        near = _adjacency(shared.value)
        for batch in batches:
            for source, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = [(s["node_id"], 0, 0, s["owner"], -1, -1) for s in starts]
                yield path_rows(source, label_nodes(near, first, limit))

    return run


def _owned(sources: DataFrame) -> DataFrame:
    """``(source, node_id, owner)`` as longs, each start once; without an ``owner`` column it is 0."""
    owner = F.col("owner").cast("long") if "owner" in sources.columns else F.lit(0).cast("long")
    return sources.select(F.col("source").cast("long").alias("source"), F.col("node_id").cast("long").alias("node_id"), owner.alias("owner")).distinct()


def shortest_paths(edges: DataFrame, sources: DataFrame, weight: Column, limit: int | None = None, max_rounds: int = 100_000, task_edges: int = TASK_EDGES, nodes: DataFrame | None = None) -> DataFrame:
    """``(source, node_id, dist, prev, prev_edge)`` from each ``(source, node_id)`` start.

    A network of at most ``task_edges`` edges is broadcast and searched by tasks, sources side by side. A larger
    one is relaxed in rounds with the same result, predecessors included: of equal distances the one of fewer
    hops wins, then the lower predecessor, then the lower edge. With ``nodes`` (x, y) it is searched over cells
    instead, by ``overlay.overlay_paths``, whose rounds count cells and not streets.
    """
    if (shared := _small(edges, weight, task_edges)) is not None:
        grouped = _owned(sources).groupBy("source").agg(F.collect_list(F.struct("node_id", "owner")).alias("starts"))
        found = grouped.mapInArrow(_pathfinder(shared, limit), PATHS)
    elif nodes is not None:
        from strandplan.operators.overlay import overlay_paths, wide_cells

        found = overlay_paths(edges, wide_cells(nodes), sources, weight, limit, max_rounds=max_rounds)
    else:
        found = relaxed_paths(edges, sources, weight, limit, max_rounds)
    return found.select("source", "node_id", "dist", "prev", "prev_edge")


class Labels:
    """The least label of each key, kept as written parts: a round adds what changed and reads what it asks about.

    Parts are merged when a later one is at least half as large as the one before, so a label is written again
    a logarithmic number of times, not once a round.
    """

    def __init__(self, spark, keys: tuple[str, ...], label: tuple[str, ...] = RANK):
        self.spark, self.keys, self.label, self.parts, self.stale = spark, list(keys), label, [], []

    def _least(self, df: DataFrame) -> DataFrame:
        least = df.groupBy(*self.keys).agg(F.min(F.struct(*self.label)).alias("_l"))
        return least.select(*self.keys, *[F.col(f"_l.{c}").alias(c) for c in self.label])

    def _union(self) -> DataFrame:
        every = self.parts[0][0]
        for df, _, _ in self.parts[1:]:
            every = every.unionByName(df)
        return every

    def add(self, df: DataFrame, path: str, rows: int) -> None:
        """Take over a written table of labels, which may be read until the next one comes."""
        for old in self.stale:
            remove(self.spark, old)
        self.stale = []
        self.parts.append((df.select(*self.keys, *self.label), path, rows))
        while len(self.parts) > 1 and 2 * self.parts[-1][2] >= self.parts[-2][2]:
            (a, at_a, n_a), (b, at_b, n_b) = self.parts[-2:]
            both, at = written_at(self._least(a.unionByName(b)), "labels")
            self.parts[-2:] = [(both, at, n_a + n_b)]
            self.stale += [at_a, at_b]

    def against(self, offers: DataFrame) -> DataFrame:
        """``offers`` (written, a key once) that beat the label kept; ``fresh`` where more than the last step changes."""
        if not self.parts:
            return offers.withColumn("fresh", F.lit(True))
        asked = self._least(self._union().join(offers.select(*self.keys), self.keys, "left_semi"))
        old = asked.select(*self.keys, F.struct(*self.label).alias("_old"))
        better = offers.join(old, self.keys, "left").withColumn("_new", F.struct(*self.label)).where(F.col("_old").isNull() | (F.col("_new") < F.col("_old")))
        step = self.label[:-2]
        fresh = F.col("_old").isNull() | (F.struct(*[F.col(f"_new.{c}") for c in step]) < F.struct(*[F.col(f"_old.{c}") for c in step]))
        return better.withColumn("fresh", fresh).drop("_old", "_new")

    def all(self) -> DataFrame:
        return self._least(self._union())


def relaxed_paths(edges: DataFrame, sources: DataFrame, weight: Column, limit: int | None = None, max_rounds: int = 100_000) -> DataFrame:
    """``PATHS`` of a network of any size, by the labels of ``label_nodes``.

    Frontier relaxation: a round extends only the labels that got better in the round before, and compares what
    that offers with the labels of the nodes it reaches; settled labels are neither rewritten nor shuffled.
    Rounds are as many as the longest path has edges. ``limit`` stops paths beyond a distance. Starts have a null
    predecessor; an ``owner`` of a start is passed on to what it reaches.
    """
    spark = edges.sparkSession
    steps, steps_at = written_at(half_edges(edges.withColumn("w", weight.cast("long")), "w"), "half-edges")
    none = F.lit(-1).cast("long")
    first = _owned(sources).groupBy("source", "node_id").agg(F.min("owner").alias("owner"))
    first = first.select("source", "node_id", *[F.lit(0).cast("long").alias(c) for c in ("dist", "hops")], "owner", none.alias("prev"), none.alias("prev_edge"))
    labels = Labels(spark, ("source", "node_id"))
    front, at = written_at(first.withColumn("fresh", F.lit(True)), "front")
    for _ in range(max_rounds):
        rows = front.count()
        if not rows:
            break
        labels.add(front, at, rows)
        ahead = front.where("fresh").join(steps, front["node_id"] == steps["u"]).select(
            "source", F.col("v").alias("node_id"), (F.col("dist") + F.col("w")).alias("dist"), (F.col("hops") + 1).alias("hops"), "owner", F.col("u").alias("prev"), F.col("edge_id").alias("prev_edge")
        )
        if limit is not None:
            ahead = ahead.where(F.col("dist") <= limit)
        offers, offers_at = written_at(labels._least(ahead), "offers")
        front, at = written_at(labels.against(offers), "front")
        remove(spark, offers_at)
    else:
        raise RuntimeError("shortest paths did not settle")
    remove(spark, steps_at)
    known = lambda c: F.when(F.col("prev_edge") >= 0, F.col(c)).alias(c)
    if not labels.parts:
        return spark.createDataFrame([], PATHS)
    return labels.all().select("source", "node_id", "dist", "hops", "owner", known("prev"), known("prev_edge"))


def rooted_tree(edges: DataFrame, root: int, task_edges: int = TASK_EDGES) -> DataFrame:
    """``(node_id, parent, parent_edge, depth, path_m)`` of the forest edges (with ``len_m``) reachable from ``root``.

    Up to ``task_edges`` edges are walked in one task; more of them are rooted by their Euler tour, in rounds that
    grow with the logarithm of their number.
    """
    if (shared := _small(edges, F.col("len_m"), task_edges)) is not None:

        def walk(batches):
            near = _adjacency(shared.value)
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    order, at = [start], {start: (None, None, 0, 0)}
                    for u in order:
                        for v, e, w in sorted(near.get(u, ())):
                            if v not in at:
                                at[v] = (u, e, at[u][2] + 1, at[u][3] + w)
                                order.append(v)
                    rows = [(n, *at[n]) for n in order]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node_id", "parent", "parent_edge", "depth", "path_m"])

        one = edges.sparkSession.range(root, root + 1, 1, 1)
        return one.mapInArrow(walk, "node_id long, parent long, parent_edge long, depth int, path_m long")
    from strandplan.operators.trees import euler_tour

    return euler_tour(edges, root).select("node_id", "parent", "parent_edge", F.col("depth").cast("int").alias("depth"), "path_m")


def subtree_sums(tree: DataFrame, values: DataFrame) -> DataFrame:
    """``(node_id, total)``: each node's and its descendants' ``value``; pointer doubling, so rounds grow with log depth.

    Every node passes what it has gathered to its ancestor 2^k steps up; after round k a node holds its
    descendants nearer than 2^(k+1) steps.
    """
    start = tree.join(values, "node_id", "left").select("node_id", F.col("parent").alias("up"), F.coalesce("value", F.lit(0)).cast("long").alias("total"))
    now, at = written_at(start, "sums")
    while not now.where("up is not null").isEmpty():
        gained = now.where("up is not null").groupBy(F.col("up").alias("to")).agg(F.sum("total").alias("more"))
        above = now.select(F.col("node_id").alias("mid"), F.col("up").alias("next"))
        step = now.join(gained.hint("merge"), now["node_id"] == gained["to"], "left").join(above.hint("merge"), now["up"] == above["mid"], "left")  # no round passes a table through the driver
        nxt, nxt_at = written_at(step.select("node_id", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")), "sums")
        remove(tree.sparkSession, at)
        now, at = nxt, nxt_at
    return now.select("node_id", "total")


#: Nodes, about, that a task joins up at once where a network is larger than a task.
PIECE_NODES = 200_000


def _pieces(most: int, name: str = "label"):
    """Streets ``(u, v)`` joined up as they come: ``(node, name)``, the label of a node is the least of its piece.

    After about ``most`` nodes a task lets go of what it holds and starts anew, so a node may have several labels.
    """

    def labelled(above):
        def top(n):
            while (up := above[n]) != n:
                above[n] = above[up]
                n = up
            return n

        nodes = list(above)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(n) for n in nodes], pa.int64())], names=["node", name])

    def run(batches):
        above: dict[int, int] = {}

        def top(n):
            while (up := above.setdefault(n, n)) != n:
                above[n] = above[up]
                n = up
            return n

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(u), top(v)
                if a != b:
                    above[max(a, b)] = min(a, b)
            if len(above) > most:
                yield labelled(above)
                above.clear()
        if above:
            yield labelled(above)

    return run


def linked(edges: DataFrame, task_edges: int = TASK_EDGES, piece: int = PIECE_NODES) -> DataFrame:
    """``(node, component)`` of the ends of a street network's edges; the component is its smallest node.

    Up to ``task_edges`` edges are joined up in one task. More are dealt by ranges of their lower end, and each task
    joins up ``piece`` nodes at a time; only nodes that got several labels link these, so what is left is a far
    smaller network of labels, joined up likewise. Where it is not (ends in no order), by star contraction.
    """
    ends = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.lit(0).cast("long").alias("edge_id"))
    shared = _small(ends, F.lit(0), task_edges)
    if shared is not None:
        one = _pieces(1 << 62, "component")

        def join_up(batches):
            for batch in batches:
                if batch.num_rows:
                    table = shared.value
                    yield from one([pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], names=["u", "v"])] if len(table) else [])

        return edges.sparkSession.range(0, 1, 1, 1).mapInArrow(join_up, "node long, component long")
    rows = ends.count()
    dealt = ends.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).repartitionByRange(-(-rows // piece), "u")
    pieces = written(dealt.mapInArrow(_pieces(piece), "node long, label long"), "pieces")
    least = written(pieces.groupBy("node").agg(F.min("label").alias("low"), F.count("*").alias("n")), "least")
    links = pieces.join(least.where("n > 1"), "node").where(F.col("label") != F.col("low")).select(F.col("label").alias("src"), F.col("low").alias("dst"))
    links = written(links.distinct(), "links")
    left = links.count()
    if left > task_edges and 2 * left > rows:
        above = connected_components(links, "src", "dst")
    else:
        above = linked(links, task_edges, piece)
    above = above.select(F.col("node").alias("low"), "component")
    return written(least.join(above, "low", "left").select("node", F.coalesce("component", "low").alias("component")), "linked")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node_id, component)`` of every node, isolated ones by themselves."""
    found = linked(edges)
    return nodes.select("node_id").join(found, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def cycle_count(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row ``(edges, nodes, components, rings)``: independent cycles are E - V + C; ``found`` is ``linked(edges)``, if known.

    A component is named by its smallest node, so it is counted there.
    """
    found = linked(edges) if found is None else found
    pieces = found.agg(F.count("*").alias("nodes"), F.count(F.when(F.col("node") == F.col("component"), 1)).alias("components"))
    return pieces.crossJoin(edges.agg(F.count("*").alias("edges"))).select("edges", "nodes", "components", (F.col("edges") - F.col("nodes") + F.col("components")).alias("rings"))


def tree_check(edges: DataFrame, required: DataFrame) -> DataFrame:
    """One row: whether the edges are one tree, and how many required nodes it misses."""
    found = linked(edges)
    missing = required.select("node_id").distinct().join(found, F.col("node_id") == F.col("node"), "left_anti").agg(F.count("*").alias("missing"))
    counts = cycle_count(edges, found)
    return counts.crossJoin(missing).withColumn("ok", (F.col("rings") == 0) & (F.col("components") == 1) & (F.col("missing") == 0))
