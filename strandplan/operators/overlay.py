"""Shortest paths over cells: a partition overlay.

Nodes are put in cells that a task can hold. A round takes the cells whose entries got better, searches each in one
task from those entries alone, and offers what that gives to the entries of the neighbouring cells; between tasks
only labels of boundary nodes travel. So rounds count the cells on a path, not its streets. When nothing gets
better any more, every cell that was reached is searched once from all its entries, and labels its inside.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandplan.operators.graph import PATHS, RANK, Labels, half_edges, label_nodes, path_rows
from strandplan.plans.session import batches_of, remove, written, written_at

#: Nodes of a cell.
CELL_NODES = 4096
#: Most nodes of a cell where one search goes over the whole network.
WIDE_NODES = 65_536
#: Entries of a cell, about, that are searched in one row of a task; a source's entries stay together.
ENTRIES = 1024


def quad_cells(nodes: DataFrame, most: int = CELL_NODES) -> DataFrame:
    """``(node_id, cell)``, written: squares of the plane, cut in four until they hold at most ``most`` nodes.

    A round a level counts the nodes of the squares that are still open. Points that no cut can part are dealt by
    a hash. Any partition gives right paths; squares make few boundary nodes.
    """
    whole = nodes.agg(F.count("*"), F.min("x"), F.min("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()
    if whole[0] <= most:
        return written(nodes.select(F.col("node_id").cast("long").alias("node_id"), F.lit(0).cast("long").alias("cell")), "cells")
    _, left, low, extent = whole
    bits = int(extent).bit_length()
    closed = None
    rest = nodes.select(F.col("node_id").cast("long").alias("node_id"), (F.col("x") - left).cast("long").alias("x"), (F.col("y") - low).cast("long").alias("y"))
    # The first level that could do.
    for level in range(min(bits, max(1, (int(whole[0]) // most).bit_length() // 2)), bits + 1):
        at = [F.shiftright(F.col(c), bits - level) for c in ("x", "y")]
        placed = rest.withColumns({"cx": at[0], "cy": at[1]})
        counts = placed.groupBy("cx", "cy").agg(F.count("*").alias("n"))
        placed = written(placed.join(counts, ["cx", "cy"]), "cells")
        parts = F.pmod(F.xxhash64("node_id"), F.ceil(F.col("n") / most)) if level == bits else F.lit(0).cast("long")
        done = (placed if level == bits else placed.where(F.col("n") <= most)).select("node_id", F.xxhash64(F.lit(level), "cx", "cy", parts).alias("cell"))
        closed = done if closed is None else closed.unionByName(done)
        rest = placed.where(F.col("n") > most).select("node_id", "x", "y")
        if level < bits and rest.isEmpty():
            break
    return written(closed, "cells")


def wide_cells(nodes: DataFrame, least: int = CELL_NODES) -> DataFrame:
    """``quad_cells`` of a 64th of the nodes, within bounds: the cells on a way, and so the rounds, hardly grow with the network."""
    return quad_cells(nodes, max(least, min(WIDE_NODES, nodes.count() // 64)))


def pack_cells(edges: DataFrame, cells: DataFrame, weight: Column) -> DataFrame:
    """``(cell, inner, outer)``, written, a row a cell: its streets (u, v, edge, weight), and those that leave it with the cell beyond."""
    half = half_edges(edges.withColumn("w", weight.cast("long")), "w")
    for end in ("u", "v"):
        half = half.join(cells.select(F.col("node_id").alias(end), F.col("cell").alias(f"c{end}")), end)
    same = F.col("cu") == F.col("cv")
    inner = F.collect_list(F.when(same & (F.col("u") < F.col("v")), F.struct("u", "v", "edge_id", "w")))
    outer = F.collect_list(F.when(~same, F.struct("u", "v", "edge_id", "w", F.col("cv").alias("cell"))))
    return written(half.groupBy(F.col("cu").alias("cell")).agg(inner.alias("inner"), outer.alias("outer")), "packed-cells")


def _near(inner: list) -> dict:
    near: dict[int, list[tuple[int, int, int]]] = {}
    for r in inner:
        near.setdefault(r["u"], []).append((r["v"], r["edge_id"], r["w"]))
        near.setdefault(r["v"], []).append((r["u"], r["edge_id"], r["w"]))
    return near


def _starts(entries: list) -> dict[int, list[tuple]]:
    by: dict[int, list[tuple]] = {}
    for r in entries:
        by.setdefault(r["source"], []).append((r["node_id"], *(r[c] for c in RANK)))
    return by


def _offers(limit):
    """A cell's entries searched, and what its labels offer to the nodes beyond."""
    names = ["source", "node_id", "cell", *RANK]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                near, out = _near(r["inner"] or []), {}
                for source, starts in _starts(r["entries"]).items():
                    found = label_nodes(near, starts, limit)
                    for x in r["outer"] or ():
                        if x["u"] in found:
                            d, h, o = found[x["u"]][:3]
                            label = (d + x["w"], h + 1, o, x["u"], x["edge_id"])
                            key = source, x["v"], x["cell"]
                            if (limit is None or label[0] <= limit) and (key not in out or label < out[key]):
                                out[key] = label
                rows = [(*key, *label) for key, label in out.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)

    return run


def _insides(limit):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                near = _near(r["inner"] or [])
                for source, starts in _starts(r["entries"]).items():
                    yield path_rows(source, label_nodes(near, starts, limit))

    return run


def overlay_paths(
    edges: DataFrame, cells: DataFrame, sources: DataFrame, weight: Column, limit: int | None = None, packed: DataFrame | None = None, log: list | None = None, max_rounds: int = 100_000,
) -> DataFrame:
    """``PATHS`` from each start ``(source, node_id[, owner][, dist])``, ``dist`` away from the beginning: the labels of ``graph.label_nodes``, whatever the cells are.

    ``cells`` holds every node. ``packed`` may be passed if several searches run over the same cells. ``log``
    gets, for each round, the number of entries that got better. A row of a task is one cell with some
    ``ENTRIES`` entries; only a cell with more of them is read more than once. Starts that are no node reach nothing.
    """
    spark = edges.sparkSession
    packed = pack_cells(edges, cells, weight) if packed is None else packed
    none, zero = F.lit(-1).cast("long"), F.lit(0).cast("long")
    away, owner = (F.col(c).cast("long") if c in sources.columns else zero for c in ("dist", "owner"))
    starts = sources.select(F.col("source").cast("long").alias("source"), F.col("node_id").cast("long").alias("node_id"), F.struct(away.alias("dist"), owner.alias("owner")).alias("s"))
    first = starts.groupBy("source", "node_id").agg(F.min("s").alias("s")).join(cells, "node_id")
    first = first.select("source", "node_id", "cell", "s.dist", zero.alias("hops"), "s.owner", none.alias("prev"), none.alias("prev_edge"), F.lit(True).alias("fresh"))
    labels = Labels(spark, ("source", "node_id", "cell"))
    front, at = written_at(first, "front")
    by_cell = Window.partitionBy("cell")

    def rows_of(entries: DataFrame, how: str) -> DataFrame:
        block = F.pmod(F.xxhash64("source"), F.ceil(F.count("*").over(by_cell) / ENTRIES))
        grouped = entries.withColumn("block", block).groupBy("cell", "block").agg(F.collect_list(F.struct("source", "node_id", *RANK)).alias("entries"))
        return grouped.join(packed, "cell", how).select("inner", "outer", "entries")

    for _ in range(max_rounds):
        rows = front.count()
        if not rows:
            break
        if log is not None:
            log.append(rows)
        labels.add(front, at, rows)
        with batches_of(spark, 1):  # a row is a cell
            offered = rows_of(front.where("fresh"), "inner").mapInArrow(_offers(limit), "source long, node_id long, cell long, dist long, hops long, owner long, prev long, prev_edge long")
            offers, offers_at = written_at(labels._least(offered), "offers")
        front, at = written_at(labels.against(offers), "front")
        remove(spark, offers_at)
    else:
        raise RuntimeError("shortest paths did not settle")
    if not labels.parts:
        return spark.createDataFrame([], PATHS)
    with batches_of(spark, 1):
        return written(rows_of(labels.all(), "left").mapInArrow(_insides(limit), PATHS), "paths")
