"""Converters: parcel polygons or canal banks to a street network with premises.

Geometry is exploded to points and edges and worked on by grid joins; only a ring's own order-dependent work
runs in Python, a ring at a time. What has to shrink to a node budget is tried on a ladder of tolerances.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandplan.functions.exprs import project, ring_centroid
from strandplan.kernels import rings
from strandplan.operators import graph, spatial
from strandplan.operators.numbering import dense_ids
from strandplan.plans.session import written
from strandplan.rules import RULES
from strandplan.sources.geojson import Projection, outer_rings

#: Fixed values of the converters: tolerances in metres, cell of the density map in degrees, bank spacing in metres.
LADDER = (0, 1, 2, 4, 8)
CELL_DEG = 0.02
BANK_STEP = 15.24
LINK_M, CROSS_M, BRIDGE_M, LAND_M = 40, 120, 2000, 200
#: Limits that other converters set; here they are arguments, and without them all data stays.
LIMITS = {"most_nodes": 98_304, "most_parcels": 131_072, "most_links": 500, "most_land": 60_000}

RING = "array<struct<x:int,y:int>>"


def id_order(raw: Column) -> Column:
    """Order of feature ids: whole numbers by value, then other text, then none."""
    number = raw.try_cast("bigint")
    return F.struct(F.when(number.isNotNull(), 0).when(raw.isNotNull(), 1).otherwise(2).alias("rank"), number.alias("n"), raw.alias("s"))


def _points(ring, fn) -> list:
    return [{"x": int(round(p[0])), "y": int(round(p[1]))} for p in fn([(p["x"], p["y"]) for p in ring])]


def simplified(c: Column, tolerance: int) -> Column:
    """A ring simplified to a tolerance."""
    f = F.pandas_udf(lambda s: s.map(lambda r: _points(r, lambda ring: rings.simplify(ring, tolerance))), RING)
    return f(c)


def resampled(c: Column, step: float = BANK_STEP) -> Column:
    """A ring with a point every ``step`` metres."""
    f = F.pandas_udf(lambda s: s.map(lambda r: _points(r, lambda ring: rings.resample(ring, step))), RING)
    return f(c)


def density(points: DataFrame) -> DataFrame:
    """``(cx, cy, n, rank)``: cells of the density map, the fullest first, then by cell."""
    n = points.groupBy(F.floor(F.col("lon") / CELL_DEG).alias("cx"), F.floor(F.col("lat") / CELL_DEG).alias("cy")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "cx", "cy")))


def grow_area(cells: dict[tuple[int, int], int], most: int) -> list[tuple[int, int]]:
    """Cells from the fullest on, always the fullest neighbour next, until the next one would pass ``most``."""
    order = lambda c: (-cells[c], c)
    taken = [min(cells, key=order)]
    total = cells[taken[0]]
    while True:
        edge = {(x + i, y + j) for x, y in taken for i in (-1, 0, 1) for j in (-1, 0, 1)} & cells.keys() - set(taken)
        if not edge or total + cells[best := min(edge, key=order)] > most:
            return taken
        taken.append(best)
        total += cells[best]


def parcels(features: DataFrame) -> DataFrame:
    """``(parcel, ring, lon, lat)``: the outer rings of polygon features with the centroid of the first."""
    f = features.where(F.col("type").isin("Polygon", "MultiPolygon")).withColumn("rings", outer_rings(F.col("type"), F.col("coordinates"))).where(F.size("rings") > 0)
    numbered = dense_ids(f, id_order(F.col("id")), "coordinates", name="parcel")
    lon, lat = ring_centroid(F.get("rings", F.lit(0)))
    return numbered.withColumns({"lon": lon, "lat": lat}).select("parcel", "rings", "lon", "lat")


def ring_edges(rows: DataFrame, ring: str, surface: int = 0) -> DataFrame:
    """``(x1, y1, x2, y2, surface)``: the sides of closed rings, each unordered pair once."""
    r = F.col(ring)
    ahead = F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1))
    sides = rows.where(F.size(r) > 1).select(F.explode(F.zip_with(r, ahead, lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))).alias("s"))
    return sides.where("s.a <> s.b").select(F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"), F.lit(surface).alias("surface")).distinct()


def as_network(sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of segments: nodes in (y, x) order, the lower surface of a repeated edge, edges in pair order."""
    points = sides.select(F.col("x1").alias("x"), F.col("y1").alias("y")).union(sides.select("x2", "y2")).distinct()
    nodes = written(dense_ids(points, "y", "x", name="node_id").select("node_id", "x", "y"), "nodes")
    a = nodes.select(F.col("node_id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = graph.distinct_edges(sides.join(a, ["x1", "y1"]).join(b, ["x2", "y2"]).select("src", "dst", "surface"))
    return nodes, written(dense_ids(pairs, "src", "dst", name="edge_id").select("edge_id", "src", "dst", "surface"), "edges")


def joined_up(nodes: DataFrame, edges: DataFrame, surface: int = 1, radius: int = BRIDGE_M, rounds: int = 40) -> DataFrame:
    """``edges`` with bridges until the network is one piece: each round every piece is linked to its nearest other.

    Pieces with no other in ``radius`` end the loop; a later check reports them.
    """
    for _ in range(rounds):
        parts = graph.components(edges, nodes).join(nodes, "node_id")
        near = spatial.nearest_between(parts, "node_id", "component", radius)
        bridges = near.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        bridges = written(bridges, "bridges")
        if bridges.isEmpty():
            return edges
        every = edges.select("src", "dst", "surface").union(bridges.select("src", "dst", F.lit(surface)))
        edges = written(dense_ids(graph.distinct_edges(every), "src", "dst", name="edge_id").select("edge_id", "src", "dst", "surface"), "edges")
    return edges


def with_links(nodes: DataFrame, edges: DataFrame, groups: DataFrame, radius: int, most: int | None, surface: int) -> DataFrame:
    """``edges`` with the links between nodes of different groups within ``radius``: all of them, or the ``most`` shortest."""
    links = spatial.pairs_between(groups.join(nodes, "node_id"), "node_id", "grp", radius, most)
    every = edges.select("src", "dst", "surface").union(links.select("a", "b", F.lit(surface)))
    return dense_ids(graph.distinct_edges(every), "src", "dst", name="edge_id").select("edge_id", "src", "dst", "surface")


def reachable_premises(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(prem_id, x, y, units)`` of points with a node in a drop's reach, numbered anew."""
    near = spatial.within(points, nodes, RULES.max_drop_m).select("key").distinct()
    kept = points.join(near, "key", "left_semi")
    return dense_ids(kept, "key", name="prem_id").select("prem_id", "x", "y", F.lit(1).alias("units"))


def parcels_to_network(
    features: DataFrame, projection: Projection, most_nodes: int | None = None, most_parcels: int | None = None, most_links: int | None = None, tolerance: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, premises): parcel boundaries are ways, parcel centroids are premises.

    Every parcel is kept and its rings are simplified to ``tolerance`` metres. Limits are the caller's choice:
    with ``most_parcels`` the area of interest grows from the densest cell up to so many; with ``most_nodes`` rings
    take the first tolerance of the ladder, from ``tolerance`` on, that keeps the nodes within it, and beyond the
    last the sparsest cell goes; ``most_links`` keeps the shortest links between pieces. ``LIMITS`` has usual values.
    """
    p = (projection.lon0, projection.lat0, projection.kx_m_per_deg, projection.ky_m_per_deg)
    rows = written(parcels(features), "parcels")
    area, cells = None, {}
    if most_parcels is not None or most_nodes is not None:
        # Cells, not parcels, reach the driver.
        cells = {(r["cx"], r["cy"]): r["n"] for r in density(rows).collect()}
        area = grow_area(cells, most_parcels) if most_parcels is not None else sorted(cells)
    spark = features.sparkSession
    while True:
        inside = rows
        if area is not None:
            wanted = spark.createDataFrame(area, "cx long, cy long")
            inside = rows.join(wanted, (F.floor(F.col("lon") / CELL_DEG) == F.col("cx")) & (F.floor(F.col("lat") / CELL_DEG) == F.col("cy")), "left_semi")
        x, y = project("lon", "lat", *p)
        flat = inside.select("parcel", x.alias("x"), y.alias("y"), F.explode("rings").alias("ring")).withColumn(
            "ring", F.transform("ring", lambda q: F.struct(*(c.alias(n) for c, n in zip(project(q["x"], q["y"], *p), ("x", "y"), strict=True))))
        )
        flat = written(flat, "rings")
        for step in [t for t in LADDER if t >= tolerance] if most_nodes is not None else [tolerance]:
            sides = written(ring_edges(flat.withColumn("ring", simplified(F.col("ring"), step)), "ring"), "sides")
            if most_nodes is None or sides.select("x1", "y1").union(sides.select("x2", "y2")).distinct().count() <= most_nodes:
                nodes, edges = as_network(sides)
                groups = written(graph.components(edges, nodes).select("node_id", F.col("component").alias("grp")), "groups")
                edges = joined_up(nodes, with_links(nodes, edges, groups, LINK_M, most_links, 1))
                points = flat.select(F.col("parcel").alias("key"), "x", "y").distinct()
                return nodes, edges, reachable_premises(points, nodes)
        if len(area) == 1:
            raise ValueError("one cell alone is over the node budget")
        area.remove(max(area, key=lambda c: (-cells[c], c)))


def canals_to_network(canals: DataFrame, addresses: DataFrame, projection: Projection, step: float = BANK_STEP, most_land: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, premises): banks are soft ways, crossings to the opposite bank asphalt, addresses premises.

    Banks of different canals in reach are linked over land, by all links or the ``most_land`` shortest.
    """
    p = (projection.lon0, projection.lat0, projection.kx_m_per_deg, projection.ky_m_per_deg)
    flat = canals.select(F.explode(outer_rings(F.col("type"), F.col("coordinates"))).alias("ring")).select(
        F.transform("ring", lambda q: F.struct(*(c.alias(n) for c, n in zip(project(q["x"], q["y"], *p), ("x", "y"), strict=True)))).alias("ring")
    )
    numbered = dense_ids(flat, "ring", name="ring_id")
    banks = written(numbered.withColumn("ring", resampled(F.col("ring"), step)), "banks")
    spots = banks.select("ring_id", F.size("ring").alias("n"), F.posexplode("ring").alias("k", "q")).select(
        "ring_id", F.col("q.x").alias("x"), F.col("q.y").alias("y"), (F.col("k") * step).cast("long").alias("pos"), (F.col("n") * step).cast("long").alias("total")
    )
    spots = written(spots, "spots")
    across = spatial.opposite_banks(spots, "ring_id", "pos", "total", CROSS_M)
    end = lambda k: spots.select(F.col("ring_id").alias("ring"), F.col("pos").alias(k), F.col("x").alias(f"x_{k}"), F.col("y").alias(f"y_{k}"))
    crossings = across.join(end("a"), ["ring", "a"]).join(end("b"), ["ring", "b"]).select(
        F.col("x_a").alias("x1"), F.col("y_a").alias("y1"), F.col("x_b").alias("x2"), F.col("y_b").alias("y2"), F.lit(1).alias("surface")
    )
    nodes, edges = as_network(written(ring_edges(banks, "ring").unionByName(crossings), "sides"))
    groups = spots.join(nodes, ["x", "y"]).groupBy("node_id").agg(F.min("ring_id").alias("grp"))
    edges = joined_up(nodes, with_links(nodes, edges, written(groups, "groups"), LAND_M, most_land, 0))
    a = addresses.where(F.col("type") == "Point").select("id", F.from_json("coordinates", "array<double>").alias("c"))
    x, y = project(F.get("c", F.lit(0)), F.get("c", F.lit(1)), *p)
    points = dense_ids(a, id_order(F.col("id")), "c", name="key").select("key", x.alias("x"), y.alias("y"))
    return nodes, edges, reachable_premises(points, nodes)


def checked(nodes: DataFrame, edges: DataFrame, premises: DataFrame) -> DataFrame:
    """``(rule, n)`` of a converter's output: ends, loops, repeats, pieces, premises out of reach; all should be 0."""
    pieces = graph.components(edges, nodes).select("component").distinct()
    far = premises.select(F.col("prem_id").alias("key"), "x", "y")
    far = far.join(spatial.within(far, nodes, RULES.max_drop_m).select("key").distinct(), "key", "left_anti")
    rules = {"dangling": graph.dangling_edges(edges, nodes), "loops": edges.where("src = dst"), "repeats": graph.duplicate_edges(edges), "out_of_reach": far}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("rule"), "n") for k, df in rules.items()]
    rows.append(pieces.agg((F.count("*") - 1).alias("n")).select(F.lit("pieces").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, rows)
