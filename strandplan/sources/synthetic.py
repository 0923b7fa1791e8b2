"""Street networks from nothing or from the driver's tables: closed-form grids, scenario towns, a seeded town."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandplan.functions.exprs import div

SPACING = 100
ARTERIALS = (10, 20)


def grid_nodes(spark: SparkSession, w: int = 30, h: int = 30, spacing: int = SPACING) -> DataFrame:
    """``(node_id, x, y)`` in row order."""
    n = spark.range(w * h)
    return n.select(
        F.col("id").alias("node_id"), (F.col("id") % w * spacing).alias("x"), (div("id", F.lit(w)) * spacing).alias("y")
    )


def grid_edges(spark: SparkSession, w: int = 30, h: int = 30, arterials: tuple = ARTERIALS) -> DataFrame:
    """``(edge_id, src, dst, surface)``: horizontal streets first, then vertical; arterial rows and columns are asphalt."""
    across, down = (w - 1) * h, w * (h - 1)
    e = spark.range(across).select(F.col("id").alias("edge_id"), div("id", F.lit(w - 1)).alias("row"), (F.col("id") % (w - 1)).alias("col"))
    horizontal = e.select("edge_id", (F.col("row") * w + F.col("col")).alias("src"), (F.col("row") * w + F.col("col") + 1).alias("dst"), F.col("row").isin(*arterials).cast("int").alias("surface"))
    e = spark.range(down).select(F.col("id"), div("id", F.lit(w)).alias("row"), (F.col("id") % w).alias("col"))
    vertical = e.select((F.col("id") + across).alias("edge_id"), (F.col("row") * w + F.col("col")).alias("src"), ((F.col("row") + 1) * w + F.col("col")).alias("dst"), F.col("col").isin(*arterials).cast("int").alias("surface"))
    return horizontal.unionByName(vertical)


def comb_edges(spark: SparkSession, w: int = 30, h: int = 30) -> DataFrame:
    """A tree on the grid's nodes: the first row and all columns, with the grid's edge ids."""
    across = (w - 1) * h
    row = spark.range(w - 1).select(F.col("id").alias("edge_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0).alias("surface"))
    down = spark.range(w * (h - 1)).select((F.col("id") + across).alias("edge_id"), F.col("id").alias("src"), (F.col("id") + w).alias("dst"), F.lit(0).alias("surface"))
    return row.unionByName(down)


def customer_premises(customer: DataFrame, w: int = 30, h: int = 30, spacing: int = SPACING) -> DataFrame:
    """``(prem_id, x, y, units)``: a premises for each customer, on a street chosen by modular arithmetic."""
    across = (w - 1) * h
    total = across + w * (h - 1)
    k = F.col("c_custkey").cast("long")
    p = customer.select(
        k.alias("prem_id"), (k * 7919 % total).alias("e"), (25 + k * 31 % 51).alias("along"), F.when(k % 2 == 0, 16).otherwise(-16).alias("off"),
        F.when(k % 17 == 0, 4 + F.col("c_nationkey").cast("long") % 13).otherwise(1).cast("long").alias("units"),
    )
    level, v = F.col("e") < across, F.col("e") - across
    x = F.when(level, F.col("e") % (w - 1) * spacing + F.col("along")).otherwise(v % w * spacing + F.col("off"))
    y = F.when(level, div("e", F.lit(w - 1)) * spacing + F.col("off")).otherwise(div(v, F.lit(w)) * spacing + F.col("along"))
    return p.select("prem_id", x.alias("x"), y.alias("y"), "units")


#: The same tables as SQL, for oracles.
NETWORK_SQL = """
nodes AS (SELECT i AS node_id, i % 30 * 100 AS x, i // 30 * 100 AS y FROM (SELECT unnest(range(0, 900)) AS i)),
edges AS (SELECT i AS edge_id, i // 29 * 30 + i % 29 AS src, i // 29 * 30 + i % 29 + 1 AS dst, CASE WHEN i // 29 IN (10, 20) THEN 1 ELSE 0 END AS surface
    FROM (SELECT unnest(range(0, 870)) AS i)
  UNION ALL SELECT 870 + i, i // 30 * 30 + i % 30, (i // 30 + 1) * 30 + i % 30, CASE WHEN i % 30 IN (10, 20) THEN 1 ELSE 0 END
    FROM (SELECT unnest(range(0, 870)) AS i)),
slots AS (SELECT c_custkey AS prem_id, c_custkey * 7919 % 1740 AS e, 25 + c_custkey * 31 % 51 AS along, CASE WHEN c_custkey % 2 = 0 THEN 16 ELSE -16 END AS off,
    CASE WHEN c_custkey % 17 = 0 THEN 4 + c_nationkey % 13 ELSE 1 END AS units FROM customer),
premises AS (SELECT prem_id, CASE WHEN e < 870 THEN e % 29 * 100 + along ELSE (e - 870) % 30 * 100 + off END AS x,
    CASE WHEN e < 870 THEN e // 29 * 100 + off ELSE (e - 870) // 30 * 100 + along END AS y, units FROM slots),
snap AS (SELECT prem_id, x, y, units, node_id, sq FROM (SELECT p.*, n.node_id, (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y) AS sq,
    row_number() OVER (PARTITION BY p.prem_id ORDER BY (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y), n.node_id) AS rn FROM premises p JOIN nodes n
    ON n.x BETWEEN p.x - 300 AND p.x + 300 AND n.y BETWEEN p.y - 300 AND p.y + 300) WHERE rn = 1),
drops AS (SELECT s.*, floor(sqrt(sq))::BIGINT AS drop_m, nx, ny, node_id // 300 * 3 + node_id % 30 // 10 AS area_id, (row_number() OVER (PARTITION BY node_id ORDER BY prem_id) - 1) // 12 AS batch
    FROM snap s JOIN (SELECT node_id, x AS nx, y AS ny FROM nodes) USING (node_id)),
terminals AS (SELECT node_id * 1000 + batch AS term_id, node_id, area_id, count(*) AS used, sum(units) AS units, CASE WHEN count(*) <= 2 THEN 2 WHEN count(*) <= 4 THEN 4
    WHEN count(*) <= 6 THEN 6 WHEN count(*) <= 8 THEN 8 ELSE 12 END AS ports FROM drops GROUP BY ALL),
elen AS (SELECT edge_id, src, dst, surface, floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))::BIGINT AS len_m, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_
    FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst)
"""

#: A grid as SQL whose side ``w`` grows with the customers, its comb and its premises, for oracles.
ROADS_SQL = """
dim AS (SELECT greatest(12, ceil(sqrt(count(*))))::BIGINT AS w FROM customer),
nodes AS (SELECT i AS node_id, i % w AS col, i // w AS row, i % w * 100 AS x, i // w * 100 AS y, w FROM dim, (SELECT unnest(range(0, (SELECT w * w FROM dim))) AS i)),
ends AS (SELECT i AS edge_id, i // (w - 1) * w + i % (w - 1) AS src, i // (w - 1) * w + i % (w - 1) + 1 AS dst FROM dim, (SELECT unnest(range(0, (SELECT (w - 1) * w FROM dim))) AS i)
  UNION ALL SELECT (w - 1) * w + i, i, i + w FROM dim, (SELECT unnest(range(0, (SELECT (w - 1) * w FROM dim))) AS i)),
slots AS (SELECT c_custkey AS prem_id, w, w * (w - 1) AS across, c_custkey * 7919 % (2 * w * (w - 1)) AS e, 25 + c_custkey * 31 % 51 AS along, CASE WHEN c_custkey % 2 = 0 THEN 16 ELSE -16 END AS off,
    CASE WHEN c_custkey % 17 = 0 THEN 4 + c_nationkey % 13 ELSE 1 END AS units FROM customer, dim),
premises AS (SELECT prem_id, units, CASE WHEN e < across THEN e % (w - 1) * 100 + along ELSE (e - across) % w * 100 + off END AS x,
    CASE WHEN e < across THEN e // (w - 1) * 100 + off ELSE (e - across) // w * 100 + along END AS y FROM slots),
snap AS (SELECT p.prem_id, p.x, p.y, p.units, n.node_id, n.row, n.col, n.w, n.x AS nx, n.y AS ny, (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y) AS sq FROM premises p
    JOIN nodes n ON n.x BETWEEN p.x - 100 AND p.x + 100 AND n.y BETWEEN p.y - 100 AND p.y + 100
    QUALIFY row_number() OVER (PARTITION BY p.prem_id ORDER BY (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y), n.node_id) = 1)
"""
