"""The geometry dump: a line for each head-end, cabinet, terminal, premises and used edge of a design."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: kind, columns after it.
KINDS = {
    "co": ("node_id",),
    "fdh": ("area_id", "fdh_node", "cabinet_units", "splitters", "units", "take_units", "feeder_m"),
    "term": ("term_id", "node_id", "area_id", "ports", "used", "path_m"),
    "prem": ("prem_id", "area_id", "term_id", "drop_m"),
    "edge": ("edge_id", "trench", "dist_fibers", "feeder_fibers"),
}


def geometry_lines(head_ends: DataFrame, areas: DataFrame, terminals: DataFrame, premises: DataFrame, edge_usage: DataFrame) -> DataFrame:
    """``(part, ord, line)``; live terminals and used edges only, -1 for what is missing."""
    used = edge_usage.where("trench or dist_fibers > 0 or feeder_fibers > 0").withColumn("trench", F.col("trench").cast("int"))
    tables = {"co": (head_ends, "he_idx"), "fdh": (areas, "area_id"), "term": (terminals.where("used > 0"), "term_id"), "prem": (premises, "prem_id"), "edge": (used, "edge_id")}
    parts = [head_ends.sparkSession.createDataFrame([(0, 0, "GEOM 1"), (9, 0, "END")], "part int, ord long, line string")]
    for k, (kind, columns) in enumerate(KINDS.items(), 1):
        df, key = tables[kind]
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("-1")) for c in columns]
        parts.append(df.select(F.lit(k).alias("part"), F.col(key).cast("long").alias("ord"), F.concat_ws(" ", F.lit(f"G {kind}"), *cells).alias("line")))
    return reduce(DataFrame.unionByName, parts)


def parse_geometry(lines: DataFrame) -> dict[str, DataFrame]:
    """Tables by kind from the dump's lines (column ``value``)."""
    cut = lines.select(F.split("value", " ").alias("c")).where(F.get("c", F.lit(0)) == "G")
    return {
        kind: cut.where(F.get("c", F.lit(1)) == kind).select(*[F.get("c", F.lit(i)).cast("long").alias(name) for i, name in enumerate(columns, 2)])
        for kind, columns in KINDS.items()
    }


def read_geometry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables by kind from a file or folder."""
    return parse_geometry(spark.read.text(path))
