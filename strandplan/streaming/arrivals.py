"""Premises that arrive as a stream: snapped to the network and counted per node as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.operators.spatial import within
from strandplan.rules import RULES


def snapped(arrivals: DataFrame, nodes: DataFrame, radius: int = RULES.max_drop_m) -> DataFrame:
    """Each arrival (``prem_id, x, y, units, ts``) with its nearest node, in batch or stream form.

    Nodes are static, so it is a stream-static equi-join on grid cells, and the choice of the nearest is an
    aggregate over the arrival's own candidates with the event time kept for the watermark. Arrivals with no
    node within ``radius`` give no row.
    """
    near = within(arrivals, nodes, radius)
    best = near.groupBy("prem_id", "units", F.window("ts", "1 minute").alias("w")).agg(F.min(F.struct("sq", "node_id")).alias("best"))
    return best.select("prem_id", "units", F.col("w.end").alias("ts"), F.col("best.node_id").alias("node_id"), "best.sq")


def running_units(arrivals: DataFrame, nodes: DataFrame, on_batch) -> object:
    """A writer that hands each micro-batch of snapped arrivals to ``on_batch(df, batch_id)``; start it with ``start()``."""
    return snapped(arrivals.withWatermark("ts", "10 minutes"), nodes).writeStream.outputMode("update").foreachBatch(on_batch)
