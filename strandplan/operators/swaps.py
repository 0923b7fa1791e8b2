"""Uncrossing by swaps that don't touch each other.

Two drops that cross may change terminals. What a swap gains is counted by joins of its two new segments, and of
its two old ones, with all drops near them. A swap occupies the cells that any of its four segments may touch; a
round takes every swap that gains most in all its cells. Segments of two swaps taken together then share no cell,
so they can't cross, neither before nor after: gains add up, and the score falls by their sum. Only swaps in
cells that a round has touched are counted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandplan.functions.exprs import dist_m
from strandplan.operators.choice import best_of_rivals
from strandplan.operators.spatial import box_cells, segment_crossings, self_crossings
from strandplan.plans.session import remove, written, written_at
from strandplan.rules import RULES

SIZE = 128
SEGMENT = ("x1", "y1", "x2", "y2")


def _cells(segments: DataFrame, key: str) -> DataFrame:
    """``(key, cell)``: the cells that segments' boxes touch, each once a key."""
    wide = box_cells(segments, *(F.col(c) for c in SEGMENT), SIZE)
    return wide.select(key, F.struct("cx", "cy").alias("cell")).distinct()


def _length(x1: str, y1: str, x2: str, y2: str) -> Column:
    return dist_m(x1, y1, x2, y2).cast("long")


def swap_candidates(drops: DataFrame, pairs: DataFrame, reach: int) -> DataFrame:
    """``(swap, side, id, x1, y1, x2, y2, terminal)``: the new segments of crossing ``pairs (a_id, b_id)`` whose units are equal and whose ends stay in reach."""
    both = pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    for end in "ab":
        both = both.join(drops.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in (*SEGMENT, "terminal", "units")]), end)
    near = (_length("a_x1", "a_y1", "b_x2", "b_y2") <= reach) & (_length("b_x1", "b_y1", "a_x2", "a_y2") <= reach)
    both = both.where((F.col("a_units") == F.col("b_units")) & (F.col("a_terminal") != F.col("b_terminal")) & near)
    new = [F.struct(F.lit(s).alias("side"), F.col(p).alias("id"), F.col(f"{p}_x1").alias("x1"), F.col(f"{p}_y1").alias("y1"), F.col(f"{q}_x2").alias("x2"), F.col(f"{q}_y2").alias("y2"), F.col(f"{q}_terminal").alias("terminal")) for s, p, q in ((0, "a", "b"), (1, "b", "a"))]
    return both.select(F.struct("a", "b").alias("swap"), F.explode(F.array(*new)).alias("n")).select("swap", "n.*")


def swap_gains(drops: DataFrame, new: DataFrame, cross: int, metre: int) -> DataFrame:
    """``(swap, gain)`` in cents: crossings and metres that the old segments have and the new ones don't."""
    old = new.select("swap", "side", "id").join(drops.select("id", *SEGMENT), "id")

    def crossings(segments: DataFrame, sign: int) -> DataFrame:
        mine = segments.select(F.struct("swap", "side").alias("id"), F.col("swap.a").alias("one"), F.col("swap.b").alias("two"), *SEGMENT)
        own = (F.col("b_id") == F.col("a_one")) | (F.col("b_id") == F.col("a_two"))
        met = segment_crossings(mine, drops.select("id", *SEGMENT), SIZE, skip=own)
        return met.groupBy(F.col("a_id.swap").alias("swap")).agg((F.count("*") * sign * cross).alias("gain"))

    def metres(segments: DataFrame, sign: int) -> DataFrame:
        return segments.groupBy("swap").agg(F.sum(_length(*SEGMENT) * sign * metre).alias("gain"))

    # The pair crossed; swapped ends of two crossing segments never do.
    pair = new.select("swap").distinct().withColumn("gain", F.lit(cross).cast("long"))
    parts = crossings(old, 1).unionByName(crossings(new, -1)).unionByName(metres(old, 1)).unionByName(metres(new, -1)).unionByName(pair)
    return parts.groupBy("swap").agg(F.sum("gain").alias("gain"))


def uncrossed(
    drops: DataFrame, cross: int = RULES.drop_crossing, metre: int = RULES.drop_cable_m, reach: int = RULES.max_drop_m, log: list | None = None, max_rounds: int = 1_000,
) -> DataFrame:
    """``drops (id, x1, y1, x2, y2, terminal, units)`` after all swaps that help: no swap of two crossing drops gains any more.

    Ids are distinct; ``(x2, y2)`` is the terminal's place. ``log`` gets the cents that each round gained, all
    above 0. Drops without a crossing come back as they are.
    """
    spark = drops.sparkSession
    now, at = written_at(drops.select("id", *SEGMENT, "terminal", "units"), "drops")
    touched, waiting = None, None
    for _ in range(max_rounds):
        pairs = written(self_crossings(now, SIZE).select("a_id", "b_id"), "crossings") if touched is None else None
        if touched is not None:
            # A crossing is new, or its gain may have changed, only where a drop of the pair touches a touched cell.
            some = written(now.join(_cells(now, "id").join(touched, "cell", "left_semi").select("id").distinct(), "id", "left_semi"), "some")
            met = segment_crossings(some, now, SIZE, skip=F.col("a_id") == F.col("b_id"))
            pairs = written(met.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct(), "crossings")
        new = written(swap_candidates(now, pairs, reach), "swaps")
        gains = swap_gains(now, new, cross, metre).where("gain > 0")
        offers = new.join(gains, "swap")
        if waiting is not None:
            offers = offers.unionByName(waiting)
        offers = written(offers, "offers")
        if offers.isEmpty():
            return now
        old = offers.select("swap", "id").join(now.select("id", *SEGMENT), "id")
        cells = written(_cells(offers.select("swap", *SEGMENT).unionByName(old.select("swap", *SEGMENT)), "swap"), "swap-cells")
        ranked = cells.join(offers.select("swap", "gain").distinct(), "swap")
        chosen = written(best_of_rivals(ranked, "swap", "cell", -F.col("gain")), "chosen")
        if log is not None:
            log.append(offers.where("side = 0").join(chosen, "swap").agg(F.sum("gain")).first()[0])
        touched = written(cells.join(chosen, "swap").select("cell").distinct(), "touched")
        # What waits keeps its gain unless one of its cells was touched; those are counted again.
        stale = cells.join(touched, "cell", "left_semi").select("swap").distinct()
        waiting = written(offers.join(stale, "swap", "left_anti"), "waiting")
        moves = offers.join(chosen, "swap", "left_semi").select("id", F.col("x2").alias("nx"), F.col("y2").alias("ny"), F.col("terminal").alias("nt"))
        after = now.join(moves, "id", "left").select("id", "x1", "y1", F.coalesce("nx", "x2").alias("x2"), F.coalesce("ny", "y2").alias("y2"), F.coalesce("nt", "terminal").alias("terminal"), "units")
        nxt, nxt_at = written_at(after, "drops")
        remove(spark, at)
        now, at = nxt, nxt_at
    raise RuntimeError("uncrossing did not settle")
