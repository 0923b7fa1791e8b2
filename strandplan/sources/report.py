"""The design report as text lines, and what can be read back from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.functions.exprs import money


def search_lines(told: DataFrame, part: int = 4) -> DataFrame:
    """``(part, ord, line)`` of what a search did, from one row of ``design.sweeps``: a line a step."""
    def field(name, c):
        return F.concat(F.lit(f"{name}="), F.col(c).cast("string"))

    steps = [
        ("assignment_m", [("areas", "areas"), ("seeds", "seeds"), ("sites", "sites"), ("exact", "exact"), ("cycles", "cycles"), ("moved", "moved"), ("stop", "stop")]),
        ("sweep_score", [("unpriced", "score_unpriced"), ("priced", "score_priced"), ("kept", "kept"), ("final", "final")]),
        ("keypath_exchange", [("moves", "tree_moves"), ("cents_before", "tree_before"), ("cents_after", "tree_after"), ("undone", "undone")]),
        ("spur_resite", [("emptied", "emptied"), ("moves", "resited")]),
        ("reach_repair", [("moves", "repaired"), ("over_before", "over_before"), ("over_after", "over_after"), ("route_max_m", "worst_route")]),
        ("uncross", [("swaps", "swaps"), ("scans", "scans"), ("residual", "residual")]),
    ]
    rows = [F.struct(F.lit(k).cast("long").alias("ord"), F.concat(F.lit(f"  {name}: "), F.concat_ws(" ", *[field(*f) for f in fields])).alias("line")) for k, (name, fields) in enumerate(steps)]
    rows.append(F.struct(F.lit(-1).cast("long").alias("ord"), F.lit("sweeps:").alias("line")))
    return told.select(F.explode(F.array(*rows)).alias("r")).select(F.lit(part).alias("part"), "r.ord", "r.line")


def report_lines(
    summary: DataFrame, areas: DataFrame, utilization: DataFrame, bom: DataFrame, rollup: DataFrame, checks: DataFrame, verdict: DataFrame,
    head_ends: DataFrame | None = None, told: DataFrame | None = None,
) -> DataFrame:
    """``(part, ord, line)``: headline, head-ends, areas, utilization, bill of materials, cost, the search and QA."""
    titles = {0: "design:", 1: "utilization:", 2: "bom:", 3: "cost:", 5: "qa:"}
    title = bom.sparkSession.createDataFrame([(p, -2, t) for p, t in titles.items()], "part int, ord long, line string")

    def lines(part, df, order, text):
        return df.select(F.lit(part).alias("part"), order.cast("long").alias("ord"), text.alias("line"))

    s = lambda c: F.col(c).cast("string")
    field = lambda c: F.concat(F.lit(f"{c}="), s(c))
    parts = [
        title,
        lines(0, summary, F.lit(-1), F.concat(F.lit("  "), F.concat_ws(" ", *[field(c) for c in summary.columns]))),
        lines(0, areas, F.col("area_id") + 1, F.concat(F.lit("  area "), s("area_id"), F.lit(": "), F.concat_ws(" ", *[field(c) for c in ("fdh_node", "units", "cabinet_units", "splitters", "feeder_m")]))),
        lines(1, utilization, F.col("ord"), F.concat(F.lit("  "), F.col("check"), F.lit(": "), s("used"), F.lit("/"), s("installed"), F.lit(" = "), F.col("text"), F.lit("%"))),
        lines(2, bom, F.col("ord"), F.concat(F.lit("  "), F.col("item"), F.lit(" qty="), s("qty"), F.lit(" "), F.col("unit"), F.lit(" unit=$"), money("unit_cost"), F.lit(" ext=$"), money("ext"))),
        lines(3, rollup, F.lit(0), F.concat(F.lit("  total_capex=$"), F.col("total_text"))),
        lines(3, rollup, F.lit(1), F.concat(F.lit("  per_unit_passed=$"), money("per_unit"))),
        lines(3, rollup, F.lit(2), F.concat(F.lit("  "), F.concat_ws(" ", field("trench_m"), field("cable_m"), field("sharing_x100")))),
        lines(5, checks, F.col("ord"), F.concat(F.lit("  "), F.col("check"), F.lit(": "), F.when(F.col("ok"), "ok").otherwise(F.concat(s("failures"), F.lit(" FAIL"))))),
        lines(5, verdict, F.lit(99), F.concat(F.lit("qa verdict: "), F.col("verdict"))),
    ]
    if head_ends is not None:
        parts.append(lines(0, head_ends, F.lit(0), F.concat(F.lit("  head_end "), s("he_idx"), F.lit(": "), field("node_id"))))
    if told is not None:
        parts.append(search_lines(told))
    return reduce(DataFrame.unionByName, parts)


def scrape_report(lines: DataFrame) -> DataFrame:
    """One row ``(capex_cents, qa_errors, verdict)`` from report lines (column ``value``)."""
    capex = F.regexp_extract("value", r"total_capex=\$(-?\d+\.\d\d)", 1)
    return lines.agg(
        F.max(F.when(capex != "", F.regexp_replace(capex, r"\.", "").cast("long"))).alias("capex_cents"),
        F.count(F.when(F.col("value").rlike(r"^  .* FAIL$"), 1)).alias("qa_errors"),
        F.max(F.when(F.col("value").startswith("qa verdict: "), F.substring("value", 13, 10))).alias("verdict"),
    )


def bom_from_report(lines: DataFrame) -> DataFrame:
    """``(item, qty, unit_cents, ext_cents)`` of a report's bill of materials."""
    pattern = r"^  (\S+) qty=(\d+) \S+ unit=\$(\d+)\.(\d\d) ext=\$(\d+)\.(\d\d)$"
    g = lambda i: F.regexp_extract("value", pattern, i)
    return lines.where(F.col("value").rlike(pattern)).select(
        g(1).alias("item"), g(2).cast("long").alias("qty"), F.concat(g(3), g(4)).cast("long").alias("unit_cents"), F.concat(g(5), g(6)).cast("long").alias("ext_cents")
    )
