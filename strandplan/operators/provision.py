"""Provisioning, bill of materials, QA and scoring over the design tables.

The tables: ``areas(area_id, fdh_node, units, feeder_m, head_end)``, ``terminals(term_id, node_id, area_id, used,
ports, path_m)``, ``premises(prem_id, units, area_id, term_id, drop_m)``, ``edge_usage(edge_id, len_m, surface,
trench, dist_fibers, feeder_fibers)``, ``head_ends(he_idx, node_id)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.functions.exprs import cable_demand, cable_stack, card_pack, ceil_div, cost_of, covering, div, money, percent, permille, splitter_bank, take_units
from strandplan.rules import CABINETS, CABLES, OLT_CARDS, RULES, SPLITTERS, TERMINALS, TRENCH


def provision_areas(areas: DataFrame) -> DataFrame:
    """Take units, splitter bank and cabinet of each area from its units."""
    take = take_units("units")
    bank = splitter_bank(take)
    named = {f"split_{s}": n for s, n in bank.items()}
    return areas.withColumns(
        {"take_units": take, **named, "splitters": reduce(lambda a, b: a + b, bank.values()), "cabinet_units": covering("units", CABINETS).cast("long")}
    )


def pon_ports(areas: DataFrame, head_ends: DataFrame) -> DataFrame:
    """``(he_idx, ports)`` of each head-end; areas of an unknown head-end count for the first."""
    known = head_ends.select("he_idx")
    by = areas.join(known, areas["head_end"] == known["he_idx"], "left").groupBy(F.coalesce("he_idx", F.lit(0)).alias("he")).agg(F.sum("splitters").alias("ports"))
    return known.join(by, known["he_idx"] == by["he"], "left").select("he_idx", F.coalesce("ports", F.lit(0)).alias("ports"))


def olt_plan(ports: DataFrame) -> DataFrame:
    """Cards of each size, cards, chassis and installed ports of each head-end."""
    cards = card_pack("ports")
    total = reduce(lambda a, b: a + b, cards.values())
    named = {f"card_{s}": n for s, n in cards.items()}
    installed = reduce(lambda a, b: a + b, (n * s for s, n in cards.items()))
    return ports.withColumns({**named, "cards": total, "chassis": ceil_div(total, F.lit(RULES.chassis_slots)), "installed": installed})


def cables(edge_usage: DataFrame) -> DataFrame:
    """``(role, size, metres)``: an edge's fibers in stacked 288s and the smallest cable that holds the rest."""
    roles = F.explode(F.array(
        F.struct(F.lit("distribution").alias("role"), F.col("dist_fibers").alias("fibers")),
        F.struct(F.lit("feeder").alias("role"), F.col("feeder_fibers").alias("fibers")),
    ))
    rows = edge_usage.select("len_m", roles.alias("r")).select("len_m", "r.*").where("fibers > 0")
    under, last = cable_stack(cable_demand("fibers", "role"))
    each = rows.select("role", "len_m", F.explode(F.array(F.struct(F.lit(288).alias("size"), under.alias("n")), F.struct(last.alias("size"), F.lit(1).cast("long").alias("n")))).alias("c"))
    return each.where("c.n > 0").groupBy("role", "c.size").agg(F.sum(F.col("len_m") * F.col("c.n")).alias("metres"))


def live_terminals(terminals: DataFrame) -> DataFrame:
    """Terminals that serve anyone."""
    return terminals.where("used > 0")


def bom(areas: DataFrame, terminals: DataFrame, premises: DataFrame, edge_usage: DataFrame, head_ends: DataFrame) -> DataFrame:
    """``(ord, item, qty, unit, unit_cost, ext)`` in the report's order; sized lines only where something is used.

    ``areas`` are provisioned. Every line is an aggregate; their union has at most a few dozen rows.
    """
    spark = areas.sparkSession
    sizes = lambda family: F.array(*[F.lit(s) for s, _ in family])

    def line(df, order, item, unit, cost):
        return df.select(order.cast("int").alias("ord"), item.alias("item"), F.col("qty").cast("long").alias("qty"), F.lit(unit).alias("unit"), cost.cast("long").alias("unit_cost"))

    def sized(df, base, prefix, suffix, unit, family):
        order = F.lit(base) + F.array_position(sizes(family), F.col("size").cast("int"))
        return line(df.where("qty > 0"), order, F.concat(F.lit(prefix), F.col("size").cast("string"), F.lit(suffix)), unit, cost_of("size", family))

    def fixed(df, order, item, unit, cost):
        return line(df, F.lit(order), F.lit(item), unit, F.lit(cost))

    surfaces = spark.createDataFrame([(0,), (1,)], "surface int")
    trench = surfaces.join(edge_usage.where("trench").groupBy("surface").agg(F.sum("len_m").alias("m")), "surface", "left").select("surface", F.coalesce("m", F.lit(0)).alias("qty"))
    ends = live_terminals(terminals).groupBy(F.col("ports").alias("size")).agg(F.count("*").alias("qty"))
    served = premises.where("term_id is not null")
    plan = olt_plan(pon_ports(areas, head_ends))
    spread = lambda df, names: df.select(F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.col(c).alias("n")) for s, c in names])).alias("c")).groupBy("c.size").agg(F.sum("c.n").alias("qty"))
    cable = cables(edge_usage).withColumnRenamed("metres", "qty")
    parts = [
        line(trench, F.col("surface") + 1, F.when(F.col("surface") == 0, "trench_soft").otherwise("trench_asphalt"), "m", cost_of("surface", TRENCH)),
        sized(cable.where("role = 'distribution'"), 10, "dist_cable_", "f", "m", CABLES),
        sized(cable.where("role = 'feeder'"), 20, "feeder_cable_", "f", "m", CABLES),
        fixed(served.agg(F.coalesce(F.sum("drop_m"), F.lit(0)).alias("qty")), 30, "drop_cable", "m", RULES.drop_cable_m),
        fixed(served.agg(F.count("*").alias("qty")), 31, "drop_assembly", "each", RULES.drop_assembly),
        sized(areas.groupBy(F.col("cabinet_units").alias("size")).agg(F.count("*").alias("qty")), 40, "fdh_cabinet_", "", "each", CABINETS),
        sized(spread(areas, [(s, f"split_{s}") for s, _ in SPLITTERS]), 50, "splitter_1_", "", "each", SPLITTERS),
        sized(ends, 60, "terminal_", "p", "each", TERMINALS),
        sized(spread(plan, [(s, f"card_{s}") for s, _ in OLT_CARDS]), 70, "olt_card_", "p", "each", OLT_CARDS),
        fixed(plan.agg(F.coalesce(F.sum("ports"), F.lit(0)).alias("qty")), 80, "olt_port_optics", "each", RULES.optics_port),
        fixed(plan.agg(F.coalesce(F.sum("chassis"), F.lit(0)).alias("qty")), 81, "olt_chassis", "each", RULES.chassis),
        fixed(head_ends.agg(F.count("*").alias("qty")), 82, "head_end_site", "each", RULES.head_end_site),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("ext", F.col("qty") * F.col("unit_cost"))


def cost_rollup(lines: DataFrame, premises: DataFrame, edge_usage: DataFrame) -> DataFrame:
    """One row: total, cost per unit passed, trench and cable metres, sharing in hundredths."""
    total = lines.agg(F.coalesce(F.sum("ext"), F.lit(0)).alias("total"))
    units = premises.agg(F.coalesce(F.sum("units"), F.lit(0)).alias("units"))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("len_m"))), F.lit(0))
    metres = edge_usage.agg(some(F.col("trench")).alias("trench_m"), (some(F.col("dist_fibers") > 0) + some(F.col("feeder_fibers") > 0)).alias("cable_m"))
    row = total.crossJoin(units).crossJoin(metres)
    return row.select(
        "total", "units", F.when(F.col("units") > 0, div("total", F.greatest("units", F.lit(1)))).otherwise(0).alias("per_unit"), "trench_m", "cable_m",
        F.when(F.col("trench_m") > 0, div(F.col("cable_m") * 100, F.greatest("trench_m", F.lit(1)))).otherwise(0).alias("sharing_x100"), money("total").alias("total_text"),
    )


def utilization(areas: DataFrame, terminals: DataFrame, head_ends: DataFrame) -> DataFrame:
    """``(ord, check, used, installed, permille, ok)`` of terminal ports, splitter ports, cabinets and OLT ports."""
    t = live_terminals(terminals).agg(F.coalesce(F.sum("used"), F.lit(0)).alias("used"), F.coalesce(F.sum("ports"), F.lit(0)).alias("installed"))
    bank = reduce(lambda a, b: a + b, (F.col(f"split_{s}") * s for s, _ in SPLITTERS))
    s = areas.agg(F.coalesce(F.sum("take_units"), F.lit(0)).alias("used"), F.coalesce(F.sum(bank), F.lit(0)).alias("installed"))
    c = areas.agg(F.coalesce(F.sum("units"), F.lit(0)).alias("used"), F.coalesce(F.sum("cabinet_units"), F.lit(0)).alias("installed"))
    o = olt_plan(pon_ports(areas, head_ends)).agg(F.coalesce(F.sum("ports"), F.lit(0)).alias("used"), F.coalesce(F.sum("installed"), F.lit(0)).alias("installed"))
    rows = [df.select(F.lit(i).alias("ord"), F.lit(n).alias("check"), "used", "installed") for i, n, df in ((8, "terminal_utilization", t), (9, "splitter_utilization", s), (10, "fdh_utilization", c), (11, "olt_utilization", o))]
    p = permille("used", "installed")
    return reduce(DataFrame.unionByName, rows).withColumns({"permille": p, "ok": p >= RULES.floor_permille, "text": percent(p)})


def qa_counts(areas: DataFrame, terminals: DataFrame, premises: DataFrame, head_ends: DataFrame) -> DataFrame:
    """``(ord, check, failures)`` of the seven counted checks."""
    lost = premises.agg(F.count(F.when(F.col("area_id").isNull() | F.col("term_id").isNull(), 1)).alias("failures"))
    long_ = premises.agg(F.count(F.when(F.col("drop_m") > RULES.max_drop_m, 1)).alias("failures"))
    bank = reduce(lambda a, b: a + b, (F.col(f"split_{s}") * s for s, _ in SPLITTERS))
    cabinet = areas.agg(F.count(F.when(F.col("units") > F.col("cabinet_units"), 1)).alias("failures"))
    ports = terminals.agg(F.count(F.when(F.col("used") > F.col("ports"), 1)).alias("failures"))
    splits = areas.agg(F.count(F.when(bank < F.col("take_units"), 1)).alias("failures"))
    route = premises.join(terminals.select("term_id", "path_m"), "term_id").join(areas.select("area_id", "feeder_m"), "area_id")
    far = route.agg(F.count(F.when(F.col("feeder_m") + F.col("path_m") + F.col("drop_m") > RULES.max_route_m, 1)).alias("failures"))
    at = areas.join(head_ends.select(F.col("he_idx").alias("head_end"), F.col("node_id").alias("he_node")), "head_end", "left")
    unfed = at.agg(F.count(F.when((F.col("feeder_m") == 0) & ~F.col("fdh_node").eqNullSafe(F.col("he_node")), 1)).alias("failures"))
    names = ("premises_served", "drop_length", "fdh_capacity", "terminal_ports", "splitter_capacity", "route_length_budget", "feeder_routed")
    rows = [df.select(F.lit(i).alias("ord"), F.lit(n).alias("check"), "failures") for i, (n, df) in enumerate(zip(names, (lost, long_, cabinet, ports, splits, far, unfed), strict=True), 1)]
    return reduce(DataFrame.unionByName, rows)


def qa(areas: DataFrame, terminals: DataFrame, premises: DataFrame, head_ends: DataFrame) -> DataFrame:
    """All eleven checks as ``(ord, check, failures, ok)``; a missed floor is one failure."""
    counted = qa_counts(areas, terminals, premises, head_ends).withColumn("ok", F.col("failures") == 0)
    floors = utilization(areas, terminals, head_ends).select("ord", "check", (~F.col("ok")).cast("long").alias("failures"), "ok")
    return counted.unionByName(floors)


def qa_verdict(checks: DataFrame) -> DataFrame:
    """One row: failing items, failing checks and PASS or FAIL."""
    row = checks.agg(F.sum("failures").alias("errors"), F.count(F.when(~F.col("ok"), 1)).alias("failing_checks"))
    return row.withColumn("verdict", F.when(F.col("errors") == 0, "PASS").otherwise("FAIL"))


def composite_score(capex, failing_checks, street, drops, odd, rings):
    """The score in cents from its parts, as a Column."""
    return (
        capex + street * RULES.street_crossing + drops * RULES.drop_crossing + odd * RULES.odd_terminal + rings * RULES.ring + failing_checks * RULES.qa_error
    )
