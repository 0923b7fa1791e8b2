"""The interchange text: a format word with version 1, then NODES, EDGES, PREMISES and END, tokens apart by white space or commas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandplan.operators.components import connected_components
from strandplan.operators.numbering import dense_ids, sums_before
from strandplan.plans.session import written

#: Fixed values of the format: section names with their row widths.
VERSION = "1"
SECTIONS = (("NODES", 3), ("EDGES", 4), ("PREMISES", 4))


class IngestError(ValueError):
    """The text breaks a rule of the format; the message names the rules with how often each is broken."""


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, token)`` of one text in order: a file, or a folder whose parts follow each other by name; line structure doesn't matter.

    The text is read in splits. A line's tokens are numbered from the sum of all tokens before it, which is found
    by ranges of (part, split, line); one line fits a task.
    """
    lines = spark.read.text(path).select(
        F.filter(F.split("value", "[ \t\r\n,]+"), lambda t: t != "").alias("tokens"),
        F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"),
    )
    rows = written(lines.withColumn("n", F.size("tokens").cast("long")).where("n > 0"), "text-lines")
    placed = sums_before(rows, "n", "part", "split", "line", name="first")
    return placed.select("first", F.posexplode("tokens").alias("k", "token")).select((F.col("first") + F.col("k")).alias("pos"), "token")


def sections(found: DataFrame) -> DataFrame:
    """``(section, start, rows, width)`` from the keywords' places; one row a section."""
    named = found.where(F.col("token").isin(*(n for n, _ in SECTIONS))).select("pos", F.col("token").alias("section"))
    counts = found.select((F.col("pos") - 1).alias("pos"), F.expr("try_cast(token as int)").alias("rows"))
    width = F.create_map(*[F.lit(x) for n, w in SECTIONS for x in (n, w)])
    return named.join(counts, "pos").select("section", (F.col("pos") + 2).alias("start"), "rows", width[F.col("section")].alias("width"))


def _rows(found: DataFrame, heads: DataFrame, section: str, columns: list[str]) -> DataFrame:
    head = heads.where(F.col("section") == section)  # one row
    inside = found.join(F.broadcast(head), (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("rows") * F.col("width")))
    at = F.col("pos") - F.col("start")
    cells = inside.select(F.floor(at / F.col("width")).alias("ord"), (at % F.col("width")).alias("k"), F.expr("try_cast(token as int)").alias("v"))
    picked = [F.max(F.when(F.col("k") == i, F.col("v"))).alias(c) for i, c in enumerate(columns)]
    return cells.groupBy("ord").agg(*picked)


def read_raw(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables as they stand, with ``ord`` (row number) and nulls for what is no integer."""
    # Written, not cached: a cache is found by path and would outlive a change of the file.
    found = written(tokens(spark, path), "tokens")
    heads = written(sections(found), "sections")
    return {
        "tokens": found, "sections": heads,
        "nodes": _rows(found, heads, "NODES", ["node_id", "x", "y"]),
        "edges": _rows(found, heads, "EDGES", ["edge_id", "src", "dst", "surface"]),
        "premises": _rows(found, heads, "PREMISES", ["prem_id", "x", "y", "units"]),
    }


def violations(raw: dict[str, DataFrame]) -> DataFrame:
    """``(rule, n)`` for each broken rule; empty for a good file. All rules are set-oriented: no row loop, no pair scan."""
    found, heads = raw["tokens"], raw["sections"]
    nodes, edges, premises = raw["nodes"], raw["edges"], raw["premises"]

    def count(rule, df):
        return df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")

    first = found.where("pos < 2").agg(F.max(F.when(F.col("pos") == 0, F.col("token"))).alias("a"), F.max(F.when(F.col("pos") == 1, F.col("token"))).alias("b"))
    ends = found.agg(F.max("pos").alias("last"), F.max(F.when(F.col("token") == "END", F.col("pos"))).alias("end"))
    order = heads.orderBy("start").agg(F.collect_list("section").alias("s"))
    known = nodes.select("node_id")
    pair = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n")).where("n > 1")
    sizes = heads.agg(*[F.max(F.when(F.col("section") == n, F.col("rows"))).alias(n) for n, _ in SECTIONS])
    spans = heads.agg(F.max(F.col("start") + F.col("rows") * F.col("width")).alias("until"))
    broken = lambda df: df.where(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in df.columns)))
    lost = edges.select("edge_id", F.explode(F.array("src", "dst")).alias("node_id")).join(known, "node_id", "left_anti")
    rules = [
        ("header", first.where(~F.coalesce(F.col("a").rlike("^[A-Z]+$"), F.lit(False)) | F.col("a").isin(*(n for n, _ in SECTIONS)))), ("version", first.where(~F.col("b").eqNullSafe(F.lit(VERSION)))),
        ("sections", order.where(~F.col("s").eqNullSafe(F.array(*[F.lit(n) for n, _ in SECTIONS])))),
        ("end", ends.crossJoin(spans).where(F.col("end").isNull() | ~F.col("end").eqNullSafe(F.col("until")))),
        ("size", sizes.where("not coalesce(NODES >= 2, false) or not coalesce(EDGES >= 1, false) or not coalesce(PREMISES >= 1, false)")),
        ("integer", broken(nodes).select("ord").union(broken(edges).select("ord")).union(broken(premises).select("ord"))),
        ("sequence", nodes.where("node_id <> ord").select("ord").union(edges.where("edge_id <> ord").select("ord")).union(premises.where("prem_id <> ord").select("ord"))),
        ("endpoint", lost), ("self_loop", edges.where("src = dst")), ("surface", edges.where("surface not in (0, 1)")), ("duplicate_edge", pair), ("units", premises.where("units < 1")),
    ]
    return reduce(DataFrame.unionByName, [count(r, df) for r, df in rules]).where("n > 0")


def unreachable(nodes: DataFrame, edges: DataFrame) -> int:
    """How many nodes node 0 doesn't reach."""
    linked = connected_components(edges, "src", "dst")
    return nodes.join(linked.where("component = 0"), F.col("node_id") == F.col("node"), "left_anti").where("node_id <> 0").count()


def read_interchange(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, premises) of a valid, connected file; raises IngestError otherwise."""
    raw = read_raw(spark, path)
    bad = {r["rule"]: r["n"] for r in violations(raw).collect()}  # a dozen rules
    if bad:
        raise IngestError("; ".join(f"{k}: {v}" for k, v in sorted(bad.items())))
    nodes, edges, premises = (raw[k].drop("ord") for k in ("nodes", "edges", "premises"))
    if n := unreachable(nodes, edges):
        raise IngestError(f"disconnected: {n}")
    return nodes, edges, premises


def renumbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered in (y, x) order and edges by their new ends, in the order of their sorted pairs."""
    ids = dense_ids(nodes, "y", "x", "node_id", name="new")
    a, b = ids.select(F.col("node_id").alias("src"), F.col("new").alias("a")), ids.select(F.col("node_id").alias("dst"), F.col("new").alias("b"))
    ends = edges.join(a, "src").join(b, "dst").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "surface")
    numbered = dense_ids(ends, "src", "dst", name="edge_id")
    return ids.select(F.col("new").alias("node_id"), "x", "y"), numbered.select("edge_id", "src", "dst", "surface")


def interchange_lines(nodes: DataFrame, edges: DataFrame, premises: DataFrame, word: str = "NETDESIGN") -> DataFrame:
    """``(part, ord, line)`` of the text; ordered by part and ord it is the file. ``word`` is the format word of its reader."""
    def head(part, name, df):
        return df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), F.lit(-1).cast("long").alias("ord"), F.concat(F.lit(f"{name} "), F.col("n").cast("string")).alias("line"))

    def body(part, df, key, *columns):
        return df.select(F.lit(part).alias("part"), F.col(key).cast("long").alias("ord"), F.concat_ws(" ", *[F.col(c).cast("string") for c in (key, *columns)]).alias("line"))

    one = nodes.sparkSession.createDataFrame([(0, 0, f"{word} {VERSION}"), (9, 0, "END")], "part int, ord long, line string")
    parts = [
        one, head(1, "NODES", nodes), body(1, nodes, "node_id", "x", "y"), head(2, "EDGES", edges), body(2, edges, "edge_id", "src", "dst", "surface"),
        head(3, "PREMISES", premises), body(3, premises, "prem_id", "x", "y", "units"),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_lines(lines: DataFrame, path: str) -> None:
    """One text folder, its rows in order over the part files."""
    lines.orderBy("part", "ord").select("line").write.text(path)
