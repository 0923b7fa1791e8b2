"""Command line: design an interchange file. Exit status 0 QA passed, 1 QA failed, 2 the file was refused."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandplan.operators import diagnostics, provision
from strandplan.plans import design
from strandplan.plans.session import written
from strandplan.sources import geometry, geojson, interchange, report


def run(spark: SparkSession, source: str, out: str, projection: geojson.Projection | None = None) -> int:
    """Write a design's report, geometry dump, score (JSON and text) and trace below ``out``, and, given a projection, that with the layers."""
    try:
        nodes, edges, premises = interchange.read_interchange(spark, source)
    except interchange.IngestError as e:
        print(f"ingest error: {e}", file=sys.stderr)
        return 2
    zero = F.lit(0).cast("long").alias("network")
    tables = design.design_networks(nodes.select("*", zero), edges.select("*", zero), premises.select("*", zero))
    areas, terminals, served, usage, ends = design.one(tables)
    bom = provision.bom(areas, terminals, served, usage, ends)
    checks = provision.qa(areas, terminals, served, ends)
    verdict = provision.qa_verdict(checks)
    summary = served.agg(F.count("*").alias("premises"), F.sum("units").alias("units")).crossJoin(areas.agg(F.count("*").alias("serving_areas"))).crossJoin(terminals.agg(F.count("*").alias("terminals")))
    lines = report.report_lines(summary, areas, provision.utilization(areas, terminals, ends), bom, provision.cost_rollup(bom, served, usage), checks, verdict, ends, design.sweeps(tables))
    interchange.write_lines(lines, f"{out}/report")
    interchange.write_lines(geometry.geometry_lines(ends, areas, terminals, served, usage), f"{out}/geometry")
    score = written(diagnostics.score_design(nodes, edges, premises, areas, terminals, served, usage, ends), "score")
    score.write.json(f"{out}/score")
    score.select(F.explode(F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in score.columns])).alias("line")).coalesce(1).write.text(f"{out}/score_text")
    tables["trace"].write.json(f"{out}/trace")
    if projection is not None:
        spark.createDataFrame([(projection.sidecar(),)], "line string").coalesce(1).write.text(f"{out}/projection")
        for name, layer in geojson.layers(nodes, edges, ends, areas, terminals, served.join(premises.select("prem_id", "x", "y"), "prem_id"), usage, projection).items():
            geojson.write_layer(layer, f"{out}/layers/{name}")
    return 0 if verdict.first()["verdict"] == "PASS" else 1


def main() -> None:
    if len(sys.argv) != 3:
        sys.exit("usage: python -m strandplan.cli INTERCHANGE OUT")
    sys.exit(run(SparkSession.builder.appName("design").getOrCreate(), *sys.argv[1:]))


if __name__ == "__main__":
    main()
