"""The command line and the stream."""

import json

from pyspark.sql import functions as F

from strandplan import cli
from strandplan.sources import geojson, interchange, scenarios
from strandplan.streaming.arrivals import running_units


def test_cli_on_a_town(spark, tmp_path):
    nodes, edges, premises = (df.where("network = 6").drop("network") for df in scenarios.tables(spark))
    rows = interchange.interchange_lines(nodes, edges, premises).orderBy("part", "ord").collect()
    path = tmp_path / "town.txt"
    path.write_text("\n".join(r["line"] for r in rows))
    out = tmp_path / "out"
    status = cli.run(spark, str(path), str(out), geojson.Projection(-81.9, 26.5, 99_600.0, 110_800.0))
    text = [r["value"] for r in spark.read.text(f"{out}/report").collect()]
    assert status == 0 and "qa verdict: PASS" in text
    assert [x for x in text if not x.startswith(" ") and x != "qa verdict: PASS"] == ["design:", "utilization:", "bom:", "cost:", "sweeps:", "qa:"]
    assert any(x.startswith("  head_end 0: node_id=") for x in text) and any(x.startswith("  reach_repair: moves=0 over_before=0 over_after=0") for x in text)
    assert json.loads(spark.read.text(f"{out}/projection").first()["value"])["lon0"] == -81.9
    score = spark.read.json(f"{out}/score").first()
    told = dict(r["value"].split("=") for r in spark.read.text(f"{out}/score_text").collect())
    assert told["qa_verdict"] == "PASS" and set(told) == set(score.asDict())
    assert score["rings"] == 0 and score["capex_cents"] <= 431_500 + 13_800_000
    layer = json.loads("".join(r["value"] for r in spark.read.text(f"{out}/layers/premises").collect()))
    assert len(layer["features"]) == 8 and layer["features"][0]["properties"]["status"] == "served"
    path.write_text("WORD 3")
    assert cli.run(spark, str(path), str(tmp_path / "none")) == 2


def test_arrivals_stream_equals_batch(spark, tmp_path):
    from strandplan.streaming.arrivals import snapped

    nodes = spark.createDataFrame([(0, 0, 0), (1, 100, 0)], "node_id long, x long, y long")
    rows = spark.createDataFrame([(i, i * 7, 5, 1, 1_700_000_000 + i) for i in range(20)], "prem_id long, x long, y long, units long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_units(stream, nodes, lambda df, i: seen.extend((r["prem_id"], r["node_id"]) for r in df.collect())).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(set(seen)) == sorted((r["prem_id"], r["node_id"]) for r in snapped(rows, nodes).collect())


def test_ledger_grows_by_iterations(spark, tmp_path):
    from strandplan.operators.diagnostics import append_scores

    for k, scores in enumerate(([10, 20], [9, 19], [9, 25])):
        rows = spark.createDataFrame([(k, f"s{i}", v) for i, v in enumerate(scores)], "iteration long, fixture string, score long")
        got = append_scores(rows, str(tmp_path / "ledger"))
    assert sorted((r["iteration"], r["total"], r["change"]) for r in got.collect()) == [(0, 30, None), (1, 28, -2), (2, 34, 6)]


def test_scratch_removes_what_was_written_inside(spark, tmp_path):
    from strandplan.plans import session

    with session.scratch(spark):
        inner = session.written_at(spark.range(3), "inner")[1]
        kept = session.written_at(spark.range(3), "kept", str(tmp_path / "kept"))[1]
        assert session.exists(spark, inner)
    assert not session.exists(spark, inner) and session.exists(spark, kept)
    before = spark.conf.get(session.BATCH_ROWS)
    session.bounded_batches(spark)
    with session.batches_of(spark, 3):
        assert spark.conf.get(session.BATCH_ROWS) == "3"
    assert spark.conf.get(session.BATCH_ROWS) == before and spark.conf.get(session.BATCH_BYTES) == f"{session.BATCH_MB}m"
