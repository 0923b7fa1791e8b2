"""Text formats, GeoJSON and converters."""

import json

import pytest
from pyspark.sql import functions as F

from strandplan.plans import convert
from strandplan.sources import geojson, interchange

GOOD = "NET 1\nNODES 3\n0 0 0\n1,100,0\n2\t-5 7\r\nEDGES 2\n0 0 1 0\n1 1 2 1 PREMISES 2\n0 5 5 1\n1 9 9 4\nEND\n"


def write(tmp_path, text):
    path = tmp_path / "net.txt"
    path.write_text(text)
    return str(path)


def test_interchange(spark, tmp_path):
    nodes, edges, premises = interchange.read_interchange(spark, write(tmp_path, GOOD))
    assert sorted(map(tuple, nodes.select("node_id", "x", "y").collect())) == [(0, 0, 0), (1, 100, 0), (2, -5, 7)]
    assert sorted(map(tuple, edges.select("edge_id", "src", "dst", "surface").collect())) == [(0, 0, 1, 0), (1, 1, 2, 1)]
    assert sorted(map(tuple, premises.select("prem_id", "units").collect())) == [(0, 1), (1, 4)]


@pytest.mark.parametrize("old, new, rule", [
    ("NET 1", "7 1", "header"), ("NET 1", "NET 2", "version"), ("1,100,0", "4,100,0", "sequence"), ("0 0 1 0", "0 0 9 0", "endpoint"), ("0 0 1 0", "0 1 1 0", "self_loop"),
    ("1 1 2 1", "1 1 2 2", "surface"), ("1 1 2 1", "1 1 0 1", "duplicate_edge"), ("1 9 9 4", "1 9 9 0", "units"), ("1 9 9 4\n", "1 9\n", "end"), ("END", "", "end"), ("1,100,0", "1,x,0", "integer"),
    ("1 1 2 1", "1 0 1 1", "duplicate_edge"),
])
def test_broken_interchange(spark, tmp_path, old, new, rule):
    with pytest.raises(interchange.IngestError, match=rule):
        interchange.read_interchange(spark, write(tmp_path, GOOD.replace(old, new)))


def test_disconnected_interchange(spark, tmp_path):
    text = GOOD.replace("NODES 3", "NODES 4").replace("2\t-5 7", "2\t-5 7\n3 8 8")
    with pytest.raises(interchange.IngestError, match="disconnected: 1"):
        interchange.read_interchange(spark, write(tmp_path, text))


def test_interchange_round_trip_renumbers(spark, tmp_path):
    nodes, edges, premises = interchange.read_interchange(spark, write(tmp_path, GOOD))
    nodes, edges = interchange.renumbered(nodes, edges)
    assert sorted(map(tuple, nodes.collect())) == [(0, 0, 0), (1, 100, 0), (2, -5, 7)]
    lines = [r["line"] for r in interchange.interchange_lines(nodes, edges, premises).orderBy("part", "ord").collect()]
    assert lines[:3] == ["NETDESIGN 1", "NODES 3", "0 0 0"] and lines[-1] == "END"


FEATURES = {
    "type": "FeatureCollection", "name": 'a "features" [ }', "features": [
        {"type": "Feature", "id": 2, "properties": {"a": "}{[\"\\"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [0.001, 0], [0.001, 0.001], [0, 0.001], [0, 0]], [[9, 9], [9, 8], [8, 8], [9, 9]]]}},
        {"type": "Feature", "id": "x", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0.001, 0], [0.002, 0], [0.002, 0.001], [0.001, 0.001], [0.001, 0]]], [[[0.004, 0], [0.005, 0], [0.005, 0.001], [0.004, 0]]]]}},
        {"type": "Feature", "properties": None, "geometry": {"type": "Point", "coordinates": [0.0005, 0.0005]}},
    ],
}


def test_scanner_at_every_chunk_size():
    data = json.dumps(FEATURES).encode()
    for size in (1, 2, 3, 7, 64, 10_000):
        got = [json.loads(o) for o in geojson.scan_objects(data[i : i + size] for i in range(0, len(data), size))]
        assert got == FEATURES["features"]


def test_features_rings_and_parcels(spark, tmp_path):
    path = tmp_path / "f.geojson"
    path.write_text(json.dumps(FEATURES))
    f = geojson.read_features(spark, str(path))
    assert [r["type"] for r in f.collect()] == ["Polygon", "MultiPolygon", "Point"]
    assert [r["n"] for r in f.select(F.size(geojson.outer_rings(F.col("type"), F.col("coordinates"))).alias("n")).collect()] == [1, 2, 0]
    p = convert.parcels(f).orderBy("parcel").collect()
    assert [(round(r["lon"], 6), round(r["lat"], 6)) for r in p] == [(0.0005, 0.0005), (0.0015, 0.0005)]


AWKWARD = {
    "type": "FeatureCollection", "name": "a } in { text, \"features\": [{", "crs": {"type": "name", "properties": {"name": "x"}}, "other": [{"type": "Feature", "id": "no"}, {"id": "no2"}],
    "features": [
        {"type": "Feature", "id": str(i), "properties": {"t": '}{"\\' * (i % 5) + "\u00e9[,]" * (i % 3), "deep": {"er": [{"e": i}, {}]}}, "geometry": {"type": "Point", "coordinates": [i, -i]}} for i in range(300)
    ],
    "last": [{"id": "no3"}], "foot": {"id": "no4"},
}


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [None, "64", "1k"])
def test_features_across_splits(spark, tmp_path, indent, size):
    """Texts full of braces and quotes, objects elsewhere, and splits that fall anywhere; two files and an empty array."""
    whole = dict(AWKWARD, features=AWKWARD["features"][:8]) if size == "64" else AWKWARD  # every split is a task
    for name in "ab":
        (tmp_path / f"{name}.geojson").write_text(json.dumps(whole, indent=indent, ensure_ascii=indent is None) + "\n")
    (tmp_path / "c.geojson").write_text('{"features": [], "rest": [{"id": "no"}]}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = geojson.read_features(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = whole["features"]
    assert [r["id"] for r in got] == [f["id"] for f in want] * 2
    assert [json.loads(r["properties"]) for r in got] == [f["properties"] for f in want] * 2
    assert [json.loads(r["coordinates"]) for r in got] == [f["geometry"]["coordinates"] for f in want] * 2


def test_parcels_to_network(spark, tmp_path):
    path = tmp_path / "f.geojson"
    path.write_text(json.dumps(FEATURES))
    flat = geojson.Projection(0.0, 0.0, 100_000.0, 100_000.0)
    nodes, edges, premises = convert.parcels_to_network(geojson.read_features(spark, str(path)), flat)
    assert nodes.count() == 9 and premises.count() == 2
    assert {r["rule"]: r["n"] for r in convert.checked(nodes, edges, premises).collect()} == dict.fromkeys(("dangling", "loops", "repeats", "out_of_reach", "pieces"), 0)
    assert json.loads(flat.sidecar())["kx_m_per_deg"] == 100_000.0


def test_canals_to_network(spark):
    ring = [[0, 0], [0.006, 0], [0.006, 0.0003], [0, 0.0003], [0, 0]]
    canals = spark.createDataFrame([("1", None, "Polygon", json.dumps([ring]))], "id string, properties string, type string, coordinates string")
    homes = spark.createDataFrame([(str(i), None, "Point", json.dumps([0.0005 * i, 0.0005])) for i in range(12)] + [("far", None, "Point", "[1, 1]")], "id string, properties string, type string, coordinates string")
    nodes, edges, premises = convert.canals_to_network(canals, homes, geojson.Projection(0.0, 0.0, 100_000.0, 100_000.0))
    assert premises.count() == 12 and {r["surface"] for r in edges.select("surface").distinct().collect()} == {0, 1}
    assert all(r["n"] == 0 for r in convert.checked(nodes, edges, premises).collect())


def test_grow_area_stops_before_the_limit():
    cells = {(0, 0): 9, (1, 0): 5, (2, 0): 4, (5, 5): 8}
    assert convert.grow_area(cells, 14) == [(0, 0), (1, 0)] and convert.grow_area(cells, 18) == [(0, 0), (1, 0), (2, 0)]
