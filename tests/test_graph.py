"""Graph and spatial operators against brute force on random inputs."""

import random
import re
from math import isqrt

import pytest
from pyspark.sql import functions as F

from strandplan.operators import graph, spatial
from strandplan.operators.components import connected_components


@pytest.fixture(scope="module")
def town(spark):
    rnd = random.Random(4)
    nodes = [(i, rnd.randrange(900), rnd.randrange(900)) for i in range(60)]
    pairs = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(90)}
    edges = [(k, a, b, rnd.randrange(2)) for k, (a, b) in enumerate(sorted(pairs))]
    return nodes, edges, spark.createDataFrame(nodes, "node_id long, x long, y long"), spark.createDataFrame(edges, "edge_id long, src long, dst long, surface int")


def test_paths_in_tasks_and_in_rounds_agree(spark, town):
    _, _, nodes, edges = town
    lengths = graph.edge_lengths(edges, nodes).withColumn("len_m", F.greatest("len_m", F.lit(1)))
    sources = spark.createDataFrame([(0, 0), (0, 7), (1, 30)], "source int, node_id long")
    fast = graph.shortest_paths(lengths, sources, F.col("len_m"))
    slow = graph.relaxed_paths(lengths, sources, F.col("len_m"))
    assert sorted(map(tuple, fast.collect()), key=str) == sorted(map(tuple, slow.select("source", "node_id", "dist", "prev", "prev_edge").collect()), key=str)


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)]
    rows = [*chain, *star, (7, 7), (None, 3), (900, 901), (901, 900)]
    random.Random(1).shuffle(rows)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 260)} == {5} == {got[5]}
    assert got[7] == 7 and got[3] == 3 and got[901] == 900 and len(got) == 61 + 61 + 2 + 2
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_linked_in_a_task_and_by_stars_agree(town):
    _, _, _, edges = town
    assert sorted(map(tuple, graph.linked(edges).collect())) == sorted(map(tuple, graph.linked(edges, task_edges=0).collect()))


def test_tree_walks_agree_and_sum(spark):
    rnd = random.Random(9)
    edges = [(i, rnd.randrange(i + 1), i + 1, rnd.randrange(1, 9)) for i in range(80)]
    df = spark.createDataFrame(edges, "edge_id long, src long, dst long, len_m long")
    tree = graph.rooted_tree(df, 0)
    assert sorted(map(tuple, tree.collect()), key=str) == sorted(map(tuple, graph.rooted_tree(df, 0, task_edges=0).select(*tree.columns).collect()), key=str)
    below = {i: i for i in range(81)}
    for _, a, b, _ in reversed(edges):
        below[a] += below[b]
    values = spark.range(81).select(F.col("id").alias("node_id"), F.col("id").alias("value"))
    assert {r["node_id"]: r["total"] for r in graph.subtree_sums(tree, values).collect()} == below


def test_nearest_far_points_and_ties(spark):
    nodes = spark.createDataFrame([(0, 0, 0), (1, 10, 0), (2, 5000, 5000)], "node_id long, x long, y long")
    points = spark.createDataFrame([(0, 5, 0), (1, 4000, 4000), (2, -9000, 0)], "k long, x long, y long")
    got = {r["k"]: (r["node_id"], r["drop_m"]) for r in spatial.nearest(points, nodes, "k").collect()}
    assert got == {0: (0, 5), 1: (2, isqrt(2 * 1000**2)), 2: (0, 9000)}
    assert spatial.nearest(points.limit(0), nodes, "k").count() == 0


def test_crossings_equal_all_pairs(spark):
    from strandplan.kernels.net import crosses

    rnd = random.Random(2)
    rows = [(i, *(rnd.randrange(-400, 400) for _ in range(4))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x1 long, y1 long, x2 long, y2 long")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and crosses(a[1:3], a[3:5], b[1:3], b[3:5]))
    assert sorted(map(tuple, spatial.self_crossings(df, 64).select("a_id", "b_id").collect())) == want


def test_opposite_banks(spark):
    """A thin canal: each bank's points face the other bank, not their neighbours."""
    ring = [(x, 0) for x in range(0, 300, 20)] + [(x, 30) for x in range(280, -20, -20)]
    rows = [(0, 20 * k, 20 * len(ring), x, y) for k, (x, y) in enumerate(ring)]
    got = spatial.opposite_banks(spark.createDataFrame(rows, "ring long, pos long, total long, x long, y long"), "ring", "pos", "total").collect()
    at = {20 * k: p for k, p in enumerate(ring)}
    assert got and all(at[r["a"]][1] != at[r["b"]][1] for r in got)


def test_groups_in_reach(spark):
    rows = [(0, 0, 0, 1), (1, 30, 0, 2), (2, 70, 0, 2), (3, 500, 0, 3)]
    df = spark.createDataFrame(rows, "id long, x long, y long, grp long")
    assert sorted(map(tuple, spatial.nearest_between(df, "id", "grp", 100).collect())) == [(1, 900, 0, 1), (2, 900, 1, 0)]
    assert sorted(map(tuple, spatial.pairs_between(df, "id", "grp", 100, 500).collect())) == [(900, 0, 1), (4900, 0, 2)]


def test_paths_with_free_edges_never_run_in_a_circle(spark):
    """Open edges weigh nothing: both ways give the same distances, and predecessors lead back to the start."""
    rnd = random.Random(6)
    rows = [(0, 5, 3, 0), (1, 3, 4, 0), (2, 5, 4, 0)] + [(3 + k, rnd.randrange(30), rnd.randrange(30), rnd.choice((0, 0, 3, 7))) for k in range(70)]
    rows = [r for r in rows if r[1] != r[2]]
    edges = spark.createDataFrame(rows, "edge_id long, src long, dst long, len_m long")
    starts = spark.createDataFrame([(0, 5)], "source int, node_id long")
    weight = {e: w for e, _, _, w in rows}
    ends = {e: {a, b} for e, a, b, _ in rows}
    got = []
    for most in (500_000, 0):
        paths = {r["node_id"]: r for r in graph.shortest_paths(edges, starts, F.col("len_m"), task_edges=most).collect()}
        got.append({n: r["dist"] for n, r in paths.items()})
        for n, r in paths.items():
            seen = set()
            while r["prev"] is not None:
                assert n not in seen and ends[r["prev_edge"]] == {n, r["prev"]}
                assert paths[r["prev"]]["dist"] + weight[r["prev_edge"]] == r["dist"]
                seen.add(n)
                n, r = r["prev"], paths[r["prev"]]
            assert n == 5
    assert got[0] == got[1]


def test_large_networks_are_searched_over_cells(spark, town, monkeypatch):
    """With coordinates at hand no round a street is run, and the paths are the same."""
    _, _, nodes, edges = town
    lengths = graph.edge_lengths(edges, nodes).withColumn("len_m", F.greatest("len_m", F.lit(1)))
    sources = spark.createDataFrame([(0, 0), (1, 30)], "source int, node_id long")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    fast = rows(graph.shortest_paths(lengths, sources, F.col("len_m")))
    monkeypatch.setattr(graph, "relaxed_paths", None)
    assert rows(graph.shortest_paths(lengths, sources, F.col("len_m"), task_edges=10, nodes=nodes)) == fast


def test_wide_cells_grow_with_the_network(spark):
    from strandplan.operators import overlay
    from strandplan.sources.synthetic import grid_nodes

    nodes = grid_nodes(spark, 120, 120)
    assert overlay.wide_cells(nodes, 16).select("cell").distinct().count() <= 256 < overlay.quad_cells(nodes, 16).select("cell").distinct().count()


def test_trench_distances_reach_every_node(spark):
    from math import isqrt

    import __spark_entry__

    sf = __spark_entry__.SMOKE_DIR
    w = max(12, isqrt(spark.read.parquet(f"{sf}/customer.parquet").count() - 1) + 1)
    got = __spark_entry__.queries()["trench_distances"](spark, sf)
    assert got.count() == got.select("node_id").distinct().count() == w * w


def test_pairs_between_groups_of_crowded_places(spark, monkeypatch):
    """Points of one place don't all meet: the pairs compared are those of places."""
    rnd = random.Random(6)
    spots = [(rnd.randrange(300), rnd.randrange(300), g) for g in range(3) for _ in range(6)]
    points = [(i, *spots[rnd.randrange(len(spots))]) for i in range(400)]
    df = spark.createDataFrame(points, "id long, x long, y long, grp long")
    every = [((x - u) ** 2 + (y - v) ** 2, a, b, g) for a, x, y, g in points for b, u, v, h in points if g != h]
    met, plain = [], spatial.within

    def counted(here, there, radius):
        met.append(plain(here, there, radius).count())
        return plain(here, there, radius)

    monkeypatch.setattr(spatial, "within", counted)
    for radius in (9, 60, 500):
        near = [p for p in every if p[0] <= radius * radius]
        for most in (1, 50, 20_000):
            got = [tuple(r) for r in spatial.pairs_between(df, "id", "grp", radius, most).collect()]
            assert got == sorted(p[:3] for p in near if p[1] < p[2])[:most]
        best = {g: min(p[:3] for p in near if p[3] == g) for g in {p[3] for p in near}}
        assert {r["grp"]: (r["sq"], r["a"], r["b"]) for r in spatial.nearest_between(df, "id", "grp", radius).collect()} == best
    assert max(met) <= len(spots) ** 2


def test_sums_of_subtrees_broadcast_nothing(spark, monkeypatch):
    """A round's tables meet by merging: none of them passes through the driver."""
    plans, plain = [], graph.written_at

    def seen(df, label, path=None):
        if label == "sums" and plans is not None:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label, path)

    monkeypatch.setattr(graph, "written_at", seen)
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(9)], "node_id long, parent long")
    got = graph.subtree_sums(tree, spark.createDataFrame([(8, 5), (3, 1)], "node_id long, value long"))
    assert {r["node_id"]: r["total"] for r in got.collect()} == {i: 5 * (i <= 8) + (i <= 3) for i in range(9)}
    assert len(plans) > 2 and not any("BroadcastHashJoin" in p for p in plans[1:])


def test_pieces_are_linked_without_contraction(spark, monkeypatch):
    """A long chain and a ring beyond a task's edges: joined up by pieces, each read once, with no rounds of stars."""
    from strandplan.operators import graph

    def refused(*_):
        raise AssertionError("contracted")

    monkeypatch.setattr(graph, "connected_components", refused)
    chain = [(i, i, i + 1) for i in range(999)]
    ring = [(1000 + i, 2000 + i, 2000 + (i + 1) % 500) for i in range(500)]
    edges = spark.createDataFrame(chain + ring, "edge_id long, src long, dst long")
    found = {r["node"]: r["component"] for r in graph.linked(edges, task_edges=100, piece=150).collect()}
    assert found == {n: 0 for n in range(1000)} | {2000 + n: 2000 for n in range(500)}
    one = graph.cycle_count(edges, graph.linked(edges, task_edges=100, piece=150)).first()
    assert tuple(one) == (1499, 1500, 2, 1)


def test_pieces_in_no_order(spark):
    """Random streets: the same components whether a task joins them up or pieces and stars do."""
    import random

    from strandplan.operators import graph

    rng = random.Random(5)
    edges = spark.createDataFrame([(i, rng.randrange(900), rng.randrange(900)) for i in range(600)], "edge_id long, src long, dst long")
    plain = {tuple(r) for r in graph.linked(edges).collect()}
    assert {tuple(r) for r in graph.linked(edges, task_edges=20, piece=40).collect()} == plain


def test_nearest_meets_rows_and_not_nodes(spark, monkeypatch):
    """Crowded nodes stand in several rows: the nearest of all, ties to the lower id, points without one left out."""
    import random

    from strandplan.operators import spatial

    monkeypatch.setattr(spatial, "NEAR_NODES", 8)
    rng = random.Random(3)
    nodes = [(i, rng.randrange(-300, 300), rng.randrange(-300, 300)) for i in range(400)] + [(400 + i, 5, 5) for i in range(40)]
    points = [(i, rng.randrange(-300, 300), rng.randrange(-300, 300)) for i in range(150)] + [(150, 5, 6), (151, 9000, 9000)]
    n, p = spark.createDataFrame(nodes, "node_id long, x long, y long"), spark.createDataFrame(points, "id long, x long, y long")
    best = {i: min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in nodes) for i, x, y in points}
    near = spatial._nearest_within(p, n, "id", 16)
    assert {r["id"]: tuple(r["best"]) for r in near.collect()} == {i: b for i, b in best.items() if b[0] <= 256}
    assert {r["id"]: (r["sq"], r["node_id"]) for r in spatial.nearest(p, n, "id", 16).collect()} == best


def test_only_points_that_face_another_group_meet(spark):
    """One piece alone meets nobody at any radius; of two far apart only the sides that face each other do."""
    from strandplan.operators import spatial

    left = [(i, 0, i % 20 * 30, i // 20 * 30) for i in range(400)]
    one = spark.createDataFrame(left, "id long, grp long, x long, y long")
    assert spatial._facing(one, one, "grp", 2000).isEmpty()
    two = spark.createDataFrame(left + [(1000 + i, 1, 670 + i % 20 * 30, i // 20 * 30) for i in range(400)], "id long, grp long, x long, y long")
    assert spatial._facing(two, two, "grp", 120).count() < 400
    assert sorted(tuple(r) for r in spatial.nearest_between(two, "id", "grp", 2000).select("grp", "sq", "a", "b").collect()) == [(0, 10000, 19, 1000), (1, 10000, 1000, 19)]


@pytest.mark.parametrize("few", [100_000, 0])
def test_nearest_brings_columns_and_broadcasts_no_points(spark, monkeypatch, few):
    """Columns of the points come along at any radius; points are never the side that is sent to all tasks."""
    monkeypatch.setattr(spatial, "FEW_NODES", few)
    plans, plain = [], spatial.written
    monkeypatch.setattr(spatial, "written", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, label))
    rnd = random.Random(6)
    nodes = [(i, rnd.randrange(900), rnd.randrange(900)) for i in range(60)]
    points = [(i, rnd.randrange(900), rnd.randrange(900), rnd.randrange(9)) for i in range(90)]
    n, p = spark.createDataFrame(nodes, "node_id long, x long, y long"), spark.createDataFrame(points, "k long, x long, y long, units long")
    best = {k: (*min(((x - a) ** 2 + (y - b) ** 2, i) for i, a, b in nodes), u, x) for k, x, y, u in points}
    got = spatial.nearest(p, n, "k", 64, keep=("units", "x"))
    assert got.columns == ["k", "node_id", "sq", "drop_m", "units", "x"]
    assert {r["k"]: (r["sq"], r["node_id"], r["units"], r["x"]) for r in got.collect()} == best
    met = [re.search(r"(\w+Join) \[cx.*", x).group() for x in plans]
    assert len(met) > 1 and all(x.startswith("BroadcastHashJoin") and "BuildRight" in x if few else x.startswith("SortMergeJoin") for x in met)
    assert spatial.nearest(p.limit(0), n, "k", keep=("units",)).columns == ["k", "node_id", "sq", "drop_m", "units"]


@pytest.mark.parametrize("name", ["transport_arc_costs", "road_tree_paths", "road_uncrossing"])
def test_premises_are_read_once(spark, monkeypatch, name):
    """After their nearest node is found, no step joins the customers to it again."""
    import __spark_entry__
    from pyspark.sql import DataFrame, DataFrameWriter

    from strandplan.operators.spatial import nearest

    late, done, plain = [], [], DataFrameWriter.parquet
    monkeypatch.setattr(spatial, "nearest", lambda *a, **k: (nearest(*a, **k), done.append(1))[0])

    def seen(self, *a, **k):
        if done:
            late.append(self._df._jdf.queryExecution().executedPlan().toString())
        return plain(self, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    got: DataFrame = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    late.append(got._jdf.queryExecution().executedPlan().toString())
    assert done and not any("customer.parquet" in x for x in late)
