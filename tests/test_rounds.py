"""Searches by rounds of joins against plain Python: paths over cells, trees, Steiner trees, greedy choices."""

import random

import pytest
from pyspark.sql import functions as F

from strandplan.operators import choice, graph, overlay, steiner, trees
from strandplan.rules import TERMINALS


def near_of(edges):
    near = {}
    for e, a, b, w in edges:
        near.setdefault(a, []).append((b, e, w))
        near.setdefault(b, []).append((a, e, w))
    return near


def grid(w, h, weight):
    nodes = [(r * w + c, c * 100, r * 100) for r in range(h) for c in range(w)]
    ends = [(r * w + c, r * w + c + 1) for r in range(h) for c in range(w - 1)] + [(r * w + c, r * w + c + w) for r in range(h - 1) for c in range(w)]
    return nodes, [(e, a, b, weight(e)) for e, (a, b) in enumerate(ends)]


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, "node_id long, x long, y long"), spark.createDataFrame(edges, "edge_id long, src long, dst long, len_m long")


@pytest.fixture(scope="module")
def town(spark):
    """A grid with weights of 0 and many ties, some streets missing, two pieces."""
    rnd = random.Random(11)
    nodes, edges = grid(10, 8, lambda e: (0, 1, 1, 2, 5)[e * 7919 % 5])
    edges = [x for x in edges if rnd.random() < 0.85 and not (x[1] < 50) != (x[2] < 50)]
    return nodes, edges, *frames(spark, nodes, edges)


def plain(rows):
    return sorted((tuple(-1 if v is None else v for v in r)) for r in rows)


def labels_of(edges, sources, limit=None):
    out = []
    for s in {s for s, _, _ in sources}:
        found = graph.label_nodes(near_of(edges), [(n, 0, 0, o, -1, -1) for k, n, o in sources if k == s], limit)
        out += [(s, n, d, h, o, u if e >= 0 else -1, e) for n, (d, h, o, u, e) in found.items()]
    return sorted(out)


@pytest.mark.parametrize("limit", [None, 6])
def test_one_label_whatever_the_way(spark, town, limit):
    """In tasks, in rounds and over cells of any kind: equal distances, hops, owners, predecessors and edges."""
    nodes, edges, n, e = town
    sources = [(0, 5, 1), (0, 60, 0), (0, 60, 4), (1, 79, 0), (2, 40, 3), (2, 41, 2), (2, 77, 2)]
    start = spark.createDataFrame(sources, "source long, node_id long, owner long")
    want = labels_of(edges, sources, limit)
    short = [(s, k, d, u, x) for s, k, d, _, _, u, x in want]
    assert plain(graph.shortest_paths(e, start, F.col("len_m"), limit).collect()) == short
    assert plain(overlay.overlay_paths(e, overlay.quad_cells(n, 9 if limit is None else 30), start, F.col("len_m"), limit).collect()) == want
    if limit is None:
        assert plain(graph.relaxed_paths(e, start, F.col("len_m"), limit).collect()) == want
    else:
        assert plain(graph.shortest_paths(e, start, F.col("len_m"), limit, task_edges=0).collect()) == short


def test_free_streets_have_one_tie_rule(spark):
    """Two free ways from 5 to 4: the one of fewer streets."""
    edges = spark.createDataFrame([(0, 5, 3, 0), (1, 3, 4, 0), (2, 5, 4, 0)], "edge_id long, src long, dst long, len_m long")
    start = spark.createDataFrame([(0, 5)], "source int, node_id long")
    for tasks in (0, 10):
        got = {r["node_id"]: (r["prev"], r["prev_edge"]) for r in graph.shortest_paths(edges, start, F.col("len_m"), task_edges=tasks).collect()}
        assert got == {5: (None, None), 3: (5, 0), 4: (5, 2)}


def test_rounds_count_cells_not_streets(spark):
    """A long strip: a label travels 300 streets in a few rounds."""
    nodes, edges = grid(120, 3, lambda e: 100)
    n, e = frames(spark, nodes, edges)
    log = []
    paths = overlay.overlay_paths(e, overlay.quad_cells(n, 150), spark.createDataFrame([(0, 0)], "source int, node_id long"), F.col("len_m"), log=log)
    assert paths.agg(F.max("hops")).first()[0] == 121 and len(log) < 12
    assert overlay.overlay_paths(e, overlay.quad_cells(n, 150), spark.createDataFrame([], "source int, node_id long"), F.col("len_m")).count() == 0


def test_cells_are_bounded_even_where_points_coincide(spark):
    rows = [(i, i * 37 % 1000, i * 91 % 1000) for i in range(300)] + [(1000 + i, 500, 500) for i in range(200)]
    cells = overlay.quad_cells(spark.createDataFrame(rows, "node_id long, x long, y long"), 20)
    sizes = [r["count"] for r in cells.groupBy("cell").count().collect()]
    assert sum(sizes) == 500 and max(sizes) <= 40 and cells.select("node_id").distinct().count() == 500


def test_tour_roots_trees_of_any_shape(spark):
    rnd = random.Random(5)
    chain = [(i, i + 1, i, 3) for i in range(70)]
    branch = [(100 + i, rnd.randrange(i + 71), 71 + i, rnd.randrange(1, 9)) for i in range(60)]
    other = [(500, 900, 901, 1), (501, 901, 902, 1)]
    df = spark.createDataFrame([*chain, *branch, *other], "edge_id long, src long, dst long, len_m long")
    got = trees.euler_tour(df, 5)
    want = graph.rooted_tree(df, 5).select("node_id", "parent", "parent_edge", "depth", "path_m")
    assert plain(got.select("node_id", "parent", "parent_edge", "depth", "path_m").collect()) == plain(want.collect())
    at = {r["node_id"]: r for r in got.collect()}
    assert sorted(x for r in at.values() for x in (r["first"], r["last"])) == list(range(2 * len(at)))
    for r in at.values():
        if r["parent"] is not None:
            assert at[r["parent"]]["first"] < r["first"] < r["last"] < at[r["parent"]]["last"]
    alone = trees.euler_tour(df.limit(0), 3).collect()
    assert [(r["node_id"], r["depth"]) for r in alone] == [(3, 0)]


def test_tree_paths_and_loads(spark):
    rnd = random.Random(7)
    edges = [(i, rnd.randrange(max(0, i - 6), i + 1), i + 1, rnd.randrange(1, 50)) for i in range(120)]
    tree = trees.euler_tour(spark.createDataFrame(edges, "edge_id long, src long, dst long, len_m long"), 0)
    pairs = [(k, rnd.randrange(121), rnd.randrange(121), rnd.randrange(1, 5)) for k in range(150)] + [(200, 0, 0, 1), (201, 7, 7, 2), (202, 999, 1, 1)]
    got = trees.common_ancestors(tree, spark.createDataFrame(pairs, "pair long, a long, b long, units long"))
    up = {b: (a, e, w) for e, a, b, w in edges}
    loads, want = {}, {}
    for k, a, b, units in pairs[:-1]:
        way, ups = {}, [a]
        while ups[-1] in up:
            ups.append(up[ups[-1]][0])
        x, metres, hops = b, 0, 0
        while x not in ups:
            way[up[x][1]] = 1
            metres, hops, x = metres + up[x][2], hops + 1, up[x][0]
        for y in ups[: ups.index(x)]:
            way[up[y][1]] = 1
            metres, hops = metres + up[y][2], hops + 1
        want[k] = (x, metres, hops)
        for e in way:
            loads[e] = loads.get(e, 0) + units
    assert {r["pair"]: (r["ancestor"], r["path_m"], r["hops"]) for r in got.collect()} == want
    assert {r["edge_id"]: r["load"] for r in trees.path_loads(tree, got, "units").collect()} == loads


def cheapest_tree(nodes, edges, required):
    """Least cost of a tree over the required nodes, by subsets."""
    far = 1 << 40
    dist = {a: {b: 0 if a == b else far for b, _, _ in nodes} for a, _, _ in nodes}
    for _, a, b, w in edges:
        dist[a][b] = dist[b][a] = min(dist[a][b], w)
    for k in dist:
        for a in dist:
            for b in dist:
                dist[a][b] = min(dist[a][b], dist[a][k] + dist[k][b])
    best = {}
    first, *rest = required
    for mask in range(1, 1 << len(rest)):
        ones = [i for i in range(len(rest)) if mask >> i & 1]
        at = {v: far for v in dist}
        if len(ones) == 1:
            at = dict(dist[rest[ones[0]]])
        else:
            split = {v: min(best[s][v] + best[mask ^ s][v] for s in range(1, mask) if s & mask == s) for v in dist}
            at = {v: min(split[u] + dist[u][v] for u in dist) for v in dist}
        best[mask] = at
    return best[(1 << len(rest)) - 1][first]


def grown_tree(edges, required):
    """Sequential growth: the required node nearest to the tree is attached, again and again."""
    near, tree, cost, left = near_of(edges), {required[0]}, 0, set(required[1:])
    weight = {e: w for e, _, _, w in edges}
    while left - tree:
        found = graph.label_nodes(near, [(n, 0, 0, 0, -1, -1) for n in tree], None)
        n = min(left - tree, key=lambda n: (found[n][0], n))
        while n not in tree:
            tree.add(n)
            cost += weight[found[n][4]]
            n = found[n][3]
    return cost


@pytest.mark.parametrize("seed", [1])
def test_steiner_trees(spark, seed):
    rnd = random.Random(seed)
    nodes, edges = grid(6, 5, lambda e: rnd.randrange(1, 9))
    n, e = frames(spark, nodes, edges)
    required = rnd.sample(range(30), 6)
    log = []
    cells = overlay.quad_cells(n, 12)
    need = spark.createDataFrame([(x,) for x in required], "node_id long")
    taken = {r["edge_id"] for r in steiner.steiner_tree(e, cells, need, F.col("len_m"), log).collect()}
    kept = e.where(F.col("edge_id").isin(*taken))
    check = graph.tree_check(kept, need).first()
    assert check["ok"], check
    assert all(r["degree"] > 1 or r["node_id"] in required for r in graph.degrees(kept).collect())
    cost = sum(w for x, _, _, w in edges if x in taken)
    assert cheapest_tree(nodes, edges, required) <= cost <= 2 * cheapest_tree(nodes, edges, required)
    assert all(2 * b <= a for a, b in zip(log, log[1:], strict=False))


def test_steiner_cost_near_sequential_growth(spark):
    rnd = random.Random(21)
    nodes, edges = grid(11, 11, lambda e: rnd.randrange(50, 150))
    n, e = frames(spark, nodes, edges)
    required = rnd.sample(range(121), 24)
    taken = {r["edge_id"] for r in steiner.steiner_tree(e, overlay.quad_cells(n, 300), spark.createDataFrame([(x,) for x in required], "node_id long"), F.col("len_m")).collect()}
    assert sum(w for x, _, _, w in edges if x in taken) <= 1.05 * grown_tree(edges, required)


def test_steiner_rounds_join_trees_in_one_task(spark, monkeypatch):
    """Trees that met are linked at once, not contracted in rounds of their own."""
    n, e = frames(spark, *grid(6, 6, lambda e: 10 + e * 7 % 5))
    calls, whole = [], steiner.linked
    monkeypatch.setattr(steiner, "linked", lambda links: calls.append(links.columns) or whole(links))
    log = []
    required = spark.createDataFrame([(x,) for x in (0, 5, 14, 30, 35)], "node_id long")
    taken = {r["edge_id"] for r in steiner.steiner_tree(e, overlay.quad_cells(n, 10), required, F.col("len_m"), log).collect()}
    assert log and calls == [["src", "dst"]] * len(log)
    assert graph.tree_check(e.where(F.col("edge_id").isin(*taken)), required).first()["ok"]


def test_steiner_of_parts_and_of_one_node(spark, town):
    _, _, n, e = town
    cells = overlay.quad_cells(n, 50)
    assert steiner.steiner_tree(e, cells, spark.createDataFrame([(3,)], "node_id long"), F.col("len_m")).count() == 0


def slow_packing(pairs):
    ports = max(s for s, _ in TERMINALS)
    left, out = {p for p, _, _ in pairs}, {}
    while left:
        best = None
        for node in {n for _, n, _ in pairs}:
            near = sorted((d, p) for p, n, d in pairs if n == node and p in left)[:ports]
            for k in range(1, len(near) + 1):
                cost = sum(d for d, _ in near[:k]) * 150 + next(c for s, c in TERMINALS if k <= s)
                offer = (cost * 27720 // k, node, -k)
                if best is None or offer < best[0]:
                    best = (offer, [p for _, p in near[:k]])
        for p in best[1]:
            out[p] = best[0][1]
        left -= set(best[1])
    return out


def test_packing_equals_the_sequential_greedy(spark):
    rnd = random.Random(13)
    sites = [(i, rnd.randrange(700), rnd.randrange(500)) for i in range(25)]
    prems = [(i, rnd.randrange(700), rnd.randrange(500)) for i in range(70)]
    pairs = [(p, n, int(((x - a) ** 2 + (y - b) ** 2) ** 0.5)) for p, x, y in prems for n, a, b in sites if (x - a) ** 2 + (y - b) ** 2 <= 150**2]
    log = []
    got = choice.pack_terminals(spark.createDataFrame(pairs, "prem_id long, node_id long, dist_m long"), log=log).collect()
    assert {r["prem_id"]: r["node_id"] for r in got} == slow_packing(pairs) and len(got) == len({p for p, _, _ in pairs})
    assert len(log) < len({r["terminal"] for r in got})
    assert choice.pack_terminals(spark.createDataFrame([], "prem_id long, node_id long, dist_m long")).count() == 0


def test_cover_equals_the_sequential_greedy(spark):
    rnd = random.Random(17)
    reach = sorted({(rnd.randrange(20), c) for c in range(60) for _ in range(3)})
    weight = {c: 1 + c % 4 for c in range(60)}
    left, want = {c for _, c in reach}, {}
    while left:
        s = min({s for s, c in reach if c in left}, key=lambda s: (-sum(weight[c] for t, c in reach if t == s and c in left), s))
        for t, c in reach:
            if t == s and c in left:
                want[c] = s
                left.discard(c)
    got = choice.cover_sites(spark.createDataFrame([(s, c, weight[c]) for s, c in reach], "site long, client long, weight long")).collect()
    assert {r["client"]: r["site"] for r in got} == want and len(got) == len(want)


def test_farthest_seeds_and_their_shrinking_work(spark):
    rnd = random.Random(19)
    nodes, edges = grid(10, 10, lambda e: rnd.randrange(50, 150))
    n, e = frames(spark, nodes, edges)
    stops = [(k, rnd.randrange(100)) for k in range(60)]
    log = []
    got = choice.farthest_seeds(e, overlay.quad_cells(n, 30), F.col("len_m"), spark.createDataFrame(stops, "stop long, node_id long"), 3, log).orderBy("seed").collect()
    near, want, standing = near_of(edges), [], {}
    for _ in range(3):
        node = max(stops, key=lambda s: (standing.get(s[1], 1 << 60), -s[0]))[1]
        want.append((node, standing.get(node)))
        for x, label in graph.label_nodes(near, [(node, 0, 0, 0, -1, -1)], None).items():
            standing[x] = min(standing.get(x, 1 << 60), label[0])
    assert [(r["node_id"], r["dist"]) for r in got] == want
    assert log[0] >= 100 and log[-1] < 0.7 * log[0]


def test_scratch_is_the_threads_own(spark):
    """What another thread writes while a block is open stays when the block ends."""
    import threading

    from strandplan.plans import session

    inside, done, found = threading.Event(), threading.Event(), []

    def other():
        inside.wait(30)
        found.append(session.written(spark.range(7), "other"))
        done.set()

    t = threading.Thread(target=other)
    t.start()
    with session.scratch(spark):
        inside.set()
        mine, at = session.written_at(spark.range(3), "mine")
        done.wait(60)
        _, elsewhere = session.written_at(spark.newSession().range(3), "elsewhere")
    t.join()
    assert found[0].count() == 7 and not session.exists(spark, at) and session.exists(spark, elsewhere)


def crossing(a, b):
    from strandplan.kernels.net import crosses

    return crosses(a[0], a[1], b[0], b[1])


def test_uncrossing_leaves_no_swap_that_helps(spark):
    from math import isqrt

    from strandplan.operators.swaps import uncrossed

    rnd = random.Random(23)
    sites = [(i, 60 * (i % 5), 60 * (i // 5)) for i in range(25)]
    rows = []
    for i in range(36):
        x, y = rnd.randrange(300), rnd.randrange(300)
        t = rnd.choice([s for s in sites if (s[1] - x) ** 2 + (s[2] - y) ** 2 <= 150**2])
        rows.append((i, x, y, t[1], t[2], t[0], rnd.choice((1, 1, 1, 4))))
    df = spark.createDataFrame(rows, "id long, x1 long, y1 long, x2 long, y2 long, terminal long, units long")
    log = []
    got = [tuple(r) for r in uncrossed(df, log=log).collect()]

    def score(drops):
        segments = [((r[1], r[2]), (r[3], r[4])) for r in drops]
        pairs = sum(crossing(a, b) for i, a in enumerate(segments) for b in segments[:i])
        return 20_000 * pairs + 150 * sum(isqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) for a, b in segments)

    before, after = score(rows), score(got)
    assert log and all(x > 0 for x in log) and before - after == sum(log)
    assert sorted((r[5], r[6]) for r in rows) == sorted((r[5], r[6]) for r in got) and sorted(r[:3] for r in rows) == sorted(r[:3] for r in got)
    for i, a in enumerate(got):
        for j, b in enumerate(got[:i]):
            near = max((a[1] - b[3]) ** 2 + (a[2] - b[4]) ** 2, (b[1] - a[3]) ** 2 + (b[2] - a[4]) ** 2) < 151**2
            if a[6] == b[6] and a[5] != b[5] and near and crossing(((a[1], a[2]), (a[3], a[4])), ((b[1], b[2]), (b[3], b[4]))):
                swapped = list(got)
                swapped[i], swapped[j] = (*a[:3], *b[3:6], a[6]), (*b[:3], *a[3:6], b[6])
                assert score(swapped) >= after
    plain_rows = df.where("id < 1")
    assert uncrossed(plain_rows).count() == 1


def least_assignment(cost, room):
    """Exact least cost: one premises after another, each over the cheapest chain of moves between areas."""
    held = {a: [] for a in room}
    for p in cost:
        best = {a: (c, [(p, a)]) for a, c in cost[p].items()}
        for _ in room:
            for j in list(best):
                for q in held[j]:
                    for t, c in cost[q].items():
                        d = best[j][0] + c - cost[q][j]
                        if t not in best or d < best[t][0]:
                            best[t] = (d, [*best[j][1], (q, t)])
        _, moves = min((best[a] for a in best if len(held[a]) < room[a]), key=lambda x: x[0])
        for q, t in moves:
            for a in held:
                if q in held[a]:
                    held[a].remove(q)
            held[t].append(q)
    return sum(cost[q][a] for a in held for q in held[a])


def test_auction_is_within_epsilon_of_the_least_cost(spark):
    from strandplan.operators.auction import auction, least_cost_bound

    rnd = random.Random(29)
    room = {0: 7, 1: 9, 2: 6, 3: 12}
    cost = {p: {a: (300 if a == 3 else 0) + rnd.randrange(0, 400, 20) for a in room if a == 3 or rnd.random() < 0.8} for p in range(28)}
    costs = spark.createDataFrame([(p, a, c) for p, row in cost.items() for a, c in row.items()], "prem_id long, area_id long, cost long")
    rooms = spark.createDataFrame(list(room.items()), "area_id long, room long")
    held, prices = auction(costs, rooms, 40)
    got = held.collect()
    assert sorted(r["prem_id"] for r in got) == sorted(cost) and all(cost[r["prem_id"]][r["area_id"]] == r["cost"] for r in got)
    assert all(sum(r["area_id"] == a for r in got) <= n for a, n in room.items())
    total, least = sum(r["cost"] for r in got), least_assignment(cost, room)
    assert least <= total <= least + 40 * len(cost)
    assert total - least_cost_bound(costs, rooms, prices) <= 40 * len(cost)
    with pytest.raises(ValueError):
        auction(costs, rooms.where("area_id < 3"), 40)


def test_auction_of_areas_that_outbid_each_other_takes_few_rounds(spark):
    """Two near areas for far too many: their prices climb to the far one's cost inside a task, not by a round each."""
    from strandplan.operators.auction import Unsettled, auction, least_cost_bound

    cost = {p: {0: 100 * (p % 2), 1: 100 - 100 * (p % 2), 2: 6000} for p in range(40)}
    room = {0: 8, 1: 8, 2: 30}
    costs = spark.createDataFrame([(p, a, c) for p, row in cost.items() for a, c in row.items()], "prem_id long, area_id long, cost long")
    rooms = spark.createDataFrame(list(room.items()), "area_id long, room long")
    log = []
    held, prices = auction(costs, rooms, 100, log)
    assert log == [40] and held.agg(F.sum("cost")).first()[0] == 24 * 6000
    assert 24 * 6000 - least_cost_bound(costs, rooms, prices) <= 100 * 40
    # Everybody's lists end before there is room for all of them.
    with pytest.raises(Unsettled):
        auction(costs.where("prem_id >= 20 or area_id < 2"), rooms, 100)


@pytest.mark.parametrize("seed", [3, 4])
def test_auction_by_blocks_is_within_epsilon_of_the_least_cost(spark, seed):
    """Areas on a line, dealt to tasks in two ways: premises pass from block to block, all still placed near the least cost."""
    from strandplan.operators.auction import auction, least_cost_bound

    rnd = random.Random(seed)
    room = {a: rnd.randrange(2, 6) for a in range(8)}
    at = [min(700, int(rnd.expovariate(1 / 200))) for _ in range(sum(room.values()) - 3)]
    cost = {p: {a: abs(x - 100 * a) // 10 * 10 for a in room} for p, x in enumerate(at)}
    costs = spark.createDataFrame([(p, a, c) for p, row in cost.items() for a, c in row.items()], "prem_id long, area_id long, cost long")
    rooms = spark.createDataFrame(list(room.items()), "area_id long, room long")
    blocks = [spark.createDataFrame([(a, (a + k) // 3) for a in room], "area_id long, block long") for k in (0, 1)]
    log = []
    held, prices = auction(costs, rooms, 10, log, blocks=blocks)
    got = held.collect()
    assert len(log) > 1 and sorted(r["prem_id"] for r in got) == sorted(cost) and all(cost[r["prem_id"]][r["area_id"]] == r["cost"] for r in got)
    assert all(sum(r["area_id"] == a for r in got) <= n for a, n in room.items())
    total, least = sum(r["cost"] for r in got), least_assignment(cost, room)
    assert least <= total <= least + 10 * len(cost) and total - least_cost_bound(costs, rooms, prices) <= 10 * len(cost)


def test_searches_that_set_out_at_a_distance(spark):
    """A start's ``dist`` counts from the beginning, over cells as in one search."""
    rnd = random.Random(31)
    nodes, edges = grid(7, 7, lambda e: rnd.randrange(5, 40))
    n, e = frames(spark, nodes, edges)
    starts = [(rnd.randrange(49), k, rnd.randrange(0, 150)) for k in range(6)]
    found = overlay.overlay_paths(e, overlay.quad_cells(n, 10), spark.createDataFrame([(0, *s) for s in starts], "source long, node_id long, owner long, dist long"), F.col("len_m"))
    want = graph.label_nodes(near_of(edges), [(v, d, 0, k, -1, -1) for v, k, d in starts], None)
    assert {r["node_id"]: (r["dist"], r["owner"]) for r in found.collect()} == {v: (x[0], x[2]) for v, x in want.items()}


def test_first_fit_of_premises_with_several_units(spark):
    from strandplan.operators.auction import first_fit

    costs = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (2, 0, 4), (2, 1, 6), (3, 0, 1), (3, 1, 50), (4, 0, 1)], "prem_id long, area_id long, cost long")
    wants = spark.createDataFrame([(1, 6), (2, 5), (3, 4), (4, 40)], "prem_id long, units long")
    taken, room = first_fit(costs, wants, spark.createDataFrame([(0, 10), (1, 20)], "area_id long, room long"))
    assert sorted(map(tuple, taken.collect())) == [(1, 0, 5), (2, 1, 6), (3, 0, 1)] and sorted(map(tuple, room.collect())) == [(0, 0), (1, 15)]


def test_head_ends_equal_the_plain_choice(spark):
    from strandplan.kernels.trench import choose_head_ends
    from strandplan.operators.diagnostics import sited_head_ends

    rnd = random.Random(31)
    for limit in (30,):
        nodes, edges = grid(7, 6, lambda e: rnd.randrange(1, 20))
        fdh, splitters, tails = rnd.sample(range(42), 9), [rnd.randrange(1, 6) for _ in range(9)], [rnd.randrange(0, 50) for _ in range(9)]
        near = near_of(edges)
        dist = {a: {n: x[0] for n, x in graph.label_nodes(near, [(a, 0, 0, 0, -1, -1)], None).items()} for a in fdh}
        sites, of = choose_head_ends(dist, fdh, splitters, tails, limit)
        ways = spark.createDataFrame([(a, k, dist[a][b]) for a in fdh for k, b in enumerate(fdh)], "site long, area_id long, dist long")
        areas = spark.createDataFrame([(k, n, s, t) for k, (n, s, t) in enumerate(zip(fdh, splitters, tails, strict=True))], "area_id long, fdh_node long, splitters long, tail long")
        got = {r["area_id"]: (r["he_idx"], r["node_id"]) for r in sited_head_ends(ways, areas, limit).collect()}
        assert got == {k: (i, sites[i]) for k, i in enumerate(of)}, limit
    assert sited_head_ends(ways.limit(0), areas.limit(0)).count() == 0


def test_trees_within_a_budget(spark):
    from strandplan.operators.reach import within_budget

    rnd = random.Random(37)
    nodes, edges = grid(6, 6, lambda e: rnd.randrange(10, 30))
    n, e = frames(spark, nodes, edges)
    spanning, seen = [], {0}
    order = sorted(edges, key=lambda x: x[3])
    while len(seen) < 36:
        x = next(x for x in order if (x[1] in seen) != (x[2] in seen))
        spanning.append(x[0])
        seen |= {x[1], x[2]}
    shortest = graph.relaxed_paths(e, spark.createDataFrame([(0, 0)], "source int, node_id long"), F.col("len_m"))
    best = {r["node_id"]: r["dist"] for r in shortest.collect()}
    weight = {x[0]: x[3] for x in edges}
    tails = {k: rnd.randrange(0, 40) for k in rnd.sample(range(36), 24)}
    tail = spark.createDataFrame(list(tails.items()), "node_id long, tail long")
    tree = spark.createDataFrame([(x,) for x in spanning], "edge_id long")
    for limit in (max(best.values()) + 5,):
        log = []
        taken = {r["edge_id"] for r in within_budget(e, tree, shortest, 0, tail, limit, log).collect()}
        kept = [x for x in edges if x[0] in taken]
        found = graph.label_nodes(near_of(kept), [(0, 0, 0, 0, -1, -1)], None)
        assert len(taken) == len(found) - 1 and set(tails) <= set(found)
        before = graph.label_nodes(near_of([x for x in edges if x[0] in spanning]), [(0, 0, 0, 0, -1, -1)], None)
        for k, t in tails.items():
            assert found[k][0] <= before[k][0] and (found[k][0] + t <= limit or best[k] + t > limit)
        assert sum(weight[x] for x in taken) <= sum(weight[x] for x in spanning) + sum(log) * limit
        assert bool(log) == any(before[k][0] + t > limit >= best[k] + t for k, t in tails.items())


def stretches_of(kept, required):
    """Chains' ends of a tree: required nodes and those with other than two edges."""
    degree = {}
    for _, a, b, _ in kept:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    return {n for n, d in degree.items() if d != 2} | set(required)


def best_exchange(edges, taken, required):
    """The greatest gain of any street that closes a cycle with the tree, by walking the cycle."""
    kept = [x for x in edges if x[0] in taken]
    keys, near = stretches_of(kept, required), near_of(kept)
    tree = {n for _, a, b, _ in kept for n in (a, b)}
    labels = graph.label_nodes(near_of(edges), [(n, 0, 0, n, -1, -1) for n in tree], None)
    weight, best = {x[0]: x[3] for x in edges}, 0
    for e, u, v, w in edges:
        a, b = labels[u][2], labels[v][2]
        if e in taken or a == b:
            continue
        found = graph.label_nodes(near, [(a, 0, 0, 0, -1, -1)], None)
        n, run, worst = b, 0, 0
        while n != a:
            run += weight[found[n][4]]
            n = found[n][3]
            worst = max(worst, run)
            if n in keys:
                run = 0
        best = max(best, worst - (labels[u][0] + w + labels[v][0]))
    return best


def test_exchanges_leave_none_that_helps(spark):
    from strandplan.operators.exchange import exchanged

    rnd = random.Random(41)
    nodes, edges = grid(5, 5, lambda e: rnd.randrange(5, 40))
    n, e = frames(spark, nodes, edges)
    required = rnd.sample(range(25), 6)
    need = spark.createDataFrame([(x,) for x in required], "node_id long")
    # A poor tree: shortest ways from one node in whole streets, whatever they cost.
    hops = graph.label_nodes(near_of([(x, a, b, 1) for x, a, b, _ in edges]), [(required[0], 0, 0, 0, -1, -1)], None)
    poor = set()
    for x in required:
        while hops[x][4] >= 0:
            poor.add(hops[x][4])
            x = hops[x][3]
    assert best_exchange(edges, poor, required) > 0
    log = []
    taken = {r["edge_id"] for r in exchanged(e, overlay.quad_cells(n, 60), spark.createDataFrame([(x,) for x in poor], "edge_id long"), need, F.col("len_m"), log).collect()}
    cost = lambda some: sum(w for x, _, _, w in edges if x in some)
    assert log and all(x > 0 for x in log) and cost(taken) <= cost(poor) - sum(log)
    assert graph.tree_check(e.where(F.col("edge_id").isin(*taken)), need).first()["ok"]
    assert best_exchange(edges, taken, required) == 0


@pytest.mark.parametrize("task_edges", [0, 1000])
def test_exchanges_of_a_tree_in_a_task_and_in_rounds(spark, monkeypatch, task_edges):
    """A small tree is walked in one task, without the rounds of a tour; either way no exchange is left that gains."""
    from strandplan.operators import exchange

    rnd = random.Random(43)
    nodes, edges = grid(6, 6, lambda e: rnd.randrange(5, 40))
    n, e = frames(spark, nodes, edges)
    required = rnd.sample(range(36), 5)
    need = spark.createDataFrame([(x,) for x in required], "node_id long")
    spanning = spanning_tree(edges, required)
    tours, whole = [], exchange.euler_tour
    monkeypatch.setattr(exchange, "euler_tour", lambda *a: tours.append(a) or whole(*a))
    assert best_exchange(edges, spanning, required) > 0
    taken = {r["edge_id"] for r in exchange.exchanged(e, overlay.quad_cells(n, 60), spark.createDataFrame([(x,) for x in spanning], "edge_id long"), need, F.col("len_m"), task_edges=task_edges).collect()}
    assert bool(tours) == (task_edges == 0)
    assert graph.tree_check(e.where(F.col("edge_id").isin(*taken)), need).first()["ok"]
    assert best_exchange(edges, taken, required) == 0


def spanning_tree(edges, required):
    """A poor tree: fewest streets from the first required node to the others, whatever they cost."""
    hops = graph.label_nodes(near_of([(x, a, b, 1) for x, a, b, _ in edges]), [(required[0], 0, 0, 0, -1, -1)], None)
    poor = set()
    for x in required:
        while hops[x][4] >= 0:
            poor.add(hops[x][4])
            x = hops[x][3]
    return poor


def test_packing_in_bounded_tasks_is_the_same(spark, monkeypatch):
    """Pairs dealt to more tasks are packed alike, in rounds that are dealt anew."""
    from strandplan.operators import choice

    pairs = spark.createDataFrame([(p, n, abs(7 * p - 31 * n) % 50) for p in range(60) for n in range(p % 4, p % 4 + 3)], "prem_id long, node_id long, dist_m long")
    dealt = []
    whole = type(pairs).repartition
    monkeypatch.setattr(type(pairs), "repartition", lambda df, *a: dealt.append(a) or whole(df, *a))
    plain = sorted(tuple(r) for r in choice.pack_terminals(pairs).collect())
    assert not dealt
    monkeypatch.setattr(choice, "TASK_PAIRS", 20)
    assert sorted(tuple(r) for r in choice.pack_terminals(pairs).collect()) == plain
    assert dealt and all(n >= 2 and k == "node_id" for n, k in dealt)
