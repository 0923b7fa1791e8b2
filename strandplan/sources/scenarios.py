"""Six small towns in closed form, as one table of streets and rows of premises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STEP = 30

#: Fixed values. A street is (x0, y0, x1, y1, step, surface); a row of premises is (x, y, dx, dy, count, units).
_ISLAND = lambda cx: (
    [(cx - 120, 0, cx + 120, 0, STEP, 0), (cx, -120, cx, 120, STEP, 0)],
    [r for i in range(8) for r in ((cx - 105 + 30 * i, 12, 0, -24, 2, 1),)] + [r for y in (-105, -75, -45, 45, 75, 105) for r in ((cx - 12, y, 24, 0, 2, 1),)],
)
_FRONT = [(15 + 30 * i, 12, 0, -24, 2, 1) for i in range(12)]
SCENARIOS = {
    "s01_single_street": ([(0, 0, 360, 0, STEP, 0)], _FRONT),
    "s02_parallel_streets": (
        [(0, 0, 300, 0, STEP, 0), (0, 30, 300, 30, STEP, 0), (0, 0, 0, 30, STEP, 0), (300, 0, 300, 30, STEP, 0)],
        [(15 + 30 * i, y, 0, 0, 1, 1) for i in range(10) for y in (-12, 42, 12, 18)],
    ),
    "s03_grid5": (
        [s for k in range(5) for s in ((0, 120 * k, 480, 120 * k, STEP, 0), (120 * k, 0, 120 * k, 480, STEP, 0))],
        [r for k in range(5) for r in ((15, 120 * k + 12, 30, 0, 16, 1), (30, 120 * k - 12, 30, 0, 15, 1))],
    ),
    "s04_culdesac": (
        [(0, 0, 360, 0, STEP, 0), (150, 0, 150, -150, STEP, 0)],
        _FRONT + [(138, -15 - 30 * i, 24, 0, 2, 1) for i in range(5)] + [(x, y, 0, 0, 1, 1) for x, y in ((135, -162), (150, -168), (165, -162), (132, -148), (168, -148), (150, -158))],
    ),
    "s05_two_islands": (_ISLAND(0)[0] + _ISLAND(265)[0] + [(120, 0, 145, 0, 25, 1)], _ISLAND(0)[1] + _ISLAND(265)[1]),
    "s06_mdu_block": ([(0, 0, 240, 0, STEP, 0)], [(15 + 30 * i, 15 - 30 * (i % 2), 0, 0, 1, u) for i, u in enumerate((8, 12, 16, 10, 9, 14, 11, 13))]),
}


def build(name: str) -> tuple[list, list, list]:
    """(nodes x, y; edges src, dst, surface; premises x, y, units) of a town; nodes in the order first met."""
    streets, rows = SCENARIOS[name]
    place: dict[tuple[int, int], int] = {}
    edges: dict[tuple[int, int], tuple[int, int, int]] = {}
    for x0, y0, x1, y1, step, surface in streets:
        n = (abs(x1 - x0) + abs(y1 - y0)) // step
        ids = [place.setdefault((x0 + (x1 - x0) * k // n, y0 + (y1 - y0) * k // n), len(place)) for k in range(n + 1)]
        for a, b in zip(ids, ids[1:], strict=False):
            edges.setdefault((min(a, b), max(a, b)), (a, b, surface))
    premises = [(x + dx * k, y + dy * k, u) for x, y, dx, dy, n, u in rows for k in range(n)]
    return list(place), list(edges.values()), premises


def detour(homes: int) -> tuple[list, list, list]:
    """Two towns of so many homes, joined by 15 km of asphalt and by 22.5 km of soft ways, cheaper to trench but too long."""
    ways = [([(500 * i, 0) for i in range(31)], 1)]
    ways += [([(0, 500 * i) for i in range(8)] + [(500 * i, 3750) for i in range(31)] + [(15_000, 500 * i) for i in range(7, -1, -1)], 0)]
    place: dict[tuple[int, int], int] = {}
    edges = []
    for points, surface in ways:
        ids = [place.setdefault(p, len(place)) for p in points]
        edges += [(a, b, surface) for a, b in zip(ids, ids[1:], strict=False)]
    return list(place), edges, [(x + 5 * (i % 25), -10 - 4 * (i // 25), 1) for x in (0, 14_900) for i in range(homes)]


def tables(spark: SparkSession, towns: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, premises) of towns by ``network``; without ``towns`` the six of above, numbered 1 to 6."""
    nodes, edges, premises = [], [], []
    for k, (n, e, p) in (towns or {k: build(name) for k, name in enumerate(SCENARIOS, 1)}).items():
        nodes += [(k, i, *v) for i, v in enumerate(n)]
        edges += [(k, i, *v) for i, v in enumerate(e)]
        premises += [(k, i, *v) for i, v in enumerate(p)]
    return (
        spark.createDataFrame(nodes, "network long, node_id long, x long, y long"),
        spark.createDataFrame(edges, "network long, edge_id long, src long, dst long, surface int"),
        spark.createDataFrame(premises, "network long, prem_id long, x long, y long, units long"),
    )
