"""Column expressions at their edges."""

from math import isqrt

import pytest
from pyspark.sql import functions as F

from strandplan.functions import exprs as X
from strandplan.rules import CABINETS, CABLES, TERMINALS


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def values(spark, rows, schema, column):
    return [r["v"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column.alias("v")).collect()]


def test_int_sqrt(spark):
    numbers = [0, 1, 2, 3, 4, 15, 16, 17, 94906266**2 - 1, 94906266**2, 99999999**2 - 1, 10**12, (1 << 53) + 1]
    assert values(spark, [(n,) for n in numbers], "n long", X.int_sqrt("n")) == [isqrt(n) for n in numbers]


@pytest.mark.parametrize("segments, want", [
    ((0, 0, 10, 10, 0, 10, 10, 0), True), ((0, 0, 10, 0, 10, 0, 20, 5), False), ((0, 0, 10, 0, 5, 0, 5, 5), False), ((0, 0, 10, 0, 5, 0, 15, 0), False),
    ((0, 0, 10, 0, 0, 0, 5, 9), False), ((0, 0, 1, 1, 5, 5, 6, 6), False),
])
def test_proper_cross(spark, segments, want):
    from strandplan.kernels.net import crosses

    p = [(F.lit(segments[i]), F.lit(segments[i + 1])) for i in range(0, 8, 2)]
    assert value(spark, X.proper_cross(*p)) is want
    assert crosses(*[(segments[i], segments[i + 1]) for i in range(0, 8, 2)]) is want


def test_cable_sizing(spark):
    rows = [(n,) for n in (1, 12, 13, 288, 289, 576, 577)]
    under, last = X.cable_stack("n")
    assert values(spark, rows, "n long", under) == [0, 0, 0, 0, 1, 1, 2]
    assert values(spark, rows, "n long", last) == [12, 12, 24, 288, 12, 288, 12]
    assert values(spark, [(100, "distribution"), (101, "distribution"), (100, "feeder")], "n long, role string", X.cable_demand("n", F.col("role"))) == [110, 112, 100]


def test_splitters(spark):
    from strandplan.kernels.trench import bank

    for take in (1, 2, 3, 31, 32, 33, 281):
        got = {s: value(spark, n) for s, n in X.splitter_bank(F.lit(take)).items()}
        total = sum(s * n for s, n in got.items())
        assert take <= total < take + 2
    assert {s: value(spark, n) for s, n in X.splitter_bank(F.lit(31)).items()}[32] == 1
    assert sum(bank(432).values()) == 11 and sum(bank(239).values()) == 7


def test_cards(spark):
    from strandplan.kernels.design import cards

    for ports, n in ((0, 0), (1, 1), (15, 4), (16, 1), (17, 2), (253, 18), (172, 12)):
        got = {s: value(spark, c) for s, c in X.card_pack(F.lit(ports)).items()}
        assert got == cards(ports) and sum(s * c for s, c in got.items()) == ports
        if ports in (253, 172, 1, 16, 17, 0):
            assert sum(got.values()) == n


def test_money_percent_and_permille(spark):
    assert values(spark, [(5,), (-123456,), (0,), (1800000,)], "n long", X.money("n")) == ["0.05", "-1234.56", "0.00", "18000.00"]
    assert values(spark, [(949, 1000), (9499, 10000), (5, 0)], "a long, b long", X.permille("a", "b")) == [949, 949, 0]
    assert value(spark, X.percent(F.lit(949))) == "94.9"


def test_covering(spark):
    assert values(spark, [(1,), (2,), (3,), (12,), (13,)], "n long", X.covering("n", TERMINALS)) == [2, 2, 4, 12, 12]
    assert values(spark, [(432,), (433,), (0,)], "n long", X.covering("n", CABINETS)) == [432, 432, 12]
    assert value(spark, X.cost_of(F.lit(288), CABLES)) == 780 and value(spark, X.cost_of(F.lit(7), CABLES)) is None


def test_projection_rounds_half_to_even(spark):
    x, y = X.project(F.lit(0.5), F.lit(1.5), 0.0, 0.0, 1.0, 1.0)
    assert (value(spark, x), value(spark, y)) == (0, 2)
    lon, lat = X.unproject(F.lit(100), F.lit(200), -81.9, 26.5, 99_600.0, 110_800.0)
    x, y = X.project(lon, lat, -81.9, 26.5, 99_600.0, 110_800.0)
    assert (value(spark, x), value(spark, y)) == (100, 200)


def test_cells_moves_and_weights(spark):
    assert values(spark, [(-1,), (0,), (127,), (128,)], "v long", X.cell("v", 128)) == [-1, 0, 0, 1]
    assert values(spark, [(-500,), (0,), (10**6,)], "v long", X.clamped_cell("v", F.lit(0), 128)) == [0, 0, 127]
    assert value(spark, X.better_move(F.lit(10), F.lit(3), F.lit(7), F.lit(2))) is True
    assert value(spark, X.edge_weight("feeder", F.lit(10), F.lit(4500), F.lit(True))) == 4700
    assert value(spark, X.edge_weight("feeder", F.lit(10), F.lit(4500), F.lit(False))) == 49_700
    assert value(spark, X.edge_weight("trench", F.lit(10), F.lit(4500), F.lit(True))) == 0
    assert value(spark, X.node_price(F.lit(9), F.lit(True))) == 0 and value(spark, X.far_end(F.lit(3), F.lit(3), F.lit(4))) == 4


def test_centroid(spark):
    ring = "array(struct(0D as x, 0D as y), struct(4D as x, 0D as y), struct(4D as x, 2D as y), struct(0D as x, 2D as y), struct(0D as x, 0D as y))"
    x, y = X.ring_centroid(F.expr(ring))
    assert (value(spark, x), value(spark, y)) == (2.0, 1.0)
    flat = "array(struct(0D as x, 0D as y), struct(4D as x, 0D as y))"
    assert value(spark, X.ring_centroid(F.expr(flat))[0]) == 2.0
