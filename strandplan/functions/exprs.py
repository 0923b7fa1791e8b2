"""Integer geometry, costing and formatting as Column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandplan.rules import CABLES, RULES, TERMINALS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _long(c) -> Column:
    return _col(c).cast("long")


def int_sqrt(v) -> Column:
    """Floor square root of a non-negative long, exact: the double root is corrected by one either way."""
    v = _long(v)
    root = F.floor(F.sqrt(v.cast("double"))).cast("long")
    return root - (root * root > v).cast("long") + ((root + 1) * (root + 1) <= v).cast("long")


def sq_dist(x1, y1, x2, y2) -> Column:
    """Squared distance."""
    dx, dy = _long(x1) - _long(x2), _long(y1) - _long(y2)
    return dx * dx + dy * dy


def dist_m(x1, y1, x2, y2) -> Column:
    """Whole metres between two points, rounded down."""
    return int_sqrt(sq_dist(x1, y1, x2, y2)).cast("int")


def div(a, b) -> Column:
    """Integer division towards zero, exact for longs."""
    return F.call_function("div", _long(a), _long(b))


def ceil_div(a, b) -> Column:
    """Ceiling division of positive numbers."""
    return div(_long(a) + _long(b) - 1, _long(b))


def orient(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of triangle abc."""
    return (_long(bx) - _long(ax)) * (_long(cy) - _long(ay)) - (_long(by) - _long(ay)) * (_long(cx) - _long(ax))


def proper_cross(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Whether segments ab and cd cross in the inside of both; touching and overlapping don't count.

    Bounding boxes are compared first, as most pairs end there.
    """
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = ((_long(x), _long(y)) for x, y in (a, b, c, d))
    boxes = (
        (F.greatest(ax, bx) >= F.least(cx, dx)) & (F.greatest(cx, dx) >= F.least(ax, bx))
        & (F.greatest(ay, by) >= F.least(cy, dy)) & (F.greatest(cy, dy) >= F.least(ay, by))
    )
    sides = F.signum(orient(ax, ay, bx, by, cx, cy)) * F.signum(orient(ax, ay, bx, by, dx, dy)) < 0
    other = F.signum(orient(cx, cy, dx, dy, ax, ay)) * F.signum(orient(cx, cy, dx, dy, bx, by)) < 0
    return boxes & sides & other


def cell(v, size: int) -> Column:
    """Grid cell of a coordinate, floor division, unbounded."""
    return F.floor(_col(v) / F.lit(size)).cast("long")


def clamped_cell(v, origin, size, cells: int = 128) -> Column:
    """Grid cell of a bounded grid: what lies outside falls in the border cells."""
    return F.greatest(F.lit(0), F.least(F.lit(cells - 1), cell(_long(v) - _long(origin), size)))


def permille(used, installed) -> Column:
    """used*1000 / installed rounded down; nothing installed is 0."""
    return F.when(_long(installed) <= 0, F.lit(0).cast("long")).otherwise(div(_long(used) * 1000, F.greatest(_long(installed), F.lit(1))))


def percent(p) -> Column:
    """A permille as text with one decimal."""
    p = _long(p)
    return F.format_string("%d.%d", div(p, F.lit(10)), p % 10)


def money(cents) -> Column:
    """Cents as text with two decimals."""
    c = _long(cents)
    whole = F.abs(c)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.format_string("%d.%02d", div(whole, F.lit(100)), whole % 100))


def node_price(price, bought) -> Column:
    """A node's trench price: nothing once it has been bought."""
    return F.when(_col(bought), F.lit(0).cast("long")).otherwise(_long(price))


def edge_weight(mode: str, length, cents_m, open_) -> Column:
    """Weight of an edge: metres, feeder cents (an open trench costs cable alone), or marginal trench cents."""
    length = _long(length)
    if mode == "metres":
        return length
    if mode == "feeder":
        return length * (F.lit(470) + F.when(_col(open_), 0).otherwise(_long(cents_m)))
    if mode == "trench":
        return F.when(_col(open_), F.lit(0).cast("long")).otherwise(length * _long(cents_m))
    raise ValueError(mode)


def far_end(node, src, dst) -> Column:
    """The other end of an edge."""
    return F.when(_col(src) == _col(node), _col(dst)).otherwise(_col(src))


def better_move(cost, k, other_cost, other_k, ties: tuple = ()) -> Column:
    """Whether cost/k is less than other_cost/other_k, by cross-multiplication.

    Of equal ratios the first of ``ties`` (pairs of columns) that differs decides, the lower being better, and after
    those the larger k.
    """
    mine, theirs = _long(cost) * _long(other_k), _long(other_cost) * _long(k)
    last = _long(k) > _long(other_k)
    for a, b in reversed(ties):
        last = (_long(a) < _long(b)) | ((_long(a) == _long(b)) & last)
    return (mine < theirs) | ((mine == theirs) & last)


def project(lon, lat, lon0: float, lat0: float, kx: float, ky: float) -> tuple[Column, Column]:
    """Metres from an anchor, rounded half to even."""
    return F.bround((_col(lon) - lon0) * kx).cast("int"), F.bround((_col(lat) - lat0) * ky).cast("int")


def unproject(x, y, lon0: float, lat0: float, kx: float, ky: float) -> tuple[Column, Column]:
    """Degrees with seven decimals."""
    return F.round(_col(x) / kx + lon0, 7), F.round(_col(y) / ky + lat0, 7)


def covering(need, sizes) -> Column:
    """The smallest catalog size that holds ``need``; the largest if none does."""
    need = _long(need)
    out = F.lit(sizes[-1][0])
    for size, _ in reversed(sizes[:-1]):
        out = F.when(need <= size, size).otherwise(out)
    return out.cast("int")


def cost_of(size, sizes) -> Column:
    """Unit cost of a catalog size; null for no catalog size."""
    out = F.lit(None).cast("long")
    for s, cost in sizes:
        out = F.when(_col(size) == s, F.lit(cost).cast("long")).otherwise(out)
    return out


def terminal_cost(ports) -> Column:
    """Cost of the smallest terminal with so many ports."""
    return cost_of(covering(ports, TERMINALS), TERMINALS)


def take_units(units) -> Column:
    """Units expected to subscribe: the take rate rounded up, at least one."""
    return F.greatest(F.lit(1).cast("long"), ceil_div(_long(units) * RULES.take_pct, F.lit(100)))


def splitter_bank(take) -> dict[int, Column]:
    """How many splitters of each size serve ``take`` units: full 1:32s, the rest (made even) from the largest down."""
    take = _long(take)
    full = div(take, F.lit(32))
    rest = take % 32
    even = rest + rest % 2
    # A rest of 31 or 32 is one more full splitter.
    return {32: full + div(even, F.lit(32))} | {s: div(even % (2 * s), F.lit(s)) for s in (16, 8, 4, 2)}


def card_pack(ports) -> dict[int, Column]:
    """Cards of each size for so many ports: full 16s, the rest in binary."""
    ports = _long(ports)
    return {16: div(ports, F.lit(16))} | {s: div(ports % (2 * s), F.lit(s)) for s in (8, 4, 2, 1)}


def cable_demand(fibers, role) -> Column:
    """Fibers a cable must hold: distribution takes its spare, feeder doesn't."""
    spare = ceil_div(_long(fibers) * (100 + RULES.spare_pct), F.lit(100))
    return F.when(_col(role) == "distribution", spare).otherwise(_long(fibers))


def cable_stack(demand) -> tuple[Column, Column]:
    """(full 288 cables below the last one, size of the last one)."""
    demand = _long(demand)
    under = div(F.greatest(demand - 1, F.lit(0).cast("long")), F.lit(288))
    return under, covering(demand - under * 288, CABLES)


def convex_cross(o, a, b) -> Column:
    """Turn of o, a, b given as structs (x, y)."""
    return orient(o["x"], o["y"], a["x"], a["y"], b["x"], b["y"])


def ring_centroid(ring) -> tuple[Column, Column]:
    """Centroid of a closed ring of (x, y) by the shoelace sum; the mean of its points where the area is zero."""
    ring = _col(ring)
    ahead = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    steps = F.zip_with(ring, ahead, lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("c"), (p["x"] + q["x"]).alias("sx"), (p["y"] + q["y"]).alias("sy")))

    def total(pick):
        return F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + pick(s).cast("double"))

    area = total(lambda s: s["c"])
    flat = F.abs(area) < 1e-12
    safe = F.when(flat, 1.0).otherwise(area)

    def mean(name):
        return F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[name].cast("double")) / F.size(ring)

    return (
        F.when(flat, mean("x")).otherwise(total(lambda s: s["sx"] * s["c"]) / (3 * safe)),
        F.when(flat, mean("y")).otherwise(total(lambda s: s["sy"] * s["c"]) / (3 * safe)),
    )
