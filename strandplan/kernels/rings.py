"""Order-dependent ring work: simplification, resampling and hulls."""

from __future__ import annotations

from math import hypot


def turn(o, a, b) -> float:
    """Twice the signed area of o, a, b."""
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull(points) -> list | None:
    """Convex hull in counter-clockwise order without collinear points; None for fewer than three."""
    ordered = sorted(set(points))

    def half(row):
        out = []
        for p in row:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(ordered) + half(ordered[::-1])
    return ring if len(ring) >= 3 else None


def dedupe(ring: list) -> list:
    """Without points that repeat the one before, around the ring; the first of them stays."""
    out = [p for p, before in zip(ring, [None, *ring], strict=False) if p != before]
    return out[:-1] if len(out) > 1 and out[-1] == out[0] else out


def drop_collinear(ring: list) -> list:
    """Without points that lie on the line between their neighbours, until none does."""
    while len(ring) > 3:
        keep = [p for i, p in enumerate(ring) if turn(ring[i - 1], p, ring[(i + 1) % len(ring)]) != 0]
        if len(keep) == len(ring) or len(keep) < 3:
            return ring
        ring = keep
    return ring


def turned(ring: list) -> list:
    """The ring from its smallest point on, so that what follows doesn't depend on where it was begun."""
    k = ring.index(min(ring)) if ring else 0
    return ring[k:] + ring[:k]


def _square(a, b) -> int:
    return (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2


def merge_short(ring: list, least: int) -> list:
    """From the smallest point on, without points closer than ``least`` to the last one kept, or at the end to the first."""
    out: list = []
    for p in turned(ring):
        if not out or _square(p, out[-1]) >= least * least:
            out.append(p)
    return out[:-1] if len(out) > 2 and _square(out[0], out[-1]) < least * least else out


def drop_near(ring: list, tolerance: int) -> list:
    """Without points at most ``tolerance`` off the chord of their neighbours, in ring order, round after round; three stay."""
    n = left = len(ring)
    before, after = [n - 1, *range(n - 1)], [*range(1, n), 0]
    order, dropped = list(range(n)), True

    def near(i: int) -> bool:
        a, p, b = ring[before[i]], ring[i], ring[after[i]]
        chord = _square(a, b)
        return turn(a, p, b) ** 2 <= tolerance**2 * chord if chord else _square(a, p) <= tolerance**2

    while dropped and left > 3:
        dropped, kept = False, []
        for i in order:
            if left > 3 and near(i):
                after[before[i]], before[after[i]] = after[i], before[i]
                left, dropped = left - 1, True
            else:
                kept.append(i)
        order = kept
    return [ring[i] for i in order]


#: Fixed value: the shortest side of a simplified ring in metres.
SHORTEST = 3


def simplify(ring: list, tolerance: int, shortest: int = SHORTEST) -> list:
    """A ring of whole metres without repeats, straight points and short sides, then without what ``tolerance`` allows."""
    ring = drop_collinear(merge_short(drop_collinear(dedupe(ring)), shortest))
    return drop_collinear(drop_near(ring, tolerance)) if tolerance > 0 and len(ring) > 3 else ring


def resample(ring: list, step: float) -> list:
    """Points every ``step`` along a closed ring, from its first point; the ring itself if it is shorter than three steps."""
    ring = dedupe(ring)
    sides = [hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    total = sum(sides)
    n = int(total // step)
    if n < 3:
        return ring
    out, i, passed = [], 0, 0.0
    for k in range(n):
        want = k * total / n
        while passed + sides[i] < want:
            passed += sides[i]
            i += 1
        t = (want - passed) / sides[i] if sides[i] else 0.0
        a, b = ring[i], ring[(i + 1) % len(ring)]
        out.append((a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t))
    return out
