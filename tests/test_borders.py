"""Simplification that keeps shared borders, on grids of uneven cells."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from rankmill.functions import arcs
from rankmill.operators import geo
from rankmill.sources.geo import GEOMETRY


def side(rng, a, b, n, spread):
    """Points from a to b with ``n`` uneven ones between."""
    inner = [
        [a[0] + (b[0] - a[0]) * k / (n + 1) - (b[1] - a[1]) * off, a[1] + (b[1] - a[1]) * k / (n + 1) + (b[0] - a[0]) * off]
        for k in range(1, n + 1)
        for off in [rng.uniform(-spread, spread)]
    ]
    return [a, *inner, b]


def grid(n, spread, seed=1):
    """n x n cells; neighbours hold the points of their common side in opposite directions, rings start anywhere."""
    rng = random.Random(seed)
    corner = {(i, j): [float(i), float(j)] for i in range(n + 1) for j in range(n + 1)}
    sides = {}
    for i in range(n + 1):
        for j in range(n + 1):
            for to in ((i + 1, j), (i, j + 1)):
                if to in corner:
                    sides[(i, j), to] = side(rng, corner[i, j], corner[to], rng.randint(0, 12), spread)
    path = lambda a, b: sides[a, b] if (a, b) in sides else sides[b, a][::-1]
    cells = {}
    for i in range(n):
        for j in range(n):
            turn = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            ring = [p for a, b in zip(turn, [*turn[1:], turn[0]]) for p in path(a, b)[:-1]]
            if rng.random() < 0.5:
                ring = ring[::-1]
            at = rng.randrange(len(ring))
            ring = ring[at:] + ring[:at]
            cells[i, j] = [[ring + ring[:1]]]
    return cells


def edges(geometry):
    return {tuple(sorted((tuple(a), tuple(b)))) for polygon in geometry for ring in polygon for a, b in zip(ring, ring[1:])}


def crosses(ring):
    """All pairs of segments compared."""
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    parts = list(zip(ring, ring[1:]))
    for i, (a, b) in enumerate(parts):
        for j, (c, d) in enumerate(parts[:i]):
            if j in (i - 1, i + 1) or (i == len(parts) - 1 and j == 0):
                continue
            if turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0:
                return True
    return False


@pytest.mark.parametrize("spread, tolerance", [(0.05, 0.02), (0.02, 0.3), (0.3, 0.5)])
def test_neighbours_keep_one_border(spark, spread, tolerance):
    cells = {k: g for k, g in grid(5, spread).items() if not any(crosses(r) for p in g for r in p)}
    df = spark.createDataFrame([(f"{i},{j}", g) for (i, j), g in cells.items()], f"cell string, geometry {GEOMETRY}")
    out = {tuple(map(int, r.cell.split(","))): r.geometry for r in geo.simplify_borders(df, tolerance).collect()}
    assert set(out) == set(cells)
    owners, before = defaultdict(set), defaultdict(set)
    for k in cells:
        for e in edges(out[k]):
            owners[e].add(k)
        for e in edges(cells[k]):
            before[e].add(k)
        for polygon in out[k]:
            for ring in polygon:
                assert ring[0] == ring[-1] and len(ring) >= 4 and not crosses(ring)
                assert {tuple(p) for p in ring} <= {tuple(p) for r in cells[k][0] for p in r}
    assert sum(map(len, owners.values())) < sum(map(len, before.values()))
    for i, j in cells:  # what was a border of two cells is one still: inner sides have two owners
        for other in ((i + 1, j), (i, j + 1)):
            if other in cells:
                shared = [e for e, o in owners.items() if {(i, j), other} <= o]
                a, b = ((i + 1, j), (i + 1, j + 1)) if other[0] > i else ((i, j + 1), (i + 1, j + 1))
                ends = [p for e in shared for p in e]
                odd = {p for p in ends if ends.count(p) % 2}
                assert odd == {tuple(map(float, a)), tuple(map(float, b))}  # the common edges lead from corner to corner


def test_rings_shared_whole_holes_and_missing(spark):
    circle = [[math.cos(k / 40 * 2 * math.pi), math.sin(k / 40 * 2 * math.pi)] for k in range(40)]
    square = [[-3.0, -3.0], [3.0, -3.0], [3.0, 3.0], [-3.0, 3.0], [-3.0, -3.0]]
    island, hole = circle + circle[:1], circle[17:] + circle[:17] + circle[17:18]
    rows = [(1, [[island]]), (2, [[square, hole[::-1]]]), (3, None), (4, []), (5, [[island]])]
    out = {r.id: r.geometry for r in geo.simplify_borders(spark.createDataFrame(rows, f"id int, geometry {GEOMETRY}"), 0.1).collect()}
    assert out[3] is None and out[4] == [] and out[5] == out[1]
    assert edges(out[1]) == edges([out[2][0][1:]]) and 4 <= len(out[1][0][0]) < 41
    assert geo.simplify_borders(spark.createDataFrame([], f"id int, geometry {GEOMETRY}"), 0.1).count() == 0


def test_crossing_segments_are_found():
    rng = random.Random(6)
    for _ in range(300):
        ring = [[rng.randint(0, 6), rng.randint(0, 6)] for _ in range(rng.randint(3, 8))]
        if len({tuple(p) for p in ring}) < len(ring):
            continue
        n = len(ring)
        found = arcs.crossing(np.array(ring, float), np.zeros(n, int), (np.arange(n) + 1) % n)
        if n > 3:
            folded = any(
                (b[0] - a[0]) * (c[1] - a[1]) == (b[1] - a[1]) * (c[0] - a[0]) and (a[0] - b[0]) * (c[0] - b[0]) + (a[1] - b[1]) * (c[1] - b[1]) > 0
                for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2])
            )
            assert bool(len(found)) == (crosses(ring + ring[:1]) or folded)


def test_geometries_thinned_together_do_not_mix():
    """Copies that lie across each other belong to different geometries: thinned in one call as one by one."""
    cells = [g for shift in (0, 0.5) for g in ([[[[x + shift, y] for x, y in r] for r in p] for p in g] for g in grid(3, 0.3).values())]
    cells += [[], [[]], [[[[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]], cells[0] + cells[1]]
    rows = [(g, {(0, 0, i): True for i in range(0, 4, 2)} if g and g[0] else {}, {}) for g in cells]
    together = arcs.thin_geometries(rows, 0.2)
    assert together == [arcs.thin_geometries([row], 0.2)[0] for row in rows]
    assert any(refine for _, _, refine in together) and not all(refine for _, _, refine in together)


def test_features_of_one_file_are_dealt_out(spark):
    """A small file is read by one task; the costly steps must not stay there."""
    df = spark.createDataFrame([(f"{i},{j}", g) for (i, j), g in grid(5, 0.05).items()], f"cell string, geometry {GEOMETRY}").coalesce(1)
    rows = geo.simplify_borders(df, 0.02)
    assert rows.count() == 25 and len([f for f in rows.inputFiles() if "stored-" in f]) > 8
