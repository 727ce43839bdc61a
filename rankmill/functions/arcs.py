"""Rings cut into arcs at given points, thinned arc by arc, and a check that nothing crosses; numpy on one geometry."""

from __future__ import annotations

import hashlib

import numpy as np

MOST_LEVELS = 6  # an arc's tolerance is divided by 4 for each level; at the last one it keeps all its points


def ring_arcs(ring: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """Arcs of a closed ring, in order, each with both ends; a ring without cuts is one arc from its first point."""
    if not cuts:
        return [ring]
    open_ring = ring[:-1]
    turned = np.roll(open_ring, -cuts[0], axis=0)
    stops = [(c - cuts[0]) for c in cuts] + [len(open_ring)]
    turned = np.concatenate([turned, turned[:1]])
    return [turned[a : b + 1] for a, b in zip(stops, stops[1:])]


def canonical(arc: np.ndarray) -> tuple[np.ndarray, bool]:
    """The arc in the direction both of its sides agree on, and whether that is the other one."""
    other = arc[::-1]
    return (other, True) if other.tolist() < arc.tolist() else (arc, False)


def arc_id(arc: np.ndarray) -> bytes:
    return hashlib.blake2b(np.ascontiguousarray(canonical(arc)[0]).tobytes(), digest_size=16).digest()


def thin_arc(arc: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker between the ends of an arc; a closed one is first split at the point farthest from its start."""
    if len(arc) < 3:
        return arc
    own, turned = canonical(arc)
    keep = np.zeros(len(own), bool)
    keep[0] = keep[-1] = True
    spans = [(0, len(own) - 1)]
    if (own[0] == own[-1]).all() and len(own) > 2:
        away = np.hypot(*(own - own[0]).T)
        far = int(away.argmax())
        keep[far] = True
        spans = [(0, far), (far, len(own) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        base, offset = own[b] - own[a], own[a + 1 : b] - own[a]
        length = base @ base
        along = np.minimum(np.maximum(offset @ base / length, 0), 1) if length else np.zeros(len(offset))
        away = np.hypot(*(offset - along[:, None] * base).T)
        far = int(away.argmax())
        if away[far] > tolerance:
            keep[a + 1 + far] = True
            spans += [(a, a + 1 + far), (a + 1 + far, b)]
    out = own[keep]
    return out[::-1] if turned else out


def crossing(points: np.ndarray, ring_of: np.ndarray, next_of: np.ndarray, polygon_of: np.ndarray | None = None) -> np.ndarray:
    """Numbers of segments (points[i], points[next_of[i]]) that meet another one of their polygon, but for neighbours at their common point."""
    a, b = points, points[next_of]
    low, high = np.minimum(a, b), np.maximum(a, b)
    # places of all x in order instead of x itself, so that a polygon's segments lie apart from all others'
    places = np.unique(np.concatenate([low[:, 0], high[:, 0]]), return_inverse=True)[1]
    apart = 0 if polygon_of is None else polygon_of * len(places)
    start, end = places[: len(low)] + apart, places[len(low) :] + apart
    order = np.argsort(start, kind="stable")
    upto = np.searchsorted(start[order], end[order], "right")
    counts = np.maximum(upto - np.arange(len(order)) - 1, 0)
    found = np.zeros(len(points), bool)
    step = max(1, 2_000_000 // max(1, int(counts.max(initial=1))))
    for at in range(0, len(order), step):  # a bounded number of pairs at once
        own = counts[at : at + step]
        i = np.repeat(np.arange(at, at + len(own)), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        i, j = order[i], order[j]
        near = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        i, j = i[near], j[near]
        turn = lambda p, q, r: (q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0])
        d1, d2, d3, d4 = turn(a[j], b[j], a[i]), turn(a[j], b[j], b[i]), turn(a[i], b[i], a[j]), turn(a[i], b[i], b[j])
        meets = (np.sign(d1) * np.sign(d2) <= 0) & (np.sign(d3) * np.sign(d4) <= 0)
        after, before = next_of[i] == j, next_of[j] == i
        # neighbours meet at one point by nature; they fold back on each other if the free ends lie on one line, on one side
        shared = np.where(after[:, None], b[i], a[i])
        free_i, free_j = np.where(after[:, None], a[i], b[i]), np.where(after[:, None], b[j], a[j])
        folded = (turn(shared, free_i, free_j) == 0) & (((free_i - shared) * (free_j - shared)).sum(axis=1) > 0)
        # rings of one polygon may touch in points both have
        touch = (a[i] == a[j]).all(axis=1) | (a[i] == b[j]).all(axis=1) | (b[i] == a[j]).all(axis=1) | (b[i] == b[j]).all(axis=1)
        bad = np.where(after | before, folded, meets & ~(touch & (ring_of[i] != ring_of[j])))
        found[i[bad]] = found[j[bad]] = True
    return np.flatnonzero(found)


def thin_geometries(rows: list[tuple[list, dict[tuple[int, int, int], bool], dict[bytes, int]]], tolerance: float) -> list[tuple[list, list[bytes], list[bytes]]]:
    """For each (geometry, cuts, levels): the geometry with its arcs thinned, its arcs, and those that have to keep more points.

    These are the arcs of small or crossing rings; crossings are looked for in all geometries at once.
    """
    made, rings, owners, polygon_of = [], [], [], []  # rings: of all polygons; owners: per segment its row and arc
    for row, (geometry, cuts, levels) in enumerate(rows):
        out, all_ids, refine = [], set(), set()
        cuts_of = {}
        for (p, r, i), hard in cuts.items():
            cuts_of.setdefault((p, r), {})[i] = hard
        for p, polygon in enumerate(geometry):
            thin = []
            for r, ring in enumerate(polygon):
                points = np.array([q[:2] for q in ring], float)
                if len(points) < 4:  # no ring; left as it is
                    thin.append(points)
                    owners += [(row, b"")] * max(len(points) - 1, 0)
                    continue
                own = cuts_of.get((p, r), {})
                some = any(own.values())
                arcs = ring_arcs(points, sorted(i for i, hard in own.items() if hard or not some))
                ids = [arc_id(a) for a in arcs]
                all_ids.update(ids)
                thinned = [a if levels.get(i, 0) >= MOST_LEVELS else thin_arc(a, tolerance / 4 ** levels.get(i, 0)) for a, i in zip(arcs, ids)]
                whole = np.concatenate([*[t[:-1] for t in thinned], thinned[0][:1]])
                if len(whole) < 4:
                    refine.update(ids)
                thin.append(whole)
                owners += [(row, i) for i, t in zip(ids, thinned) for _ in t[:-1]]
            number = polygon_of[-1] + 1 if polygon_of else 0
            polygon_of += [number] * len(thin)
            rings += thin
            out.append([r.tolist() for r in thin])
        made.append((out, all_ids, refine))
    sizes = np.array([max(len(r) - 1, 0) for r in rings], int)
    if sizes.sum():
        starts, ring_of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rings)), sizes)
        at = np.arange(len(ring_of)) - starts[ring_of]
        following = starts[ring_of] + (at + 1) % sizes[ring_of]
        for k in crossing(np.concatenate([r[:-1] for r in rings if len(r) > 1]), ring_of, following, np.array(polygon_of)[ring_of]):
            row, arc = owners[k]
            made[row][2].add(arc)
    return [
        (out, sorted(ids), sorted(i for i in refine if i and levels.get(i, 0) < MOST_LEVELS))
        for (out, ids, refine), (_, _, levels) in zip(made, rows, strict=True)
    ]
