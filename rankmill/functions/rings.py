"""Thinning of closed rings, in numpy on the flat points of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _farthest(points: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per span (first, last): the inner point farthest from the line between the ends, and how far."""
    sizes = last - first - 1
    starts = np.cumsum(sizes) - sizes
    span = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(span)) - starts[span] + first[span] + 1
    base = points[last] - points[first]
    length = np.einsum("ij,ij->i", base, base)[span]
    offset = points[inner] - points[first[span]]
    along = np.einsum("ij,ij->i", offset, base[span]) / np.where(length == 0, 1, length)
    away = np.hypot(*(offset - np.clip(along, 0, 1)[:, None] * base[span]).T)
    most = np.maximum.reduceat(away, starts)
    winner = np.where(away == most[span], inner, len(points))
    return np.minimum.reduceat(winner, starts), most


def kept_points(points: np.ndarray, starts: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on many closed rings at once; ``starts`` holds each ring's first index and the end.

    All spans of one depth are measured together. A closed ring has no base line, so it is first
    split at the point farthest from its start. Rings keep at least four points.
    """
    keep = np.zeros(len(points), dtype=bool)
    small = np.diff(starts) <= 4
    keep[np.repeat(small, np.diff(starts))] = True
    first, last = starts[:-1][~small], starts[1:][~small] - 1
    if not len(first):
        return keep
    keep[first] = keep[last] = True
    turn, _ = _farthest(points, first, last)
    keep[turn] = True
    spare = np.stack([_second(points, first, turn), _second(points, turn, last)])
    spans = np.concatenate([first, turn]), np.concatenate([turn, last])
    while True:
        wide = spans[1] - spans[0] > 1
        a, b = spans[0][wide], spans[1][wide]
        if not len(a):
            break
        middle, away = _farthest(points, a, b)
        far = away > tolerance
        keep[middle[far]] = True
        spans = np.concatenate([a[far], middle[far]]), np.concatenate([middle[far], b[far]])
    # A ring that fell to three points (start, turn, start) gets its widest remaining point back.
    upto = np.concatenate([[0], np.cumsum(keep)])
    flat = upto[last + 1] - upto[first] < 4
    for ring in np.flatnonzero(flat):
        candidates = [p for p in spare[:, ring] if p >= 0]
        base = points[turn[ring]] - points[first[ring]]
        offset = points[candidates] - points[first[ring]]
        keep[candidates[int(np.abs(offset @ np.array([-base[1], base[0]])).argmax())]] = True
    return keep


def _second(points: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Per span the farthest inner point, -1 where there is none."""
    out = np.full(len(first), -1)
    wide = last - first > 1
    if wide.any():
        out[wide] = _farthest(points, first[wide], last[wide])[0]
    return out


def _flat(lists: pa.Array) -> pa.Array:
    """Elements of all lists; Arrow cannot flatten an array without lists that came from a JVM."""
    return lists.flatten() if len(lists) else lists.values


def _offsets(lists: pa.Array) -> np.ndarray:
    """Start of each list and the end of the last, counted from 0; a NULL list is empty."""
    if not len(lists):
        return np.zeros(1, dtype=int)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)])


def points_before(geometries: pa.Array) -> np.ndarray:
    """Number of points before each geometry, and of all."""
    polygons = _flat(geometries)
    return _offsets(_flat(polygons))[_offsets(polygons)][_offsets(geometries)]


def thin_batch(geometries: pa.Array, tolerance: float) -> pa.Array:
    """Polygons of rings of [x, y] points, with the points that Douglas-Peucker drops left out."""
    polygons = _flat(geometries)
    rings = _flat(polygons)
    pairs = _flat(rings)
    points = _flat(pairs).to_numpy(zero_copy_only=False).reshape(-1, 2)
    starts = _offsets(rings)
    keep = kept_points(points, starts, tolerance)
    kept = np.concatenate([[0], np.cumsum(keep)])[starts]

    def nest(offsets: np.ndarray, values: pa.Array, mask: pa.Array | None = None) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)

    out = nest(np.arange(keep.sum() + 1) * 2, pa.array(points[keep].ravel(), pa.float64()))
    out = nest(_offsets(polygons), nest(kept, out))
    return nest(_offsets(geometries), out, geometries.is_null() if geometries.null_count else None)
