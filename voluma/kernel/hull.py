"""Convex hulls with exact signs."""

from __future__ import annotations

import numpy as np

from voluma.kernel import predicates as exact
from voluma.kernel import shape as s
from voluma.kernel.shape import Shape, with_faces
from voluma.kernel.triangulate import cross, triangulate


def flat_hull(points: list[tuple[float, float]]) -> list[int]:
    """Indices of the strict corners, counter-clockwise from the least point."""
    order = sorted(range(len(points)), key=lambda k: points[k])
    order = [k for n, k in enumerate(order) if not n or points[k] != points[order[n - 1]]]
    if len(order) < 3:
        return order

    def half(sequence):
        out: list[int] = []
        for k in sequence:
            while len(out) > 1 and exact.orient2d(points[out[-2]], points[out[-1]], points[k]) <= 0:
                out.pop()
            out.append(k)
        return out[:-1]

    return half(order) + half(order[::-1])


def _seed(p: list[tuple]) -> tuple[int, ...]:
    """Up to four points that span as much as there is."""
    b = next((k for k in range(1, len(p)) if p[k] != p[0]), None)
    if b is None:
        return (0,)
    c = next((k for k in range(len(p)) if not exact.collinear(p[0], p[b], p[k])), None)
    if c is None:
        return 0, b
    d = next((k for k in range(len(p)) if exact.orient3d(p[0], p[b], p[c], p[k])), None)
    return (0, b, c) if d is None else (0, b, c, d)


def _triangles(p: list[tuple], seed: tuple[int, ...]) -> set[tuple[int, int, int]]:
    a, b, c, d = seed
    if exact.orient3d(p[a], p[b], p[c], p[d]) > 0:
        b, c = c, b
    faces = {(a, b, c), (a, d, b), (b, d, c), (c, d, a)}
    for k in range(len(p)):
        if k in seed:
            continue
        seen = {f for f in faces if exact.orient3d(*(p[i] for i in f), p[k]) > 0}
        if not seen:
            continue
        edges = {(f[i], f[(i + 1) % 3]) for f in seen for i in range(3)}
        faces -= seen
        faces |= {(x, y, k) for x, y in edges if (y, x) not in edges}
    return faces


def _merged(p: list[tuple], faces: set[tuple[int, int, int]]) -> list[list[int]]:
    """Coplanar neighbours joined into polygons, without points on straight edges."""
    owner = {(f[i], f[(i + 1) % 3]): f for f in faces for i in range(3)}
    group: dict[tuple, int] = {}
    polygons = []
    for start in sorted(faces):
        if start in group:
            continue
        group[start] = len(polygons)
        members, queue = [start], [start]
        while queue:
            f = queue.pop()
            for i in range(3):
                other = owner[f[(i + 1) % 3], f[i]]
                if other not in group and all(exact.orient3d(*(p[x] for x in start), p[y]) == 0 for y in other):
                    group[other] = group[start]
                    members.append(other)
                    queue.append(other)
        edges = {(f[i], f[(i + 1) % 3]) for f in members for i in range(3)}
        following = {x: y for x, y in edges if (y, x) not in edges}
        first = min(following)
        loop, at = [first], following[first]
        while at != first:
            loop.append(at)
            at = following[at]
        polygons.append([x for n, x in enumerate(loop) if not exact.collinear(p[loop[n - 1]], p[x], p[loop[(n + 1) % len(loop)]])])
    return polygons


def convex_hull(shape: Shape) -> Shape:
    points = np.unique(shape.v + 0.0, axis=0)
    p = list(map(tuple, points.tolist()))
    if not p:
        return Shape(s.POINT, np.zeros((0, 3)), shape.crs)
    seed = _seed(p)
    if len(seed) == 1:
        return Shape(s.POINT, points[:1], shape.crs)
    if len(seed) == 2:
        return Shape(s.LINE, points[[0, -1]], shape.crs)
    if len(seed) == 3:
        axis = exact.normal_axis(*(p[k] for k in seed))
        flat = [(x[(axis + 1) % 3], x[(axis + 2) % 3]) for x in p]
        out = with_faces(s.POLYGON, shape.crs, [[_rotated(points[flat_hull(flat)], axis)]])
    else:
        out = with_faces(s.SURFACE, shape.crs, [[points[f]] for f in _merged(p, _triangles(p, seed))])
    triangulate(out)
    return out


def _rotated(ring: np.ndarray, axis: int) -> np.ndarray:
    """The ring from its least point, turning left seen from above where it has an upper side."""
    turn = cross(ring[1] - ring[0], ring[2] - ring[0])
    if turn[2] < 0 or (turn[2] == 0 and turn[axis] < 0):
        ring = ring[::-1]
    return np.roll(ring, -int(np.lexsort(ring.T[::-1])[0]), axis=0)


def footprint_hull(shape: Shape) -> Shape:
    if not len(shape.v):
        return Shape(s.POINT, np.zeros((0, 3)), shape.crs)
    flat = list(map(tuple, (shape.v[:, :2] + 0.0).tolist()))
    corners = flat_hull(flat)
    ring = np.column_stack([np.array([flat[k] for k in corners]), np.full(len(corners), shape.v[:, 2].min())])
    if len(corners) < 3:
        return Shape(s.POINT if len(corners) == 1 else s.LINE, ring, shape.crs)
    out = with_faces(s.POLYGON, shape.crs, [[ring]])
    triangulate(out)
    return out
