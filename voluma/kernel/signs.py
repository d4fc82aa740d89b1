"""The exact predicates of many rows at once.

A float determinant settles what lies outside its error bound. Where the differences of the coordinates are exact and whole
under a power of two, with at most 30 bits, the determinant is taken in whole numbers; what is left goes row by row
through ``predicates``. So every sign is exact, whichever way it is found.
"""

from __future__ import annotations

import numpy as np

from voluma.kernel import predicates as exact

_ERROR2, _ERROR3 = 4e-16, 8e-16
_BITS = 30


def _whole(ends: list[np.ndarray], origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(differences from the origin as whole numbers under one scale a row, rows where they are exact)."""
    d = np.stack([e - origin for e in ends])
    o = np.broadcast_to(origin, d.shape)
    e = np.stack(ends)
    with np.errstate(over="ignore", invalid="ignore"):
        back = d - e
        lost = (e - (d - back)) - (o + back)  # zero only where e - o is d exactly
        most = np.abs(d).max(axis=(0, 2))
        scaled = np.ldexp(d, (_BITS - np.frexp(most)[1])[None, :, None])
        good = (lost == 0).all(axis=(0, 2)) & np.isfinite(most) & (scaled == np.floor(scaled)).all(axis=(0, 2)) & (most > 1e-280) & (most < 1e280)
    return np.where(good[None, :, None], scaled, 0).astype(np.int64), good | (most == 0)


def orient3d(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Row by row ``predicates.orient3d``."""
    u, v, w = b - a, c - a, d - a
    p, q, r = u[:, 1] * v[:, 2], u[:, 2] * v[:, 1], u[:, 2] * v[:, 0]
    t, m, k = u[:, 0] * v[:, 2], u[:, 0] * v[:, 1], u[:, 1] * v[:, 0]
    det = w[:, 0] * (p - q) + w[:, 1] * (r - t) + w[:, 2] * (m - k)
    size = np.abs(w[:, 0]) * (np.abs(p) + np.abs(q)) + np.abs(w[:, 1]) * (np.abs(r) + np.abs(t)) + np.abs(w[:, 2]) * (np.abs(m) + np.abs(k))
    out = np.where(np.abs(det) > _ERROR3 * size, np.sign(det), 0).astype(np.int8)
    at = np.flatnonzero(~(np.abs(det) > _ERROR3 * size))
    if not len(at):
        return out
    (u, v, w), good = _whole([b[at], c[at], d[at]], a[at])
    minors = [u[:, i] * v[:, j] - u[:, j] * v[:, i] for i, j in ((1, 2), (2, 0), (0, 1))]  # below 2^61
    low = sum(w[:, i] * (x & ((1 << _BITS) - 1)) for i, x in enumerate(minors))
    high = sum(w[:, i] * (x >> _BITS) for i, x in enumerate(minors)) + (low >> _BITS)
    low &= (1 << _BITS) - 1
    out[at] = np.where(high != 0, np.sign(high), np.sign(low))
    for i in at[~good].tolist():
        out[i] = exact.orient3d(a[i].tolist(), b[i].tolist(), c[i].tolist(), d[i].tolist())
    return out


def orient2d(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row ``predicates.orient2d``."""
    u, v = a - c, b - c
    left, right = u[:, 0] * v[:, 1], u[:, 1] * v[:, 0]
    det, size = left - right, np.abs(left) + np.abs(right)
    out = np.where(np.abs(det) > _ERROR2 * size, np.sign(det), 0).astype(np.int8)
    at = np.flatnonzero(~(np.abs(det) > _ERROR2 * size))
    if not len(at):
        return out
    (u, v), good = _whole([a[at], b[at]], c[at])
    out[at] = np.sign(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    for i in at[~good].tolist():
        out[i] = exact.orient2d(a[i].tolist(), b[i].tolist(), c[i].tolist())
    return out


def flat_axis(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row ``predicates.normal_axis``, -1 for a triangle that is a line."""
    out = np.full(len(a), -1)
    left = np.arange(len(a))
    for axis in range(3):
        if len(left):
            plane = [(axis + 1) % 3, (axis + 2) % 3]
            stands = orient2d(a[left][:, plane], b[left][:, plane], c[left][:, plane]) != 0
            out[left[stands]] = axis
            left = left[~stands]
    return out


def flattened(p: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """The coordinates beside each row's axis."""
    return np.take_along_axis(p, np.stack([(axis + 1) % 3, (axis + 2) % 3], axis=1), axis=1)


def _mixed(*signs: np.ndarray) -> np.ndarray:
    each = np.stack(signs)
    return (each.max(axis=0) > 0) & (each.min(axis=0) < 0)


def _within(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether a point of the plane lies in the closed triangle; pairs of coordinates."""
    return ~_mixed(orient2d(a, b, p), orient2d(b, c, p), orient2d(c, a, p))


def in_triangle(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Row by row ``predicates.in_triangle``."""
    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    out = np.zeros(len(p), dtype=bool)
    axis = flat_axis(a, b, c)
    at = np.flatnonzero((axis >= 0) & (orient3d(a, b, c, p) == 0))
    if len(at):
        out[at] = _within(*(flattened(x[at], axis[at]) for x in (p, a, b, c)))
    for i in np.flatnonzero(axis < 0).tolist():
        out[i] = exact.in_triangle(p[i].tolist(), *t[i].tolist())
    return out


def _segments_meet(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Row by row ``predicates._segments_meet_2d``."""
    o1, o2, o3, o4 = orient2d(a, b, c), orient2d(a, b, d), orient2d(c, d, a), orient2d(c, d, b)
    between = lambda p, q, r: ((np.minimum(p, q) <= r) & (r <= np.maximum(p, q))).all(axis=1)
    return ((o1 * o2 < 0) & (o3 * o4 < 0)) | ((o1 == 0) & between(a, b, c)) | ((o2 == 0) & between(a, b, d)) | ((o3 == 0) & between(c, d, a)) | ((o4 == 0) & between(c, d, b))


def segment_meets_triangle(p: np.ndarray, q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Row by row ``predicates.segment_meets_triangle``."""
    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    axis = flat_axis(a, b, c)
    out = np.zeros(len(p), dtype=bool)
    sp, sq = orient3d(a, b, c, p), orient3d(a, b, c, q)
    through = np.flatnonzero((axis >= 0) & (sp * sq < 0))
    if len(through):
        p1, q1, a1, b1, c1 = (x[through] for x in (p, q, a, b, c))
        out[through] = ~_mixed(orient3d(p1, q1, a1, b1), orient3d(p1, q1, b1, c1), orient3d(p1, q1, c1, a1))
    for end, own, other in ((p, sp, sq), (q, sq, sp)):
        at = np.flatnonzero((axis >= 0) & (own == 0) & ~out)
        if len(at):
            out[at] = _within(*(flattened(x[at], axis[at]) for x in (end, a, b, c)))
    level = np.flatnonzero((axis >= 0) & (sp == 0) & (sq == 0) & ~out)
    if len(level):
        p2, q2, a2, b2, c2 = (flattened(x[level], axis[level]) for x in (p, q, a, b, c))
        out[level] = _segments_meet(p2, q2, a2, b2) | _segments_meet(p2, q2, b2, c2) | _segments_meet(p2, q2, c2, a2)
    for i in np.flatnonzero(axis < 0).tolist():
        out[i] = exact.segment_meets_triangle(p[i].tolist(), q[i].tolist(), *t[i].tolist())
    return out
