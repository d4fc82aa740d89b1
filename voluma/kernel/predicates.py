"""Signs of determinants: floating point where it is certain, rational arithmetic where it is not."""

from __future__ import annotations

#: Bounds on the relative error of the floating-point determinants.
_ERROR2, _ERROR3 = 4e-16, 8e-16


def _sign(x) -> int:
    return (x > 0) - (x < 0)


def _scaled(*points) -> list[list[int]]:
    """The coordinates as whole numbers under one common scale, exactly: floats are whole numbers over powers of two."""
    ratios = [[float(x).as_integer_ratio() for x in p] for p in points]
    most = max(d for p in ratios for _, d in p)
    return [[n * (most // d) for n, d in p] for p in ratios]


def orient2d(a, b, c) -> int:
    """The side of line ab on which c lies; points are pairs."""
    left, right = (a[0] - c[0]) * (b[1] - c[1]), (a[1] - c[1]) * (b[0] - c[0])
    det = left - right
    if abs(det) > _ERROR2 * (abs(left) + abs(right)):
        return _sign(det)
    (ax, ay), (bx, by), (cx, cy) = _scaled(a[:2], b[:2], c[:2])
    return _sign((ax - cx) * (by - cy) - (ay - cy) * (bx - cx))


def orient3d(a, b, c, d) -> int:
    """Positive if d lies on the side of plane abc to which its right-handed normal points."""
    ux, uy, uz = b[0] - a[0], b[1] - a[1], b[2] - a[2]
    vx, vy, vz = c[0] - a[0], c[1] - a[1], c[2] - a[2]
    wx, wy, wz = d[0] - a[0], d[1] - a[1], d[2] - a[2]
    p, q, r = uy * vz, uz * vy, uz * vx
    t, m, n = ux * vz, ux * vy, uy * vx
    det = wx * (p - q) + wy * (r - t) + wz * (m - n)
    size = abs(wx) * (abs(p) + abs(q)) + abs(wy) * (abs(r) + abs(t)) + abs(wz) * (abs(m) + abs(n))
    if abs(det) > _ERROR3 * size:
        return _sign(det)
    a, b, c, d = _scaled(a, b, c, d)
    u, v, w = ([x - y for x, y in zip(p, a, strict=True)] for p in (b, c, d))
    return _sign(w[0] * (u[1] * v[2] - u[2] * v[1]) + w[1] * (u[2] * v[0] - u[0] * v[2]) + w[2] * (u[0] * v[1] - u[1] * v[0]))


def normal_axis(a, b, c) -> int | None:
    """An axis along which triangle abc does not project to a line, or None if it is a line itself."""
    for axis in range(3):
        i, j = (axis + 1) % 3, (axis + 2) % 3
        if orient2d((a[i], a[j]), (b[i], b[j]), (c[i], c[j])):
            return axis
    return None


def collinear(a, b, c) -> bool:
    return normal_axis(a, b, c) is None


def on_segment(p, a, b) -> bool:
    return collinear(a, b, p) and all(min(x, y) <= z <= max(x, y) for x, y, z in zip(a, b, p, strict=True))


def _flat(p, axis: int) -> tuple[float, float]:
    return p[(axis + 1) % 3], p[(axis + 2) % 3]


def _segments_meet_2d(a, b, c, d) -> bool:
    o1, o2, o3, o4 = orient2d(a, b, c), orient2d(a, b, d), orient2d(c, d, a), orient2d(c, d, b)
    if o1 * o2 < 0 and o3 * o4 < 0:
        return True
    between = lambda p, q, r: min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    return (not o1 and between(a, b, c)) or (not o2 and between(a, b, d)) or (not o3 and between(c, d, a)) or (not o4 and between(c, d, b))


def segments_meet(a, b, c, d) -> bool:
    if orient3d(a, b, c, d):
        return False
    axis = next((x for t in ((a, b, c), (a, b, d), (a, c, d), (b, c, d)) if (x := normal_axis(*t)) is not None), None)
    if axis is not None:
        return _segments_meet_2d(*(_flat(p, axis) for p in (a, b, c, d)))
    return on_segment(c, a, b) or on_segment(d, a, b) or on_segment(a, c, d) or on_segment(b, c, d)


def in_triangle(p, a, b, c) -> bool:
    """p is in the closed triangle."""
    axis = normal_axis(a, b, c)
    if axis is None:
        return on_segment(p, a, b) or on_segment(p, b, c) or on_segment(p, c, a)
    if orient3d(a, b, c, p):
        return False
    a, b, c, p = (_flat(x, axis) for x in (a, b, c, p))
    signs = {orient2d(a, b, p), orient2d(b, c, p), orient2d(c, a, p)}
    return not {1, -1} <= signs


def segment_meets_triangle(p, q, a, b, c) -> bool:
    axis = normal_axis(a, b, c)
    if axis is None:
        return segments_meet(p, q, a, b) or segments_meet(p, q, b, c) or segments_meet(p, q, c, a)
    sp, sq = orient3d(a, b, c, p), orient3d(a, b, c, q)
    if sp * sq > 0:
        return False
    if not sp and not sq:
        if in_triangle(p, a, b, c) or in_triangle(q, a, b, c):
            return True
        fp, fq, fa, fb, fc = (_flat(x, axis) for x in (p, q, a, b, c))
        return _segments_meet_2d(fp, fq, fa, fb) or _segments_meet_2d(fp, fq, fb, fc) or _segments_meet_2d(fp, fq, fc, fa)
    if not sp:
        return in_triangle(p, a, b, c)
    if not sq:
        return in_triangle(q, a, b, c)
    signs = {orient3d(p, q, a, b), orient3d(p, q, b, c), orient3d(p, q, c, a)}
    return not {1, -1} <= signs


def triangles_meet(s, t) -> bool:
    edges = lambda x: ((x[0], x[1]), (x[1], x[2]), (x[2], x[0]))
    return any(segment_meets_triangle(*e, *t) for e in edges(s)) or any(segment_meets_triangle(*e, *s) for e in edges(t))
