"""Distances and intersections of many pairs of solids at once.

The solids of a batch lie end to end as vertices, triangles and edges. Candidates of all pairs are laid end to end
too: elements near the other solid's box, then combinations whose boxes are near enough, then the exact measure, and
the least for each pair. Intersection asks for signs of determinants: floats settle what their error bound allows, and
only what is left goes through the rational predicates. The results are those of ``distance`` pair by pair.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np

from voluma.kernel import signs
from voluma.kernel.distance import _closest_on_triangles, _closest_segments, inside_exactly
from voluma.kernel.flat import ranges as _ranges

#: Combinations that are laid out at a time; a pair with more of them alone is left to the caller.
BLOCK = 1 << 20
_ERROR = 8e-16


@dataclass
class Solids:
    """Row r has the vertices v[vo[r]:vo[r+1]]; triangles and edges are indices of v."""

    v: np.ndarray
    vo: np.ndarray
    t: np.ndarray
    to: np.ndarray
    e: np.ndarray
    eo: np.ndarray

    @classmethod
    def of(cls, v: np.ndarray, vo: np.ndarray, t: np.ndarray, to: np.ndarray) -> Solids:
        row = np.repeat(np.arange(len(to) - 1), np.diff(to))
        ends = np.concatenate([t[:, :2], t[:, 1:], t[:, ::2]]) if len(t) else np.zeros((0, 2), dtype=np.int64)
        low, high = ends.min(axis=1), ends.max(axis=1)
        keys = np.unique(low * (len(v) + 1) + high)  # vertices rise with the rows, so edges do
        e = np.stack([keys // (len(v) + 1), keys % (len(v) + 1)], axis=1)
        owner = np.searchsorted(vo, e[:, 0], side="right") - 1
        eo = np.searchsorted(owner, np.arange(len(vo)))
        assert len(row) == len(t)
        return cls(v, vo, t, to, e, eo)

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.vo) - 1
        low, high = np.full((n, 3), np.inf), np.full((n, 3), -np.inf)
        full = np.diff(self.vo) > 0
        if full.any():
            low[full] = np.minimum.reduceat(self.v, self.vo[:-1][full])
            high[full] = np.maximum.reduceat(self.v, self.vo[:-1][full])
        return low, high


def _members(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, element) for the elements of each pair's row."""
    sizes = offsets[rows + 1] - offsets[rows]
    return np.repeat(np.arange(len(rows)), sizes), _ranges(offsets[rows], sizes)


def _span(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if points.ndim == 2:
        return points, points
    corners = [points[:, k] for k in range(points.shape[1])]
    return reduce(np.minimum, corners), reduce(np.maximum, corners)


def _gap2(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return np.einsum("ij,ij->i", gap, gap)


def _near(pair: np.ndarray, shape: np.ndarray, box: tuple[np.ndarray, np.ndarray], bound2: np.ndarray) -> np.ndarray:
    """Which elements lie near enough to the other side's box."""
    return _gap2(_span(shape), (box[0][pair], box[1][pair])) <= bound2[pair]


def _combined(pa: np.ndarray, pb: np.ndarray, n: int):
    """(i, j) of all combinations of elements of one pair, in blocks; pa and pb rise."""
    ca, cb = np.bincount(pa, minlength=n), np.bincount(pb, minlength=n)
    sa, sb = np.cumsum(ca) - ca, np.cumsum(cb) - cb
    sizes = cb[pa]  # each element of a meets all of b's
    ends = np.cumsum(sizes)
    start = 0
    while start < len(pa):
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        part = np.arange(start, stop)
        yield np.repeat(part, sizes[part]), _ranges(sb[pa[part]], sizes[part])
        start = stop
    assert len(sa) == n


def _least(out: np.ndarray, pair: np.ndarray, values: np.ndarray) -> None:
    """Lowers ``out`` to the least value of each pair; pairs rise."""
    if len(pair):
        starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        at = pair[starts]
        out[at] = np.minimum(out[at], np.minimum.reduceat(values, starts))


def apart2(a: Solids, b: Solids, ra: np.ndarray, rb: np.ndarray, limit2: np.ndarray | None = None) -> np.ndarray:
    """The squared distance of the surfaces of each pair of rows, which do not meet; under ``limit2`` any value that is, over it any that is over."""
    n = len(ra)
    (al, ah), (bl, bh) = a.boxes(), b.boxes()
    box_a, box_b = (al[ra], ah[ra]), (bl[rb], bh[rb])
    pva, va = _members(a.vo, ra)
    pvb, vb = _members(b.vo, rb)
    best = np.full(n, np.inf)
    # a first bound: the vertex of a nearest to b's box, and b's vertex nearest to that
    d = _gap2((a.v[va], a.v[va]), (box_b[0][pva], box_b[1][pva]))
    order = np.lexsort((d, pva))
    seed = va[order[np.flatnonzero(np.append(True, pva[order][1:] != pva[order][:-1]))]]
    x = b.v[vb] - a.v[seed][pvb]
    _least(best, pvb, np.einsum("ij,ij->i", x, x))

    def bound() -> np.ndarray:
        if limit2 is None:
            return best * (1 + 1e-9) + 1e-300
        return np.where(best <= limit2, -1.0, np.minimum(best, limit2) * (1 + 1e-9) + 1e-300)  # near enough is near enough

    def sweep(one: Solids, two: Solids, r1: np.ndarray, r2: np.ndarray, box1, box2) -> None:
        """Vertices of one against triangles of two."""
        p, i = _members(one.vo, r1)
        q, j = _members(two.to, r2)
        limit = bound()
        keep = _near(p, one.v[i], box2, limit)
        p, i = p[keep], i[keep]
        keep = _near(q, two.v[two.t[j]], box1, limit)
        q, j = q[keep], j[keep]
        corners = two.v[two.t[j]]
        low, high = _span(corners)
        for x, y in _combined(p, q, n):
            point = one.v[i[x]]
            near = _gap2((point, point), (low[y], high[y])) <= bound()[p[x]]
            x, y, point = x[near], y[near], point[near]
            d = point - _closest_on_triangles(point, corners[y])
            _least(best, p[x], np.einsum("ij,ij->i", d, d))

    sweep(a, b, ra, rb, box_a, box_b)
    sweep(b, a, rb, ra, box_b, box_a)
    p, i = _members(a.eo, ra)
    q, j = _members(b.eo, rb)
    limit = bound()
    ea, eb = a.v[a.e[i]], b.v[b.e[j]]
    keep = _near(p, ea, box_b, limit)
    p, ea = p[keep], ea[keep]
    keep = _near(q, eb, box_a, limit)
    q, eb = q[keep], eb[keep]
    span_a, span_b = _span(ea), _span(eb)
    for x, y in _combined(p, q, n):
        near = _gap2((span_a[0][x], span_a[1][x]), (span_b[0][y], span_b[1][y])) <= bound()[p[x]]
        x, y = x[near], y[near]
        one, two = _closest_segments(ea[x], eb[y])
        _least(best, p[x], np.einsum("ij,ij->i", one - two, one - two))
    return best


def _sides(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The signs of orient3d where floats are certain, else 0."""
    u, v, w = b - a, c - a, d - a
    p, q, r = u[:, 1] * v[:, 2], u[:, 2] * v[:, 1], u[:, 2] * v[:, 0]
    t, m, k = u[:, 0] * v[:, 2], u[:, 0] * v[:, 1], u[:, 1] * v[:, 0]
    det = w[:, 0] * (p - q) + w[:, 1] * (r - t) + w[:, 2] * (m - k)
    size = np.abs(w[:, 0]) * (np.abs(p) + np.abs(q)) + np.abs(w[:, 1]) * (np.abs(r) + np.abs(t)) + np.abs(w[:, 2]) * (np.abs(m) + np.abs(k))
    return np.where(np.abs(det) > _ERROR * size, np.sign(det), 0).astype(np.int8)


def _segments_meet_triangles(p: np.ndarray, q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """1 where segment pq surely meets the triangle, -1 where it surely doesn't, 0 where floats can't tell."""
    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    sp, sq = _sides(a, b, c, p), _sides(a, b, c, q)
    out = np.where(sp * sq > 0, -1, 0).astype(np.int8)
    at = np.flatnonzero(out == 0)
    s = np.stack([_sides(p[at], q[at], *(x[at] for x in pair)) for pair in ((a, b), (b, c), (c, a))])
    mixed = (s.max(axis=0) > 0) & (s.min(axis=0) < 0)
    through = (sp[at] * sq[at] < 0) & (s != 0).all(axis=0) & ~mixed
    out[at] = np.where(through, 1, np.where(mixed & (sp[at] != 0) & (sq[at] != 0), -1, 0))
    return out


def surfaces_meet(a: Solids, b: Solids, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """Exactly whether the surfaces of each pair of rows share a point."""
    n = len(ra)
    (al, ah), (bl, bh) = a.boxes(), b.boxes()
    none = np.zeros(n)
    p, i = _members(a.to, ra)
    q, j = _members(b.to, rb)
    ta, tb = a.v[a.t[i]], b.v[b.t[j]]
    keep = _near(p, ta, (bl[rb], bh[rb]), none)
    p, ta = p[keep], ta[keep]
    keep = _near(q, tb, (al[ra], ah[ra]), none)
    q, tb = q[keep], tb[keep]
    span_a, span_b = _span(ta), _span(tb)
    out, doubt = np.zeros(n, dtype=bool), []
    for x, y in _combined(p, q, n):
        meet = _gap2((span_a[0][x], span_a[1][x]), (span_b[0][y], span_b[1][y])) == 0
        meet &= ~out[p[x]]
        x, y = x[meet], y[meet]
        # a triangle wholly on one side of the other's plane does not meet it
        for one, two in ((ta, tb), (tb, ta)):
            m, k = (x, y) if one is ta else (y, x)
            s = np.stack([_sides(*(one[m][:, c] for c in range(3)), two[k][:, c]) for c in range(3)])
            both = ~((s > 0).all(axis=0) | (s < 0).all(axis=0))
            x, y = x[both], y[both]
        for one, two, m, k in ((ta, tb, x, y), (tb, ta, y, x)):
            for side in range(3):
                ends = one[m]
                found = _segments_meet_triangles(ends[:, side], ends[:, (side + 1) % 3], two[k])
                out[p[x[found > 0]]] = True
                unsure = np.flatnonzero(found == 0)
                doubt.append((p[x[unsure]], ends[unsure, side], ends[unsure, (side + 1) % 3], two[k[unsure]]))
    if doubt:
        _settled(out, *(np.concatenate(c) for c in zip(*doubt, strict=True)))
    return out


def _settled(out: np.ndarray, pair: np.ndarray, start: np.ndarray, end: np.ndarray, triangle: np.ndarray) -> None:
    """Sets ``out`` for pairs of which a segment exactly meets its triangle; a few of each pair at a time, until one does."""
    order = np.argsort(pair, kind="stable")
    turn = np.arange(len(pair)) - np.searchsorted(pair[order], pair[order])
    low, some = 0, 4
    while low <= (turn.max() if len(turn) else -1):
        at = order[(turn >= low) & (turn < low + some)]
        at = at[~out[pair[at]]]
        out[pair[at[signs.segment_meets_triangle(start[at], end[at], triangle[at])]]] = True
        low, some = low + some, 2 * some


def inside(t: np.ndarray, low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Whether each point, off the closed surface of the triangles t[low:high], lies inside it, exactly, as ``distance.inside_exactly``."""
    out = np.zeros(len(points), dtype=bool)
    chance = np.random.default_rng(1)
    left = np.flatnonzero(high > low)
    for _ in range(8):
        if not len(left):
            return out
        turn, again = chance.normal(size=3), []
        for some in np.array_split(left, min(len(left), 1 + int((high[left] - low[left]).sum()) * 8 // BLOCK)):
            size = high[some] - low[some]
            at, job = _ranges(low[some], size), np.repeat(np.arange(len(some)), size)
            start, corners = points[some], t[at]
            span = _span(corners)
            first = np.cumsum(size) - size
            box = np.minimum.reduceat(span[0], first), np.maximum.reduceat(span[1], first)
            reach = 4 * (np.maximum(box[1], start) - np.minimum(box[0], start)).max(axis=1) + 1
            end = start + turn / np.abs(turn).max() * reach[:, None]
            near = ((span[0] <= np.maximum(start, end)[job]) & (span[1] >= np.minimum(start, end)[job])).all(axis=1)
            job, (a, b, c) = job[near], (corners[near, k] for k in range(3))
            s, e = signs.orient3d(a, b, c, start[job]), signs.orient3d(a, b, c, end[job])
            over = np.flatnonzero(s * e <= 0)
            job, s, e, a, b, c = (x[over] for x in (job, s, e, a, b, c))
            sides = np.stack([signs.orient3d(start[job], end[job], x, y) for x, y in ((a, b), (b, c), (c, a))])
            hit = ~((sides.max(axis=0) > 0) & (sides.min(axis=0) < 0))
            touched = hit & ((s == 0) | (e == 0) | (sides == 0).any(axis=0))
            doubt = np.zeros(len(some), dtype=bool)
            doubt[job[touched]] = True
            out[some] = np.bincount(job[hit], minlength=len(some)) % 2 == 1
            again.append(some[doubt])
        left = np.concatenate(again)
    for k in left.tolist():
        out[k] = inside_exactly(t[low[k] : high[k]], points[k])
    return out


def parts_inside(a: Solids, ra: np.ndarray, solids: tuple[np.ndarray, np.ndarray, np.ndarray], b: Solids, rb: np.ndarray, parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether a part of b's rows lies inside a's, whose surfaces do not meet.

    ``solids`` gives where the rows' solids begin, and the first and last triangle of each; ``parts`` where the rows' parts begin, and a vertex of each.
    """
    low, high = a.boxes()
    other_low, other_high = b.boxes()
    out = np.zeros(len(ra), dtype=bool)
    pair = np.flatnonzero(((low[ra] <= other_high[rb]) & (other_low[rb] <= high[ra])).all(axis=1))
    owner, part = _members(parts[0], rb[pair])
    pair, point = pair[owner], parts[1][part]
    within = ((point >= low[ra[pair]]) & (point <= high[ra[pair]])).all(axis=1)
    pair, point = pair[within], point[within]
    owner, solid = _members(solids[0], ra[pair])
    found = inside(a.v[a.t], solids[1][solid], solids[2][solid], point[owner])
    out[pair[owner[found]]] = True
    return out
