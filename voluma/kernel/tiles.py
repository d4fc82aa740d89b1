"""Triangles of many faces at once.

Triangles and convex quadrilaterals are fans. Faces with one ring of more corners, or with one hole, are laid out by their
numbers of corners, and all of one layout are bridged and clipped together, step by step as ``triangulate`` does it for
one face and by the same arithmetic. A face that is rare in its batch, large or doubtful goes through ``face_triangles``.
"""

from __future__ import annotations

import numpy as np

from voluma.kernel.shape import EPS_AREA, POLYGON, Shape, offsets
from voluma.kernel.triangulate import TILED, UNTILEABLE, ZERO_AREA, along, cross, face_triangles, lengths, newells, plane_frame

_FEW, _MOST, _BLOCK = 4, 40, 1 << 20


def tile(v: np.ndarray, size: np.ndarray, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(triangles in each face, triangles as indices of v, outcome of each face) for faces of ``rings`` rings of ``size`` vertices, laid end to end."""
    n = len(rings)
    whole = Shape(POLYGON, v, face_ring=offsets(rings), ring_vertex=offsets(size), ring_idx=np.arange(len(v)))
    start, first = np.cumsum(size) - size, np.cumsum(rings) - rings
    with np.errstate(over="ignore", invalid="ignore"):
        normal = newells(whole)
        length = lengths(normal)
    outer, low = size[first], start[first]
    outcome = np.where(~np.isfinite(length), UNTILEABLE, np.where(length <= 2 * EPS_AREA, ZERO_AREA, -1))
    fan = (outcome < 0) & (rings == 1) & (outer == 3)
    four = np.flatnonzero((outcome < 0) & (rings == 1) & (outer == 4))
    if len(four):
        corner = [v[low[four] + k] for k in range(4)]
        ahead = [corner[(k + 1) % 4] - corner[k] for k in range(4)]
        with np.errstate(over="ignore", invalid="ignore"):
            turns = np.stack([along(normal[four], cross(ahead[k - 1], ahead[k])) for k in range(4)])
            fan[four] = (turns > 1e-14 * length[four] * length[four]).all(axis=0)
    outcome[fan] = TILED
    counts = np.where(fan, outer - 2, 0)
    found: list[tuple[np.ndarray, np.ndarray]] = []  # (face of each triangle, triangles), by face
    three = np.flatnonzero(fan)
    at = low[three][:, None] + np.array([0, 1, 2, 0, 2, 3])
    some = np.stack([np.ones(len(three), dtype=bool), outer[three] == 4], axis=1)
    found.append((np.repeat(three, outer[three] - 2), at.reshape(-1, 2, 3)[some]))
    second = np.where(rings == 2, size[np.minimum(first + 1, len(size) - 1)], 0) if n else rings
    more = np.flatnonzero((outcome < 0) & (rings <= 2) & ((rings == 2) & (second >= 3) | (outer > 4)) & (outer + second <= _MOST))
    if len(more):
        layout, of = np.unique(outer[more] * 1000 + second[more], return_inverse=True)
        for k, code in enumerate(layout.tolist()):
            o, h = divmod(code, 1000)
            group = more[of == k]
            for part in np.array_split(group, max(1, -(-len(group) * (o + h + 2) ** 2 // _BLOCK))) if len(group) >= _FEW else ():
                t, some, good = _clipped(v, low[part][:, None] + np.arange(o), low[part][:, None] + o + np.arange(h), normal[part], length[part])
                some &= good[:, None]
                counts[part] = some.sum(axis=1)
                outcome[part[good]] = TILED
                found.append((np.repeat(part, counts[part]), t[some]))
    for f in np.flatnonzero(outcome < 0).tolist():
        outcome[f], each = face_triangles(v, whole.face(f), normal[f])
        counts[f] = len(each)
        found.append((np.full(len(each), f), np.array(each, dtype=np.int64).reshape(-1, 3)))
    face, tri = (np.concatenate(x) for x in zip(*found, strict=True))
    return counts, tri[np.argsort(face, kind="stable")], outcome


def _turn(o, a, b) -> np.ndarray:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _area2(xy: np.ndarray) -> np.ndarray:
    """Twice the area of each row's loop; xy is 2 x rows x corners."""
    o = xy[:, :, :1]
    return _turn(o, xy[:, :, 1:-1], xy[:, :, 2:]).sum(axis=1)


def _pick(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.take_along_axis(a, at[:, None], axis=1)[:, 0]


def _first_least(some: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """The first place of each row with the least keys among ``some``."""
    for key in keys:
        held = np.where(some, key, np.inf)
        some = some & (held == held.min(axis=1)[:, None])
    return some.argmax(axis=1)


def _bridged(xy: np.ndarray, o: int, h: int, hole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the outer loop with the hole spliced in, whether a corner sees it), as ``triangulate._bridge``; loops are places of xy."""
    n = xy.shape[1]
    x, y = xy[0][:, :o], xy[1][:, :o]
    hx, hy = (np.take_along_axis(c, hole, axis=1) for c in xy)
    right = _first_least(np.ones((n, h), dtype=bool), -hx, hy)
    px, py = _pick(hx, right)[:, None], _pick(hy, right)[:, None]
    bx, by = np.roll(x, -1, axis=1), np.roll(y, -1, axis=1)
    beside = (((y <= py) & (py <= by)) | ((by <= py) & (py <= y))) & (y != by)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        met = x + (py - y) * (bx - x) / (by - y)
    beside &= met >= px - 1e-12 * (1 + np.abs(px))
    edge = _first_least(beside, met)
    at = np.where(_pick(x, edge) > _pick(bx, edge), edge, (edge + 1) % o)
    hit = _pick(met, edge)[:, None]
    cx, cy = _pick(x, at)[:, None], _pick(y, at)[:, None]
    p, q, c, t = (px, py), (x, y), (cx, cy), (hit, py)
    with np.errstate(invalid="ignore"):
        turns = np.stack([_turn(p, t, q), _turn(t, c, q), _turn(c, p, q)])
        hiding = ((turns.min(axis=0) >= 0) | (turns.max(axis=0) <= 0)) & (_turn((np.roll(x, 1, axis=1), np.roll(y, 1, axis=1)), q, (bx, by)) <= 0)
        hiding &= (np.arange(o) != at[:, None]) & ((x != cx) | (y != cy)) & (x >= px)
        slope = np.abs(y - py) / np.maximum(x - px, 1e-300)
    at = np.where(hiding.any(axis=1), _first_least(hiding, slope, x), at)[:, None]
    k = np.arange(o + h + 2)
    spliced = np.take_along_axis(hole, (right[:, None] + k - at - 1) % h, axis=1)
    return np.where(k <= at, k, np.where(k <= at + h + 1, spliced, k - h - 2)), beside.any(axis=1)


def _clipped(v: np.ndarray, outer: np.ndarray, hole: np.ndarray, normal: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(triangles, which places hold one, whether the row's are settled) of faces of one layout."""
    n, o, h = len(outer), outer.shape[1], hole.shape[1]
    index = np.concatenate([outer, hole], axis=1)
    u, w = plane_frame(normal)
    local = v[index] - v[outer[:, :1]]
    xy = np.stack([along(local, u[:, None]), along(local, w[:, None])])
    good = np.isfinite(xy).all(axis=(0, 2))
    want, flat = _area2(xy[:, :, :o]), (1e-14 * size)[:, None]
    loop = np.broadcast_to(np.arange(o), (n, o))
    if h:
        inner = _area2(xy[:, :, o:])
        good &= np.abs(inner) > 1e-9 * size
        want = want - np.abs(inner)
        loop, seen = _bridged(xy, o, h, np.where((inner < 0)[:, None], o + np.arange(h), o + np.arange(h)[::-1]))
        good &= seen
    tri, some, got = [], [], np.zeros(n)
    rows = np.arange(n)[:, None]
    while (m := loop.shape[1]) > 3:
        x, y = xy[0][rows, loop], xy[1][rows, loop]
        b = (x, y)
        a, c = ((np.roll(x, k, axis=1), np.roll(y, k, axis=1)) for k in (1, -1))
        turn = _turn(a, b, c)
        with np.errstate(invalid="ignore"):
            reflex = turn <= flat
        one, two, three = ((p[0][:, :, None], p[1][:, :, None]) for p in (a, b, c))
        q = (x[:, None], y[:, None])
        held = reflex[:, None] & (_turn(one, two, q) >= 0) & (_turn(two, three, q) >= 0) & (_turn(three, one, q) >= 0)
        for p in (one, two, three):
            held &= (q[0] != p[0]) | (q[1] != p[1])
        ear = ~reflex & ~held.any(axis=2)
        found, straight = ear.any(axis=1), np.abs(turn) <= flat
        good &= found | straight.any(axis=1)
        chosen = np.where(found, ear.argmax(axis=1), straight.argmax(axis=1))
        tri.append(np.stack([_pick(loop, (chosen + k) % m) for k in (-1, 0, 1)], axis=1))
        some.append(found)
        got += np.where(found, _pick(turn, chosen), 0.0)
        loop = loop[np.arange(m) != chosen[:, None]].reshape(n, m - 1)
    last = _turn(*((xy[0][np.arange(n), loop[:, k]], xy[1][np.arange(n), loop[:, k]]) for k in range(3)))
    tri.append(loop)
    some.append(last > flat[:, 0])
    got += np.where(some[-1], last, 0.0)
    good &= (np.abs(got - want) <= 0.5e-9 * size) & np.any(some, axis=0)
    return index[np.arange(n)[:, None, None], np.stack(tri, axis=1)], np.stack(some, axis=1), good
