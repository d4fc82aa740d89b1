"""Volumes, areas, lengths and centroids, each about a local origin."""

from __future__ import annotations

import numpy as np

from voluma.kernel import shape as s
from voluma.kernel.shape import GeometryError, Shape
from voluma.kernel.triangulate import cross, newell


def _corners(shape: Shape, triangles: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(shape.v[triangles[:, k]] - origin for k in range(3))


def _shell_triangles(shape: Shape, shell: int) -> np.ndarray:
    a, b = shape.shell_face[shell], shape.shell_face[shell + 1]
    return shape.tri[3 * shape.face_tri[a] : 3 * shape.face_tri[b]].reshape(-1, 3)


def shell_volume(shape: Shape, shell: int) -> float:
    """The signed volume of a shell."""
    t = _shell_triangles(shape, shell)
    if not len(t):
        return 0.0
    a, b, c = _corners(shape, t, shape.v[t[0, 0]])
    return float(np.einsum("ij,ij->i", a, cross(b, c)).sum() / 6)


def require_volume(shape: Shape, name: str) -> None:
    v = shape.validation
    for bad, what in (
        (not v["is_closed"], "is not closed"),
        (not v["is_manifold"], "is not manifold"),
        (not v["is_oriented"], "has inconsistent orientation"),
        (v["degenerate_faces"], "contains degenerate faces"),
        (v["self_intersections"], "has self-intersecting faces"),
        (not len(shape.tri), "has no triangulation cache"),
    ):
        if bad:
            raise GeometryError(f"{name}: solid {what}")


def volume(shape: Shape) -> float:
    require_volume(shape, "ST_3DVolume")
    return float(sum(abs(sum(shell_volume(shape, sh) for sh in shape.shells_of(k))) for k in range(shape.n_solids)))


def triangle_areas(shape: Shape) -> np.ndarray:
    t = shape.triangles()
    a, b, c = (shape.v[t[:, k]] for k in range(3))
    return np.linalg.norm(cross(b - a, c - a), axis=1) / 2


def area(shape: Shape) -> float:
    if shape.kind == s.SOLID and shape.validation["degenerate_faces"]:
        raise GeometryError("ST_3DSurfaceArea: solid contains degenerate faces")
    return float(triangle_areas(shape).sum()) if len(shape.tri) else 0.0


def _flat_area(ring: np.ndarray) -> float:
    return abs(float(newell(ring)[2])) / 2


def footprint_area(shape: Shape) -> float:
    """Half of all faces' upright projections for solids and surfaces; exterior less holes for polygons."""
    if shape.kind in (s.SOLID, s.SURFACE):
        return sum(abs(float(sum(newell(shape.v[r])[2] for r in face))) / 2 for face in shape.faces()) / 2
    if shape.kind in (s.POLYGON, s.MULTIPOLYGON):
        return float(sum(_flat_area(shape.v[f[0]]) - sum(_flat_area(shape.v[r]) for r in f[1:]) for f in shape.faces() if f))
    return 0.0


def _ring_length(ring: np.ndarray) -> float:
    return float(np.linalg.norm(np.roll(ring, -1, axis=0) - ring, axis=1).sum()) if len(ring) > 1 else 0.0


def perimeter(shape: Shape) -> float:
    """Edges that one face uses, for solids and surfaces; every ring for polygons."""
    if shape.kind in (s.POLYGON, s.MULTIPOLYGON):
        return sum(_ring_length(shape.v[r]) for f in shape.faces() for r in f)
    if shape.kind not in (s.SOLID, s.SURFACE):
        return 0.0
    shells = [shape.shell_faces(k) for k in range(shape.n_shells)] if shape.kind == s.SOLID else [range(shape.n_faces)]
    total = 0.0
    for faces in shells:
        uses: dict[frozenset, int] = {}
        for f in faces:
            for r in shape.face(f):
                points = [tuple(p) for p in (shape.v[r] + 0.0).tolist()]
                for a, b in zip(points, points[1:] + points[:1], strict=True):
                    key = frozenset((a, b))
                    uses[key] = uses.get(key, 0) + 1
        total += sum(float(np.linalg.norm(np.subtract(*map(np.array, e)))) for e, n in uses.items() if n == 1 and len(e) == 2)
    return total


def length(shape: Shape) -> float:
    if shape.kind not in (s.LINE, s.MULTILINE):
        return 0.0
    return float(sum(np.linalg.norm(np.diff(x, axis=0), axis=1).sum() for x in shape.lines()))


def centroid(shape: Shape) -> np.ndarray | None:
    """The centre of volume, of exterior area, of length or of vertices; None for an empty value."""
    if shape.kind == s.SOLID:
        require_volume(shape, "ST_3DCentroid")
        origin, total, moment = shape.v.mean(axis=0), 0.0, np.zeros(3)
        for k in range(shape.n_solids):
            parts = []
            for sh in shape.shells_of(k):
                t = _shell_triangles(shape, sh)
                base = shape.v[t[0, 0]]
                a, b, c = _corners(shape, t, base)
                w = np.einsum("ij,ij->i", a, cross(b, c)) / 6
                parts.append((w.sum(), ((a + b + c) / 4 * w[:, None]).sum(axis=0) + w.sum() * (base - origin)))
            turn = np.sign(sum(p[0] for p in parts))
            total += turn * sum(p[0] for p in parts)
            moment += turn * sum(p[1] for p in parts)
        if not total > 0:
            raise GeometryError("ST_3DCentroid: solid encloses no volume")
        return origin + moment / total
    if not len(shape.v):
        return None
    if shape.kind in (s.POINT, s.MULTIPOINT):
        return shape.v.mean(axis=0)
    origin = shape.v[0]
    if shape.kind in (s.LINE, s.MULTILINE):
        ends = [(x[:-1], x[1:]) for x in shape.lines() if len(x) > 1]
        if ends:
            a, b = (np.concatenate(x) - origin for x in zip(*ends, strict=True))
            w = np.linalg.norm(b - a, axis=1)
            if w.sum() > 0:
                return origin + ((a + b) / 2 * w[:, None]).sum(axis=0) / w.sum()
        return shape.v.mean(axis=0)
    total, moment = 0.0, np.zeros(3)
    for face in shape.faces():
        ring = shape.v[face[0]] - origin
        n = newell(ring)
        size = np.linalg.norm(n)
        if not size:
            continue
        p = ring - ring[0]
        w = cross(p[1:-1], p[2:]) @ (n / size) / 2
        total += w.sum()
        moment += (((p[1:-1] + p[2:]) / 3 + ring[0]) * w[:, None]).sum(axis=0)
    return origin + moment / total if total > 0 else shape.v.mean(axis=0)


def is_planar(shape: Shape) -> bool:
    groups = [shape.v[r] for f in shape.faces() for r in f] if shape.kind in s.AREAL else [shape.v]
    for points in groups:
        if len(points) <= 3:
            continue
        centre = points.mean(axis=0)
        n = newell(points) if shape.kind in s.AREAL else np.linalg.svd(points - centre)[2][2]
        size = np.linalg.norm(n)
        if size <= s.EPS_ABSOLUTE:
            n = np.linalg.svd(points - centre)[2][2]
            size = 1.0
        if np.abs((points - centre) @ (n / size)).max() > s.EPS_RELATIVE * max(1.0, np.abs(points).max()):
            return False
    return True


def face_areas(shape: Shape) -> list[float | None]:
    each = triangle_areas(shape) if len(shape.tri) else np.zeros(0)
    cuts = shape.face_tri.tolist()
    return [float(each[a:b].sum()) if b > a else None for a, b in zip(cuts, cuts[1:], strict=False)]


def face_normals(shape: Shape) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for f in range(shape.n_faces):
        if shape.face_tri[f] == shape.face_tri[f + 1]:
            out.append(None)
            continue
        n = newell(shape.v[shape.face(f)[0]])
        size = float(np.linalg.norm(n))
        out.append(n / size + 0.0 if size else None)
    return out
