"""A 3D value in memory: vertices, rings, faces, shells and solids as offset arrays.

One class holds both families. A solid (kind 0) shares vertices between faces through ``ring_idx``; any
other value lists each ring's vertices in order, and ``ring_idx`` counts up. Rings never repeat their first
vertex at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import pairwise

import numpy as np

SOLID, POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, SURFACE = 0, 1, 2, 3, 4, 5, 6, 15
NAMES = {POINT: "Point", LINE: "LineString", POLYGON: "Polygon", MULTIPOINT: "MultiPoint", MULTILINE: "MultiLineString", MULTIPOLYGON: "MultiPolygon", SURFACE: "PolyhedralSurface"}
AREAL = (POLYGON, MULTIPOLYGON, SURFACE)

#: Absolute and relative tolerances, and the least area.
EPS_ABSOLUTE, EPS_RELATIVE, EPS_AREA = 1e-12, 1e-9, 1e-18


class GeometryError(ValueError):
    """What is wrong with one value; the row fails, or is null under a try function."""


def offsets(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(list(sizes), dtype=np.int64))]).astype(np.int32)


EMPTY = np.zeros(0, dtype=np.int32)


@dataclass
class Shape:
    kind: int
    v: np.ndarray  # n x 3
    crs: str | None = None
    solid_shell: np.ndarray = field(default_factory=lambda: EMPTY)
    shell_face: np.ndarray = field(default_factory=lambda: EMPTY)
    face_ring: np.ndarray = field(default_factory=lambda: EMPTY)
    ring_vertex: np.ndarray = field(default_factory=lambda: EMPTY)
    ring_idx: np.ndarray = field(default_factory=lambda: EMPTY)
    parts: np.ndarray = field(default_factory=lambda: EMPTY)
    face_tri: np.ndarray = field(default_factory=lambda: EMPTY)
    tri: np.ndarray = field(default_factory=lambda: EMPTY)  # flat, three indices a triangle
    validation: dict | None = None

    @property
    def n_faces(self) -> int:
        return max(0, len(self.face_ring) - 1)

    @property
    def n_shells(self) -> int:
        return max(0, len(self.shell_face) - 1)

    @property
    def n_solids(self) -> int:
        return max(0, len(self.solid_shell) - 1)

    def face(self, f: int) -> list[np.ndarray]:
        """The rings of a face as vertex indices."""
        return [self.ring_idx[self.ring_vertex[r] : self.ring_vertex[r + 1]] for r in range(self.face_ring[f], self.face_ring[f + 1])]

    def faces(self) -> list[list[np.ndarray]]:
        return [self.face(f) for f in range(self.n_faces)]

    def triangles(self, f: int | None = None) -> np.ndarray:
        """k x 3 vertex indices, of one face or of all."""
        flat = self.tri if f is None else self.tri[3 * self.face_tri[f] : 3 * self.face_tri[f + 1]]
        return flat.reshape(-1, 3)

    def shell_faces(self, s: int) -> range:
        return range(self.shell_face[s], self.shell_face[s + 1])

    def shells_of(self, solid: int) -> range:
        return range(self.solid_shell[solid], self.solid_shell[solid + 1])

    def bbox(self) -> tuple[float, ...] | None:
        if not len(self.v) or np.isnan(self.v).all():
            return None
        return (*self.v.min(axis=0).tolist(), *self.v.max(axis=0).tolist())

    def lines(self) -> list[np.ndarray]:
        """Vertex coordinates of each line of a line or multi-line."""
        if self.kind == LINE:
            return [self.v]
        return [self.v[a:b] for a, b in pairwise(self.parts.tolist())]


def with_faces(kind: int, crs: str | None, faces: list[list[np.ndarray]]) -> Shape:
    """A polygon, multi-polygon or surface from faces as lists of rings of coordinates; not triangulated yet."""
    rings = [r for f in faces for r in f]
    v = np.concatenate(rings) if rings else np.zeros((0, 3))
    return Shape(kind, v, crs, face_ring=offsets(map(len, faces)), ring_vertex=offsets(map(len, rings)), ring_idx=np.arange(len(v), dtype=np.int32))


def retagged(shape: Shape, **changes) -> Shape:
    return replace(shape, **changes)


def clean_ring(ring: np.ndarray) -> np.ndarray:
    """A ring of coordinates without the repeated end and without equal neighbours."""
    if not len(ring):
        return ring
    keep = np.ones(len(ring), dtype=bool)
    keep[1:] = (ring[1:] != ring[:-1]).any(axis=1)
    ring = ring[keep]
    while len(ring) > 1 and (ring[0] == ring[-1]).all():
        ring = ring[:-1]
    return ring


def build_solid(members: list[list[list[np.ndarray]]], shells: list[list[int]] | None, crs: str | None) -> Shape:
    """A solid from members (faces as rings of coordinates) and face counts by solid and shell; not triangulated yet."""
    if shells is None:
        groups = [[len(m)] for m in members]
    else:
        groups = _grouped(members, shells)
    rings: list[np.ndarray] = []
    ring_counts = []
    for member in members:
        for face in member:
            ring_counts.append(len(face))
            rings += [clean_ring(r) for r in face]
    points = (np.concatenate(rings) if rings else np.zeros((0, 3))) + 0.0  # -0 and +0 are one
    if len(points):
        order = np.lexsort(points.T[::-1])
        new = np.ones(len(points), dtype=bool)
        new[1:] = (points[order][1:] != points[order][:-1]).any(axis=1)
        group = np.empty(len(points), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        first = np.full(int(new.sum()), len(points))
        np.minimum.at(first, group, np.arange(len(points)))
        by_first = np.argsort(first)
        number = np.empty_like(by_first)
        number[by_first] = np.arange(len(by_first))
        vertices, index = points[np.sort(first)], number[group].astype(np.int32)
    else:
        vertices, index = points, EMPTY
    return Shape(
        SOLID, vertices, crs, offsets(len(g) for g in groups), offsets(n for g in groups for n in g), offsets(ring_counts), offsets(map(len, rings)), index
    )


def _grouped(members: list, shells: list[list[int]]) -> list[list[int]]:
    if len(shells) != len(members):
        raise GeometryError(f"geometry_properties: shells solid count ({len(shells)}) does not match WKB member count ({len(members)})")
    out = []
    for i, (counts, member) in enumerate(zip(shells, members, strict=True)):
        if sum(counts) != len(member):
            raise GeometryError(f"geometry_properties: shell face count mismatch for solid {i}: shells sum ({sum(counts)}) != WKB face count ({len(member)})")
        kept = [c for c in counts if c]
        if not kept:
            raise GeometryError(f"geometry_properties: solid {i} has no non-empty shell")
        out.append(kept)
    return out


def sub_shape(shape: Shape, faces: list[int], kind: int = SURFACE) -> Shape:
    """The faces as a value of their own, with their triangles."""
    rings = [shape.face(f) for f in faces]
    out = with_faces(kind, shape.crs, [[shape.v[r] for r in f] for f in rings])
    out.face_tri = offsets(shape.face_tri[f + 1] - shape.face_tri[f] for f in faces)
    tri, start = [], 0
    for f, rs in zip(faces, rings, strict=True):
        flat = np.concatenate(rs)
        place: dict[int, int] = {}
        for k, x in enumerate(flat.tolist()):
            place.setdefault(x, start + k)
        tri += [place[x] for x in shape.triangles(f).ravel().tolist()]
        start += len(flat)
    out.tri = np.array(tri, dtype=np.int32)
    return out
