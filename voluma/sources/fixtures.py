"""Small values as WKB, for tests and examples: tetrahedra, cubes with cavities, points, lines, polygons."""

from __future__ import annotations

import numpy as np

from voluma.kernel import shape as s
from voluma.kernel import wkb
from voluma.kernel.shape import Shape, with_faces

Corner = tuple[float, float, float]


def surface_wkb(*members: list[list[Corner]]) -> bytes:
    """Faces (exterior rings) as one surface, or several members as a collection."""
    shapes = [with_faces(s.SURFACE, None, [[np.array(f, dtype=np.float64)] for f in faces]) for faces in members]
    parts = [wkb.write(x) for x in shapes]
    return parts[0] if len(parts) == 1 else b"\x01" + (1007).to_bytes(4, "little") + len(parts).to_bytes(4, "little") + b"".join(parts)


def box_faces(low: Corner, high: Corner, inward: bool = False) -> list[list[Corner]]:
    """Bottom, top, front (low y), back, left (low x), right."""
    (x, y, z), (a, b, c) = low, high
    faces = [
        [(x, y, z), (x, b, z), (a, b, z), (a, y, z)],
        [(x, y, c), (a, y, c), (a, b, c), (x, b, c)],
        [(x, y, z), (a, y, z), (a, y, c), (x, y, c)],
        [(x, b, z), (x, b, c), (a, b, c), (a, b, z)],
        [(x, y, z), (x, y, c), (x, b, c), (x, b, z)],
        [(a, y, z), (a, b, z), (a, b, c), (a, y, c)],
    ]
    return [f[::-1] for f in faces] if inward else faces


def tetra_faces() -> list[list[Corner]]:
    o, x, y, z = (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)
    return [[o, y, x], [o, z, y], [o, x, z], [x, y, z]]


def tetra() -> bytes:
    return surface_wkb(tetra_faces())


def open_tetra() -> bytes:
    return surface_wkb(tetra_faces()[1:])


def hollow_cube() -> bytes:
    return surface_wkb(box_faces((0, 0, 0), (4, 4, 4)) + box_faces((1, 1, 1), (3, 3, 3), inward=True))


def multi_cube(apart: float = 5.0) -> bytes:
    return surface_wkb(box_faces((0, 0, 0), (2, 2, 2)), box_faces((apart, apart, apart), (apart + 2, apart + 2, apart + 2)))


def two_cubes(offset: float) -> bytes:
    return surface_wkb(box_faces((0, 0, 0), (2, 2, 2)) + box_faces((offset, offset, offset), (offset + 2, offset + 2, offset + 2)))


def _lines(*lines: list[Corner]) -> bytes:
    v = np.concatenate([np.array(x, dtype=np.float64) for x in lines])
    return wkb.write(Shape(s.LINE, v) if len(lines) == 1 else Shape(s.MULTILINE, v, parts=s.offsets(map(len, lines))))


def point_z(x: float, y: float, z: float) -> bytes:
    return wkb.write(Shape(s.POINT, np.array([[x, y, z]], dtype=np.float64)))


def line_z() -> bytes:
    return _lines([(0, 0, 0), (3, 4, 12)])


def multi_line_z() -> bytes:
    return _lines([(0, 0, 0), (3, 4, 12)], [(10, 10, 10), (13, 14, 10)])


def polygon_z() -> bytes:
    return wkb.write(with_faces(s.POLYGON, None, [[np.array([(0, 0, 5), (4, 0, 5), (4, 3, 5), (0, 3, 5)], dtype=np.float64)]]))


def warped_polygon_z() -> bytes:
    return wkb.write(with_faces(s.POLYGON, None, [[np.array([(0, 0, 0), (2, 0, 0), (2, 2, 5), (0, 2, 0)], dtype=np.float64)]]))


def multi_point_z() -> bytes:
    return wkb.write(Shape(s.MULTIPOINT, np.array([(1, 1, 1), (2, 2, 2), (3, 3, 9)], dtype=np.float64), parts=s.offsets([1] * 3)))


def multi_polygon_z() -> bytes:
    square = lambda o: [np.array([(o, o, 0), (o + 1, o, 0), (o + 1, o + 1, 0), (o, o + 1, 0)], dtype=np.float64)]
    return wkb.write(with_faces(s.MULTIPOLYGON, None, [square(0), square(5)]))
