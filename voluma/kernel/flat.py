"""Many values at once as flat arrays: what the columns of a batch hold, without an object for each row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from voluma.kernel.shape import EMPTY, Shape

LISTS = ("solid_shell", "shell_face", "face_ring", "ring_vertex", "ring_idx", "parts", "face_tri", "tri")


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def starts_of(sizes: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate([[0], np.cumsum(sizes)])


def cuts(sizes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ``groups`` groups of ``sizes`` each: every row's offsets from 0, laid end to end, and where each row's begin; none for a row without groups."""
    total, first = starts_of(sizes), starts_of(groups)[:-1]
    width = np.where(groups > 0, groups + 1, 0)
    at = ranges(first, width)
    return total[at] - np.repeat(total[first], width), starts_of(width)


@dataclass
class Flat:
    """Row r has the vertices v[vo[r]:vo[r+1]]; ``lists`` has for each list column its values end to end and where the rows' begin."""

    kind: np.ndarray
    v: np.ndarray
    vo: np.ndarray
    lists: dict[str, tuple[np.ndarray, np.ndarray]]
    validation: dict | None = None  # of every row
    crs: list[str | None] | None = None

    @property
    def n(self) -> int:
        return len(self.kind)

    def shapes(self) -> list[Shape]:
        out = []
        for r in range(self.n):
            lists = {name: np.asarray(x[at[r] : at[r + 1]], dtype=np.int32) if at[r + 1] > at[r] else EMPTY for name, (x, at) in self.lists.items()}
            out.append(Shape(int(self.kind[r]), self.v[self.vo[r] : self.vo[r + 1]], self.crs[r] if self.crs else None, **lists, validation=None if self.validation is None else dict(self.validation)))
        return out


def with_faces(kind: np.ndarray, v: np.ndarray, size: np.ndarray, rings: np.ndarray, faces: np.ndarray, vertices: np.ndarray, counts: np.ndarray, tri: np.ndarray) -> Flat:
    """Geometries: vertices in each ring, rings in each face, faces and vertices in each row, triangles of each face as indices of v; only areal rows have rings."""
    n = len(kind)
    vo, none = starts_of(vertices), (np.zeros(0, dtype=np.int64), np.zeros(n + 1, dtype=np.int64))
    face_row = np.repeat(np.arange(n), faces)
    row_rings, row_tri = (np.bincount(face_row, weights=x, minlength=n).astype(np.int64) for x in (rings, counts))
    corners = np.where(faces > 0, vertices, 0)
    lists = dict.fromkeys(LISTS, none)
    lists["face_ring"], lists["ring_vertex"] = cuts(rings, faces), cuts(size, row_rings)
    lists["ring_idx"] = ranges(np.zeros(n, dtype=np.int64), corners), starts_of(corners)
    face_tri, at = cuts(counts, faces)
    # every geometry has the offset 0 of its triangles, also one without faces
    width = np.where(faces > 0, faces + 1, 1)
    every = np.zeros(int(width.sum()), dtype=np.int64)
    every[np.repeat(faces > 0, width)] = face_tri
    lists["face_tri"] = every, starts_of(width)
    lists["tri"] = (tri - np.repeat(vo[:-1], row_tri)[:, None]).ravel(), starts_of(3 * row_tri)
    assert at[-1] == len(face_tri)
    return Flat(kind, v, vo, lists)
