"""Import of many solids at once, for the shapes that make up most of any table.

All rings of a batch are laid end to end and handled by a few numpy passes: ring cleaning, vertex numbering,
triangles and convex quadrilaterals, edge counts, connectivity and one-sidedness of faces. A row leaves this
path, and is built by itself, as soon as anything about it is unusual: several solids, cavities that come near another shell, holes, faces of
more than four corners or that are not convex, edges that are not used exactly twice in opposite directions,
an Euler number other than two, a face that does not have the whole solid on one side, or degenerate faces. So both paths give the
same values, and the slow one decides every doubtful case.
"""

from __future__ import annotations

import re
from dataclasses import replace

import numpy as np

from voluma.kernel import flat
from voluma.kernel import shape as s
from voluma.kernel.shape import EPS_RELATIVE, Shape, offsets
from voluma.kernel.tiles import tile
from voluma.kernel.triangulate import UNTILEABLE, cross
from voluma.kernel.validate import COUNTS

#: How far cavities keep from other faces, in tolerances of the whole solid; ``validate`` sees no crossing beyond seven.
_CLEAR = 16
#: Numbers that are laid out at a time.
_BLOCK = 1 << 20
_SOUND = dict.fromkeys(COUNTS, 0) | {"is_valid": True, "is_closed": True, "is_manifold": True, "is_oriented": True}


def plain_rings(data: bytes) -> list[np.ndarray] | None:
    """The rings of a little-endian ISO surface whose faces have one ring each, without the repeated ends; None for anything else."""
    if len(data) < 9 or data[:5] != b"\x01\xf7\x03\x00\x00":
        return None
    n, at, out = int.from_bytes(data[5:9], "little"), 9, []
    if n > 64 or n < 4:
        return None
    for _ in range(n):
        if data[at : at + 9] != b"\x01\xeb\x03\x00\x00\x01\x00\x00\x00":
            return None
        k = int.from_bytes(data[at + 9 : at + 13], "little")
        at += 13
        if k not in (4, 5) or at + 24 * k > len(data):
            return None
        points = np.frombuffer(data, dtype="<f8", count=3 * k, offset=at)
        if data[at : at + 24] != data[at + 24 * (k - 1) : at + 24 * k]:
            return None
        out.append(points[: 3 * (k - 1)])
        at += 24 * k
    return out


def sound_solids(rows: list[list[np.ndarray] | None]) -> list[Shape | None]:
    """A valid solid for each row of rings that passes every plain test; None for the others."""
    out: list[Shape | None] = [None] * len(rows)
    which = [i for i, r in enumerate(rows) if r is not None]
    if not which:
        return out
    rings = [ring for i in which for ring in rows[i]]
    size = np.fromiter((len(r) // 3 for r in rings), dtype=np.int64, count=len(rings))
    faces = np.fromiter((len(rows[i]) for i in which), dtype=np.int64, count=len(which))
    found, good = flat_solids(np.concatenate(rings).reshape(-1, 3), size, faces, np.ones(len(which), dtype=np.int64))
    for k, solid in zip(np.flatnonzero(good).tolist(), found.shapes(), strict=True):
        out[which[k]] = solid
    return out


def flat_solids(p: np.ndarray, size: np.ndarray, faces: np.ndarray, shells: np.ndarray) -> tuple[flat.Flat, np.ndarray]:
    """(valid solids, which rows have one) of rows of ``shells`` shells of ``faces`` faces, each a ring of ``size`` corners; all laid end to end.

    Every shell is convex; the first is turned outwards, the others are cavities, turned inwards and well inside it and apart from each other.
    """
    p = p + 0.0
    n, n_rings = len(faces), len(size)
    row_of_shell, exterior = np.repeat(np.arange(len(shells)), shells), np.repeat(flat.starts_of(shells)[:-1], shells)
    inward = np.arange(n) != exterior
    row_of_face = np.repeat(np.arange(n), faces)
    start = np.cumsum(size) - size
    face_of = np.repeat(np.arange(n_rings), size)
    row_of = row_of_face[face_of]
    following = np.arange(len(p)) + 1
    following[start + size - 1] = start
    good = np.isfinite(p).all(axis=1)
    bad = np.zeros(n, dtype=bool)
    bad[row_of[~good | (p == p[following]).all(axis=1)]] = True
    # vertices, numbered by first use within their shell
    order = np.lexsort((p[:, 2], p[:, 1], p[:, 0], row_of))
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[order][1:] != p[order][:-1]).any(axis=1) | (row_of[order][1:] != row_of[order][:-1])
    group = np.empty(len(p), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    first = np.full(group.max() + 1, len(p), dtype=np.int64)
    np.minimum.at(first, group, np.arange(len(p)))
    by_first = np.argsort(first, kind="stable")
    number = np.empty_like(by_first)
    number[by_first] = np.arange(len(by_first))
    vertex = number[group]
    places = np.sort(first)
    vertices = np.bincount(row_of[places], minlength=n)
    base = np.cumsum(vertices) - vertices
    # edges: each once in either direction
    a, b = vertex, vertex[following]
    key = a * len(places) + b
    back = b * len(places) + a
    owner = np.argsort(key, kind="stable")
    sorted_key = key[owner]
    at = np.searchsorted(sorted_key, back)
    paired = (at < len(key)) & (sorted_key[np.minimum(at, len(key) - 1)] == back)
    doubled = np.zeros(len(key), dtype=bool)
    repeated = sorted_key[1:][sorted_key[1:] == sorted_key[:-1]]
    if len(repeated):
        doubled = np.isin(key, repeated)
    bad[row_of[~paired | doubled]] = True
    edges = np.bincount(row_of, minlength=n) // 2
    bad |= vertices - edges + faces != 2
    # one part: the least face number spreads over edges
    other = face_of[owner[np.minimum(at, len(key) - 1)]]
    label = np.arange(n_rings)
    for _ in range(64):
        spread = label.copy()
        np.minimum.at(spread, face_of, label[other])
        spread = np.minimum(spread, spread[spread])
        if (spread == label).all():
            break
        label = spread
    bad[row_of_face[label != (np.cumsum(faces) - faces)[row_of_face]]] = True
    # planes, convexity, degeneracy
    local = p - p[start][face_of]
    terms = cross(local, local[following])
    normal = np.add.reduceat(terms, start, axis=0)
    length = np.linalg.norm(normal, axis=1)
    low, high = np.minimum.reduceat(p, start), np.maximum.reduceat(p, start)
    extent = (high - low).max(axis=1)
    thin = ~(length / 2 > EPS_RELATIVE * extent * extent) | (length <= 2 * s.EPS_AREA)
    unit = normal / np.where(length > 0, length, 1)[:, None]
    ahead = p[following] - p
    turn = np.einsum("ij,ij->i", cross(ahead, ahead[following]), unit[face_of])
    bad[row_of[turn <= 1e-12 * length[face_of]]] = True
    bad[row_of_face[thin]] = True
    # every face has the whole shell on its inner side, and no two lie in one plane
    face_start = np.cumsum(faces) - faces
    centre = np.add.reduceat(p, start, axis=0) / size[:, None]
    row_low, row_high = np.minimum.reduceat(low, face_start), np.maximum.reduceat(high, face_start)
    floor = 1e-5 * np.linalg.norm(row_high - row_low, axis=1)
    around = floor[exterior]  # of the whole solid, whose cavities lie in its exterior
    everywhere = p[places]
    corner = vertex[start[:, None] + np.minimum(np.arange(int(size.max())), size[:, None] - 1)] - base[row_of_face][:, None]
    by_shape: dict[tuple[int, int, bool], list[int]] = {}
    for i in np.flatnonzero(~bad).tolist():
        by_shape.setdefault((int(faces[i]), int(vertices[i]), bool(inward[i])), []).append(i)
    for f, v, inner, m in ((*k, part) for k, x in by_shape.items() for part in np.array_split(np.array(x), 1 + len(x) * k[0] * max(k[1], 4 * k[0]) // _BLOCK)):
        its = face_start[m][:, None] + np.arange(f)
        u, c = unit[its], centre[its]
        w = everywhere[base[m][:, None] + np.arange(v)]
        side = np.einsum("mfk,mvk->mfv", u, w) - np.einsum("mfk,mfk->mf", u, c)[:, :, None]
        apart = np.abs(np.einsum("mfk,mgk->mfg", u, u)) >= 1 - 1e-6
        same_way = np.einsum("mfk,mgk->mfg", u, u) > 0
        beside = np.abs(np.einsum("mfk,mgk->mfg", u, c) - np.einsum("mfk,mfk->mf", u, c)[:, :, None]) <= 4 * around[m][:, None, None]
        apart &= same_way | beside
        if inner:  # thin beside the whole solid: its faces might pass for one plane
            reach = np.abs(np.take_along_axis(side[:, :, None], corner[its][:, None], axis=3)).max(axis=3)
            apart |= reach <= _CLEAR * around[m][:, None, None]
        apart[:, np.arange(f), np.arange(f)] = False
        bad[m] |= ((-side if inner else side).max(axis=2) > 0.5 * floor[m][:, None]).any(axis=1) | apart.any(axis=(1, 2))
    # cavities: all their vertices behind every face of the exterior, and their boxes apart
    cavity = np.flatnonzero(inward & ~bad & ~bad[exterior])
    for f, v in {(int(faces[exterior[i]]), int(vertices[i])) for i in cavity.tolist()}:
        alike = cavity[(faces[exterior[cavity]] == f) & (vertices[cavity] == v)]
        for m in np.array_split(alike, 1 + len(alike) * f * v // _BLOCK):
            its = face_start[exterior[m]][:, None] + np.arange(f)
            u, c = unit[its], centre[its]
            side = np.einsum("mfk,mvk->mfv", u, everywhere[base[m][:, None] + np.arange(v)]) - np.einsum("mfk,mfk->mf", u, c)[:, :, None]
            bad[m] |= (side > -_CLEAR * around[m][:, None, None]).any(axis=(1, 2))
    for k in range(1, int(shells.max()) - 1):  # the k-th next shell of the same row
        one = np.flatnonzero(inward[:-k] & (row_of_shell[:-k] == row_of_shell[k:]))
        two = one + k
        clear = _CLEAR * around[one][:, None]
        bad[one] |= ~((row_low[one] > row_high[two] + clear) | (row_low[two] > row_high[one] + clear)).any(axis=1)
    sound = np.ones(len(shells), dtype=bool)
    sound[row_of_shell[bad]] = False
    held = sound[row_of_shell]
    of_face, of_vertex = held[row_of_face], held[row_of[places]]
    index = (vertex - base[exterior][row_of])[held[row_of]]
    shells, faces, size, vertices = shells[sound], faces[held], size[of_face], vertices[held]
    per_row = lambda values: np.add.reduceat(values, flat.starts_of(shells)[:-1]) if len(shells) else values
    row_faces, row_vertices = per_row(faces), per_row(vertices)
    start = np.cumsum(size) - size
    fan = np.array([0, 1, 2, 0, 2, 3])
    tri = index[np.minimum(start[:, None] + fan, max(0, len(index) - 1))].reshape(-1, 2, 3)[np.stack([size > 2, size == 4], axis=1)] if len(size) else np.zeros((0, 3), dtype=np.int64)
    none = np.zeros(0, dtype=np.int64), np.zeros(len(shells) + 1, dtype=np.int64)
    corners = np.bincount(np.repeat(np.arange(len(shells)), row_faces), weights=size, minlength=len(shells)).astype(np.int64)
    lists = {
        "solid_shell": flat.cuts(shells, np.ones(len(shells), dtype=np.int64)),
        "shell_face": flat.cuts(faces, shells),
        "face_ring": flat.cuts(np.ones(len(size), dtype=np.int64), row_faces),
        "ring_vertex": flat.cuts(size, row_faces),
        "ring_idx": (index, flat.starts_of(corners)),
        "parts": none,
        "face_tri": flat.cuts(size - 2, row_faces),
        "tri": (tri.ravel(), flat.starts_of(3 * (corners - 2 * row_faces))),
    }
    return flat.Flat(np.full(len(shells), s.SOLID), everywhere[of_vertex], flat.starts_of(row_vertices), lists, _SOUND), sound


def laid_out(data: bytes) -> tuple[list[int], np.ndarray] | None:
    """(corners of each face, where its coordinates begin) of a little-endian ISO surface whose faces have one ring of three or four corners; None for anything else."""
    if len(data) < 9 or data[:5] != b"\x01\xf7\x03\x00\x00":
        return None
    n, at, sizes, begins = int.from_bytes(data[5:9], "little"), 9, [], []
    if n > 64 or n < 4:
        return None
    for _ in range(n):
        if data[at : at + 9] != b"\x01\xeb\x03\x00\x00\x01\x00\x00\x00":
            return None
        k = int.from_bytes(data[at + 9 : at + 13], "little")
        if k not in (4, 5) or at + 13 + 24 * k > len(data):
            return None
        sizes.append(k - 1)
        begins.append(at + 13)
        at += 13 + 24 * k
    return sizes, np.array(begins)


def flat_wkb(data: np.ndarray, at: np.ndarray, shells: list[tuple[int, ...] | None]) -> tuple[flat.Flat | None, np.ndarray]:
    """(solids, their rows) of WKB that lies end to end from ``at`` on; ``shells`` has each row's face counts (empty: one shell; None: leave the row)."""
    size_of = np.diff(at)
    left = np.array([x is not None for x in shells], dtype=bool)
    points, sizes, faces, counts, rows = [], [], [], [], []
    for width in np.unique(size_of[left]).tolist():
        group = np.flatnonzero(left & (size_of == width))
        tries = 0
        while len(group):
            tries += 1
            if tries > 8:  # too many layouts of one length to take them together
                for i in group.tolist():
                    rings = plain_rings(data[at[i] : at[i + 1]].tobytes())
                    split = shells[i] or (len(rings or ()),)
                    if rings is not None and sum(split) == len(rings) and min(split) > 3:
                        points.append(np.concatenate(rings).reshape(-1, 3))
                        sizes.append(np.array([len(r) // 3 for r in rings]))
                        faces += split
                        counts.append(len(split))
                        rows.append(np.array([i]))
                break
            found = laid_out(data[at[group[0]] : at[group[0] + 1]].tobytes())
            if found is None:
                group = group[1:]
                continue
            corners, begins = found
            parts = np.array_split(group, 1 + len(group) * width // _BLOCK)
            each = np.concatenate([data[at[part][:, None] + np.arange(width)] for part in parts])
            k = np.array(corners)
            coordinates = flat.ranges(begins, 24 * k)
            fixed = np.ones(width, dtype=bool)
            fixed[coordinates] = False
            ends = flat.ranges(begins + 24 * k, np.full(len(k), 24))
            fixed[ends] = False
            alike = (each[:, fixed] == each[0, fixed]).all(axis=1)
            alike_rows = np.flatnonzero(alike)
            closed = (each[alike][:, ends] == each[alike][:, flat.ranges(begins, np.full(len(k), 24))]).all(axis=1)
            split = [shells[i] or (len(k),) for i in group[alike_rows].tolist()]
            fits = closed & np.array([sum(x) == len(k) and min(x) > 3 for x in split], dtype=bool)
            if fits.any():
                points.append(np.ascontiguousarray(each[alike_rows[fits]][:, coordinates]).view("<f8").reshape(-1, 3))
                sizes.append(np.tile(k, int(fits.sum())))
                split = [x for x, ok in zip(split, fits.tolist(), strict=True) if ok]
                faces += [f for x in split for f in x]
                counts += map(len, split)
                rows.append(group[alike_rows[fits]])
            group = group[~alike]
    if not rows:
        return None, np.zeros(0, dtype=np.int64)
    solids, good = flat_solids(np.concatenate(points), np.concatenate(sizes), np.array(faces), np.array(counts))
    return solids, np.concatenate(rows)[good]


_N = r"[-+]?(?:\d++(?:\.\d*+)?+|\.\d++)(?:[eE][-+]?\d++)?+"
_RUN = rf"\({_N} {_N} {_N}(?:, {_N} {_N} {_N})*+\)"
_FACE = rf"\({_RUN}(?:, {_RUN})*+\)"
#: The kinds of text that a batch reads: what stands before the first bracket, and the form of the rest.
FORMS = {
    s.POINT: ("POINT Z ", rf"\({_N} {_N} {_N}\)"),
    s.LINE: ("LINESTRING Z ", _RUN),
    s.POLYGON: ("POLYGON Z ", _FACE),
    s.SURFACE: ("POLYHEDRALSURFACE Z ", rf"\({_FACE}(?:, {_FACE})*+\)"),
}
_PLAIN = {head[:8]: (kind, re.compile(head + form, re.ASCII)) for kind, (head, form) in FORMS.items()}


def plain_texts(words: list[str | None]) -> list[Shape | None]:
    """Values of WKT as this library writes it, whose rings have no equal neighbours and whose faces can be tiled; None for the others."""
    out: list[Shape | None] = [None] * len(words)
    which, kinds = [], []
    for i, w in enumerate(words):
        kind, form = _PLAIN.get(w[:8], (None, None)) if w is not None else (None, None)
        if form is not None and form.fullmatch(w):
            which.append(i)
            kinds.append(kind)
    data = np.frombuffer("".join(words[i] for i in which).encode("ascii"), dtype=np.uint8)
    found, good = flat_texts(data, flat.starts_of(np.array([len(words[i]) for i in which], dtype=np.int64)), np.array(kinds, dtype=np.int64))
    for k, x in zip(np.flatnonzero(good).tolist(), found.shapes(), strict=True):
        out[which[k]] = x
    return out


def flat_texts(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[flat.Flat, np.ndarray]:
    """(values, which rows have one) of texts of ``FORMS``, laid end to end as bytes from ``at`` on."""
    n = len(kind)
    opened, closing = data == 40, data == 41
    begins = np.flatnonzero(opened[:-1] & ~opened[1:])  # a ring's own bracket is the innermost
    ends = np.flatnonzero(closing[1:] & ~closing[:-1]) + 1
    commas = np.cumsum(data == 44)
    size = (commas[ends] - commas[begins] + 1).astype(np.int64)
    row = np.searchsorted(at, begins, side="right") - 1
    areal = np.isin(kind, s.AREAL)
    opens = (data[begins - 1] == 40) & areal[row]  # a face's first ring opens with one bracket more
    words = data.copy()
    words[opened | closing | (data == 44)] = 32
    head = np.zeros(max(FORMS) + 1, dtype=np.int64)
    for k, (text, _) in FORMS.items():
        head[k] = len(text)
    words[flat.ranges(at[:-1], head[kind])] = 32
    p = np.fromstring(words.tobytes().decode("ascii"), sep=" ").reshape(-1, 3) if n else np.zeros((0, 3))
    start = np.cumsum(size) - size
    ring = np.repeat(np.arange(len(size)), size)
    same = np.zeros(len(p), dtype=bool)  # as the next one of its ring
    same[:-1] = (p[1:] == p[:-1]).all(axis=1) & (ring[1:] == ring[:-1])
    odd = np.zeros(n, dtype=bool)
    odd[row[ring[~np.isfinite(p).all(axis=1) | (same & areal[row[ring]])]]] = True
    closed = (p[start] == p[start + size - 1]).all(axis=1) & areal[row]
    odd[row[areal[row] & (size - closed < 3)]] = True
    keep = ~odd[row[ring]]
    keep[(start + size - 1)[closed]] = False
    held = ~odd[row]
    v, size, row, opens = p[keep], (size - closed)[held], row[held], opens[held]
    inside = areal[row]
    face_row = row[opens]
    rings = np.diff(np.append(np.flatnonzero(opens[inside]), int(inside.sum())))
    corners = np.repeat(inside, size)
    counts, tri, outcome = tile(v[corners], size[inside], rings)
    tri = np.flatnonzero(corners)[tri]
    if (outcome == UNTILEABLE).any():
        odd[face_row[outcome == UNTILEABLE]] = True
        point_row = np.repeat(row, size)
        stays = ~odd[point_row]
        place = np.cumsum(stays) - 1
        tri = place[tri[~odd[np.repeat(face_row, counts)]]]
        left, kept = ~odd[face_row], ~odd[row]
        v, counts, rings, face_row = v[stays], counts[left], rings[left], face_row[left]
        size, row, inside = size[kept], row[kept], inside[kept]
    good = ~odd
    vertices = np.bincount(row, weights=size, minlength=n).astype(np.int64)[good]
    return flat.with_faces(kind[good], v, size[inside], rings, np.bincount(face_row, minlength=n)[good], vertices, counts, tri), good


def _plain_faces(x: Shape) -> list[np.ndarray] | None:
    """The rings of a value whose faces have one ring of three or four corners each; None for others."""
    sizes, cut = np.diff(x.ring_vertex), x.ring_vertex
    if not 4 <= x.n_faces <= 64 or not np.array_equal(x.face_ring, np.arange(x.n_faces + 1)) or len(sizes) != x.n_faces or sizes.min() < 3 or sizes.max() > 4:
        return None
    if cut[0] != 0 or cut[-1] != len(x.ring_idx) or x.ring_idx.min() < 0 or x.ring_idx.max() >= len(x.v):
        return None
    return [r.ravel() for r in np.split(x.v[x.ring_idx], cut[1:-1])]


def of_surfaces(values: list[Shape | None]) -> list[Shape | None]:
    """The solids of plain sound surfaces; None for the others."""
    out = sound_solids([None if x is None or x.kind != s.SURFACE else _plain_faces(x) for x in values])
    return [None if solid is None else replace(solid, crs=x.crs) for solid, x in zip(out, values, strict=True)]


def rebuilt(values: list[Shape | None]) -> list[Shape | None]:
    """Values made anew as their faces say, of plain sound solids whose vertices are numbered by first use; None for the others."""
    plain = [x is not None and x.kind == s.SOLID and x.n_solids == 1 and x.n_shells == 1 for x in values]
    out = sound_solids([_plain_faces(x) if ok else None for x, ok in zip(values, plain, strict=True)])
    for i, (solid, x) in enumerate(zip(out, values, strict=True)):
        if solid is not None:
            same = all(np.array_equal(getattr(solid, n), getattr(x, n)) for n in ("v", "solid_shell", "shell_face", "face_ring", "ring_vertex", "ring_idx"))
            out[i] = replace(solid, v=x.v, crs=x.crs, parts=x.parts) if same else None
    return out
