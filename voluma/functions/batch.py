"""Measures of whole Arrow batches at once, for the values whose triangles are cached."""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from voluma.functions import codec
from voluma.functions.codec import Lists
from voluma.functions.schema import G3D
from voluma.kernel import bulk, pairs, sidecar, signs, wkb
from voluma.kernel.flat import ranges, starts_of
from voluma.kernel.shape import AREAL, EPS_ABSOLUTE, EPS_RELATIVE, MULTIPOLYGON, POINT, POLYGON, SOLID, SURFACE, GeometryError
from voluma.kernel.triangulate import along, cross, lengths

_REFUSALS = (("is_closed", False, "is not closed"), ("is_manifold", False, "is not manifold"), ("is_oriented", False, "has inconsistent orientation"), ("degenerate_faces", True, "contains degenerate faces"), ("self_intersections", True, "has self-intersecting faces"))


def _corners(array: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vertices, triangles as indices of them, row of each triangle)."""
    xs, tri = Lists(array.field("xs")), Lists(array.field("tri"))
    v = np.stack([xs.flat, np.asarray(array.field("ys").values), np.asarray(array.field("zs").values)], axis=1)
    row = np.repeat(np.arange(len(array)), np.diff(tri.offsets) // 3)
    flat = tri.flat[tri.offsets[0] : tri.offsets[-1]].reshape(-1, 3)
    return v, flat + xs.offsets[row][:, None], row


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of stretches, each by itself, so that far stretches don't lose digits to others."""
    out = np.zeros(len(starts))
    full = starts < ends
    if full.any():
        edges = np.stack([starts[full], ends[full]], axis=1).ravel()
        out[full] = np.add.reduceat(np.append(values, 0.0), edges)[::2]
    return out


def _failing(array: pa.StructArray, name: str) -> np.ndarray:
    field = array.field("validation").field(name)
    return np.asarray(field.cast(pa.int64()).fill_null(0))


def refusals(array: pa.StructArray, name: str, only: tuple[str, ...] | None = None) -> tuple[np.ndarray, str | None]:
    """(rows that have no volume, why the first has none)."""
    present = np.asarray(array.is_valid())
    bad, why = np.zeros(len(array), dtype=bool), [None] * len(array)
    for field, flag, what in _REFUSALS:
        found = present & ((_failing(array, field) != 0) == flag) & ~bad
        bad |= found
        for i in np.flatnonzero(found):
            why[i] = f"{name}: solid {what}"
    first = np.flatnonzero(bad)
    return bad, why[first[0]] if len(first) else None


def volumes(array: pa.StructArray, strict: bool = True) -> pa.Array:
    bad, why = refusals(array, "ST_3DVolume")
    if why and strict:
        raise GeometryError(why)
    v, t, _ = _corners(array)
    tri, face_tri, shell_face, solid_shell = (Lists(array.field(n)) for n in ("tri", "face_tri", "shell_face", "solid_shell"))
    counts = np.maximum(np.diff(shell_face.offsets) - 1, 0)
    row = np.repeat(np.arange(len(array)), counts)
    at = np.repeat(shell_face.offsets[:-1], counts) + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = lambda k: tri.offsets[row] // 3 - tri.offsets[0] // 3 + face_tri.flat[face_tri.offsets[row] + shell_face.flat[at + k]]
    starts, ends = start(0), start(1)
    origin = np.repeat(np.where(starts < ends, starts, 0), ends - starts)
    base = v[t[origin, 0]] if len(t) else np.zeros((0, 3))
    a, b, c = (v[t[:, k]] - base for k in range(3))
    shells = _sums(np.einsum("ij,ij->i", a, np.cross(b, c)), starts, ends) / 6
    shell_base = np.cumsum(counts) - counts
    solids = np.maximum(np.diff(solid_shell.offsets) - 1, 0)
    owner = np.repeat(np.arange(len(array)), solids)
    at = np.repeat(solid_shell.offsets[:-1], solids) + np.arange(len(owner)) - np.repeat(np.cumsum(solids) - solids, solids)
    each = np.abs(_sums(shells, shell_base[owner] + solid_shell.flat[at], shell_base[owner] + solid_shell.flat[at + 1]))
    total = np.zeros(len(array))
    np.add.at(total, owner, each)
    return pa.array(total, pa.float64(), mask=~np.asarray(array.is_valid()) | bad)


def areas(array: pa.StructArray, strict: bool = True) -> pa.Array:
    present = np.asarray(array.is_valid())
    bad = present & (np.asarray(array.field("kind").fill_null(-1)) == SOLID) & (_failing(array, "degenerate_faces") != 0)
    if bad.any() and strict:
        raise GeometryError("ST_3DSurfaceArea: solid contains degenerate faces")
    v, t, row = _corners(array)
    a = v[t[:, 0]] if len(t) else np.zeros((0, 3))
    size = np.linalg.norm(np.cross(v[t[:, 1]] - a, v[t[:, 2]] - a), axis=1) / 2 if len(t) else np.zeros(0)
    ends = np.searchsorted(row, np.arange(len(array)), side="right")
    starts = np.searchsorted(row, np.arange(len(array)), side="left")
    return pa.array(_sums(size, starts, ends), pa.float64(), mask=~present | bad)


def _blocks(array: pa.StructArray, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each stretch that a list column of offsets gives."""
    lists = Lists(array.field(name))
    counts = np.maximum(np.diff(lists.offsets) - 1, 0)
    row = np.repeat(np.arange(len(array)), counts)
    at = np.repeat(lists.offsets[:-1], counts) + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, lists.flat[at].astype(np.int64), lists.flat[at + 1].astype(np.int64)


def footprints(array: pa.StructArray, strict: bool = True) -> pa.Array:
    present, kind = np.asarray(array.is_valid()), np.asarray(array.field("kind").fill_null(-1))
    xs, ys, index = (Lists(array.field(n)) for n in ("xs", "ys", "ring_idx"))
    row, start, end = _blocks(array, "ring_vertex")
    sizes = end - start
    first = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(index.offsets[row] + start - first, sizes)
    corner = index.flat[at] + np.repeat(xs.offsets[row], sizes)
    x, y = xs.flat[corner], ys.flat[corner]
    ring = np.repeat(np.arange(len(row)), sizes)
    x, y = x - x[first[ring]], y - y[first[ring]]  # about the ring's first corner
    after = np.arange(len(x)) + 1
    after[(first + sizes - 1)[sizes > 0]] = first[sizes > 0]
    turns = _sums(x * y[after] - x[after] * y, first, first + sizes)
    face_row, low, high = _blocks(array, "face_ring")
    base = np.searchsorted(row, face_row)  # the first ring of the face's row
    solid = np.isin(kind[face_row], (SOLID, SURFACE))
    outer = np.zeros(len(face_row))
    some = high > low
    outer[some] = np.abs(turns[(base + low)[some]])
    whole, each = _sums(turns, base + low, base + high), _sums(np.abs(turns), base + low, base + high)
    area = np.where(solid, np.abs(whole) / 2, 2 * outer - each) / 2
    total = np.zeros(len(array))
    np.add.at(total, face_row, np.where(solid | np.isin(kind[face_row], (POLYGON, MULTIPOLYGON)), area, 0.0))
    return pa.array(total, pa.float64(), mask=~present)


class _Rings:
    """The rings of the areal rows of a column, end to end: p are their corners, ring r has p[start[r]:start[r] + size[r]]."""

    def __init__(self, array: pa.StructArray, kinds: tuple[int, ...]) -> None:
        self.some = np.asarray(array.is_valid()) & np.isin(np.asarray(array.field("kind").fill_null(-1)), kinds)
        at, low, high = _blocks(array, "ring_vertex")
        if not self.some.all():
            chosen = self.some[at]
            at, low, high = at[chosen], low[chosen], high[chosen]
        xs, index = Lists(array.field("xs")), Lists(array.field("ring_idx"))
        self.row, self.size = at, high - low
        self.start = np.cumsum(self.size) - self.size
        self.ring = np.repeat(np.arange(len(at)), self.size)
        corner = index.flat[ranges(index.offsets[at] + low, self.size)] + xs.offsets[at][self.ring]
        self.p = np.stack([xs.flat[corner], np.asarray(array.field("ys").values)[corner], np.asarray(array.field("zs").values)[corner]], axis=1)
        self.following = np.arange(len(self.p)) + 1
        full = self.size > 0
        self.following[(self.start + self.size - 1)[full]] = self.start[full]


def perimeters(array: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """The length of every ring of polygons; other kinds are left to the row function."""
    rings = _Rings(array, (POLYGON, MULTIPOLYGON))
    each = _sums(lengths(rings.p[rings.following] - rings.p), rings.start, rings.start + rings.size)
    return pa.array(np.bincount(rings.row, weights=each, minlength=len(array))[rings.some], pa.float64()), rings.some


def planar(array: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """Whether all rings of areal values lie in planes; rows with a ring too thin to tell, or on the verge, are left to the row function."""
    rings = _Rings(array, AREAL)
    p, start, ring = rings.p, rings.start, rings.ring
    some, flat = rings.some.copy(), np.ones(len(array), dtype=bool)
    if len(p):
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            local = p - p[start[ring]]
            normal, middle = (np.stack([_sums(x[:, k], start, start + rings.size) for k in range(3)], axis=1) for x in (cross(local, local[rings.following]), local))
            size = lengths(normal)
            unit, centre = normal / size[:, None], middle / rings.size[:, None]
            off, reach = np.abs(along(local - centre[ring], unit[ring])), np.abs(p).max(axis=1)
            full = np.flatnonzero(rings.size > 3)
            edges = np.stack([start[full], start[full] + rings.size[full]], axis=1).ravel()
            most, far = (np.maximum.reduceat(np.append(x, 0.0), edges)[::2] for x in (off, reach))
            limit = EPS_RELATIVE * np.maximum(1.0, far)
            doubt = ~(size[full] > 4 * EPS_ABSOLUTE) | ~(np.abs(most - limit) > 1e-3 * limit + 1e-14 * far)
        some[rings.row[full[doubt]]] = False
        flat[rings.row[full[most > limit]]] = False
    return pa.array(flat[some]), some


def envelopes(array: pa.StructArray, strict: bool = True) -> pa.Array:
    """Of boxes, or of the boxes of values."""
    box = array.field("bbox") if array.type.get_field_index("bbox") >= 0 else array
    present = (np.asarray(array.is_valid()) & np.asarray(box.is_valid())).tolist()
    out = []
    for ok, x, y, a, b in zip(present, *(box.field(n).to_pylist() for n in ("min_x", "min_y", "max_x", "max_y")), strict=True):
        if not ok:
            out.append(None)
        elif x == a and y == b:
            out.append(struct.pack("<BI2d", 1, 1, x, y))
        elif x == a or y == b:
            out.append(struct.pack("<BII4d", 1, 2, 2, x, y, a, b))
        else:
            out.append(struct.pack("<BIII10d", 1, 3, 1, 5, x, y, a, y, a, b, x, b, x, y))
    return pa.array(out, pa.binary())


def _buffers(array: pa.Array) -> tuple:
    """What tells whether two columns are the same memory, as long as one of them is held."""
    return (len(array), array.offset, *(None if b is None else (b.address, b.size) for b in array.buffers()))


def _held(keep: int):
    """The last results of a function of columns: the functions of one batch ask for the same columns in turn, and a text under several of them is read once."""

    def wrap(make: Callable) -> Callable:
        last: list[tuple] = []

        @wraps(make)  # so that workers import it by name, and share what it holds, instead of a copy in each function
        def found(*columns: pa.Array):
            key = tuple(map(_buffers, columns))
            for k, (known, _, result) in enumerate(last):
                if known == key:
                    last.append(last.pop(k))
                    return result
            result = make(*columns)
            last.append((key, columns, result))
            del last[:-keep]
            return result

        return found

    return wrap


#: The forms of text that a batch reads, as Arrow matches them: it has no possessive repeats and needs none.
_FORMS = {kind: rf"^{head}{form}\z".replace("++", "+").replace("*+", "*").replace("?+", "?") for kind, (head, form) in bulk.FORMS.items()}


@_held(1)
def texts(words: pa.Array) -> tuple[pa.StructArray, np.ndarray]:
    """(values, which rows have one) of the texts that ``bulk.flat_texts`` reads."""
    kind = np.full(len(words), -1)
    for k, form in _FORMS.items():
        kind[np.asarray(pc.match_substring_regex(words, form).fill_null(False))] = k
    some = kind >= 0
    chosen = pc.filter(words, pa.array(some)).cast(pa.large_string())
    _, at, data = chosen.buffers()
    at = np.frombuffer(at, dtype=np.int64, count=len(chosen) + 1, offset=8 * chosen.offset) if len(chosen) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data or b"", dtype=np.uint8)[at[0] : at[-1]]
    found, good = bulk.flat_texts(data, at - at[0], kind[some])
    some[some] = good
    return codec.encode_flat(found), some


def solids(data: pa.Array, properties: pa.Array) -> tuple[pa.StructArray, np.ndarray]:
    """(values, which rows have one) of WKB that ``bulk.flat_wkb`` reads, with its cavities."""
    known: dict = {}

    def shells(given) -> tuple[int, ...] | None:
        try:
            found = None if given is None else sidecar.from_json(given) if isinstance(given, str) else sidecar.from_struct(given)
        except GeometryError:
            return None
        return () if found is None else tuple(found[0]) if len(found) == 1 and found[0] else None

    each: list = [None] * len(data)
    for i, (ok, given) in enumerate(zip(data.is_valid().to_pylist(), properties.to_pylist(), strict=True)):
        if ok and isinstance(given, (str, type(None))):
            if given not in known:
                known[given] = shells(given)
            each[i] = known[given]
        elif ok:
            each[i] = shells(given)
    whole = data.cast(pa.large_binary())
    at = np.frombuffer(whole.buffers()[1], dtype=np.int64, count=len(whole) + 1, offset=8 * whole.offset)
    found, rows = bulk.flat_wkb(np.frombuffer(whole.buffers()[2] or b"", dtype=np.uint8), at, each)
    some = np.zeros(len(data), dtype=bool)
    some[rows] = True
    if found is None:
        return pa.nulls(0, codec.arrow_type(G3D)), some
    out = codec.encode_flat(found)
    return (out if (np.diff(rows) > 0).all() else out.take(pa.array(np.argsort(rows)))), some


def binaries(array: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """(WKB, which rows have it) of polygons, surfaces and single solids; the others are left to the row function."""
    kind = np.asarray(array.field("kind").fill_null(-1))
    faces = np.maximum(np.diff(Lists(array.field("face_ring")).offsets) - 1, 0)
    solid = np.diff(Lists(array.field("solid_shell")).offsets) == 2
    some = np.asarray(array.is_valid()) & (faces > 0) & (np.isin(kind, (SURFACE, MULTIPOLYGON)) | ((kind == POLYGON) & (faces == 1)) | ((kind == SOLID) & solid))
    rings = _Rings(array, (*AREAL, SOLID))
    some[rings.row[rings.size == 0]] = False
    row, low, high = _blocks(array, "face_ring")
    held = some[rings.row]
    code = np.where(kind == SOLID, 1000 + SURFACE, 1000 + kind)
    data, at = wkb.write_many(code[some], faces[some], (high - low)[some[row]], rings.size[held], rings.p[np.repeat(held, rings.size)])
    if at[-1] > 2**31 - 1:
        return pa.nulls(0, pa.binary()), np.zeros(len(array), dtype=bool)
    return pa.Array.from_buffers(pa.binary(), int(some.sum()), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]), some


class _Side:
    """One column of a batch of pairs."""

    def __init__(self, array: pa.StructArray) -> None:
        v, t, _ = _corners(array)
        self.tri = Lists(array.field("tri"))
        to = self.tri.offsets // 3 - self.tri.offsets[0] // 3
        self.solids = pairs.Solids.of(v, Lists(array.field("xs")).offsets, t, to)
        self.shells, self.faces, self.triangles = (Lists(array.field(n)) for n in ("solid_shell", "shell_face", "face_tri"))
        kind, valid = np.asarray(array.field("kind").fill_null(-1)), array.field("validation").field("is_valid").cast(pa.int64()).fill_null(0)
        self.sound = np.asarray(array.is_valid()) & (kind == SOLID) & (np.asarray(valid) != 0) & (np.diff(to) > 0)
        self.crs = array.field("crs").fill_null("")

    def _first_triangle(self, row: np.ndarray, shell: np.ndarray) -> np.ndarray:
        """Where the triangles of the rows' shells begin; of the one behind a row's last shell, where the row's end."""
        face = self.faces.flat[self.faces.offsets[row] + shell]
        return self.solids.to[row] + self.triangles.flat[self.triangles.offsets[row] + face]

    def solid_triangles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each sound row's solids begin, and the first and last triangle of every solid."""
        counts = np.where(self.sound, np.diff(self.shells.offsets) - 1, 0)
        row = np.repeat(np.arange(len(counts)), counts)
        at = ranges(self.shells.offsets[:-1], counts)
        return starts_of(counts), self._first_triangle(row, self.shells.flat[at]), self._first_triangle(row, self.shells.flat[at + 1])

    def part_points(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each sound row's shells begin, and a vertex of every shell."""
        counts = np.where(self.sound, np.diff(self.faces.offsets) - 1, 0)
        row = np.repeat(np.arange(len(counts)), counts)
        first = self._first_triangle(row, ranges(np.zeros(len(counts), dtype=np.int64), counts))
        return starts_of(counts), self.solids.v[self.solids.t[first, 0]]


@_held(4)
def _side(array: pa.StructArray) -> _Side:
    return _Side(array)


@_held(1)
def _pairs(a: pa.StructArray, b: pa.StructArray) -> Pairs:
    return Pairs(a, b)


class Pairs:
    """What batches of pairs of valid solids in one reference system give; other rows are left to the row functions."""

    def __init__(self, a: pa.StructArray, b: pa.StructArray) -> None:
        self.a, self.b = _side(a), _side(b)
        self._met: np.ndarray | None = None
        self.n = len(a)
        same = np.array([x == y for x, y in zip(self.a.crs.to_pylist(), self.b.crs.to_pylist(), strict=True)], dtype=bool)
        self.rows = np.flatnonzero(self.a.sound & self.b.sound & same)
        (al, ah), (bl, bh) = self.a.solids.boxes(), self.b.solids.boxes()
        r = self.rows
        gap = np.maximum(0, np.maximum(al[r] - bh[r], bl[r] - ah[r]))
        self.gap = np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def meet(self, some: np.ndarray) -> np.ndarray:
        """Exactly which of the rows ``some`` share a point."""
        out = pairs.surfaces_meet(self.a.solids, self.b.solids, some, some)
        for one, two in ((self.a, self.b), (self.b, self.a)):
            apart = np.flatnonzero(~out)
            out[apart] = pairs.parts_inside(one.solids, some[apart], one.solid_triangles(), two.solids, some[apart], two.part_points())
        return out

    def intersects(self) -> np.ndarray:
        if self._met is None:
            self._met = np.zeros(len(self.rows), dtype=bool)
            touching = np.flatnonzero(self.gap == 0)
            self._met[touching] = self.meet(self.rows[touching])
        return self._met

    def distances(self, limits: np.ndarray | None = None) -> np.ndarray:
        """Of each row the distance; with limits only which side of its limit it lies on."""
        out = np.where(self.intersects(), 0.0, np.inf)
        far = out > 0
        if limits is not None:
            far &= (limits >= 0) & (self.gap <= limits * (1 + 1e-12))
        at = np.flatnonzero(far)
        if len(at):
            out[at] = np.sqrt(pairs.apart2(self.a.solids, self.b.solids, self.rows[at], self.rows[at], None if limits is None else limits[at] ** 2))
        return out

    def as_list(self, values: np.ndarray) -> list:
        out: list = [None] * self.n
        for r, x in zip(self.rows.tolist(), values.tolist(), strict=True):
            out[r] = x
        return out


def _points_in(a: pa.StructArray, b: pa.StructArray, out: list) -> list:
    """Fills in exactly which points lie in which areal values of the same row; faces without triangles are left to the row function."""
    for areal, point in ((a, b), (b, a)):
        kind, other = (np.asarray(x.field("kind").fill_null(-1)) for x in (areal, point))
        some = np.asarray(areal.is_valid()) & np.asarray(point.is_valid()) & np.isin(kind, AREAL) & (other == POINT) & (np.diff(Lists(point.field("xs")).offsets) == 1)
        if not some.any():
            continue
        some &= np.array([x == y for x, y in zip(areal.field("crs").fill_null("").to_pylist(), point.field("crs").fill_null("").to_pylist(), strict=True)], dtype=bool)
        row, low, high = _blocks(areal, "face_tri")
        some[row[low == high]] = False
        v, t, row = _corners(areal)
        at = Lists(point.field("xs")).offsets[:-1]
        at = np.where(np.diff(Lists(point.field("xs")).offsets) > 0, at, 0)
        p = np.stack([np.asarray(point.field(c).values)[at] if some.any() else np.zeros(len(at)) for c in ("xs", "ys", "zs")], axis=1)
        corners = v[t]
        near = np.flatnonzero(some[row] & ((corners.min(axis=1) <= p[row]) & (p[row] <= corners.max(axis=1))).all(axis=1))
        inside = np.zeros(len(areal), dtype=bool)
        inside[row[near[signs.in_triangle(p[row[near]], corners[near])]]] = True
        for r in np.flatnonzero(some).tolist():
            out[r] = bool(inside[r])
    return out


def pair_distances(a: pa.Array, b: pa.Array) -> list:
    both = _pairs(a, b)
    return both.as_list(both.distances())


def pair_intersects(a: pa.Array, b: pa.Array) -> list:
    both = _pairs(a, b)
    return _points_in(a, b, both.as_list(both.intersects()))


def pair_disjoint(a: pa.Array, b: pa.Array) -> list:
    return [None if x is None else not x for x in pair_intersects(a, b)]


def pair_within(a: pa.Array, b: pa.Array, limit: pa.Array) -> list:
    both = Pairs(a, b)
    given = np.asarray(limit.cast(pa.float64()).fill_null(np.nan))
    known = ~np.isnan(given[both.rows])
    both.rows, both.gap = both.rows[known], both.gap[known]
    limits = given[both.rows]
    return both.as_list((both.distances(limits) <= limits) & (limits >= 0))
