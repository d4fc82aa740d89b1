"""The ST_3D functions over columns.

Header facts are native expressions; what needs the coordinates is one Arrow function over a batch. A
Python function is evaluated whatever surrounds it, so guards must be passed into it as null: with
``st_3dvolume(when(valid, g))`` the invalid rows are null, with ``when(valid, st_3dvolume(g))`` they raise. Every
raising function has a ``try_`` twin that gives null for a bad row instead.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from voluma.functions import batch, codec
from voluma.functions.schema import BBOX, FACE, G3D
from voluma.kernel import build, bulk, crs, distance, hull, measure, text, wkb
from voluma.kernel import shape as s
from voluma.kernel.shape import GeometryError, Shape
from voluma.kernel.triangulate import triangulate

POINT3 = "struct<x:double,y:double,z:double>"
SIDECAR = "struct<type:string,shells:array<array<bigint>>>"


@dataclass(frozen=True)
class Heavy:
    """A row function in Python, or a batch function."""

    name: str
    arguments: tuple[str, ...]
    returns: str
    row: Callable | None
    optional: frozenset[int] = frozenset()  # arguments that may be null
    whole: Callable | None = None
    doc: str = ""
    many: Callable | None = None  # results of the rows that a batch function can settle, None for the rest
    pairs: Callable | None = None  # the same from the Arrow columns of two values
    flat: Callable | None = None  # from the Arrow columns: results of the rows that it can settle, and which these are
    short: dict[int, tuple[int, ...]] | None = None  # where so many arguments go, if not to the first places


HEAVY: dict[str, Heavy] = {}


def heavy(name: str, arguments: str, returns: str, optional: tuple[int, ...] = (), whole: Callable | None = None, many: Callable | None = None, pairs: Callable | None = None, flat: Callable | None = None, short: dict[int, tuple[int, ...]] | None = None):
    def add(row: Callable) -> Callable:
        HEAVY[name] = Heavy(name, tuple(arguments.split()), returns, row, frozenset(optional), whole, (row.__doc__ or "").strip(), many, pairs, flat, short)
        return row

    return add


def _run(function: Heavy, strict: bool, columns: tuple[pa.Array, ...]) -> pa.Array:
    if function.whole is not None and pa.types.is_struct(columns[0].type):
        return function.whole(columns[0], strict)
    if function.pairs is not None and len(columns[0]) and all(codec.is_value(c) for c in columns[:2]):
        out = function.pairs(*columns)
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            left = _run(replace(function, pairs=None), strict, tuple(c.take(pa.array(rest)) for c in columns)).to_pylist()
            for i, x in zip(rest, left, strict=True):
                out[i] = x
        return pa.array(out, codec.arrow_type(function.returns))
    if function.flat is not None and len(columns[0]):
        found, some = function.flat(*columns)
        if some.all():
            return found
        rest = np.flatnonzero(~some)
        left = _run(replace(function, flat=None), strict, tuple(c.take(pa.array(rest)) for c in columns))
        place = np.empty(len(some), dtype=np.int64)
        place[np.concatenate([np.flatnonzero(some), rest])] = np.arange(len(some))
        return pa.concat_arrays([found, left]).take(pa.array(place))
    values = [codec.decode(c) if codec.is_value(c) else c.to_pylist() for c in columns]
    settled = function.many(*values) if function.many is not None else None
    out = []
    for i, row in enumerate(zip(*values, strict=True)):
        if settled is not None and settled[i] is not None:
            out.append(settled[i])
            continue
        if any(x is None for k, x in enumerate(row) if k not in function.optional):
            out.append(None)
            continue
        try:
            out.append(function.row(*row))
        except GeometryError:
            if strict:
                raise
            out.append(None)
    if function.returns == G3D:
        return codec.encode(out)
    if function.returns == f"array<{FACE}>":
        return _faces_array(out)
    return pa.array(out, codec.arrow_type(function.returns))


def _faces_array(rows: list[list[tuple] | None]) -> pa.Array:
    flat = [x for r in rows if r for x in r]
    kind = codec.arrow_type(f"array<{FACE}>")
    fields = list(kind.value_type)
    inner = pa.StructArray.from_arrays([*(pa.array([x[k] for x in flat], pa.int32()) for k in range(3)), codec.encode([x[3] for x in flat])], fields=fields)
    ends = np.cumsum([0, *(len(r or ()) for r in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, mask=pa.array([r is None for r in rows])).cast(kind)


@lru_cache(maxsize=None)
def udf_of(name: str, strict: bool = True, returns: str | None = None):
    """The Arrow UDF of a heavy function; built on first use."""
    function = HEAVY[name] if returns is None else replace(HEAVY[name], returns=returns)

    def run(*given: pa.Array, **named: pa.Array) -> pa.Array:
        return _run(function, strict, _arranged(function, given, named))

    return F.arrow_udf(run, returnType=function.returns)


def _arranged(function: Heavy, given: tuple, named: dict) -> tuple:
    """The arguments in their places; optional ones that are not given are null."""
    out: list = [None] * len(function.arguments)
    places = (function.short or {}).get(len(given), range(len(given))) if not named else range(len(given))
    if len(given) > len(out):
        raise GeometryError(f"{function.name}: takes {len(out)} arguments at most, not {len(given)}")
    for k, column in zip(places, given, strict=True):
        out[k] = column
    for name, column in named.items():
        if name not in function.arguments or out[k := function.arguments.index(name)] is not None:
            raise GeometryError(f"{function.name}: takes {', '.join(function.arguments)}; {name} is unknown or given twice")
        out[k] = column
    rows = len(next(x for x in out if x is not None))
    for k, column in enumerate(out):
        if column is None:
            if k not in function.optional:
                raise GeometryError(f"{function.name}: {function.arguments[k]} is missing")
            out[k] = pa.nulls(rows, pa.string())
    return tuple(out)


#: Functions that read one field of the header; nothing else of the value goes to Python.
_HEADER_ONLY = {"st_3denvelope": "bbox"}
#: The fields that a batch function reads; of a stored column no others are read from Parquet or sent to Python.
_FIELDS_READ = {
    "st_3dvolume": ("kind", "xs", "ys", "zs", "solid_shell", "shell_face", "face_tri", "tri", "validation"),
    **dict.fromkeys(("st_3darea", "st_3dsurfacearea"), ("kind", "xs", "ys", "zs", "tri", "validation")),
    "st_3dfootprintarea": ("kind", "xs", "ys", "face_ring", "ring_vertex", "ring_idx"),
}


def _is_plain(value) -> bool:
    """Whether it is a column by name and no expression, whose Python part would run apart from its caller's."""
    return isinstance(value, str) or re.fullmatch(r"Column<'\w+'>", str(value)) is not None


def call(name: str, *columns, strict: bool = True, **named) -> Column:
    """The function ``name`` of columns, by place or by the names of ``HEAVY[name].arguments``."""
    if name in _HEADER_ONLY or name in _FIELDS_READ:
        (value,) = (*columns, *named.values())
        g = F.col(value) if isinstance(value, str) else value
        if name in _HEADER_ONLY:
            columns, named = (g[_HEADER_ONLY[name]],), {}
        elif _is_plain(value):
            columns, named = (F.when(g.isNotNull(), F.struct(*[g[f].alias(f) for f in _FIELDS_READ[name]])),), {}
    return udf_of(name, strict)(*columns, **named)


# --- import and construction -------------------------------------------------------------------------


def _plain_prisms(polygons: list, heights: list) -> list[Shape | None]:
    ready = [p is not None and h is not None and p.kind == s.POLYGON and p.n_faces == 1 and h > 0 and 3 <= len(p.face(0)[0]) <= 4 for p, h in zip(polygons, heights, strict=True)]
    out = bulk.sound_solids([[r.ravel() for r in build.prism_rings(p.v[p.face(0)[0]], h)] if ok else None for p, h, ok in zip(polygons, heights, ready, strict=True)])
    for solid, p in zip(out, polygons, strict=True):
        if solid is not None:
            solid.crs = p.crs
    return out


@heavy("st_3dfromwkb", "wkb geometry_properties", G3D, optional=(1,), flat=batch.solids)
def _from_wkb(data: bytes, properties) -> Shape:
    """A solid from WKB of a PolyhedralSurface Z or a collection of them, with an optional shell sidecar."""
    return build.solid_with_sidecar(bytes(data), properties)


@heavy("st_geom3dfromwkb", "wkb", G3D)
def _geom_from_wkb(data: bytes) -> Shape:
    """A geometry from ISO WKB or EWKB with Z."""
    return build.geometry_from_wkb(bytes(data))


@heavy("st_3dgeomfromtext", "wkt", G3D, flat=batch.texts)
def _geom_from_text(words: str) -> Shape:
    """A geometry from WKT or EWKT with Z."""
    return build.geometry_from_text(words)


@heavy("st_3dextrude", "geom height", G3D, many=_plain_prisms)
def _extrude(polygon: Shape, height: float) -> Shape:
    """The closed prism over a polygon's exterior ring."""
    return build.extrude(polygon, height)


@heavy("st_makesolid", "geom", G3D, many=bulk.of_surfaces)
def _make_solid(surface: Shape) -> Shape:
    """A closed, manifold, oriented PolyhedralSurface as a solid."""
    return build.make_solid(surface)


@heavy("g3d_rebuild", "value", G3D, many=bulk.rebuilt)
def _rebuild(value: Shape) -> Shape:
    """An untrusted value with bounds, triangles and validation made anew."""
    return build.rebuild(value)


_PAYLOAD = b"VOLUMA01"
_PRINTED = [chr(b) if 32 <= b < 127 and b != 92 else f"\\x{b:02X}" for b in range(256)]
_PRINTABLE = re.compile(r"(?:[ -\[\]-~]++|\\x[0-9A-Fa-f]{2})*+")


@heavy("g3d_to_payload", "value", "binary")
def _to_payload(value: Shape) -> bytes:
    """The value as one self-contained binary: a header of its shells and reference system, and its WKB."""
    shells = [[len(value.shell_faces(sh)) for sh in value.shells_of(k)] for k in range(value.n_solids)]
    head = json.dumps({"solid": value.kind == s.SOLID, "shells": shells, "crs": value.crs}).encode()
    return _PAYLOAD + len(head).to_bytes(4, "little") + head + wkb.write(value)


@heavy("g3d_payload_text", "payload", "string")
def _payload_text(payload: bytes) -> str:
    """A payload as printable text: bytes outside printable ASCII, and backslashes, as \\xHH."""
    return "".join(map(_PRINTED.__getitem__, bytes(payload)))


def _payload_bytes(payload: bytes | str) -> bytes:
    if not isinstance(payload, str):
        return bytes(payload)
    if not _PRINTABLE.fullmatch(payload):
        raise GeometryError("the text is no payload: it has characters other than printable ASCII, or a backslash without xHH")
    return payload.encode("ascii").decode("unicode_escape").encode("latin-1")


def _opened(payload: bytes | str) -> tuple[dict, bytes]:
    """The header and the WKB of a payload."""
    data = _payload_bytes(payload)
    if not data.startswith(_PAYLOAD):
        raise GeometryError("BLOB is not a payload of this library; build one from WKB with ST_3DFromWKB or ST_Geom3DFromWKB")
    at = len(_PAYLOAD) + 4
    size = int.from_bytes(data[at - 4 : at], "little")
    try:
        head = json.loads(data[at : at + size])
    except ValueError:
        raise GeometryError("Cannot cast BLOB: damaged header") from None
    return head, data[at + size :]


def _plain_payloads(payloads: list) -> list[Shape | None]:
    """The payloads of plain sound solids of one shell; None for the others."""
    rings, systems = [], []
    for payload in payloads:
        try:
            head, body = _opened(payload) if payload is not None else ({}, b"")
            found = bulk.plain_rings(body) if head.get("solid") is True else None
            rings.append(found if found is not None and head["shells"] == [[len(found)]] else None)
            systems.append(head.get("crs"))
        except (ValueError, KeyError, AttributeError):
            rings.append(None)
            systems.append(None)
    out = bulk.sound_solids(rings)
    for solid, system in zip(out, systems, strict=True):
        if solid is not None:
            solid.crs = system
    return out


@heavy("g3d_from_payload", "payload", G3D, many=_plain_payloads)
def _from_payload(payload: bytes | str) -> Shape:
    """The value of a payload, binary or as text; bounds, triangles and validation are made anew, so it need not be trusted."""
    head, body = _opened(payload)
    out = build.solid_from_wkb(body, head["shells"]) if head["solid"] else build.geometry_from_wkb(body)
    out.crs = head["crs"]
    return out


@heavy("g3d_solid_from_payload", "payload", G3D, many=_plain_payloads)
def _solid_from_payload(payload: bytes | str) -> Shape:
    """As g3d_from_payload, of a solid."""
    out = _from_payload(payload)
    if out.kind != s.SOLID:
        raise GeometryError("BLOB is not a SOLID_3D payload")
    return out


@heavy("g3d_geom_from_payload", "payload", G3D)
def _geom_from_payload(payload: bytes | str) -> Shape:
    """As g3d_from_payload, of a geometry that is not a solid."""
    if _opened(payload)[0]["solid"]:
        raise GeometryError("BLOB is not a GEOM_3D payload")
    return _from_payload(payload)


def from_geometry(column: Column, solid: bool = False, strict: bool = True) -> Column:
    """A value from a column of Spark's own GEOMETRY type, under its reference system; ``solid`` imports a solid."""
    data = F.st_asbinary(column)
    value = call("st_3dfromwkb", data, F.lit(None).cast("string"), strict=strict) if solid else call("st_geom3dfromwkb", data, strict=strict)
    srid = F.st_srid(column)
    return F.when(srid > 0, st_3dsetcrs(value, F.concat(F.lit("EPSG:"), srid.cast("string")))).otherwise(value)


# --- export ------------------------------------------------------------------------------------------


@heavy("st_3daswkb", "solid", "binary", flat=batch.binaries)
def _as_wkb(solid: Shape) -> bytes:
    """A solid as WKB."""
    return wkb.write(solid)


@heavy("st_3dasbinary", "geom", "binary", flat=batch.binaries)
def _as_binary(geometry: Shape) -> bytes:
    """A geometry as ISO WKB."""
    return wkb.write(geometry)


@heavy("st_3dastext", "geom", "string")
def _as_text(geometry: Shape) -> str:
    """A geometry as WKT."""
    return text.wkt(geometry)


@heavy("st_3dasgeojson", "geom", "string")
def _as_geojson(geometry: Shape) -> str:
    """A geometry as GeoJSON; a surface is a MultiPolygon."""
    return text.geojson(geometry)


# --- faces, shells and parts -------------------------------------------------------------------------


@heavy("st_3dfaces", "solid", f"array<{FACE}>")
def _faces(solid: Shape) -> list[tuple]:
    """Every face with its number, solid, shell and polygon, from 1."""
    out = []
    for k in range(solid.n_solids):
        for m, sh in enumerate(solid.shells_of(k)):
            out += [(f + 1, k + 1, m + 1, build.face_polygon(solid, f)) for f in solid.shell_faces(sh)]
    return out


@heavy("st_3dfacen", "solid n", G3D)
def _face_n(solid: Shape, n: int) -> Shape | None:
    """The n-th face as a polygon."""
    return build.face_polygon(solid, n - 1) if 1 <= n <= solid.n_faces else None


@heavy("st_3dfaceareas", "geom", "array<double>")
def _face_areas(value: Shape) -> list:
    """Each face's area; null for a face without triangles."""
    return measure.face_areas(value)


@heavy("st_3dfacenormals", "geom", f"array<{POINT3}>")
def _face_normals(value: Shape) -> list:
    """Each face's unit normal, by its exterior ring."""
    return [None if n is None else dict(zip("xyz", n.tolist(), strict=True)) for n in measure.face_normals(value)]


@heavy("st_3dexteriorshell", "solid", G3D)
def _exterior_shell(solid: Shape) -> Shape | None:
    """The first shell as a PolyhedralSurface."""
    return build.shell_surface(solid, 0)


@heavy("st_3dinteriorshelln", "solid n", G3D)
def _interior_shell(solid: Shape, n: int) -> Shape | None:
    """The n-th interior shell as a PolyhedralSurface, from 1."""
    return build.shell_surface(solid, n) if n >= 1 else None


@heavy("st_3dgeometryn", "geom n", G3D)
def _geometry_n(value: Shape, n: int) -> Shape | None:
    """The n-th solid, member or patch, from 1."""
    return build.geometry_n(value, n)


# --- measures ----------------------------------------------------------------------------------------


@heavy("st_3dvolume", "solid", "double", whole=batch.volumes)
def _volume(solid: Shape) -> float:
    """The volume of a closed, manifold, oriented solid."""
    return measure.volume(solid)


@heavy("st_3dsurfacearea", "solid", "double", whole=batch.areas)
def _surface_area(solid: Shape) -> float:
    """The area of all faces, cavity walls included."""
    return measure.area(solid)


@heavy("st_3darea", "geom", "double", whole=batch.areas)
def _area(value: Shape) -> float:
    """The area of all faces; 0 for points and lines."""
    return measure.area(value)


@heavy("st_3dfootprintarea", "geom", "double", whole=batch.footprints)
def _footprint_area(value: Shape) -> float:
    """The upright projection's area."""
    return measure.footprint_area(value)


@heavy("st_3dperimeter", "geom", "double", flat=batch.perimeters)
def _perimeter(value: Shape) -> float:
    """The length of the boundary."""
    return measure.perimeter(value)


@heavy("st_3dlength", "geom", "double")
def _length(geometry: Shape) -> float:
    """The length of lines; 0 for others."""
    return measure.length(geometry)


@heavy("st_3dcentroid", "geom", G3D)
def _centroid(value: Shape) -> Shape:
    """The centre of volume, area, length or vertices as a point."""
    at = measure.centroid(value)
    return Shape(s.POINT, np.zeros((0, 3)) if at is None else at[None], value.crs)


@heavy("st_isplanar", "geom", "boolean", flat=batch.planar)
def _is_planar(geometry: Shape) -> bool:
    """Whether every ring, or the vertices, lie in one plane."""
    return bool(measure.is_planar(geometry))


# --- distances ---------------------------------------------------------------------------------------


def pair(name: str, returns: str, extra: str = "", pairs: Callable | None = None):
    """A function of two values in one reference system."""

    def add(row: Callable) -> Callable:
        title = row.__name__.strip("_")

        def checked(a: Shape, b: Shape, *rest):
            crs.require_same(title, a.crs, b.crs)
            return row(a, b, *rest)

        checked.__doc__ = row.__doc__
        heavy(name, f"geom1 geom2 {extra}".strip(), returns, pairs=pairs)(checked)
        return row

    return add


@pair("st_3ddistance", "double", pairs=batch.pair_distances)
def ST_3DDistance(a: Shape, b: Shape) -> float:
    """The least distance; solids are volumes; infinite if a side is empty."""
    return distance.distance(a, b)


@pair("st_3ddwithin", "boolean", "distance", pairs=batch.pair_within)
def ST_3DDWithin(a: Shape, b: Shape, limit: float) -> bool:
    """Whether the least distance is at most ``distance``."""
    return distance.within(a, b, limit)


@pair("st_3dmaxdistance", "double")
def ST_3DMaxDistance(a: Shape, b: Shape) -> float:
    """The greatest distance of two vertices."""
    return distance.max_distance(a, b)


@pair("st_3ddfullywithin", "boolean", "distance")
def ST_3DDFullyWithin(a: Shape, b: Shape, limit: float) -> bool:
    """Whether the greatest distance is at most ``distance``."""
    return limit >= 0 and distance.max_distance(a, b) <= limit


@pair("st_3dintersects", "boolean", pairs=batch.pair_intersects)
def ST_3DIntersects(a: Shape, b: Shape) -> bool:
    """Exactly whether the values share a point."""
    return distance.intersects(a, b)


@pair("st_3ddisjoint", "boolean", pairs=batch.pair_disjoint)
def ST_3DDisjoint(a: Shape, b: Shape) -> bool:
    """Whether the values share no point."""
    return not distance.intersects(a, b)


@pair("st_3dclosestpoint", G3D)
def ST_3DClosestPoint(a: Shape, b: Shape) -> Shape:
    """The point of the first value that is nearest to the second."""
    return Shape(s.POINT, distance.closest(distance.elements(a), distance.elements(b))[1][None], a.crs)


@pair("st_3dshortestline", G3D)
def ST_3DShortestLine(a: Shape, b: Shape) -> Shape:
    """The shortest line from the first value to the second."""
    return Shape(s.LINE, np.stack(distance.closest(distance.elements(a), distance.elements(b))[1:]), a.crs)


# --- maps --------------------------------------------------------------------------------------------


@heavy("st_3dscale", "geom sx sy sz", G3D)
def _scale(value: Shape, x: float, y: float, z: float) -> Shape:
    """Scaled about the origin; an uneven scale validates a solid anew."""
    return build.scale(value, x, y, z)


def _rotation(axis: int) -> Callable:
    def run(value: Shape, radians: float) -> Shape:
        return build.rotate(value, axis, radians)

    run.__doc__ = f"Rotated counter-clockwise about {'XYZ'[axis]}."
    return run


for _axis, _name in enumerate(("st_3drotatex", "st_3drotatey", "st_3drotatez")):
    heavy(_name, "geom radians", G3D)(_rotation(_axis))


@heavy("st_3dtransform", "geom source_crs target_crs", G3D, optional=(1,), short={2: (0, 2)})
def _transform(value: Shape, source, target) -> Shape | None:
    """Reprojected from ``source`` (or the value's own system) to ``target``; heights stay."""
    given = value.crs if source is None else crs.identifier(source)
    if not given:
        raise GeometryError("ST_3DTransform: the value has no CRS; name the source, or set one with ST_3DSetCRS")
    if value.crs and crs.canonical(value.crs) != crs.canonical(given):
        raise GeometryError(f"ST_3DTransform: the value is in {value.crs}, not {given}")
    goal = crs.identifier(target)
    out = build.moved(value, crs.transform(value.v, given, goal), goal, check=True)
    if out.kind in s.AREAL:
        triangulate(out)
    return out


@heavy("st_3dplaceimplicit", "relative_geometry reference_point transformation_matrix", G3D, optional=(2,))
def _place(value: Shape, point: Shape, matrix) -> Shape:
    """A template placed by a row-major 4 x 4 matrix (null: identity) and a reference point."""
    return build.place_implicit(value, point, None if matrix is None else list(matrix))


@heavy("st_3dconvexhull", "geom", G3D)
def _convex_hull(value: Shape) -> Shape:
    """The convex hull, of the dimension that the points have."""
    return hull.convex_hull(value)


@heavy("st_3dfootprinthull", "geometry", G3D)
def _footprint_hull(geometry: Shape) -> Shape:
    """The convex hull of the XY projection at the least Z."""
    return hull.footprint_hull(geometry)


# --- native expressions --------------------------------------------------------------------------------


@heavy("st_3denvelope", "geom", "binary", whole=batch.envelopes)
def _envelope(value: Shape) -> bytes | None:
    """The XY rectangle as two-dimensional WKB, a line or point where it is flat; null if empty."""
    return batch.envelopes(codec.encode([value]))[0].as_py()


def native(name: str, value: Column) -> Column:
    """A native function of a column."""
    return _BUILDERS[name](value)


def _num(field: str) -> Callable[[Column], Column]:
    return lambda g: g["counts"][field].cast("long")


def _coordinate(letter: str) -> Callable[[Column], Column]:
    fail = lambda what: F.raise_error(F.lit(f"ST_3D{letter}: {what}")).cast("double")
    return lambda g: F.when(g["kind"] != 1, fail("argument is not a Point")).when(F.size(g[f"{letter.lower()}s"]) == 0, fail("empty point")).otherwise(F.get(g[f"{letter.lower()}s"], F.lit(0)))


def _type_name(g: Column) -> Column:
    out = F.when(g.isNull(), F.lit(None).cast("string"))
    for k, name in s.NAMES.items():
        out = out.when(g["kind"] == k, F.lit(f"ST_{name}"))
    return out.otherwise(F.raise_error(F.lit("ST_3DGeometryType: unknown class")).cast("string"))


def _report(g: Column) -> Column:
    v = g["validation"]
    issues = [(~v["is_closed"], "not closed"), (v["non_manifold_edges"] > 0, "non-manifold edges"), (v["non_manifold_vertices"] > 0, "non-manifold vertices"), (~v["is_oriented"], "orientation inconsistent"), (v["degenerate_faces"] > 0, "degenerate faces"), (v["disconnected_shells"] > 0, "disconnected shells"), (v["self_intersections"] > 0, "self-intersecting faces")]
    message = F.concat(F.lit("Invalid solid: "), F.concat_ws(", ", *[F.when(c, F.lit(t)) for c, t in issues]))
    counts = {"solid_count": g["counts"]["solids"], "shell_count": g["counts"]["shells"], "face_count": g["counts"]["faces"], "open_edge_count": v["open_edges"], "non_manifold_edge_count": v["non_manifold_edges"], "degenerate_face_count": v["degenerate_faces"], "orientation_error_count": v["orientation_errors"], "non_manifold_vertex_count": v["non_manifold_vertices"], "disconnected_shell_count": v["disconnected_shells"], "self_intersection_count": v["self_intersections"]}
    flags = [v[n].alias(n) for n in ("is_valid", "is_closed", "is_manifold", "is_oriented")]
    built = F.struct(*flags, *[c.cast("long").alias(n) for n, c in counts.items()], F.when(v["is_valid"], "VALID").otherwise("INVALID").alias("code"), F.when(v["is_valid"], F.lit("Valid solid")).otherwise(message).alias("message"))
    return F.when(v.isNotNull(), built)


_BUILDERS: dict[str, Callable[[Column], Column]] = {
    "st_3dbounds": lambda g: g["bbox"],
    **{f"st_3d{a}{e}": (lambda f: lambda g: g["bbox"][f])(f"{e}_{a}") for a in "xyz" for e in ("min", "max")},
    **{f"st_3dnum{n}": _num(n) for n in ("solids", "shells", "faces")},
    "st_ndims": lambda g: F.when(g.isNotNull(), F.lit(3)),
    "st_coorddim": lambda g: F.when(g.isNotNull(), F.lit(3)),
    "st_3dhasz": lambda g: F.when(g.isNotNull(), F.lit(True)),
    "st_3dgeometrytype": _type_name,
    "st_3ddimension": lambda g: F.when(g["kind"].isin(1, 4), 0).when(g["kind"].isin(2, 5), 1).when(g["kind"].isin(3, 6, 15), 2),
    "st_3dnumgeometries": lambda g: F.when(g["kind"].isin(4, 5), F.greatest(F.size(g["parts"]) - 1, F.lit(0))).when(g["kind"].isin(6, 15), g["counts"]["faces"]).when(g.isNotNull(), F.lit(1)),
    **{f"st_3d{a}": _coordinate(a.upper()) for a in "xyz"},
    "st_3dnuminteriorshells": lambda g: F.when(g["counts"]["solids"] == 1, g["counts"]["shells"] - 1),
    **{f"st_3dis{n}": (lambda f: lambda g: g["validation"][f])(f"is_{n}") for n in ("valid", "closed", "manifold", "oriented")},
    "st_3dvalidationreport": _report,
    "st_3dcrs": lambda g: g["crs"],
    "st_3dsrid": lambda g: F.when(g.isNotNull(), F.coalesce(F.nullif(F.regexp_extract(g["crs"], r"^EPSG:([0-9]{1,9})$", 1), F.lit("")).cast("int"), F.lit(0))),
    "st_force3d": lambda g: g,
}


def canonical_crs(name: Column) -> Column:
    """One spelling of a reference system's identifier, '' for none."""
    spelled = F.concat(F.get_json_object(name, "$.id.authority"), F.lit(":"), F.get_json_object(name, "$.id.code"))
    return F.upper(F.coalesce(F.when(name.startswith("{"), spelled), name, F.lit("")))


def st_3dextent(g: Column) -> Column:
    """The box of all boxes, an aggregate of native minima and maxima; nulls and empties are skipped, mixed systems raise."""
    used = F.when(g["bbox"].isNotNull(), canonical_crs(g["crs"]))
    names = ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")
    box = F.struct(*[(F.min if n.startswith("min") else F.max)(g["bbox"][n]).alias(n) for n in names])
    mixed = F.raise_error(F.lit("ST_3DExtent: the inputs have different CRSs; bring them to one with ST_3DTransform, or set one with ST_3DSetCRS")).cast(BBOX)
    return F.when(F.min(used) != F.max(used), mixed).when(F.count(used) > 0, box)


def st_3dsetcrs(g: Column, name: Column) -> Column:
    """The value under another label; '' removes it."""
    return F.when(name.isNotNull() & g.isNotNull(), g.withField("crs", F.nullif(name, F.lit(""))))


def st_3dtranslate(g: Column, x: Column, y: Column, z: Column) -> Column:
    """The value moved, natively; a solid's validation stays."""
    out = g
    shifted = lambda values, by: F.transform(values, lambda c: c + by)
    for letter, by in zip("xyz", (x, y, z), strict=True):
        out = out.withField(f"{letter}s", shifted(g[f"{letter}s"], by.cast("double")))
    names = ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")
    by = {"x": x, "y": y, "z": z}
    box = F.when(g["bbox"].isNotNull(), F.struct(*[(g["bbox"][n] + by[n[-1]].cast("double")).alias(n) for n in names]))
    return F.when(g.isNotNull() & x.isNotNull() & y.isNotNull() & z.isNotNull(), out.withField("bbox", box))


def st_3dfaceslopes(g: Column) -> Column:
    """Each face's tilt from level, in degrees from 0 to 90."""
    n = call("st_3dfacenormals", g)
    return F.transform(n, lambda v: F.when(v.isNotNull(), F.degrees(F.atan2(F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]), F.abs(v["z"])))))


def st_3dfaceazimuths(g: Column) -> Column:
    """The compass direction each face leans to, in degrees from 0; null for level faces."""

    def of(v: Column) -> Column:
        turn = F.degrees(F.atan2(v["x"], v["y"]))
        around = F.when(turn < 0, turn + 360.0).otherwise(turn)
        level = v.isNull() | ((v["x"] == 0) & (v["y"] == 0))
        return F.when(~level, F.when(around >= 360.0, 0.0).otherwise(around))

    return F.transform(call("st_3dfacenormals", g), of)


def _slope(n: dict | None) -> float | None:
    return None if n is None else math.degrees(math.atan2(math.hypot(n["x"], n["y"]), abs(n["z"])))


def _azimuth(n: dict | None) -> float | None:
    if n is None or (n["x"] == 0 and n["y"] == 0):
        return None
    around = math.degrees(math.atan2(n["x"], n["y"])) % 360.0
    return 0.0 if around >= 360.0 else around


def face_directions(name: str):
    """ST_3DFaceSlopes or ST_3DFaceAzimuths for SQL, of a value or of its face normals."""
    each = {"st_3dfaceslopes": _slope, "st_3dfaceazimuths": _azimuth}[name]

    def run(geom: pa.Array) -> pa.Array:
        normals = _run(HEAVY["st_3dfacenormals"], True, (geom,)) if codec.is_value(geom) else geom
        return pa.array([None if row is None else [each(n) for n in row] for row in normals.to_pylist()], codec.arrow_type("array<double>"))

    return F.arrow_udf(run, "array<double>")


def extent_of(column: pa.Array) -> dict | None:
    """The box of all boxes of a column of values, or of boxes."""
    box = column.field("bbox") if codec.is_value(column) else column
    used = np.asarray(column.is_valid()) & np.asarray(box.is_valid())
    if not used.any():
        return None
    if codec.is_value(column):
        systems = {crs.canonical(x) if x else "" for x, u in zip(column.field("crs").to_pylist(), used, strict=True) if u}
        if len(systems) > 1:
            raise GeometryError("ST_3DExtent: the inputs have different CRSs; bring them to one with ST_3DTransform, or set one with ST_3DSetCRS")
    names = ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")
    return {n: float((np.min if n.startswith("min") else np.max)(np.asarray(box.field(n))[used])) for n in names}


def extent_aggregate():
    """ST_3DExtent for SQL: an Arrow aggregate, which holds a group at a time; ``st_3dextent`` combines on the map side instead."""

    def extent(geom: pa.Array) -> dict:
        return extent_of(geom)

    return F.arrow_udf(extent, BBOX)


def st_3dtryfromwkb(data: Column, properties: Column | None = None) -> Column:
    """As st_3dfromwkb; null for a bad row."""
    return call("st_3dfromwkb", data, F.lit(None).cast("string") if properties is None else properties, strict=False)


def bbox_gap2(a: Column, b: Column) -> Column:
    """The squared distance of two values' boxes, natively."""
    out = None
    for axis in "xyz":
        gap = F.greatest(F.lit(0.0), a["bbox"][f"min_{axis}"] - b["bbox"][f"max_{axis}"], b["bbox"][f"min_{axis}"] - a["bbox"][f"max_{axis}"])
        out = gap * gap if out is None else out + gap * gap
    return out


#: Every public function of the library.
PUBLIC = sorted({*HEAVY, *_BUILDERS, "st_3dextent", "st_3dsetcrs", "st_3dtranslate", "st_3dfaceslopes", "st_3dfaceazimuths", "st_3dtryfromwkb"} - {n for n in HEAVY if n.startswith("g3d_")})
