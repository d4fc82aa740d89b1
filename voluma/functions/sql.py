"""The functions under their SQL names.

Header functions become SQL functions, which Catalyst inlines, so their filters still reach the Parquet scan;
the others are the Arrow UDFs. Arguments go by place or by name (``st_3dtranslate(g, dz => 1, dx => 10, dy => 0)``), and
overloads that differ in their number of arguments are called so: ``st_3dfromwkb(wkb)``, ``st_3dtransform(g, 'EPSG:4326')``.
``st_3dextent`` is an aggregate that holds the boxes of a group at a time; over large groups use the column builder
``library.st_3dextent``, which combines on the map side.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from voluma.functions import library
from voluma.functions.schema import BBOX, G3D, REPORT
from voluma.kernel.shape import NAMES

_RETURNS = {
    "st_3dbounds": BBOX,
    "st_3dgeometrytype": "STRING",
    "st_3dcrs": "STRING",
    "st_3dvalidationreport": REPORT,
    "st_force3d": G3D,
    "st_3dhasz": "BOOLEAN",
    **dict.fromkeys(("st_ndims", "st_coorddim", "st_3ddimension", "st_3dnumgeometries", "st_3dnuminteriorshells", "st_3dsrid"), "INT"),
    **dict.fromkeys(("st_3dnumsolids", "st_3dnumshells", "st_3dnumfaces"), "BIGINT"),
    **dict.fromkeys((f"st_3dis{n}" for n in ("valid", "closed", "manifold", "oriented")), "BOOLEAN"),
}
_FIELDS = {
    "st_3dbounds": "g.bbox",
    **{f"st_3d{a}{e}": f"g.bbox.{e}_{a}" for a in "xyz" for e in ("min", "max")},
    **{f"st_3dnum{n}": f"CAST(g.counts.{n} AS BIGINT)" for n in ("solids", "shells", "faces")},
    "st_3dcrs": "g.crs",
    "st_force3d": "g",
    **{f"st_3dis{n}": f"g.validation.is_{n}" for n in ("valid", "closed", "manifold", "oriented")},
    "st_3dsrid": "CASE WHEN g IS NOT NULL THEN coalesce(CAST(nullif(regexp_extract(g.crs, '^EPSG:([0-9]{1,9})$', 1), '') AS INT), 0) END",
    **dict.fromkeys(("st_ndims", "st_coorddim"), "CASE WHEN g IS NOT NULL THEN 3 END"),
    "st_3dhasz": "CASE WHEN g IS NOT NULL THEN TRUE END",
    "st_3dgeometrytype": "CASE WHEN g IS NULL THEN NULL " + " ".join(f"WHEN g.kind = {k} THEN 'ST_{name}'" for k, name in NAMES.items()) + " ELSE raise_error('ST_3DGeometryType: unknown class') END",
    "st_3ddimension": "CASE WHEN g.kind IN (1, 4) THEN 0 WHEN g.kind IN (2, 5) THEN 1 WHEN g.kind IN (3, 6, 15) THEN 2 END",
    "st_3dnumgeometries": "CASE WHEN g.kind IN (4, 5) THEN greatest(size(g.parts) - 1, 0) WHEN g.kind IN (6, 15) THEN g.counts.faces WHEN g IS NOT NULL THEN 1 END",
    "st_3dnuminteriorshells": "CASE WHEN g.counts.solids = 1 THEN g.counts.shells - 1 END",
    **{
        f"st_3d{a}": f"CASE WHEN g.kind <> 1 THEN CAST(raise_error('ST_3D{a.upper()}: argument is not a Point') AS DOUBLE) WHEN size(g.{a}s) = 0 THEN CAST(raise_error('ST_3D{a.upper()}: empty point') AS DOUBLE) ELSE get(g.{a}s, 0) END"
        for a in "xyz"
    },
}
_COUNTS = {"solid_count": "counts.solids", "shell_count": "counts.shells", "face_count": "counts.faces"} | {
    f"{name}_count": f"validation.{field}"
    for name, field in (("open_edge", "open_edges"), ("non_manifold_edge", "non_manifold_edges"), ("degenerate_face", "degenerate_faces"), ("orientation_error", "orientation_errors"), ("non_manifold_vertex", "non_manifold_vertices"), ("disconnected_shell", "disconnected_shells"), ("self_intersection", "self_intersections"))
}
_ISSUES = (
    ("NOT g.validation.is_closed", "not closed"),
    ("g.validation.non_manifold_edges > 0", "non-manifold edges"),
    ("g.validation.non_manifold_vertices > 0", "non-manifold vertices"),
    ("NOT g.validation.is_oriented", "orientation inconsistent"),
    ("g.validation.degenerate_faces > 0", "degenerate faces"),
    ("g.validation.disconnected_shells > 0", "disconnected shells"),
    ("g.validation.self_intersections > 0", "self-intersecting faces"),
)
_FIELDS["st_3dvalidationreport"] = (
    "CASE WHEN g.validation IS NOT NULL THEN named_struct("
    + ", ".join(f"'is_{n}', g.validation.is_{n}" for n in ("valid", "closed", "manifold", "oriented"))
    + "".join(f", '{name}', CAST(g.{field} AS BIGINT)" for name, field in _COUNTS.items())
    + ", 'code', CASE WHEN g.validation.is_valid THEN 'VALID' ELSE 'INVALID' END, 'message', CASE WHEN g.validation.is_valid THEN 'Valid solid' ELSE concat('Invalid solid: ', concat_ws(', ', "
    + ", ".join(f"CASE WHEN {test} THEN '{what}' END" for test, what in _ISSUES)
    + ")) END) END"
)


#: Functions that take an argument of more than one type.
_ANY_TYPE = {"st_3dfromwkb", "g3d_from_payload", "g3d_solid_from_payload", "g3d_geom_from_payload"}
_TYPES = {
    **dict.fromkeys(("wkb", "payload"), "BINARY"),
    **dict.fromkeys(("wkt", "source_crs", "target_crs"), "STRING"),
    **dict.fromkeys(("height", "distance", "radians", "sx", "sy", "sz"), "DOUBLE"),
    "n": "INT",
    "transformation_matrix": "ARRAY<DOUBLE>",
}


def _signature(function: library.Heavy) -> str:
    """Parameters in SQL; those from the first that may be missing on have a default."""
    first = min([*function.optional, *(min(set(range(len(function.arguments))) - set(places)) for places in (function.short or {}).values()), len(function.arguments)])
    return ", ".join(f"{a} {_TYPES.get(a, G3D)}" + (" DEFAULT NULL" if k >= first else "") for k, a in enumerate(function.arguments))


def _places(function: library.Heavy) -> str:
    """The arguments of the Python call: with the last one missing, a short form's last argument is the one before it."""
    if not function.short:
        return ", ".join(function.arguments)
    *others, before, last = function.arguments
    return ", ".join([*others, f"CASE WHEN {last} IS NOT NULL THEN {before} END", f"coalesce({last}, {before})"])


#: Header functions of solids alone; the others' argument is ``geom``.
_OF_SOLIDS = {"st_3dvalidationreport", "st_3dnuminteriorshells", *(f"st_3dnum{n}" for n in ("solids", "shells", "faces")), *(f"st_3dis{n}" for n in ("valid", "closed", "manifold", "oriented"))}


def argument(name: str) -> str:
    """The name of a header function's argument."""
    return "solid" if name in _OF_SOLIDS else "geom"


def _named(body: str, name: str) -> str:
    return re.sub(r"\bg\b", name, body)


def register(spark: SparkSession) -> list[str]:
    """Registers every function in ``spark``; returns their names."""
    names = []
    for name in library._BUILDERS:
        returns = _RETURNS.get(name, "DOUBLE")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument(name)} {G3D}) RETURNS {returns} RETURN {_named(_FIELDS[name], argument(name))}")
        names.append(name)
    for plain, function in library.HEAVY.items():
        for name, strict in ((plain, True), (f"try_{plain}", False)):
            if plain in _ANY_TYPE:
                spark.udf.register(name, library.udf_of(plain, strict))
            else:  # Spark does not take named arguments inside chained Python calls; inside a SQL function they have places
                spark.udf.register(f"_{name}", library.udf_of(plain, strict))
                spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({_signature(function)}) RETURNS {function.returns} RETURN _{name}({_places(function)})")
            names.append(name)
    spark.udf.register("st_3dtryfromwkb", library.udf_of("st_3dfromwkb", strict=False))
    others = "".join(f", '{c}', g.{c}" for c in ("kind", "bbox", "counts", "xs", "ys", "zs", "solid_shell", "shell_face", "face_ring", "ring_vertex", "ring_idx", "parts", "face_tri", "tri", "validation"))
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION st_3dsetcrs(geom {G3D}, crs STRING) RETURNS {G3D} RETURN CASE WHEN geom IS NOT NULL AND crs IS NOT NULL THEN "
        "named_struct('kind', geom.kind, 'crs', nullif(crs, '')" + _named(others[others.index(", 'bbox'") :], "geom") + ") END"
    )
    moved = {f"{a}s": f"transform(g.{a}s, c -> c + d{a})" for a in "xyz"}
    moved["bbox"] = "CASE WHEN g.bbox IS NOT NULL THEN named_struct(" + ", ".join(f"'{e}_{a}', g.bbox.{e}_{a} + d{a}" for e in ("min", "max") for a in "xyz") + ") END"
    fields = ("kind", "crs", "bbox", "counts", "xs", "ys", "zs", "solid_shell", "shell_face", "face_ring", "ring_vertex", "ring_idx", "parts", "face_tri", "tri", "validation")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION st_3dtranslate(geom {G3D}, dx DOUBLE, dy DOUBLE, dz DOUBLE) RETURNS {G3D} RETURN CASE WHEN geom IS NOT NULL AND dx IS NOT NULL AND dy IS NOT NULL AND dz IS NOT NULL THEN named_struct("
        + _named(", ".join(f"'{f}', {moved.get(f, f'g.{f}')}" for f in fields), "geom")
        + ") END"
    )
    for name in ("st_3dfaceslopes", "st_3dfaceazimuths"):
        spark.udf.register(name, library.face_directions(name))
    spark.udf.register("st_3dextent", library.extent_aggregate())
    return names + ["st_3dtryfromwkb", "st_3dsetcrs", "st_3dtranslate", "st_3dfaceslopes", "st_3dfaceazimuths", "st_3dextent"]


def catalog(spark: SparkSession) -> DataFrame:
    """name, native, arguments, returns and description of every public function."""
    rows = []
    for name in library.PUBLIC:
        if name in library.HEAVY:
            f = library.HEAVY[name]
            rows.append((name, False, ", ".join(f.arguments), f.returns, f.doc))
        else:
            doc = getattr(getattr(library, name, None), "__doc__", None)
            rows.append((name, True, {"st_3dsetcrs": "geom, crs", "st_3dtranslate": "geom, dx, dy, dz", "st_3dtryfromwkb": "wkb, geometry_properties"}.get(name, argument(name)), _RETURNS.get(name, "DOUBLE"), (doc or "A header fact of the value.").strip()))
    return spark.createDataFrame(rows, "name string, native boolean, arguments string, returns string, description string")
