"""City models in JSON as rows of solids: one row a city object and geometry.

A whole-model file is one text value; a file of features has one feature a line, after a header line that
carries the transform and has no ``id``. Solids, MultiSolids and CompositeSolids come out as WKB with their shell sidecar, ready for
``st_3dfromwkb``; MultiSurfaces and CompositeSurfaces as WKB for ``st_geom3dfromwkb``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voluma.kernel import shape as s
from voluma.kernel import wkb
from voluma.kernel.shape import with_faces

ROW = "id string, type string, lod string, geometry_type string, parents array<string>, crs string, wkb binary, properties struct<type:string,surfaces:string,face_semantics:array<int>,shells:array<array<bigint>>>"


def _crs(meta: dict) -> str | None:
    system = (meta.get("metadata") or {}).get("referenceSystem") or ""
    return f"EPSG:{system.rstrip('/').rpartition('/')[2]}" if system else None


def _semantics(g: dict) -> tuple[str | None, list[int | None] | None]:
    """(the semantic surfaces as JSON, each face's number among them) of a geometry."""
    given = g.get("semantics") or {}
    if not given.get("surfaces"):
        return None, None

    def flat(x) -> list[int | None]:
        return [y for part in x for y in flat(part)] if isinstance(x, list) else [x]

    return json.dumps(given["surfaces"]), flat(given.get("values") or [])


def objects(document: dict, transform: dict | None, crs: str | None) -> Iterator[tuple]:
    """Rows of ROW for every geometry of a city model or feature."""
    t = document.get("transform") or transform or {"scale": [1, 1, 1], "translate": [0, 0, 0]}
    v = np.array(document.get("vertices") or np.zeros((0, 3)), dtype=np.float64) * t["scale"] + t["translate"]
    crs = _crs(document) or crs
    surface = lambda faces: with_faces(s.SURFACE, None, [[v[ring] for ring in face] for face in faces])
    for name, thing in (document.get("CityObjects") or {}).items():
        for g in thing.get("geometry") or []:
            kind, bounds = g.get("type"), g.get("boundaries") or []
            solids = [bounds] if kind == "Solid" else bounds if kind in ("MultiSolid", "CompositeSolid") else None
            if solids is not None:
                members = [wkb.write(surface([f for shell in solid for f in shell])) for solid in solids]
                data = members[0] if kind == "Solid" else b"\x01" + (1007).to_bytes(4, "little") + len(members).to_bytes(4, "little") + b"".join(members)
                shells = [[len(shell) for shell in solid] for solid in solids]
            elif kind in ("MultiSurface", "CompositeSurface"):
                data, shells = wkb.write(surface(bounds)), None
            else:
                continue
            surfaces, numbers = _semantics(g)
            sidecar = {"type": kind, "surfaces": surfaces, "face_semantics": numbers, "shells": shells}
            yield name, thing.get("type"), str(g.get("lod")), kind, thing.get("parents"), crs, data, sidecar


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from voluma.functions.codec import arrow_type

    types = [arrow_type(x) for x in ("string", "string", "string", "string", "array<string>", "string", "binary", "struct<type:string,surfaces:string,face_semantics:array<int>,shells:array<array<bigint>>>")]
    names = ["id", "type", "lod", "geometry_type", "parents", "crs", "wkb", "properties"]
    for batch in batches:
        for text, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            first = json.loads(head) if head else {}
            rows = list(objects(json.loads(text), first.get("transform"), _crs(first)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_model_files(spark: SparkSession, path: str) -> DataFrame:
    """The geometries of files that hold a whole model each."""
    return spark.read.text(path, wholetext=True).select("value", F.lit(None).cast("string").alias("head")).mapInArrow(_parse, ROW)


def read_feature_files(spark: SparkSession, path: str) -> DataFrame:
    """The geometries of files of one feature a line; each file's header line goes to its features by a join on the file name."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).where(F.trim("value") != "")
    is_head = F.get_json_object("value", "$.id").isNull() & F.get_json_object("value", "$.transform").isNotNull()
    heads = lines.where(is_head).groupBy("file").agg(F.first("value").alias("head"))
    return lines.where(~is_head).join(heads, "file", "left").select("value", "head").mapInArrow(_parse, ROW)


def lod_suffix(lod: str) -> str:
    """2 and 2.0 are 2_0, 2.2 is 2_2."""
    whole, _, part = lod.partition(".")
    return f"{whole}_{part or 0}"


def by_lod(rows: DataFrame, lods: list[str] | None = None) -> DataFrame:
    """A row for each object of the readers' rows, with ``geometry_lod<X>_<Y>`` (WKB) and ``geometry_properties_lod<X>_<Y>`` for each level.

    ``lods`` names the levels; without it they are looked up, a handful of values. An object with several geometries of
    a level keeps the one of the least type name.
    """
    if lods is None:
        lods = [r[0] for r in rows.select("lod").where("lod is not null").distinct().orderBy("lod").collect()]
    suffixes: dict[str, list[str]] = {}
    for lod in lods:
        suffixes.setdefault(lod_suffix(lod), []).append(lod)
    columns = []
    for suffix, names in suffixes.items():
        one = F.min_by(F.struct("wkb", "properties"), F.when(F.col("lod").isin(names), F.struct("geometry_type", "wkb")))
        columns += [one["wkb"].alias(f"geometry_lod{suffix}"), one["properties"].alias(f"geometry_properties_lod{suffix}")]
    return rows.groupBy("id", "type", "parents", "crs").agg(*columns)
