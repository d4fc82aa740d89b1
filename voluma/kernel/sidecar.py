"""The geometry_properties sidecar: face counts by solid and shell, as JSON text or as a struct."""

from __future__ import annotations

import json

from voluma.kernel.shape import GeometryError

_MOST = 0xFFFFFFFF


def from_json(text: str) -> list[list[int]] | None:
    try:
        found = json.loads(text)
    except ValueError as error:
        raise GeometryError(f"geometry_properties JSON: invalid JSON: {error}") from None
    if not isinstance(found, dict):
        raise GeometryError("geometry_properties JSON: expected an object")
    return _checked(found.get("shells"), "geometry_properties JSON: ")


def from_struct(row: dict) -> list[list[int]] | None:
    return _checked(row["shells"], "geometry_properties: ")


def _checked(shells, prefix: str) -> list[list[int]] | None:
    if shells is None:
        return None
    if not isinstance(shells, list):
        raise GeometryError(f"{prefix}expected shells to be an array of arrays")
    out = []
    for solid in shells:
        if solid is None:
            raise GeometryError(f"{prefix}null shells entry")
        if not isinstance(solid, list):
            raise GeometryError(f"{prefix}expected shells to be an array of arrays")
        for n in solid:
            if n is None:
                raise GeometryError(f"{prefix}null shell face count")
            if isinstance(n, bool) or not isinstance(n, int):
                raise GeometryError(f"{prefix}expected a shell face count")
            if not 0 <= n <= _MOST:
                raise GeometryError(f"{prefix}shells face count out of range")
        out.append(list(solid))
    return out
