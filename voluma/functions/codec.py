"""Between Arrow struct arrays of 3D values and shapes in memory."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from voluma.functions.schema import G3D, LISTS
from voluma.kernel.flat import Flat
from voluma.kernel.shape import SOLID, Shape
from voluma.kernel.validate import COUNTS, FLAGS

_BBOX = ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")


_SIMPLE = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


@lru_cache(maxsize=None)
def arrow_type(ddl: str) -> pa.DataType:
    """The Arrow type of a type string as schema.py writes them; workers have no Spark session to ask."""
    if ddl.startswith("array<"):
        return pa.list_(pa.field("element", arrow_type(ddl[6:-1])))
    if not ddl.startswith("struct<"):
        return _SIMPLE[ddl]
    fields, depth, start = [], 0, 7
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if (c == "," and depth == 1) or i == len(ddl) - 1:
            name, _, kind = ddl[start:i].partition(":")
            fields.append(pa.field(name, arrow_type(kind)))
            start = i + 1
    return pa.struct(fields)


def is_value(array: pa.Array) -> bool:
    return pa.types.is_struct(array.type) and array.type.get_field_index("ring_vertex") >= 0


class Lists:
    """A list column as one flat array and offsets."""

    def __init__(self, array: pa.Array) -> None:
        self.offsets = np.asarray(array.offsets).astype(np.int64)
        self.flat = np.asarray(array.values)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.offsets[i] : self.offsets[i + 1]]


def decode(array: pa.StructArray) -> list[Shape | None]:
    if not len(array):
        return []
    column = lambda name: array.field(name)
    kinds, crs, present = column("kind").to_pylist(), column("crs").to_pylist(), array.is_valid().to_pylist()
    coordinates = [Lists(column(c)) for c in ("xs", "ys", "zs")]
    lists = {name: Lists(column(name)) for name in LISTS}
    checked = column("validation")
    checks = {name: checked.field(name).to_pylist() for name in (*COUNTS, *FLAGS)} if SOLID in kinds else {}
    out: list[Shape | None] = []
    for i, ok in enumerate(present):
        if not ok:
            out.append(None)
            continue
        v = np.stack([c[i] for c in coordinates], axis=1).astype(np.float64, copy=False)
        validation = {k: x[i] for k, x in checks.items()} if kinds[i] == SOLID else None
        out.append(Shape(kinds[i], v, crs[i], **{name: values[i] for name, values in lists.items()}, validation=validation))
    return out


def _list_array(parts: list[np.ndarray], value_type: pa.DataType, dtype) -> pa.ListArray:
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.concatenate(parts).astype(dtype, copy=False) if parts else np.zeros(0, dtype=dtype)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, value_type))


_NOTHING = Shape(-1, np.zeros((0, 3)))


def encode(shapes: list[Shape | None]) -> pa.StructArray:
    kind = arrow_type(G3D)
    missing = np.array([x is None for x in shapes], dtype=bool)
    each = [_NOTHING if x is None else x for x in shapes]
    boxes = [x.bbox() for x in each]
    no_box = np.array([b is None for b in boxes], dtype=bool)
    fields = {
        "kind": pa.array([x.kind for x in each], pa.int32()),
        "crs": pa.array([x.crs or None for x in each], pa.string()),
        "bbox": pa.StructArray.from_arrays([pa.array([None if b is None else b[k] for b in boxes], pa.float64()) for k in range(6)], fields=list(kind.field("bbox").type), mask=pa.array(no_box)),
        "counts": pa.StructArray.from_arrays(
            [pa.array(c, pa.int32()) for c in ([len(x.v) for x in each], [x.n_solids for x in each], [x.n_shells for x in each], [x.n_faces for x in each], [max(0, len(x.ring_vertex) - 1) for x in each], [len(x.tri) // 3 for x in each])],
            fields=list(kind.field("counts").type),
        ),
    }
    for k, name in enumerate(("xs", "ys", "zs")):
        fields[name] = _list_array([x.v[:, k] for x in each], pa.float64(), np.float64)
    for name in LISTS:
        fields[name] = _list_array([getattr(x, name) for x in each], pa.int32(), np.int32)
    unchecked = np.array([x.validation is None for x in each], dtype=bool)
    checks = [pa.array([None if x.validation is None else x.validation[name] for x in each], f.type) for name, f in zip((*COUNTS, *FLAGS), kind.field("validation").type, strict=True)]
    fields["validation"] = pa.StructArray.from_arrays(checks, fields=list(kind.field("validation").type), mask=pa.array(unchecked))
    return pa.StructArray.from_arrays([fields[f.name].cast(f.type) for f in kind], fields=list(kind), mask=pa.array(missing))


def encode_flat(x: Flat) -> pa.StructArray:
    """The column of a batch of values, none of them null."""
    kind, n = arrow_type(G3D), x.n
    size = np.diff(x.vo)
    full = size > 0
    box = np.zeros((6, n))
    if full.any():
        box[:3, full] = np.minimum.reduceat(x.v, x.vo[:-1][full]).T
        box[3:, full] = np.maximum.reduceat(x.v, x.vo[:-1][full]).T
    groups = {name: np.maximum(np.diff(x.lists[name][1]) - 1, 0) for name in ("solid_shell", "shell_face", "face_ring", "ring_vertex")}
    counts = [size, *groups.values(), np.diff(x.lists["tri"][1]) // 3]
    lists = lambda values, at, to: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, to))
    missing = lambda some: pa.array(np.broadcast_to(some, n))
    struct = lambda name, columns, mask: pa.StructArray.from_arrays(columns, fields=list(kind.field(name).type), mask=mask)
    fields = {
        "kind": pa.array(x.kind.astype(np.int32)),
        "crs": pa.nulls(n, pa.string()) if x.crs is None else pa.array([c or None for c in x.crs], pa.string()),
        "bbox": struct("bbox", [pa.array(b, mask=~full) for b in box], pa.array(~full)),
        "counts": struct("counts", [pa.array(c.astype(np.int32)) for c in counts], None),
    }
    for k, name in enumerate(("xs", "ys", "zs")):
        fields[name] = lists(np.ascontiguousarray(x.v[:, k]), x.vo, pa.float64())
    for name, (values, at) in x.lists.items():
        fields[name] = lists(values.astype(np.int32), at, pa.int32())
    checks = [pa.nulls(n, f.type) if x.validation is None else pa.array(np.full(n, x.validation[f.name]), f.type) for f in kind.field("validation").type]
    fields["validation"] = struct("validation", checks, missing(x.validation is None))
    return pa.StructArray.from_arrays([fields[f.name].cast(f.type) for f in kind], fields=list(kind))
