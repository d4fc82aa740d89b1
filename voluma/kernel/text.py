"""WKT and GeoJSON: text in by a small recursive reader, text out with nine significant digits."""

from __future__ import annotations

import re

import numpy as np

from voluma.kernel import shape as s
from voluma.kernel.shape import GeometryError, Shape

_TOKEN = re.compile(r"\s*(?:([A-Za-z]+)|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|([(),;=]))")
_CLASSES = {"POINT": s.POINT, "LINESTRING": s.LINE, "POLYGON": s.POLYGON, "TRIANGLE": s.POLYGON, "MULTIPOINT": s.MULTIPOINT, "MULTILINESTRING": s.MULTILINE, "MULTIPOLYGON": s.MULTIPOLYGON, "POLYHEDRALSURFACE": s.SURFACE, "TIN": s.SURFACE}


class _Text:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.start = text, 0, 0

    def fail(self, what: str):
        raise GeometryError(f"WKT: {what} at offset {self.start}")

    def peek(self) -> tuple[str, str]:
        m = _TOKEN.match(self.text, self.at)
        if not m:
            rest = self.text[self.at :]
            self.start = self.at + len(rest) - len(rest.lstrip())
            if rest.strip():
                self.fail("unexpected character")
            return "end", ""
        self.start = m.start(m.lastindex)
        return ("word", m[1].upper()) if m[1] else ("number", m[2]) if m[2] else ("mark", m[3])

    def next(self) -> tuple[str, str]:
        found = self.peek()
        m = _TOKEN.match(self.text, self.at)
        self.at = m.end() if m else len(self.text)
        return found

    def expect(self, mark: str) -> None:
        if self.next() != ("mark", mark):
            self.fail(f"expected '{mark}'")

    def listed(self, one) -> list:
        if self.peek() == ("word", "EMPTY"):
            self.next()
            return []
        self.expect("(")
        out = [one()]
        while self.peek() == ("mark", ","):
            self.next()
            out.append(one())
        self.expect(")")
        return out

    def point(self) -> list[float]:
        out = []
        while self.peek()[0] == "number":
            out.append(float(self.next()[1]))
        if len(out) < 2:
            self.fail("expected a coordinate")
        if len(out) == 2:
            self.fail("GEOM_3D needs a Z ordinate")
        if len(out) > 3:
            self.fail("GEOM_3D holds no M ordinate")
        if not np.isfinite(out).all():
            self.fail("coordinate is not finite")
        return out

    def maybe_wrapped(self) -> list[float]:
        if self.peek() == ("mark", "("):
            self.next()
            out = self.point()
            self.expect(")")
            return out
        return self.point()


def _array(points: list) -> np.ndarray:
    return np.array(points, dtype=np.float64).reshape(-1, 3)


def read(text: str) -> Shape:
    """The value of WKT or EWKT; polygons are not triangulated yet."""
    t, crs = _Text(text), None
    kind, word = t.next()
    if (kind, word) == ("word", "SRID"):
        t.expect("=")
        kind, number = t.next()
        if kind != "number" or not number.lstrip("+").isdigit():
            t.fail("expected an SRID")
        t.expect(";")
        crs = f"EPSG:{int(number)}" if int(number) else None
        kind, word = t.next()
    if kind != "word":
        t.fail("expected a geometry class")
    name, tag = word, ""
    if name not in _CLASSES:
        for suffix in ("ZM", "Z", "M"):
            if name.endswith(suffix) and name[: -len(suffix)] in _CLASSES:
                name, tag = name[: -len(suffix)], suffix
                break
    if name not in _CLASSES:
        t.fail(f"GEOM_3D has no class {word}")
    if not tag and t.peek()[0] == "word" and t.peek()[1] in ("Z", "M", "ZM"):
        tag = t.next()[1]
    if tag in ("M", "ZM"):
        t.fail("GEOM_3D holds no M ordinate")
    which = _CLASSES[name]
    ring = lambda: s.clean_ring(_array(t.listed(t.point)))
    if which == s.POINT:
        out = Shape(which, _array(t.listed(t.point)))
        if len(out.v) > 1:
            t.fail("expected ')'")
    elif which == s.LINE:
        out = Shape(which, _array(t.listed(t.point)))
    elif which == s.POLYGON:
        rings = t.listed(ring)
        out = s.with_faces(which, crs, [rings] if rings else [])
    elif which == s.MULTIPOINT:
        points = t.listed(t.maybe_wrapped)
        out = Shape(which, _array(points), parts=s.offsets([1] * len(points)))
    elif which == s.MULTILINE:
        lines = [_array(x) for x in t.listed(lambda: t.listed(t.point))]
        out = Shape(which, np.concatenate(lines) if lines else np.zeros((0, 3)), parts=s.offsets(map(len, lines)))
    else:
        out = s.with_faces(which, crs, t.listed(lambda: t.listed(ring)))
    if t.peek()[0] != "end":
        t.fail("unexpected text")
    out.crs = crs
    return out


def number(x: float) -> str:
    return "%.9g" % x


def _closed(r: np.ndarray) -> np.ndarray:
    return np.concatenate([r, r[:1]])


def wkt(shape: Shape) -> str:
    point = lambda p: " ".join(map(number, p))
    run = lambda v: "(" + ", ".join(map(point, v)) + ")"
    face = lambda f: "(" + ", ".join(run(_closed(shape.v[r])) for r in shape.face(f)) + ")"
    head = s.NAMES[shape.kind].upper() + " Z "
    if not len(shape.v):
        return head + "EMPTY"
    if shape.kind in (s.POINT, s.LINE):
        return head + run(shape.v)
    if shape.kind == s.POLYGON:
        return head + face(0)
    if shape.kind == s.MULTIPOINT:
        return head + "(" + ", ".join(f"({point(p)})" for p in shape.v) + ")"
    if shape.kind == s.MULTILINE:
        return head + "(" + ", ".join(map(run, shape.lines())) + ")"
    return head + "(" + ", ".join(face(f) for f in range(shape.n_faces)) + ")"


def geojson(shape: Shape) -> str:
    point = lambda p: "[" + ",".join(map(number, p)) + "]"
    run = lambda v: "[" + ",".join(map(point, v)) + "]"
    face = lambda f: "[" + ",".join(run(_closed(shape.v[r])) for r in shape.face(f)) + "]"
    kind = s.NAMES[s.MULTIPOLYGON if shape.kind == s.SURFACE else shape.kind]
    if shape.kind == s.POINT:
        inner = point(shape.v[0]) if len(shape.v) else "[]"
    elif shape.kind in (s.LINE, s.MULTIPOINT):
        inner = run(shape.v)
    elif shape.kind == s.POLYGON:
        inner = face(0) if shape.n_faces else "[]"
    elif shape.kind == s.MULTILINE:
        inner = "[" + ",".join(map(run, shape.lines())) + "]"
    else:
        inner = "[" + ",".join(face(f) for f in range(shape.n_faces)) + "]"
    return f'{{"type":"{kind}","coordinates":{inner}}}'
