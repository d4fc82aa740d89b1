"""Whole batches against the row functions: the same values, and every doubtful row is left to the row function."""

import random
from fractions import Fraction

import pyarrow as pa
import pytest

from voluma.functions import codec
from voluma.functions import library as lib
from voluma.kernel import build, bulk, predicates, text
from voluma.kernel.shape import GeometryError
from voluma.sources import fixtures as fx

TEXTS = [
    "POINT Z (1 2 3)",
    "LINESTRING Z (0 0 0, 0 0 0, 1.5 -2e1 .5)",
    "POLYGON Z ((0 0 0, 4 0 0, 4 4 0, 0 4 0, 0 0 0), (1 1 0, 1 2 0, 2 2 0, 2 1 0, 1 1 0))",
    "POLYGON Z ((0 0 0, 3 0 0, 1 1 0, 0 3 0, 0 0 0))",
    "POLYGON Z ((0 0 -0, 3 0 0, 0 3 5, 0 0 0))",
    "POLYGON Z ((0 0 0, 1 0 0, 2 0 0, 0 0 0))",
    "POLYHEDRALSURFACE Z (((0 0 0, 1 0 0, 1 1 0, 0 1 0, 0 0 0)), ((0 0 0, 9 0 0, 9 9 0, 0 9 0, 0 0 0), (1 1 0, 1 2 0, 2 2 0, 1 1 0)), ((0 0 0, 1 0 1, 0 1 0, 0 0 0)))",
]
LEFT = ["POLYGON Z ((0 0 0, 0 0 0, 1 0 0, 1 1 0, 0 0 0))", "POLYGON Z ((0 0 0, 2 2 0, 2 0 0, 0 3 0, 0 0 0))", "POLYGON Z ((0 0 0, 1e999 0 0, 1 1 0, 0 0 0))", "POINT(1 2 3)", "SRID=7415;POINT Z (1 2 3)", "POINT Z EMPTY", "POINT Z (1 2)", "POINT Z (1 2 3) x", "", None]


def test_texts():
    found = bulk.plain_texts([*TEXTS, *LEFT])
    assert [x is not None for x in found] == [True] * len(TEXTS) + [False] * len(LEFT)
    assert codec.encode(found[: len(TEXTS)]).equals(codec.encode([build.geometry_from_text(t) for t in TEXTS]))


def test_rings_of_four_turned_at_random():
    draw = random.Random(5)
    words = []
    for _ in range(400):
        points = [[draw.randint(0, 3) for _ in "xy"] + [0] for _ in range(4)]
        words.append("POLYGON Z ((" + ", ".join(" ".join(map(str, p)) for p in [*points, points[0]]) + "))")
    settled = 0
    for w, found in zip(words, bulk.plain_texts(words), strict=True):
        if found is None:
            continue
        settled += 1
        assert codec.encode([found]).equals(codec.encode([build.geometry_from_text(w)])), w
    assert settled > 100


def solids():
    square = text.read("POLYGON Z ((0 0 0, 2 0 0, 2 3 0, 0 3 0, 0 0 0))")
    bar = build.extrude(square, 4.0)
    named = build.moved(bar, bar.v, "EPSG:7415", check=False)
    turned = build.moved(bar, bar.v[::-1], None, check=True)
    return [bar, named, turned, build.solid_from_wkb(bytes(fx.hollow_cube()), [[6, 6]]), build.solid_from_wkb(bytes(fx.open_tetra())), None]


def test_rebuilt():
    assert [x is not None for x in bulk.rebuilt(solids())][:2] == [True, True]
    out = lib._run(lib.HEAVY["g3d_rebuild"], True, (codec.encode(solids()),))
    assert out.equals(codec.encode([None if x is None else build.rebuild(x) for x in solids()]))


def test_payloads():
    binary = [None if x is None else lib._to_payload(x) for x in solids()]
    plain = lib._plain_payloads(binary)
    assert [x is not None for x in plain][:2] == [True, True] and plain[1].crs == "EPSG:7415"
    printed = [None if x is None else lib._payload_text(x) for x in binary]
    for given, kind in ((binary, pa.binary()), (printed, pa.string())):
        out = lib._run(lib.HEAVY["g3d_from_payload"], True, (pa.array(given, kind),))
        assert out.equals(codec.encode([None if x is None else lib._from_payload(x) for x in given]))
    every = bytes(range(256))
    assert lib._payload_bytes(lib._payload_text(every)) == every
    assert lib._payload_bytes("a\\x5c\\x6E") == b"a\\n"
    for bad in ("\\x5", "\\n", "é", "\t"):
        with pytest.raises(GeometryError, match="no payload"):
            lib._payload_bytes(bad)


def test_exact_signs():
    draw = random.Random(7)
    for _ in range(300):
        a, b = ([draw.choice((0.1, 0.25, 1e-9, 3.0, 1e17)) * draw.randint(-3, 3) for _ in "xyz"] for _ in "ab")
        middle = [(x + y) / 2 for x, y in zip(a, b, strict=True)]
        p, q, r = ([Fraction(x) for x in point] for point in (a, b, middle))
        det = (p[0] - r[0]) * (q[1] - r[1]) - (p[1] - r[1]) * (q[0] - r[0])
        assert predicates.orient2d(a, b, middle) == (det > 0) - (det < 0)


def test_solids_of_surfaces():
    surfaces = [None if x is None else build.shell_surface(x, 0) for x in solids()]
    surfaces[0].crs = "EPSG:7415"
    assert [x is not None for x in bulk.of_surfaces(surfaces)] == [True, True, False, True, False, False]
    out = lib._run(lib.HEAVY["st_makesolid"], False, (codec.encode(surfaces),))
    whole = [build.make_solid(x) for x in surfaces[:4]]
    assert out.equals(codec.encode([*whole, None, None]))
