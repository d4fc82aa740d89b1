"""Solids with cavities a batch at a time, and pairs of solids: the row functions' values, without calling them where nothing is doubtful."""

import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from voluma.functions import codec
from voluma.functions import library as lib
from voluma.kernel import bulk, text, wkb
from voluma.sources import fixtures as fx

SIX = '{"type": "Solid", "shells": [[6, 6]]}'
NINE = '{"type": "Solid", "shells": [[6, 6, 6]]}'


def hollow(low, high, *cavities, turned=True):
    return bytes(fx.surface_wkb(sum((fx.box_faces(a, b, inward=turned) for a, b in cavities), fx.box_faces(low, high))))


def both(name, *columns, strict=False):
    kind = lib.HEAVY[name]
    return lib._run(kind, strict, columns), lib._run(replace(kind, flat=None, pairs=None, many=None), strict, columns)


def refuse(*_):
    raise AssertionError("a row went through the row function")


def cube(a, b):
    return (a, a, a), (b, b, b)


def test_plain_cavities_in_batches(monkeypatch):
    data = [hollow(*cube(0, n), cube(1, n - 1)) for n in range(3, 8)] + [bytes(fx.surface_wkb(fx.box_faces(*cube(0, 2)))), hollow(*cube(0, 9), cube(1, 3), cube(5, 8))]
    columns = pa.array(data), pa.array([SIX] * 5 + [None, NINE])
    want = both("st_3dfromwkb", *columns)[1]
    monkeypatch.setitem(lib.HEAVY, "st_3dfromwkb", replace(lib.HEAVY["st_3dfromwkb"], row=refuse))
    found = lib._run(lib.HEAVY["st_3dfromwkb"], True, columns)
    assert found.equals(want)
    shells = pa.array([{"type": "Solid", "shells": [[6, 6]]}] * 5, pa.struct([("type", pa.string()), ("shells", pa.list_(pa.list_(pa.int64())))]))
    assert lib._run(lib.HEAVY["st_3dfromwkb"], True, (columns[0][:5], shells)).equals(want[:5])


def test_doubtful_cavities_are_left():
    odd = [
        (hollow(*cube(0, 4), cube(0, 3)), SIX),  # touches the wall
        (hollow(*cube(0, 4), cube(2, 6)), SIX),  # breaks through
        (hollow(*cube(0, 4), cube(6, 8)), SIX),  # outside
        (hollow(*cube(0, 4), cube(1, 3), turned=False), SIX),  # winds like the exterior
        (hollow(*cube(0, 9), cube(1, 6), cube(2, 4)), NINE),  # one in the other
        (hollow(*cube(0, 9), cube(1, 4), cube(4, 8)), NINE),  # meet in a corner
        (hollow(*cube(0, 4), ((1, 1, 1), (3, 3, 1.00001))), SIX),  # thin beside the whole
        (hollow(*cube(0, 4), ((1, 1, 3.9999), (3, 3, 3.99999))), SIX),  # next to the wall
        (hollow(*cube(0, 4), cube(1, 3)), None),  # one shell, not connected
        (hollow(*cube(0, 4), cube(1, 3)), '{"shells": [[6, 7]]}'),
        (hollow(*cube(0, 4), cube(1, 3)), '{"shells": [[6, 0, 6]]}'),
        (hollow(*cube(0, 4), cube(1, 3)), "{"),
        (hollow(*cube(0, 4), cube(1, 3))[:-9], SIX),
        (None, SIX),
        (bytes(fx.multi_cube()), None),
        (bytes(fx.open_tetra()), None),
    ]
    draw = random.Random(2)
    for _ in range(60):
        a, b = sorted(draw.sample(range(0, 9), 2))
        odd.append((hollow(*cube(0, 8), cube(a, b)), SIX))
    found, want = both("st_3dfromwkb", *map(pa.array, zip(*odd, strict=True)))
    assert found.equals(want)


def test_many_layouts_of_one_length():
    faces = [fx.box_faces(*cube(0, 2)), *([f[k:] + f[:k] for f in fx.box_faces(*cube(0, 2))] for k in (1, 2))]
    prism = [[(0, 0, 0), (0, 1, 0), (1, 0, 0)], [(0, 0, 2), (1, 0, 2), (0, 1, 2)], [(0, 0, 0), (1, 0, 0), (1, 0, 2), (0, 0, 2)], [(1, 0, 0), (0, 1, 0), (0, 1, 2), (1, 0, 2)], [(0, 1, 0), (0, 0, 0), (0, 0, 2), (0, 1, 2)]]
    draw = random.Random(4)
    data = [bytes(fx.surface_wkb(draw.sample(prism, 5))) for _ in range(60)] + [bytes(fx.surface_wkb(f)) for f in faces]
    found, want = both("st_3dfromwkb", pa.array(data), pa.nulls(len(data), pa.string()), strict=True)
    assert found.equals(want)
    _, rows = bulk.flat_wkb(np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0, *map(len, data)]), [()] * len(data))
    assert sorted(rows.tolist()) == list(range(len(data)))


def test_binaries(monkeypatch):
    words = ["POLYGON Z ((0 0 0, 4 0 0, 4 4 0, 0 4 0, 0 0 0), (1 1 0, 1 2 0, 2 2 0, 1 1 0))", "POLYHEDRALSURFACE Z (((0 0 0, 1 0 0, 1 1 0, 0 0 0)), ((0 0 0, 9 0 0, 9 9 0, 0 9 0, 0 0 0), (1 1 0, 1 2 0, 2 2 0, 1 1 0)))", "MULTIPOLYGON Z (((0 0 0, 1 0 0, 1 1 0, 0 0 0)), ((5 0 0, 6 0 0, 6 1 0, 5 0 0)))"]
    shapes = [lib._geom_from_text(w) for w in words] + [lib._from_wkb(hollow(*cube(0, 4), cube(1, 3)), SIX)]
    others = [None, lib._geom_from_text("POINT Z (1 2 3)"), lib._from_wkb(bytes(fx.multi_cube()), None), lib._geom_from_text("POLYGON Z EMPTY"), text.read("LINESTRING Z (0 0 0, 1 1 1)")]
    column = codec.encode([x for pair in zip(shapes + shapes[:1], others, strict=True) for x in pair])
    assert lib._run(lib.HEAVY["st_3dasbinary"], True, (column,)).to_pylist() == [None if x is None else wkb.write(x) for pair in zip(shapes + shapes[:1], others, strict=True) for x in pair]
    monkeypatch.setitem(lib.HEAVY, "st_3dasbinary", replace(lib.HEAVY["st_3dasbinary"], row=refuse))
    assert lib._run(lib.HEAVY["st_3dasbinary"], True, (codec.encode(shapes),)).to_pylist() == list(map(wkb.write, shapes))


@pytest.mark.parametrize("unit", [1.0, 0.1])
def test_pairs_of_hollow_solids(unit):
    draw, left, right = random.Random(9), [], []
    for _ in range(250):
        n = draw.randint(3, 7)
        low, high = sorted(draw.sample([x / 2 for x in range(-2, 20)], 2))
        left.append((hollow(*cube(0, unit * n), cube(unit, unit * (n - 1))), SIX))
        shift = draw.choice(((0, 0, 0), (0.5, 0, 0), (0.25, 0.5, 0)))
        right.append((hollow(*(tuple(unit * (c + s) for c, s in zip(p, shift, strict=True)) for p in cube(low, high))), None))
    a, b = (lib._run(lib.HEAVY["st_3dfromwkb"], True, tuple(map(pa.array, zip(*side, strict=True)))) if side[0][1] else lib._run(lib.HEAVY["st_3dfromwkb"], True, (pa.array([d for d, _ in side]), pa.nulls(len(side), pa.string()))) for side in (left, right))
    for name in ("st_3dintersects", "st_3ddisjoint", "st_3ddistance"):
        for one, two in ((a, b), (b, a)):
            found, want = both(name, one, two, strict=True)
            assert found.to_pylist() == pytest.approx(want.to_pylist()), name
    met = lib._run(lib.HEAVY["st_3dintersects"], True, (a, b)).to_pylist()
    assert {True, False} == set(met)


def test_held_pairs_are_told_apart():
    solids = [lib._from_wkb(bytes(fx.surface_wkb(fx.box_faces(*cube(k, k + 1)))), None) for k in range(6)]
    a, b, c = codec.encode(solids[:3]), codec.encode(solids[:3]), codec.encode(solids[3:])
    for _ in range(2):
        assert lib._run(lib.HEAVY["st_3dintersects"], True, (a, b)).to_pylist() == [True] * 3
        assert lib._run(lib.HEAVY["st_3dintersects"], True, (a, c)).to_pylist() == [False] * 3
        assert lib._run(lib.HEAVY["st_3dintersects"], True, (codec.encode(solids)[0:3], codec.encode(solids)[3:6])).to_pylist() == [False] * 3
        every = codec.encode(solids)
        assert lib._run(lib.HEAVY["st_3dintersects"], True, (every[1:4], every[0:3])).to_pylist() == [True] * 3
        assert lib._run(lib.HEAVY["st_3dintersects"], True, (every[2:5], every[0:3])).to_pylist() == [False] * 3
