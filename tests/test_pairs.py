"""Distances and intersections of whole batches against the same pair by pair, without Spark."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from voluma.functions import batch, codec
from voluma.functions import library as lib
from voluma.kernel import build, distance
from voluma.kernel import shape as s
from voluma.kernel.shape import Shape, with_faces
from voluma.sources import fixtures as fx


def box(low, high):
    return build.solid_from_wkb(fx.surface_wkb(fx.box_faces(low, high)))


def prism(ring, low, height):
    flat = with_faces(s.POLYGON, None, [[np.array([(x, y, low) for x, y in ring], dtype=np.float64)]])
    return build.extrude(flat, height)


def hollow(outer, inner):
    data = fx.surface_wkb(fx.box_faces(*outer) + fx.box_faces(*inner, inward=True))
    return build.solid_with_sidecar(data, '{"type": "Solid", "shells": [[6, 6]]}')


ELL = [(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)]


def some(rng, k):
    at = [rng.choice([0, 1, 2, 2.5, 4, 7.25]) for _ in range(3)]
    kind = k % 6
    if kind == 0:
        return box(at, [c + rng.choice([1, 2, 0.5]) for c in at])
    if kind == 1:
        return build.moved(build.solid_from_wkb(fx.tetra()), build.solid_from_wkb(fx.tetra()).v * rng.choice([1, 3]) + at, None, check=True)
    if kind == 2:
        return prism([(x + at[0], y + at[1]) for x, y in ELL], at[2], rng.choice([1, 2]))
    if kind == 3:
        return hollow((at, [c + 4 for c in at]), ([c + 1 for c in at], [c + 3 for c in at]))
    if kind == 4:
        return build.rotate(box(at, [c + 1.5 for c in at]), rng.randrange(3), rng.random())
    return build.solid_from_wkb(fx.multi_cube(rng.choice([3.0, 5.0])))


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(7)
    a, b = ([some(rng, rng.randrange(6)) for _ in range(400)] for _ in range(2))
    line = Shape(s.LINE, np.array([[0.0, 0, 0], [3, 3, 3]]))
    open_ = build.solid_from_wkb(fx.open_tetra())
    a += [hollow(((0, 0, 0), (4, 4, 4)), ((1, 1, 1), (3, 3, 3)))] * 3 + [None, line, line, box((0, 0, 0), (9, 9, 9))]
    b += [box((1.5, 1.5, 1.5), (2, 2, 2)), box((1, 1, 1), (3, 3, 3)), box((0.2, 0.2, 0.2), (0.6, 0.6, 0.6)), line, None, line, box((4, 4, 4), (5, 5, 5))]
    assert not open_.validation["is_valid"]
    return a, b


def test_same_as_pair_by_pair(pairs):
    a, b = pairs
    ca, cb = codec.encode(a), codec.encode(b)
    far, meet, apart = batch.pair_distances(ca, cb), batch.pair_intersects(ca, cb), batch.pair_disjoint(ca, cb)
    settled = 0
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is None or y is None or s.LINE in (x.kind, y.kind):
            assert far[i] is None and meet[i] is None
            continue
        settled += 1
        assert meet[i] == distance.intersects(x, y) == (not apart[i])
        assert far[i] == pytest.approx(distance.distance(x, y), rel=1e-12, abs=1e-14)
    assert settled > 400 and 50 < sum(1 for m in meet if m) < 350


def test_limits(pairs):
    a, b = pairs
    ca, cb = codec.encode(a), codec.encode(b)
    far = batch.pair_distances(ca, cb)
    for factor in (0.0, 0.9999, 1.0, 1.0001):
        limits = [None if d is None else d * factor for d in far]
        got = batch.pair_within(ca, cb, pa.array(limits, pa.float64()))
        assert got == [None if d is None else d <= d * factor for d in far]
    assert not any(batch.pair_within(ca, cb, pa.array([-1.0] * len(a))))


def test_nested_solids():
    shell = hollow(((0, 0, 0), (4, 4, 4)), ((1, 1, 1), (3, 3, 3)))
    cases = [((1.5, 1.5, 1.5), (2, 2, 2), False, 0.5), ((1, 1, 1), (2, 2, 2), True, 0.0), ((0.25, 0.25, 0.25), (0.5, 0.5, 0.5), True, 0.0), ((-1, -1, -1), (5, 5, 5), True, 0.0), ((4, 4, 4), (5, 5, 5), True, 0.0), ((5, 5, 5), (6, 6, 6), False, math.sqrt(3))]
    a, b = codec.encode([shell] * len(cases)), codec.encode([box(low, high) for low, high, _, _ in cases])
    assert batch.pair_intersects(a, b) == [c[2] for c in cases] == batch.pair_intersects(b, a)
    assert batch.pair_distances(a, b) == pytest.approx([c[3] for c in cases])


def test_inside_exactly_where_rays_touch_edges():
    cube = box((0, 0, 0), (2, 2, 2))
    (triangles,) = distance.solid_triangles(cube)
    for point, want in (((1, 1, 1), True), ((1e-300, 1, 1), True), ((1, 1, 2 - 2**-52), True), ((1, 1, 3), False), ((-1e-300, 1, 1), False), ((3, 3, 3), False)):
        assert distance.inside_exactly(triangles, np.array(point, dtype=np.float64)) is want


def test_slices_nulls_and_systems_through_the_column_function():
    a = [box((k, 0, 0), (k + 1, 1, 1)) for k in range(8)]
    b = [box((k + 3, 0, 0), (k + 4, 1, 1)) for k in range(8)]
    a[2] = None
    column = lambda x: codec.encode(x).slice(1, 6)
    out = lib._run(lib.HEAVY["st_3ddistance"], True, (column(a), column(b)))
    assert out.to_pylist() == [2.0, None, 2.0, 2.0, 2.0, 2.0]
    a[3].crs, b[3].crs = "EPSG:7415", "EPSG:4326"
    assert lib._run(lib.HEAVY["st_3ddwithin"], False, (column(a), column(b), pa.array([2.0] * 6))).to_pylist() == [True, None, None, True, True, True]
    with pytest.raises(Exception, match="CRS"):
        lib._run(lib.HEAVY["st_3ddistance"], True, (column(a), column(b)))


def test_footprints_and_envelopes_of_batches(pairs):
    from voluma.kernel import measure

    values = [x for side in pairs for x in side] + [build.geometry_from_wkb(w) for w in (fx.polygon_z(), fx.warped_polygon_z(), fx.multi_polygon_z(), fx.line_z(), fx.multi_point_z())]
    values.append(build.geometry_from_text("POLYGON Z ((0 0 1, 9 0 1, 9 9 1, 0 9 1, 0 0 1), (1 1 1, 1 3 1, 3 3 1, 3 1 1, 1 1 1))"))
    values.append(build.geometry_from_text("POLYHEDRALSURFACE Z EMPTY"))
    column = codec.encode(values)
    want = [None if x is None else measure.footprint_area(x) for x in values]
    got = batch.footprints(column).to_pylist()
    assert [g is None for g in got] == [w is None for w in want]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], rel=1e-9, abs=1e-12)
    assert batch.footprints(column.slice(5, 300)).to_pylist() == got[5:305]
    assert batch.envelopes(column).to_pylist() == batch.envelopes(column.field("bbox")).to_pylist()
    assert batch.envelopes(column)[-1].as_py() is None and batch.envelopes(codec.encode([values[0]]))[0].as_py()[:5] == b"\x01\x03\x00\x00\x00"
