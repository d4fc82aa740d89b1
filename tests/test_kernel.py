"""The kernel alone, without Spark: golden values of small solids and geometries."""

import math
from fractions import Fraction

import numpy as np
import pytest

from voluma.kernel import build, crs, distance, hull, measure, predicates, text, triangulate, wkb
from voluma.kernel.shape import GeometryError
from voluma.sources import fixtures as fx

W = build.geometry_from_text
S = build.solid_from_wkb


def box(low, high):
    return S(fx.surface_wkb(fx.box_faces(low, high)))


def test_tetrahedron():
    t = S(fx.tetra())
    assert t.validation["is_valid"] and len(t.v) == 4 and t.n_faces == 4
    assert measure.volume(t) == pytest.approx(1 / 6, rel=1e-12)
    assert measure.footprint_area(t) == pytest.approx(0.5)
    assert measure.perimeter(t) == 0
    assert wkb.write(t) == fx.tetra()


def test_open_tetrahedron():
    t = S(fx.open_tetra())
    assert t.validation["open_edges"] == 3 and not t.validation["is_closed"] and t.validation["is_manifold"] and t.validation["is_oriented"]
    assert measure.perimeter(t) == pytest.approx(2 + math.sqrt(2))
    with pytest.raises(GeometryError, match="not closed"):
        measure.volume(t)


@pytest.mark.parametrize(("offset", "crossing"), [(0.5, True), (2.0, False), (5.0, False)])
def test_two_cubes(offset, crossing):
    t = S(fx.two_cubes(offset))
    v = t.validation
    assert v["is_closed"] and v["disconnected_shells"] == 1 and v["non_manifold_vertices"] == 0
    assert (v["self_intersections"] > 0) == crossing and not v["is_valid"]
    if not crossing:
        assert measure.volume(t) == 16


def test_hollow_cube():
    t = build.solid_with_sidecar(fx.hollow_cube(), '{"type": "Solid", "shells": [[6, 6]]}')
    assert t.validation["is_valid"] and t.n_shells == 2
    assert measure.volume(t) == 56 and measure.area(t) == 120
    plain = S(fx.hollow_cube())
    assert plain.n_shells == 1 and measure.volume(plain) == 56
    same = S(fx.surface_wkb(fx.box_faces((0, 0, 0), (4, 4, 4)) + fx.box_faces((1, 1, 1), (3, 3, 3))), [[6, 6]])
    assert not same.validation["is_oriented"]
    assert measure.area(build.shell_surface(t, 0)) == 96 and measure.area(build.shell_surface(t, 1)) == 24 and build.shell_surface(t, 2) is None


@pytest.mark.parametrize("apart", [5.0, 1e3, 1e6, 1e10])
def test_multi_cube(apart):
    t = S(fx.multi_cube(apart))
    assert t.n_solids == 2 and t.validation["is_valid"] and measure.volume(t) == 16 and measure.area(t) == 48
    assert wkb.write(t) == fx.multi_cube(apart)


def test_flat_solid_is_degenerate():
    for o in (0, 1, 1e3):
        t = build.scale(box((o, o, o), (o + 1, o + 1, o + 1)), 0, 1, 1)
        assert t.validation["degenerate_faces"] >= 2 and not t.validation["is_valid"]


def test_pinched_vertex_and_shared_vertex():
    a, b, c, d, p = (0, 0, 0), (1, 0, 0), (1, 2, 0), (0, 2, 0), (0.5, 1, 1)
    t = S(fx.surface_wkb([[a, b, p], [p, c, d], [b, a, d, c]]))
    assert t.validation["non_manifold_vertices"] == 1 and t.validation["disconnected_shells"] == 0
    t = S(fx.surface_wkb(fx.box_faces((0, 0, 0), (1, 1, 1)) + fx.box_faces((1, 1, 1), (2, 2, 2))))
    assert t.validation["disconnected_shells"] == 1 and t.validation["non_manifold_vertices"] == 0 and t.validation["self_intersections"] == 0


def test_cavities():
    outer = fx.box_faces((0, 0, 0), (10, 10, 10))
    hole = lambda lo, hi: fx.box_faces(lo, hi, inward=True)
    assert S(fx.surface_wkb(outer + hole((1, 1, 1), (3, 3, 3)) + hole((5, 5, 5), (7, 7, 7))), [[6, 6, 6]]).validation["is_valid"]
    assert not S(fx.surface_wkb(outer + hole((20, 20, 20), (21, 21, 21))), [[6, 6]]).validation["is_oriented"]
    assert not S(fx.surface_wkb(outer + hole((1, 1, 1), (5, 5, 5)) + hole((2, 2, 2), (3, 3, 3))), [[6, 6, 6]]).validation["is_oriented"]
    assert S(fx.surface_wkb(outer + hole((8, 8, 8), (12, 12, 12))), [[6, 6]]).validation["self_intersections"] > 0


def test_inconsistent_winding():
    faces = fx.box_faces((0, 0, 0), (1, 1, 1))
    faces[0] = faces[0][::-1]
    v = S(fx.surface_wkb(faces)).validation
    assert not v["is_oriented"] and v["is_closed"]


def test_triangulation():
    l_shape = W("POLYGON Z ((0 0 0, 2 0 0, 2 1 0, 1 1 0, 1 2 0, 0 2 0, 0 0 0))")
    assert measure.area(l_shape) == pytest.approx(3) and len(l_shape.tri) == 12
    hole = W("POLYGON Z ((0 0 0, 10 0 0, 10 10 0, 0 10 0, 0 0 0), (2 2 0, 2 6 0, 6 6 0, 6 2 0, 2 2 0))")
    assert measure.area(hole) == pytest.approx(84) and measure.perimeter(hole) == 56
    four = W("POLYGON Z ((0 0 0, 10 0 0, 10 10 0, 0 10 0, 0 0 0), (1 1 0, 2 1 0, 2 2 0, 1 1 0), (4 1 0, 5 1 0, 5 2 0, 4 1 0), (1 4 0, 2 4 0, 2 5 0, 1 4 0), (6 6 0, 8 6 0, 8 8 0, 6 6 0))")
    assert measure.area(four) == pytest.approx(100 - 1.5 - 2)
    assert measure.area(W("POLYGON Z ((0 0 0, 1 0 0, 2 0 0, 2 2 0, 0 2 0, 0 0 0))")) == pytest.approx(4)
    with pytest.raises(GeometryError, match="cannot be triangulated"):
        W("POLYGON Z ((0 0 0, 4 0 0, 1 3 0, 2 -1 0, 3 3 0, 0 0 0))")
    rng = np.random.default_rng(1)
    for n in (5, 17, 60):
        angle = np.sort(rng.uniform(0, 2 * np.pi, n))
        ring = np.stack([np.cos(angle), np.sin(angle), 0.3 * np.cos(angle)], axis=1) * rng.uniform(0.3, 1, n)[:, None]
        if np.diff(np.append(angle, angle[0] + 2 * np.pi)).max() < np.pi:
            outcome, found = triangulate.face_triangles(ring, [np.arange(n)])
            assert outcome == triangulate.TILED and len(found) == n - 2


def test_distances():
    d = lambda a, b: distance.distance(W(a), W(b))
    assert d("POINT Z (0 0 0)", "POINT Z (3 4 0)") == 5
    assert d("POINT Z (0 0 5)", "POLYGON Z ((-1 -1 0, 1 -1 0, 1 1 0, -1 1 0, -1 -1 0))") == 5
    assert d("LINESTRING Z (0 0 0, 1 0 0)", "LINESTRING Z (0.5 1 1, 0.5 -1 1)") == 1
    assert d("LINESTRING Z (0 0 -1, 0 0 1)", "POLYGON Z ((-1 -1 0, 1 -1 0, 1 1 0, -1 1 0, -1 -1 0))") == 0
    assert distance.max_distance(W("POINT Z (0 0 0)"), W("LINESTRING Z (1 0 0, 3 4 0)")) == 5
    assert d("POINT Z EMPTY", "POINT Z (0 0 0)") == math.inf


def test_distance_matches_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(30):
        tris = [rng.normal(size=(3, 3, 3)) + [shift, 0, 0] for shift in (0, rng.uniform(0, 4))]
        a, b = (distance.Elements(np.zeros((0, 3)), np.zeros((0, 2, 3)), t) for t in tris)
        got = distance.closest(a, b)
        grid = [(i / 12, j / 12) for i in range(13) for j in range(13 - i)]
        cloud = lambda t: np.concatenate([x[0] + u * (x[1] - x[0]) + v * (x[2] - x[0]) for x in t for u, v in grid]).reshape(-1, 3)
        near = min(np.linalg.norm(cloud(tris[0])[:, None] - cloud(tris[1])[None], axis=2).min(), 9e9)
        assert got[0] <= near + 1e-9 and near - got[0] < 0.6
        assert np.linalg.norm(got[1] - got[2]) == pytest.approx(got[0], abs=1e-9)
        assert distance.surfaces_meet(a, b) == (got[0] == 0)


def test_solids_are_volumes():
    b, big, small = box((0, 0, 0), (4, 4, 4)), box((0, 0, 0), (10, 10, 10)), box((4, 4, 4), (6, 6, 6))
    hollow = S(fx.hollow_cube(), [[6, 6]])
    point = lambda x, y, z: W(f"POINT Z ({x} {y} {z})")
    assert distance.distance(b, point(2, 2, 2)) == 0 and distance.intersects(point(2, 2, 2), b) and distance.within(b, point(2, 2, 2), 0)
    assert distance.distance(b, point(2, 2, 6)) == 2 and not distance.intersects(b, point(2, 2, 6)) and not distance.within(b, point(2, 2, 6), 1.5)
    assert distance.distance(big, small) == 0 and distance.intersects(small, big)
    assert distance.distance(hollow, point(2, 2, 2)) == 1 and not distance.intersects(hollow, point(2, 2, 2)) and distance.distance(hollow, point(0.5, 2, 2)) == 0
    assert distance.intersects(b, box((4, 0, 0), (5, 4, 4)))
    with pytest.raises(GeometryError, match="not valid"):
        distance.distance(S(fx.open_tetra()), b)


def test_exact_intersection():
    near = float(np.nextafter(1.0, 2))
    wall = W("POLYGON Z ((0 0 1, 4 0 1, 4 4 1, 0 4 1, 0 0 1))")
    assert distance.intersects(wall, W("POINT Z (1 2 1)")) and not distance.intersects(wall, W(f"POINT Z (1 2 {near!r})"))
    assert predicates.orient3d((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)) == 1
    for i in range(8):
        for j in range(8):
            p = (0.5 + i * 2**-53, 0.5 + j * 2**-53)
            exact = (Fraction(12) - Fraction(p[0])) * 0 + (Fraction(12) - 0) * 0
            want = (Fraction(24) - Fraction(12)) * (Fraction(p[1]) - 12) - (Fraction(24) - Fraction(12)) * (Fraction(p[0]) - 12) + exact
            assert predicates.orient2d((12, 12), (24, 24), p) == (want > 0) - (want < 0)


def test_hulls():
    lattice = "MULTIPOINT Z (" + ", ".join(f"{x} {y} {z}" for x in range(5) for y in range(5) for z in range(5)) + ")"
    cube = build.make_solid(hull.convex_hull(W(lattice)))
    assert cube.n_faces == 6 and measure.volume(cube) == 64 and measure.area(cube) == 96
    prism = build.extrude(W("POLYGON Z ((0 0 0, 2 0 0, 2 1 0, 1 1 0, 1 2 0, 0 2 0, 0 0 0))"), 2.0)
    assert measure.volume(prism) == pytest.approx(6)
    assert measure.centroid(prism) == pytest.approx([5 / 6, 5 / 6, 1])
    hulled = build.make_solid(hull.convex_hull(prism))
    assert hulled.n_faces == 7 and measure.volume(hulled) == pytest.approx(7)
    assert text.wkt(hull.convex_hull(W("MULTIPOINT Z (0 0 0, 2 0 2, 2 2 2, 0 2 0, 1 1 1, 1 0 1)"))) == "POLYGON Z ((0 0 0, 2 0 2, 2 2 2, 0 2 0, 0 0 0))"
    assert text.wkt(hull.convex_hull(W("MULTIPOINT Z (1 0 2, 3 0 4, 0 0 1, 2 0 3)"))) == "LINESTRING Z (0 0 1, 3 0 4)"
    assert text.wkt(hull.footprint_hull(W("POLYGON Z ((0 0 1, 4 0 3, 0 3 5, 0 0 1))"))) == "POLYGON Z ((0 0 1, 4 0 1, 0 3 1, 0 0 1))"
    rng = np.random.default_rng(3)
    for _ in range(5):
        cloud = rng.normal(size=(40, 3))
        h = build.make_solid(hull.convex_hull(W("MULTIPOINT Z (" + ", ".join(" ".join(map(repr, map(float, p))) for p in cloud) + ")")))
        assert h.validation["is_valid"]


def test_reprojection():
    x, y, z = crs.transform(np.array([[8.0, 0.0, 5.0]]), "EPSG:4326", "EPSG:3857")[0]
    assert round(x, 1) == 890555.9 and abs(y) < 1e-6 and z == 5
    lon, lat, _ = crs.transform(np.array([[85000.0, 446800.0, 5.0]]), "EPSG:28992", "EPSG:4326")[0]
    assert "%.9g %.9g" % (lon, lat) == "4.3677243 52.0051517"
    for target in ("EPSG:3857", "EPSG:28992", "EPSG:32631"):
        there = crs.transform(np.array([[4.36, 52.0, 7.5]]), "EPSG:4326", target)
        assert crs.transform(there, target, "EPSG:4326")[0] == pytest.approx([4.36, 52.0, 7.5], abs=1e-8)
    with pytest.raises(GeometryError, match="cannot build transform"):
        crs.transform(np.zeros((1, 3)), "EPSG:4326", "EPSG:99999999")
    assert crs.canonical("epsg:28992") == crs.canonical('{"id":{"authority":"EPSG","code":28992}}')


def test_text_round_trip():
    for words in ("POINT Z (1 2 3)", "LINESTRING Z (0 0 0, 1 1 1, 2 0 -1.5)", "POLYGON Z ((0 0 0, 4 0 0, 4 4 0, 0 4 0, 0 0 0), (1 1 0, 1 2 0, 2 2 0, 1 1 0))", "MULTIPOINT Z ((1 2 3), (4 5 6))", "MULTILINESTRING Z ((0 0 0, 1 1 1), (2 2 2, 3 3 3))", "MULTIPOLYGON Z (((0 0 0, 1 0 0, 1 1 0, 0 0 0)), ((5 5 5, 6 5 5, 6 6 5, 5 5 5)))", "POLYHEDRALSURFACE Z (((0 0 0, 0 1 0, 1 0 0, 0 0 0)))", "POINT Z EMPTY", "LINESTRING Z EMPTY", "MULTIPOINT Z EMPTY"):
        g = W(words)
        assert text.wkt(g) == words
        assert text.wkt(build.geometry_from_wkb(wkb.write(g))) == words
    assert wkb.write(W("POINT(1e3 -2.5E-2 .5)")).hex() == "01e90300000000000000408f409a999999999999bf000000000000e03f"
    assert W("SRID=28992;POINT Z (1 2 3)").crs == "EPSG:28992"
    for bad, what in (("POINT (1 2)", "needs a Z"), ("POINT ZM (1 2 3 4)", "no M"), ("CIRCULARSTRING Z (0 0 0)", "no class"), ("POINT Z (1 2 3", "offset"), ("POINT Z (1 2 3) x", "offset")):
        with pytest.raises(GeometryError, match=what):
            W(bad)
    assert text.geojson(W("POLYHEDRALSURFACE Z (((0 0 0, 0 1 0, 1 0 0, 0 0 0)))")) == '{"type":"MultiPolygon","coordinates":[[[[0,0,0],[0,1,0],[1,0,0],[0,0,0]]]]}'


def test_bad_wkb():
    for data, what in ((b"", "empty"), (fx.tetra()[:50], "truncated|exceeds"), (fx.point_z(1, 2, 3), "type code 1001")):
        with pytest.raises(GeometryError, match=what):
            S(data)
    ewkb = bytes.fromhex("01010000a0406f0000") + fx.point_z(1, 2, 3)[5:]
    assert build.geometry_from_wkb(ewkb).crs == "EPSG:28480"
    big = b"\x00" + (1001).to_bytes(4, "big") + np.array([1, 2, 3], dtype=">f8").tobytes()
    assert build.geometry_from_wkb(big).v.tolist() == [[1, 2, 3]]
    for props, what in (('{"shells": [6, 6]}', "array of arrays"), ('{"shells": [[6], [6]]}', "solid count"), ('{"shells": [[5, 6]]}', "mismatch"), ("{", "invalid"), ('{"shells": []}', "solid count")):
        with pytest.raises(GeometryError, match=what):
            build.solid_with_sidecar(fx.hollow_cube(), props)
    assert build.solid_with_sidecar(fx.hollow_cube(), '{"shells": [[6, 0, 6]]}').n_shells == 2
    assert build.solid_with_sidecar(fx.hollow_cube(), "{}").n_shells == 1


def test_maps_keep_measures():
    t = S(fx.hollow_cube(), [[6, 6]])
    for axis in range(3):
        r = build.rotate(t, axis, 0.7)
        assert measure.volume(r) == pytest.approx(56, rel=1e-12) and measure.area(r) == pytest.approx(120, rel=1e-12)
    assert measure.volume(build.scale(t, 2, 3, 0.5)) == pytest.approx(56 * 3)
    p = W("POINT Z (10 20 30)")
    placed = build.place_implicit(t, p, [-2.0, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1])
    assert placed.validation["is_valid"] and measure.volume(placed) == 448
    with pytest.raises(GeometryError, match="singular"):
        build.place_implicit(t, p, [1.0, 0, -1, 0, 0, 1, -1, 0, 0, 0, 0, 0, 0, 0, 0, 1])
    with pytest.raises(GeometryError, match="16 values"):
        build.place_implicit(t, p, [1.0])


def test_warped_neighbours_are_not_crossing():
    # a slab with one raised top corner is warped but sound
    f = fx.box_faces((0, 0, 0), (10, 10, 0.5))
    f = [[(x, y, 0.52 if (x, y, z) == (10, 10, 0.5) else z) for x, y, z in face] for face in f]
    assert S(fx.surface_wkb(f)).validation["self_intersections"] == 0
    turned = build.rotate(build.rotate(S(fx.two_cubes(0.5)), 0, 0.3), 2, 1.1)
    again = S(wkb.write(turned))
    assert again.validation["self_intersections"] > 0


def test_bulk_import_gives_the_same_values():
    import dataclasses
    import random

    from voluma.kernel import bulk

    rng = random.Random(1)

    def odd():
        f, k = fx.box_faces((0, 0, 0), (2, 3, 4)), rng.random()
        if k < 0.2:
            f[rng.randrange(6)].reverse()
        elif k < 0.3:
            f.pop(rng.randrange(6))
        elif k < 0.5:
            corner = rng.choice(f[0])
            other = tuple(x + rng.uniform(-1.5, 1.5) for x in corner)
            f = [[other if q == corner else q for q in face] for face in f]
        elif k < 0.6:
            f = [[(x, y, 0.0) for x, y, _ in face] for face in f]
        elif k < 0.7:
            f += fx.box_faces((1, 1, 1), (5, 5, 5))
        elif k < 0.8:
            f = [[(x * 1e-9, y * 1e-9, z * 1e-9) for x, y, z in face] for face in f]
        elif k < 0.9:
            f = fx.box_faces((0, 0, 0), (2, 3, 4), inward=True)
        return fx.surface_wkb(f)

    data = [fx.tetra(), fx.open_tetra(), fx.hollow_cube(), fx.multi_cube(), fx.two_cubes(0.5), fx.two_cubes(2), fx.two_cubes(5), fx.point_z(1, 2, 3)]
    data += [fx.surface_wkb(fx.box_faces((i, 0, 0), (i + 2, 1 + i % 5, 3))) for i in range(30)] + [odd() for _ in range(200)]
    rng.shuffle(data)
    found = bulk.sound_solids([bulk.plain_rings(d) for d in data])
    assert sum(x is not None for x in found) > 50
    for d, fast in zip(data, found, strict=True):
        if fast is not None:
            slow = S(d)
            for field in dataclasses.fields(fast):
                a, b = getattr(fast, field.name), getattr(slow, field.name)
                assert np.array_equal(a, b) if isinstance(a, np.ndarray) else a == b, field.name
