"""Polygons with holes and their measures a batch at a time: the row functions' values, without calling them."""

import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from voluma.functions import codec
from voluma.functions import library as lib
from voluma.kernel import build, predicates, signs, tiles
from voluma.kernel.triangulate import TILED, face_triangles


def star(draw, n, turn=1, reach=(2.0, 9.0)):
    angles = sorted(draw.sample(range(360), n))
    points = [(r * np.cos(np.radians(a)), r * np.sin(np.radians(a))) for a in angles for r in [draw.uniform(*reach)]]
    return points[::turn]


def frames(draw, count):
    """Stars with a hole about the centre, laid into planes that are turned at random; some by whole numbers."""
    out = []
    for k in range(count):
        outer, hole = star(draw, draw.choice((4, 5, 8)), draw.choice((1, -1))), star(draw, draw.choice((3, 4)), draw.choice((1, -1)), (0.2, 0.6))
        turn = np.linalg.qr(np.random.default_rng(k).normal(size=(3, 3)))[0] if k % 3 else np.eye(3)
        rings = [np.array([(*p, 0.0) for p in ring]) @ turn for ring in (outer, hole)]
        out.append([np.round(r) if k % 9 == 0 and i == 0 else r for i, r in enumerate(rings)])
    return out


def text(rings):
    return "POLYGON Z (" + ", ".join("(" + ", ".join(" ".join(map(repr, map(float, p))) for p in [*r, r[0]]) + ")" for r in rings) + ")"


def test_holes_are_tiled_as_one_by_one(monkeypatch):
    faces = frames(random.Random(3), 600) + [[np.array([(x, y, 0.0) for x, y in star(random.Random(k), 7)])] for k in range(100)]
    v = np.concatenate([r for f in faces for r in f])
    size, rings = np.array([len(r) for f in faces for r in f]), np.array([len(f) for f in faces])
    one_by_one = []
    monkeypatch.setattr(tiles, "face_triangles", lambda *given: one_by_one.append(face_triangles(*given)) or one_by_one[-1])
    counts, tri, outcome = tiles.tile(v, size, rings)
    assert sum(found == TILED for found, _ in one_by_one) < 0.01 * len(faces)  # the others have a hole that leaves the star
    at, low, ring = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(size)]), 0
    for k, f in enumerate(faces):
        want, triangles = face_triangles(v, [np.arange(low[ring + j], low[ring + j + 1]) for j in range(len(f))])
        assert outcome[k] == want and list(map(tuple, tri[at[k] : at[k + 1]].tolist())) == triangles
        ring += len(f)
    assert (outcome == TILED).mean() > 0.6


def refuse(*_):
    raise AssertionError("a row went through the row function")


@pytest.fixture
def batch_only(monkeypatch):
    for name in ("st_3dgeomfromtext", "st_3dperimeter", "st_isplanar", "st_3dintersects"):
        monkeypatch.setitem(lib.HEAVY, name, replace(lib.HEAVY[name], row=refuse))


def columns(count=40):
    words, points = [], []
    for k in range(count):
        w, d = 1 + k % 7, 1 + k % 5
        words.append(text([np.array([(0, 0, 0), (4 * w, 0, 0), (4 * w, 4 * d, 0), (0, 4 * d, 0)]), np.array([(w, d, 0), (w, 2 * d, 0), (2 * w, 2 * d, 0), (2 * w, d, 0)])]))
        points.append(f"POINT Z ({(0.5, 1.0, 1.5, 4.0, 9.0)[k % 5] * w} {1.5 * d} {k % 11 == 10:d})")
    return words, points


def test_measures_of_holes_in_batches(batch_only):
    words, points = columns()
    run = lambda name, *given: lib._run(lib.HEAVY[name], True, given)
    frames, probes = run("st_3dgeomfromtext", pa.array(words)), run("st_3dgeomfromtext", pa.array(points))
    assert frames.equals(codec.encode([build.geometry_from_text(w) for w in words]))
    assert run("st_3dperimeter", frames).to_pylist() == [10.0 * (1 + k % 7 + 1 + k % 5) for k in range(40)]
    assert run("st_isplanar", frames).to_pylist() == [True] * 40
    met = [k % 5 in (0, 1, 3) and k % 11 != 10 for k in range(40)]
    assert run("st_3dintersects", frames, probes).to_pylist() == met
    assert run("st_3dintersects", probes, frames).to_pylist() == met


def test_rows_of_all_kinds_keep_their_places():
    words = [*columns(6)[0], "POINT Z (1 2 3)", None, "POINT(1 2 3)", "POLYGON Z ((0 0 0, 2 0 0, 2 1 5, 0 1 0, 0 0 0))", "POLYGON Z ((0 0 0, 2 2 0, 2 0 0, 0 3 0, 0 0 0))", "LINESTRING Z (0 0 0, 1 1 1)", "x"]
    found = lib._run(lib.HEAVY["st_3dgeomfromtext"], False, (pa.array(words),))
    rows = lib._run(replace(lib.HEAVY["st_3dgeomfromtext"], flat=None), False, (pa.array(words),))
    assert found.equals(rows)
    for name in ("st_3dperimeter", "st_isplanar"):
        one_by_one = lib._run(replace(lib.HEAVY[name], flat=None), False, (found,)).to_pylist()
        assert lib._run(lib.HEAVY[name], False, (found,)).to_pylist() == pytest.approx(one_by_one), name


def test_signs_of_many():
    draw = random.Random(11)
    grids = (1.0, 0.25, 0.1, 1e-9, 3e7)
    rows = [[[g * draw.randint(-2, 2) + (1e6 if k % 7 == 0 else 0) for _ in "xyz"] for _ in range(5)] for k in range(3000) for g in [grids[k % 5]]]
    x = np.array(rows)
    p, q, t = x[:, 0], x[:, 1], x[:, 2:]
    assert signs.orient3d(t[:, 0], t[:, 1], t[:, 2], p).tolist() == [predicates.orient3d(r[2], r[3], r[4], r[0]) for r in rows]
    assert signs.orient2d(p[:, :2], q[:, :2], t[:, 0, :2]).tolist() == [predicates.orient2d(r[0][:2], r[1][:2], r[2][:2]) for r in rows]
    assert signs.in_triangle(p, t).tolist() == [predicates.in_triangle(r[0], *r[2:]) for r in rows]
    assert signs.segment_meets_triangle(p, q, t).tolist() == [predicates.segment_meets_triangle(*r) for r in rows]


def test_a_text_under_several_functions_is_read_once(monkeypatch):
    from voluma.kernel import bulk

    read, calls = bulk.flat_texts, []
    monkeypatch.setattr(bulk, "flat_texts", lambda *given: calls.append(1) or read(*given))
    words = pa.array(columns()[0])
    first, again = (lib._run(lib.HEAVY["st_3dgeomfromtext"], True, (words,)) for _ in range(2))
    other = lib._run(lib.HEAVY["st_3dgeomfromtext"], True, (words.slice(1),))
    assert first.equals(again) and other.equals(first.slice(1)) and len(calls) == 2
    kept = lib.HEAVY["st_3dgeomfromtext"].flat
    assert cloudpickle.loads(cloudpickle.dumps(kept)) is kept  # workers get it by name, not a copy for each function
