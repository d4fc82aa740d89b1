"""The registered queries over 3D geometry and their plain-SQL counterparts.

The driver's tables hold no geometry, so shapes with whole-number coordinates are derived from their keys, and
the SQL side answers in closed form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voluma.functions import library as lib
from voluma.operators.joins import dwithin_join, intersects_join
from voluma.sources.fixtures import box_faces, tetra_faces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

call, native = lib.call, lib.native


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt over all cores before shapes are made of them: a small file is a task or two, and its shapes are work for many."""
    context = rows.sparkSession
    n = max(4 * context.sparkContext.defaultParallelism, int(context.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "k")


# --- shapes from keys ------------------------------------------------------------------------------------


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _ring(*points) -> list:
    out: list = ["("]
    for k, p in enumerate([*points, points[0]]):
        out += [", "] if k else []
        for n, c in enumerate(p):
            out += [" "] if n else []
            out.append(c)
    return [*out, ")"]


def _rectangle(x, y, z, w, d) -> Column:
    z0 = F.lit(z) if not isinstance(z, Column) else z
    return _text("POLYGON Z (", *_ring((x, y, z0), (x + w, y, z0), (x + w, y + d, z0), (x, y + d, z0)), ")")


def _surface(faces: list) -> Column:
    parts: list = ["POLYHEDRALSURFACE Z ("]
    for k, face in enumerate(faces):
        parts += [", (" if k else "(", *_ring(*face), ")"]
    return _text(*parts, ")")


def _cube(low: Column, high: Column, inward: bool = False) -> list:
    pick = {0: low, 1: high}
    return [[tuple(pick[c] for c in corner) for corner in face] for face in box_faces((0, 0, 0), (1, 1, 1), inward)]


def _solid(text: Column, sidecar: Column | None = None) -> Column:
    wkb = call("st_3dasbinary", call("st_3dgeomfromtext", text))
    return call("st_3dfromwkb", wkb, F.lit(None).cast("string") if sidecar is None else sidecar)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, w, d, h, x, y, base (polygon) and g (its prism) for each part."""
    key = F.col("p_partkey")
    rows = _read(spark, sf_dir, "part").select(
        key.alias("k"), (1 + key % 7).alias("w"), (1 + F.col("p_size") % 5).alias("d"), (1 + key % 11).alias("h"), (10 * (key % 100)).alias("x"), (10 * F.floor(key / 100)).alias("y")
    )
    based = _spread(rows).withColumn("base", call("st_3dgeomfromtext", _rectangle(F.col("x"), F.col("y"), 0, F.col("w"), F.col("d"))))
    return based.withColumn("g", call("st_3dextrude", "base", F.col("h").cast("double")))


_BOXES = "(SELECT p_partkey AS k, 1 + p_partkey % 7 AS w, 1 + p_size % 5 AS d, 1 + p_partkey % 11 AS h, 10 * (p_partkey % 100) AS x, 10 * (p_partkey // 100) AS y FROM part) AS b"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, x, y, z and g (a point) for each customer."""
    key = F.col("c_custkey")
    rows = _read(spark, sf_dir, "customer").select(key.alias("k"), (key % 97).alias("x"), (key % 89).alias("y"), (key % 83).alias("z"))
    return _spread(rows).withColumn("g", call("st_3dgeomfromtext", _text("POINT Z (", F.col("x"), " ", F.col("y"), " ", F.col("z"), ")")))


_POINTS = "(SELECT c_custkey AS k, c_custkey % 97 AS x, c_custkey % 89 AS y, c_custkey % 83 AS z FROM customer) AS p"


def hollows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, n and g: a cube of side n with a cavity one off its walls, for each supplier."""
    n = F.col("n")
    rows = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (3 + F.col("s_suppkey") % 5).alias("n"))
    zero = F.lit(0)
    faces = _cube(zero, n) + _cube(F.lit(1), n - 1, inward=True)
    return _spread(rows).withColumn("wkb", call("st_3dasbinary", call("st_3dgeomfromtext", _surface(faces)))).withColumn("g", call("st_3dfromwkb", "wkb", F.lit('{"type": "Solid", "shells": [[6, 6]]}')))


_HOLLOWS = "(SELECT s_suppkey AS k, 3 + s_suppkey % 5 AS n FROM supplier) AS s"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, o and g: two cubes of side 2 as a collection, the second o away, for each supplier."""
    rows = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (5 + F.col("s_suppkey") % 9).alias("o"))
    one = lambda low: call("st_3dasbinary", call("st_3dgeomfromtext", _surface(_cube(low, low + 2))))
    both = F.concat(F.unhex(F.lit("01EF03000002000000")), one(F.lit(0)), one(F.col("o")))
    return _spread(rows).withColumn("g", call("st_3dfromwkb", both, F.lit(None).cast("string")))


_PAIRS = "(SELECT s_suppkey AS k, 5 + s_suppkey % 9 AS o FROM supplier) AS s"


def tetras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, m and g: a right tetrahedron of leg m for each supplier, without its base where k is odd."""
    m = (1 + F.col("s_suppkey") % 6).alias("m")
    rows = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), m)
    faces = [[tuple(F.lit(0) if c == 0 else F.col("m") for c in corner) for corner in face] for face in tetra_faces()]
    text = F.when(F.col("k") % 2 == 0, _surface(faces)).otherwise(_surface(faces[1:]))
    return _spread(rows).withColumn("g", _solid(text))


_TETRAS = "(SELECT s_suppkey AS k, 1 + s_suppkey % 6 AS m FROM supplier) AS s"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, m and g: the line (0 0 0, 3m 4m 0, 3m 4m 12) for each order."""
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (1 + F.col("o_orderkey") % 9).alias("m"))
    return _spread(rows).withColumn("g", call("st_3dgeomfromtext", _text("LINESTRING Z (0 0 0, ", 3 * F.col("m"), " ", 4 * F.col("m"), " 0, ", 3 * F.col("m"), " ", 4 * F.col("m"), " 12)")))


_LINES = "(SELECT o_orderkey AS k, 1 + o_orderkey % 9 AS m FROM orders) AS o"


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, a and g: a square of side 10 with a square hole of side a, for each supplier."""
    a = F.col("a")
    rows = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (1 + F.col("s_suppkey") % 7).alias("a"))
    outer = [(F.lit(x), F.lit(y), F.col("k")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))]
    inner = [(F.lit(1), F.lit(1), F.col("k")), (F.lit(1), a + 1, F.col("k")), (a + 1, a + 1, F.col("k")), (a + 1, F.lit(1), F.col("k"))]
    return _spread(rows).withColumn("g", call("st_3dgeomfromtext", _text("POLYGON Z (", *_ring(*outer), ", ", *_ring(*inner), ")")))


_WELLS = "(SELECT s_suppkey AS k, 1 + s_suppkey % 7 AS a FROM supplier) AS s"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with a point p at (x + px, y + py, pz), inside some and outside others."""
    k = F.col("k")
    moved = boxes(spark, sf_dir).withColumns({"px": k % 9 - 2, "py": k % 13 - 3, "pz": k % 17 - 4})
    return moved.withColumn("p", call("st_3dgeomfromtext", _text("POINT Z (", F.col("x") + F.col("px"), " ", F.col("y") + F.col("py"), " ", F.col("pz"), ")")))


_PROBES = f"(SELECT *, k % 9 - 2 AS px, k % 13 - 3 AS py, k % 17 - 4 AS pz FROM {_BOXES}) AS b"
_GAP = "sqrt(power(greatest(0, -px, px - w), 2) + power(greatest(0, -py, py - d), 2) + power(greatest(0, -pz, pz - h), 2))"


# --- registration -----------------------------------------------------------------------------------------


def query(name: str, source, columns: dict[str, Column | str], oracle_from: str | None, oracle: dict[str, str] | None) -> None:
    """A query that selects k and ``columns`` of ``source``; ``oracle`` has the SQL for each column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = {n: (c() if callable(c) else c) for n, c in columns.items()}
        return source(spark, sf_dir).select("k", *[c.alias(n) for n, c in made.items()])

    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = "SELECT CAST(k AS BIGINT) AS k, " + ", ".join(f"{sql} AS {n}" for n, sql in oracle.items()) + f" FROM {oracle_from}"


def g(name: str, *more) -> Callable[[], Column]:
    return lambda: call(name, "g", *more) if name in lib.HEAVY else native(name, F.col("g"))


def rounded(name: str, *more, digits: int = 6) -> Callable[[], Column]:
    return lambda: F.round(call(name, "g", *more), digits)


def D(sql: str) -> str:  # noqa: N802
    return f"CAST({sql} AS DOUBLE)"


def _box_of(column: Callable[[], Column]) -> dict[str, Callable[[], Column]]:
    return {f"{e}_{a}": (lambda f: lambda: F.round(column()["bbox"][f], 6) + 0.0)(f"{e}_{a}") for e in ("min", "max") for a in "xyz"}


_CORNERS = {"min_x": D("x"), "min_y": D("y"), "min_z": D("0"), "max_x": D("x + w"), "max_y": D("y + d"), "max_z": D("h")}

# import, construction, export
query("st_3dextrude", boxes, {"faces": lambda: native("st_3dnumfaces", F.col("g")), "volume": g("st_3dvolume")}, _BOXES, {"faces": "CAST(6 AS BIGINT)", "volume": D("w * d * h")})
query("st_3dfromwkb", hollows, {"shells": lambda: native("st_3dnumshells", F.col("g")), "volume": g("st_3dvolume")}, _HOLLOWS, {"shells": "CAST(2 AS BIGINT)", "volume": D("n * n * n - (n - 2) * (n - 2) * (n - 2)")})
query("st_3dtryfromwkb", hollows, {"good": lambda: lib.st_3dtryfromwkb(F.col("wkb")).isNotNull(), "bad": lambda: lib.st_3dtryfromwkb(F.substring(F.col("wkb"), 1, 40)).isNull()}, _HOLLOWS, {"good": "TRUE", "bad": "TRUE"})
query("st_geom3dfromwkb", points, {"text": lambda: call("st_3dastext", call("st_geom3dfromwkb", call("st_3dasbinary", "g")))}, _POINTS, {"text": "'POINT Z (' || x || ' ' || y || ' ' || z || ')'"})
query("st_3dgeomfromtext", points, {"x": g("st_3dx"), "y": g("st_3dy"), "z": g("st_3dz")}, _POINTS, {"x": D("x"), "y": D("y"), "z": D("z")})
query("st_makesolid", hollows, {"volume": lambda: call("st_3dvolume", call("st_makesolid", call("st_3dexteriorshell", "g")))}, _HOLLOWS, {"volume": D("n * n * n")})
query("st_force3d", points, {"text": lambda: call("st_3dastext", native("st_force3d", F.col("g")))}, _POINTS, {"text": "'POINT Z (' || x || ' ' || y || ' ' || z || ')'"})
query("st_3daswkb", pairs, {"size": lambda: F.length(call("st_3daswkb", "g")), "volume": lambda: call("st_3dvolume", call("st_3dfromwkb", call("st_3daswkb", "g"), F.lit(None).cast("string")))}, _PAIRS, {"size": "CAST(9 + 2 * (9 + 6 * (13 + 5 * 24)) AS INTEGER)", "volume": D("16")})
query("st_3dasbinary", points, {"wkb": lambda: F.hex(call("st_3dasbinary", "g"))}, _POINTS, {"wkb": "hex(ST_AsWKB(CAST('POINT Z (' || x || ' ' || y || ' ' || z || ')' AS GEOMETRY)))"})
query("st_3dastext", boxes, {"text": lambda: call("st_3dastext", "base")}, _BOXES, {"text": "'POLYGON Z ((' || x || ' ' || y || ' 0, ' || (x + w) || ' ' || y || ' 0, ' || (x + w) || ' ' || (y + d) || ' 0, ' || x || ' ' || (y + d) || ' 0, ' || x || ' ' || y || ' 0))'"})
query("st_3dasgeojson", points, {"json": g("st_3dasgeojson")}, _POINTS, {"json": "'{\"type\":\"Point\",\"coordinates\":[' || x || ',' || y || ',' || z || ']}'"})
query("cast_rebuild", boxes, {"volume": lambda: call("st_3dvolume", call("g3d_rebuild", F.col("g").withField("validation.is_valid", F.lit(False)))), "valid": lambda: call("g3d_rebuild", F.col("g").withField("validation.is_valid", F.lit(False)))["validation"]["is_valid"]}, _BOXES, {"volume": D("w * d * h"), "valid": "TRUE"})

query(
    "cast_payload",
    boxes,
    {
        "volume": lambda: call("st_3dvolume", call("g3d_solid_from_payload", call("g3d_to_payload", "g"))),
        "of_text": lambda: call("st_3dvolume", call("g3d_from_payload", call("g3d_payload_text", call("g3d_to_payload", "g")))),
        "other_kind": lambda: call("g3d_geom_from_payload", call("g3d_to_payload", "g"), strict=False).isNull(),
        "no_payload": lambda: call("g3d_from_payload", call("st_3daswkb", "g"), strict=False).isNull(),
    },
    _BOXES,
    {"volume": D("w * d * h"), "of_text": D("w * d * h"), "other_kind": "TRUE", "no_payload": "TRUE"},
)
query(
    "struct_sidecar",
    hollows,
    {
        "shells": lambda: native("st_3dnumshells", call("st_3dfromwkb", "wkb", F.struct(F.lit("Solid").alias("type"), F.array(F.array(F.lit(6), F.lit(6)).cast("array<bigint>")).alias("shells")))),
        "without": lambda: native("st_3dnumshells", call("st_3dfromwkb", "wkb")),
    },
    _HOLLOWS,
    {"shells": "CAST(2 AS BIGINT)", "without": "CAST(1 AS BIGINT)"},
)
query("try_twin", tetras, {"volume": lambda: call("st_3dvolume", "g", strict=False)}, _TETRAS, {"volume": "CASE WHEN k % 2 = 0 THEN m * m * m / 6.0::DOUBLE END"})
query("crs_rule", points, {"unlike": lambda: call("st_3ddistance", lib.st_3dsetcrs(F.col("g"), F.lit("EPSG:7415")), "g", strict=False).isNull(), "alike": lambda: call("st_3ddistance", "g", "g")}, _POINTS, {"unlike": "TRUE", "alike": D("0")})


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hollows, and cubes in the cavity, in the wall, around the whole, and off a corner."""
    at = {"inner": (F.lit(1.25), F.lit(1.5)), "wall": (F.lit(0.25), F.lit(0.75)), "around": (F.lit(-1), F.col("n") + 1), "off": (F.col("n") + 1, F.col("n") + 2)}
    return hollows(spark, sf_dir).withColumns({name: _solid(_surface(_cube(*corners))) for name, corners in at.items()})


query(
    "nested_solids",
    nested,
    {f"{name}_{what}": (lambda f, n: lambda: call(f, "g", n))(f, name) for name in ("inner", "wall", "around", "off") for what, f in (("far", "st_3ddistance"), ("meet", "st_3dintersects"))},
    _HOLLOWS,
    {"inner_far": D("0.25"), "inner_meet": "FALSE", "wall_far": D("0"), "wall_meet": "TRUE", "around_far": D("0"), "around_meet": "TRUE", "off_far": "sqrt(3::DOUBLE)", "off_meet": "FALSE"},
)


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, w, d, h, frame (a polygon of 4 w x 4 d with a hole of w x d) and warped (one corner raised by h) for each part."""
    w, d, h, zero = F.col("w"), F.col("d"), F.col("h"), F.lit(0)
    outer, inner = _ring((zero, zero, zero), (4 * w, zero, zero), (4 * w, 4 * d, zero), (zero, 4 * d, zero)), _ring((w, d, zero), (w, 2 * d, zero), (2 * w, 2 * d, zero), (2 * w, d, zero))
    warped = _text("POLYGON Z (", *_ring((zero, zero, zero), (w, zero, zero), (w, d, h), (zero, d, zero)), ")")
    return boxes(spark, sf_dir).select("k", "w", "d", "h", call("st_3dgeomfromtext", _text("POLYGON Z (", *outer, ", ", *inner, ")")).alias("frame"), call("st_3dgeomfromtext", warped).alias("warped"))


query(
    "holed_and_warped",
    holed,
    {
        "area": lambda: call("st_3darea", "frame"),
        "footprint": lambda: call("st_3dfootprintarea", "frame"),
        "around": lambda: call("st_3dperimeter", "frame"),
        "planar": lambda: call("st_isplanar", "frame"),
        "bent": lambda: call("st_isplanar", "warped"),
        "in_hole": lambda: call("st_3dintersects", "frame", call("st_3dgeomfromtext", _text("POINT Z (", F.col("w") * 1.5, " ", F.col("d") * 1.5, " 0)"))),
    },
    _BOXES,
    {"area": D("15 * w * d"), "footprint": D("15 * w * d"), "around": D("10 * (w + d)"), "planar": "TRUE", "bent": "FALSE", "in_hole": "FALSE"},
)

# header facts
query("st_3dbounds", boxes, {f"{e}_{a}": (lambda f: lambda: native("st_3dbounds", F.col("g"))[f])(f"{e}_{a}") for e in ("min", "max") for a in "xyz"}, _BOXES, _CORNERS)
for _a in "xyz":
    for _e in ("min", "max"):
        query(f"st_3d{_a}{_e}", boxes, {"v": g(f"st_3d{_a}{_e}")}, _BOXES, {"v": _CORNERS[f"{_e}_{_a}"]})
query("st_3denvelope", boxes, {"size": lambda: F.length(call("st_3denvelope", "g")), "flat": lambda: F.length(call("st_3denvelope", call("st_3dcentroid", "g")))}, _BOXES, {"size": "CAST(93 AS INTEGER)", "flat": "CAST(21 AS INTEGER)"})
query("st_3dnumsolids", pairs, {"n": g("st_3dnumsolids")}, _PAIRS, {"n": "CAST(2 AS BIGINT)"})
query("st_3dnumshells", hollows, {"n": g("st_3dnumshells")}, _HOLLOWS, {"n": "CAST(2 AS BIGINT)"})
query("st_3dnumfaces", tetras, {"n": g("st_3dnumfaces")}, _TETRAS, {"n": "CAST(4 - k % 2 AS BIGINT)"})
query("st_ndims", boxes, {"n": g("st_ndims")}, _BOXES, {"n": "CAST(3 AS INTEGER)"})
query("st_coorddim", points, {"n": g("st_coorddim")}, _POINTS, {"n": "CAST(3 AS INTEGER)"})
query("st_3dhasz", points, {"z": g("st_3dhasz")}, _POINTS, {"z": "TRUE"})
query("st_3dgeometrytype", boxes, {"base": lambda: native("st_3dgeometrytype", F.col("base")), "centre": lambda: native("st_3dgeometrytype", call("st_3dcentroid", "g"))}, _BOXES, {"base": "'ST_Polygon'", "centre": "'ST_Point'"})
query("st_3ddimension", lines, {"n": g("st_3ddimension")}, _LINES, {"n": "CAST(1 AS INTEGER)"})
query("st_3dnumgeometries", hollows, {"n": lambda: native("st_3dnumgeometries", call("st_3dexteriorshell", "g"))}, _HOLLOWS, {"n": "CAST(6 AS INTEGER)"})
for _a in "xyz":
    query(f"st_3d{_a}", points, {"v": g(f"st_3d{_a}")}, _POINTS, {"v": D(_a)})
query("st_isplanar", wells, {"flat": g("st_isplanar")}, _WELLS, {"flat": "TRUE"})

# faces, shells, parts
QUERIES["st_3dfaces"] = lambda spark, d: boxes(spark, d).select("k", F.inline(call("st_3dfaces", "g"))).select("k", "face", "solid", "shell", F.round(call("st_3darea", "polygon"), 6).alias("area"))
ORACLES["st_3dfaces"] = f"SELECT CAST(k AS BIGINT) AS k, CAST(f AS INTEGER) AS face, CAST(1 AS INTEGER) AS solid, CAST(1 AS INTEGER) AS shell, {D('CASE WHEN f <= 2 THEN w * d WHEN f % 2 = 1 THEN w * h ELSE d * h END')} AS area FROM {_BOXES}, range(1, 7) AS r(f)"
query("st_3dfacen", boxes, {"area": lambda: call("st_3darea", call("st_3dfacen", "g", F.lit(3))), "none": lambda: call("st_3dfacen", "g", F.lit(7)).isNull()}, _BOXES, {"area": D("w * h"), "none": "TRUE"})
query("st_3dfaceareas", boxes, {"total": lambda: F.aggregate(call("st_3dfaceareas", "g"), F.lit(0.0), lambda a, x: a + x), "first": lambda: call("st_3dfaceareas", "g")[0]}, _BOXES, {"total": D("2 * (w * d + w * h + d * h)"), "first": D("w * d")})
query("st_3dfacenormals", boxes, {"down": lambda: call("st_3dfacenormals", "g")[0]["z"], "east": lambda: call("st_3dfacenormals", "g")[3]["x"]}, _BOXES, {"down": D("-1"), "east": D("1")})
query("st_3dfaceslopes", boxes, {"level": lambda: lib.st_3dfaceslopes(F.col("g"))[1], "wall": lambda: lib.st_3dfaceslopes(F.col("g"))[2]}, _BOXES, {"level": D("0"), "wall": D("90")})
query("st_3dfaceazimuths", boxes, {"level": lambda: lib.st_3dfaceazimuths(F.col("g"))[0], "south": lambda: lib.st_3dfaceazimuths(F.col("g"))[2], "west": lambda: lib.st_3dfaceazimuths(F.col("g"))[5]}, _BOXES, {"level": "CAST(NULL AS DOUBLE)", "south": D("180"), "west": D("270")})
query("st_3dexteriorshell", hollows, {"area": lambda: call("st_3darea", call("st_3dexteriorshell", "g"))}, _HOLLOWS, {"area": D("6 * n * n")})
query("st_3dnuminteriorshells", hollows, {"n_inner": g("st_3dnuminteriorshells")}, _HOLLOWS, {"n_inner": "CAST(1 AS INTEGER)"})
query("st_3dinteriorshelln", hollows, {"area": lambda: call("st_3darea", call("st_3dinteriorshelln", "g", F.lit(1)))}, _HOLLOWS, {"area": D("6 * (n - 2) * (n - 2)")})
query("st_3dgeometryn", pairs, {"low": lambda: call("st_3dgeometryn", "g", F.lit(2))["bbox"]["min_x"], "none": lambda: call("st_3dgeometryn", "g", F.lit(3)).isNull()}, _PAIRS, {"low": D("o"), "none": "TRUE"})
query("st_3dgeometryn_geom", hollows, {"area": lambda: call("st_3darea", call("st_3dgeometryn", call("st_3dexteriorshell", "g"), F.lit(2)))}, _HOLLOWS, {"area": D("n * n")})

# validation
query("st_3disvalid", tetras, {"v": g("st_3disvalid")}, _TETRAS, {"v": "k % 2 = 0"})
query("st_3disclosed", tetras, {"v": g("st_3disclosed")}, _TETRAS, {"v": "k % 2 = 0"})
query("st_3dismanifold", tetras, {"v": g("st_3dismanifold")}, _TETRAS, {"v": "TRUE"})
query("st_3disoriented", tetras, {"v": g("st_3disoriented")}, _TETRAS, {"v": "TRUE"})
query("st_3dvalidationreport", tetras, {"code": lambda: native("st_3dvalidationreport", F.col("g"))["code"], "message": lambda: native("st_3dvalidationreport", F.col("g"))["message"], "open_edges": lambda: native("st_3dvalidationreport", F.col("g"))["open_edge_count"]}, _TETRAS, {"code": "CASE WHEN k % 2 = 0 THEN 'VALID' ELSE 'INVALID' END", "message": "CASE WHEN k % 2 = 0 THEN 'Valid solid' ELSE 'Invalid solid: not closed' END", "open_edges": "CAST(3 * (k % 2) AS BIGINT)"})

# measures
query("st_3dvolume", boxes, {"v": rounded("st_3dvolume")}, _BOXES, {"v": D("w * d * h")})
query("st_3dvolume_guarded", tetras, {"v": lambda: F.round(call("st_3dvolume", F.when(F.col("g")["validation"]["is_valid"], F.col("g"))), 6)}, _TETRAS, {"v": "CASE WHEN k % 2 = 0 THEN round(CAST(m * m * m AS DOUBLE) / 6, 6) END"})
query("st_3dsurfacearea", boxes, {"v": rounded("st_3dsurfacearea")}, _BOXES, {"v": D("2 * (w * d + w * h + d * h)")})
query("st_3darea", wells, {"v": rounded("st_3darea")}, _WELLS, {"v": D("100 - a * a")})
query("st_3darea_solid", hollows, {"v": rounded("st_3darea")}, _HOLLOWS, {"v": D("6 * n * n + 6 * (n - 2) * (n - 2)")})
query("st_3dfootprintarea", boxes, {"v": rounded("st_3dfootprintarea"), "base": lambda: F.round(call("st_3dfootprintarea", "base"), 6)}, _BOXES, {"v": D("w * d"), "base": D("w * d")})
query("st_3dperimeter", tetras, {"v": rounded("st_3dperimeter")}, _TETRAS, {"v": "CASE WHEN k % 2 = 0 THEN 0.0::DOUBLE ELSE round(m * (2 + sqrt(2)), 6) END"})
query("st_3dperimeter_geom", wells, {"v": rounded("st_3dperimeter")}, _WELLS, {"v": D("40 + 4 * a")})
query("st_3dlength", lines, {"v": rounded("st_3dlength")}, _LINES, {"v": D("5 * m + 12")})
query("st_3dcentroid", boxes, {a: (lambda c: lambda: F.round(F.get(call("st_3dcentroid", "g")[f"{c}s"], F.lit(0)), 6))(a) for a in "xyz"}, _BOXES, {"x": D("x + w / 2"), "y": D("y + d / 2"), "z": D("h / 2")})
query("st_3dcentroid_geom", lines, {"z": lambda: F.round(F.get(call("st_3dcentroid", "g")["zs"], F.lit(0)), 6)}, _LINES, {"z": "round(CAST(72 AS DOUBLE) / (5 * m + 12), 6)"})

# distances and relations
query("st_3ddistance", probes, {"v": lambda: F.round(call("st_3ddistance", "g", "p"), 6)}, _PROBES, {"v": f"round({_GAP}, 6)"})
query("st_3ddistance_geom", points, {"v": lambda: F.round(call("st_3ddistance", "g", call("st_3dgeomfromtext", F.lit("POINT Z (1 2 3)"))), 6)}, _POINTS, {"v": "round(sqrt(power(x - 1, 2) + power(y - 2, 2) + power(z - 3, 2)), 6)"})
query("st_3ddwithin", probes, {"v": lambda: call("st_3ddwithin", "g", "p", F.lit(1.5))}, _PROBES, {"v": f"{_GAP} <= 1.5"})
query("st_3dmaxdistance", boxes, {"v": lambda: F.round(call("st_3dmaxdistance", "base", "base"), 6)}, _BOXES, {"v": "round(sqrt(w * w + d * d), 6)"})
query("st_3ddfullywithin", boxes, {"v": lambda: call("st_3ddfullywithin", "base", "base", F.lit(5.5))}, _BOXES, {"v": "sqrt(w * w + d * d) <= 5.5"})
query("st_3dintersects", probes, {"v": lambda: call("st_3dintersects", "g", "p")}, _PROBES, {"v": f"{_GAP} = 0"})
query("st_3ddisjoint", probes, {"v": lambda: call("st_3ddisjoint", "p", "g")}, _PROBES, {"v": f"{_GAP} > 0"})
query("st_3dclosestpoint", probes, {a: (lambda c: lambda: F.round(F.get(call("st_3dclosestpoint", "base", "p")[f"{c}s"], F.lit(0)), 6))(a) for a in "xyz"}, _PROBES, {"x": D("x + greatest(0, least(w, px))"), "y": D("y + greatest(0, least(d, py))"), "z": D("0")})
query("st_3dshortestline", probes, {"v": lambda: F.round(call("st_3dlength", call("st_3dshortestline", "base", "p")), 6)}, _PROBES, {"v": "round(sqrt(power(greatest(0, -px, px - w), 2) + power(greatest(0, -py, py - d), 2) + pz * pz), 6)"})

# reference systems and maps
query("st_3dsetcrs", boxes, {"v": lambda: lib.st_3dsetcrs(F.col("g"), F.concat(F.lit("EPSG:"), (28000 + F.col("w")).cast("string")))["crs"]}, _BOXES, {"v": "'EPSG:' || (28000 + w)"})
query("st_3dcrs", boxes, {"v": lambda: native("st_3dcrs", lib.st_3dsetcrs(F.col("g"), F.when(F.col("k") % 2 == 0, F.lit("EPSG:7415")).otherwise(F.lit(""))))}, _BOXES, {"v": "CASE WHEN k % 2 = 0 THEN 'EPSG:7415' END"})
query("st_3dsrid", boxes, {"v": lambda: native("st_3dsrid", lib.st_3dsetcrs(F.col("g"), F.when(F.col("k") % 2 == 0, F.lit("EPSG:7415")).otherwise(F.lit(""))))}, _BOXES, {"v": "CAST(CASE WHEN k % 2 = 0 THEN 7415 ELSE 0 END AS INTEGER)"})
query("st_3dtranslate", boxes, _box_of(lambda: lib.st_3dtranslate(F.col("g"), F.col("w"), F.lit(2), F.lit(-3))), _BOXES, {"min_x": D("x + w"), "min_y": D("y + 2"), "min_z": D("-3"), "max_x": D("x + w + w"), "max_y": D("y + d + 2"), "max_z": D("h - 3")})
query("st_3dscale", boxes, {"volume": lambda: F.round(call("st_3dvolume", call("st_3dscale", "g", F.lit(2.0), F.lit(3.0), F.lit(0.5))), 6)}, _BOXES, {"volume": D("3 * w * d * h")})
_QUARTER = lambda name: lambda: call(name, lib.st_3dtranslate(F.col("g"), -F.col("x"), -F.col("y"), F.lit(0)), F.radians(F.lit(90.0)))
query("st_3drotatex", boxes, _box_of(_QUARTER("st_3drotatex")), _BOXES, {"min_x": D("0"), "min_y": D("-h"), "min_z": D("0"), "max_x": D("w"), "max_y": D("0"), "max_z": D("d")})
query("st_3drotatey", boxes, _box_of(_QUARTER("st_3drotatey")), _BOXES, {"min_x": D("0"), "min_y": D("0"), "min_z": D("-w"), "max_x": D("h"), "max_y": D("d"), "max_z": D("0")})
query("st_3drotatez", boxes, _box_of(_QUARTER("st_3drotatez")), _BOXES, {"min_x": D("-d"), "min_y": D("0"), "min_z": D("0"), "max_x": D("0"), "max_y": D("w"), "max_z": D("h")})
query(
    "st_3dtransform",
    points,
    {"mx": lambda: F.round(F.get(call("st_3dtransform", "g", F.lit("EPSG:4326"), F.lit("EPSG:3857"))["xs"], F.lit(0)), 3), "my": lambda: F.round(F.get(call("st_3dtransform", "g", F.lit("EPSG:4326"), F.lit("EPSG:3857"))["ys"], F.lit(0)), 3) + 0.0},
    _POINTS,
    {"mx": "round(6378137.0 * radians(x), 3)", "my": "round(6378137.0 * ln(tan(pi() / 4 + radians(y) / 2)), 3) + 0.0"},
)
_TURN = [0.0, -1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0, 3.0, 0.0, 0.0, 0.0, 1.0]
query("st_3dplaceimplicit", points, {"text": lambda: call("st_3dastext", call("st_3dplaceimplicit", "g", "g", F.array(*[F.lit(v) for v in _TURN])))}, _POINTS, {"text": "'POINT Z (' || (1 - y + x) || ' ' || (x + 2 + y) || ' ' || (z + 3 + z) || ')'"})
query("st_3dconvexhull", hollows, {"faces": lambda: native("st_3dnumgeometries", call("st_3dconvexhull", "g")), "volume": lambda: call("st_3dvolume", call("st_makesolid", call("st_3dconvexhull", "g")))}, _HOLLOWS, {"faces": "CAST(6 AS INTEGER)", "volume": D("n * n * n")})
query("st_3dfootprinthull", wells, {"area": lambda: F.round(call("st_3darea", call("st_3dfootprinthull", "g")), 6)}, _WELLS, {"area": D("100")})


# aggregates and joins
def agg_extent_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    extent = lib.st_3dextent(F.col("g"))
    return boxes(spark, sf_dir).groupBy((F.col("k") % 10).alias("k")).agg(extent.alias("e")).select("k", "e.*")


QUERIES["st_3dextent"] = lambda spark, d: boxes(spark, d).agg(lib.st_3dextent(F.col("g")).alias("e")).select("e.*")
ORACLES["st_3dextent"] = f"SELECT {D('min(x)')} AS min_x, {D('min(y)')} AS min_y, {D('0')} AS min_z, {D('max(x + w)')} AS max_x, {D('max(y + d)')} AS max_y, {D('max(h)')} AS max_z FROM {_BOXES}"
QUERIES["agg_extent_grouped"] = agg_extent_grouped
ORACLES["agg_extent_grouped"] = ORACLES["st_3dextent"].replace("SELECT ", "SELECT CAST(k % 10 AS BIGINT) AS k, ", 1) + " GROUP BY k % 10"


def _joined(kind: str, distance: float) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left = boxes(spark, sf_dir).select("k", "g")
        if kind == "dwithin":
            return dwithin_join(left, left, distance, "k", "k", distinct_pairs=True, cell=16.0)
        moved = left.select("k", lib.st_3dtranslate(F.col("g"), F.lit(4), F.lit(3), F.lit(5)).alias("g"))
        return intersects_join(left, moved, "k", "k", cell=16.0)

    return run


_AB = f"(SELECT * FROM {_BOXES}) AS a JOIN (SELECT * FROM {_BOXES}) AS c"
_SPAN = "power(greatest(0, a.x - c.x - c.w, c.x - a.x - a.w), 2) + power(greatest(0, a.y - c.y - c.d, c.y - a.y - a.d), 2)"
QUERIES["join_dwithin_grid"] = _joined("dwithin", 6.0)
ORACLES["join_dwithin_grid"] = f"SELECT CAST(a.k AS BIGINT) AS l_id, CAST(c.k AS BIGINT) AS r_id FROM {_AB} ON a.k < c.k AND {_SPAN} <= 36"
QUERIES["join_intersects_grid"] = _joined("intersects", 0.0)
ORACLES["join_intersects_grid"] = (
    f"SELECT CAST(a.k AS BIGINT) AS l_id, CAST(c.k AS BIGINT) AS r_id FROM {_AB} ON a.x <= c.x + 4 + c.w AND c.x + 4 <= a.x + a.w AND a.y <= c.y + 3 + c.d AND c.y + 3 <= a.y + a.d AND 5 <= a.h"
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume, footprint and height of every valid box, and how much of its bounds it fills."""
    solids = boxes(spark, sf_dir).where(native("st_3disvalid", F.col("g")))
    return solids.select("k", call("st_3dvolume", "g").alias("volume"), call("st_3dfootprintarea", "g").alias("footprint"), (native("st_3dzmax", F.col("g")) - native("st_3dzmin", F.col("g"))).alias("height"))


QUERIES["flagship"] = flagship
ORACLES["flagship"] = f"SELECT CAST(k AS BIGINT) AS k, {D('w * d * h')} AS volume, {D('w * d')} AS footprint, {D('h')} AS height FROM {_BOXES}"
