"""The column library and its SQL names on Spark."""

import itertools

import pytest
from pyspark.sql import functions as F

from voluma.functions import library as lib
from voluma.functions import sql
from voluma.operators.joins import dwithin_join, intersects_join
from voluma.sources import fixtures as fx
from voluma.streaming.extents import windowed_extent

BOX = "st_3dextrude(st_3dgeomfromtext('POLYGON Z ((0 0 0, 2 0 0, 2 2 0, 0 2 0, 0 0 0))'), 3.0D)"


@pytest.fixture(scope="module")
def names(spark):
    return sql.register(spark)


def one(spark, expression):
    return spark.sql(f"SELECT {expression} AS v").first()["v"]


def test_catalog(spark, names):
    rows = sql.catalog(spark).collect()
    assert len(rows) == 75 == len(lib.PUBLIC)
    assert all(r["description"] for r in rows)
    assert {r["name"] for r in rows} - {"st_3dextent"} <= set(names)


def test_sql_names(spark, names):
    assert one(spark, f"st_3dvolume({BOX})") == 12
    assert one(spark, f"st_3dvalidationreport({BOX}).message") == "Valid solid"
    assert one(spark, f"st_3dfaceazimuths(st_3dfacenormals({BOX}))") == [None, None, 180, 90, 0, 270]
    assert one(spark, f"st_3dsrid(st_3dsetcrs({BOX}, 'EPSG:7415'))") == 7415
    assert one(spark, f"st_3dcrs(st_3dtransform(st_3dsetcrs({BOX}, 'EPSG:28992'), null, 'EPSG:4326'))") == "EPSG:4326"
    assert one(spark, "st_3dastext(st_3dtransform(st_3dgeomfromtext('SRID=28992;POINT Z (85000 446800 5)'), null, 'EPSG:4326'))") == "POINT Z (4.3677243 52.0051517 5)"
    assert one(spark, f"size(st_3dfaces({BOX}))") == 6
    assert one(spark, "st_3dvolume(null)") is None


def test_nulls_and_errors(spark, names):
    bad = spark.createDataFrame([(bytes(fx.open_tetra()),), (bytes(fx.tetra()),), (None,), (b"\x01",)], "w binary").withColumn("g", lib.st_3dtryfromwkb(F.col("w")))
    rows = bad.select(F.col("g").isNull().alias("none"), lib.call("st_3dvolume", F.when(F.col("g")["validation"]["is_valid"], F.col("g"))).alias("v"), lib.call("st_3dvolume", "g", strict=False).alias("t")).collect()
    assert [r["none"] for r in rows] == [False, False, True, True]
    assert [r["v"] is None for r in rows] == [True, False, True, True] == [r["t"] is None for r in rows]
    with pytest.raises(Exception, match="not closed"):
        bad.select(lib.call("st_3dvolume", "g")).collect()
    with pytest.raises(Exception, match="not a Point"):
        one(spark, f"st_3dx({BOX})")
    with pytest.raises(Exception, match="different CRSs"):
        one(spark, f"st_3ddistance({BOX}, st_3dsetcrs({BOX}, 'EPSG:7415'))")
    with pytest.raises(Exception, match="has no CRS"):
        one(spark, f"st_3dtransform({BOX}, null, 'EPSG:4326')")


def test_struct_sidecar(spark):
    df = spark.createDataFrame([(bytes(fx.hollow_cube()), ("Solid", [[6, 6]]))], f"w binary, p {lib.SIDECAR}")
    g = df.withColumn("g", lib.udf_of("st_3dfromwkb")("w", "p"))
    assert g.select(lib.native("st_3dnumshells", F.col("g")), lib.call("st_3dvolume", "g")).first()[:] == (2, 56)


def test_extent(spark):
    df = spark.createDataFrame([(bytes(fx.tetra()), None), (bytes(fx.multi_cube()), None), (None, None)], "w binary, c string")
    df = df.withColumn("g", lib.st_3dtryfromwkb(F.col("w")))
    assert df.agg(lib.st_3dextent(F.col("g")).alias("e")).first()["e"]["max_x"] == 7
    assert df.where("w is null").agg(lib.st_3dextent(F.col("g")).alias("e")).first()["e"] is None
    mixed = df.withColumn("g", F.when(F.col("g")["counts"]["solids"] == 1, lib.st_3dsetcrs(F.col("g"), F.lit("EPSG:7415"))).otherwise(F.col("g")))
    with pytest.raises(Exception, match="different CRSs"):
        mixed.agg(lib.st_3dextent(F.col("g")).alias("e")).collect()
    plan = df.agg(lib.st_3dextent(F.col("g")))._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_header_filters_reach_the_scan(spark, names, tmp_path):
    path = str(tmp_path / "solids")
    spark.range(20).selectExpr("id", f"st_3dtranslate({BOX}, CAST(id AS DOUBLE), 0, 0) AS g").write.parquet(path)
    found = spark.read.parquet(path).where("st_3dxmax(g) > 15").select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(g.bbox.max_x,15.0)" in plan and "xs" not in plan.split("ReadSchema")[1]
    assert found.count() == 6


def test_joins_match_brute_force(spark, names):
    base = spark.range(80).selectExpr("id", "pmod(xxhash64(id), 60) AS x", "pmod(xxhash64(id, 1), 60) AS y", "1 + pmod(xxhash64(id, 2), 5) + CASE WHEN id % 17 = 0 THEN 200 ELSE 0 END AS w")
    text = "concat('POLYGON Z ((', x, ' ', y, ' 0, ', x + w, ' ', y, ' 0, ', x + w, ' ', y + w, ' 0, ', x, ' ', y + w, ' 0, ', x, ' ', y, ' 0))')"
    df = base.selectExpr("id", "x", "y", "w", f"st_3dextrude(st_3dgeomfromtext({text}), 1.0D) AS g")
    rows = base.collect()

    def gap2(a, b):
        return sum(max(0, p - (q + b["w"]), q - (p + a["w"])) ** 2 for p, q in ((a["x"], b["x"]), (a["y"], b["y"])))

    for reach, cell in ((4.0, 5.0), (4.0, 30.0)):
        got = {tuple(r) for r in dwithin_join(df, df, reach, distinct_pairs=True, cell=cell).collect()}
        assert got == {(a["id"], b["id"]) for a, b in itertools.combinations(rows, 2) if gap2(a, b) <= reach**2}
    got = [tuple(r) for r in intersects_join(df, df).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a["id"], b["id"]) for a in rows for b in rows if gap2(a, b) == 0}


def test_streaming_extent(spark, names, tmp_path):
    source = str(tmp_path / "in")
    spark.sql(f"SELECT timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT)) AS ts, st_3dtranslate({BOX}, CAST(id AS DOUBLE), 0, 0) AS g FROM range(4)").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    q = windowed_extent(stream, "g", "ts", "2 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("extents").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT extent.min_x, extent.max_x, n FROM extents ORDER BY 1").collect()
    assert [tuple(r) for r in rows] == [(0, 3, 2), (2, 5, 2)]


def test_payload_casts(spark):
    df = spark.createDataFrame([(bytes(fx.hollow_cube()),)], "w binary").withColumn("g", lib.st_3dsetcrs(lib.call("st_3dfromwkb", "w", F.lit('{"shells": [[6, 6]]}')), F.lit("EPSG:7415")))
    back = df.select(lib.call("g3d_from_payload", lib.call("g3d_to_payload", "g")).alias("g"), lib.call("g3d_from_payload", "w", strict=False).alias("bad"))
    row = back.select("g.crs", "g.counts.shells", "g.validation.is_valid", lib.call("st_3dvolume", "g"), F.col("bad").isNull()).first()
    assert tuple(row) == ("EPSG:7415", 2, True, 56, True)
    with pytest.raises(Exception, match="not a payload"):
        df.select(lib.call("g3d_from_payload", "w")).collect()


def test_city_models(spark, tmp_path):
    import json

    from voluma.sources import city_models

    cube = [[[0, 3, 2, 1]], [[4, 5, 6, 7]], [[0, 1, 5, 4]], [[1, 2, 6, 5]], [[2, 3, 7, 6]], [[3, 0, 4, 7]]]
    corners = [[0, 0, 0], [1000, 0, 0], [1000, 1000, 0], [0, 1000, 0], [0, 0, 1000], [1000, 0, 1000], [1000, 1000, 1000], [0, 1000, 1000]]
    head = {"type": "Model", "version": "2.0", "transform": {"scale": [0.001] * 3, "translate": [10, 0, 0]}, "metadata": {"referenceSystem": "https://www.opengis.net/def/crs/EPSG/0/7415"}}
    body = {"CityObjects": {"a": {"type": "Building", "geometry": [{"type": "Solid", "lod": "2.2", "boundaries": [cube]}]}}, "vertices": corners}
    (tmp_path / "one.city.json").write_text(json.dumps(head | body, indent=1))
    (tmp_path / "two.city.jsonl").write_text(json.dumps(head | {"CityObjects": {}, "vertices": []}) + "\n" + json.dumps({"type": "Feature", "id": "a"} | body) + "\n")
    for df in (city_models.read_model_files(spark, f"{tmp_path}/one.city.json"), city_models.read_feature_files(spark, f"{tmp_path}/two.city.jsonl")):
        g = df.withColumn("g", lib.st_3dsetcrs(lib.udf_of("st_3dfromwkb")("wkb", "properties"), F.col("crs")))
        row = g.select("id", "lod", "g.crs", F.col("g")["bbox"]["min_x"], lib.call("st_3dvolume", "g")).first()
        assert tuple(row)[:4] == ("a", "2.2", "EPSG:7415", 10.0) and row[4] == pytest.approx(1)


def test_sql_overloads_names_and_aggregates(spark):
    from pyspark.sql import Row

    from voluma.sources import fixtures as fx

    sql.register(spark)
    spark.createDataFrame([(fx.hollow_cube(), None, 0), (fx.tetra(), "x", 1)], "wkb binary, label string, k int").createOrReplaceTempView("made")
    one = lambda sql: spark.sql(sql).collect()
    assert [r[0] for r in one("SELECT round(st_3dvolume(st_3dfromwkb(wkb)), 6) FROM made ORDER BY k")] == [56.0, 0.166667]
    assert one("SELECT st_3dvolume(st_3dfromwkb(wkb, '{\"type\": \"Solid\", \"shells\": [[6, 6]]}')) FROM made WHERE k = 0")[0][0] == 56.0
    assert one("SELECT st_3dtryfromwkb(wkb).kind, try_st_3dfromwkb(cast('no' AS BINARY)) FROM made WHERE k = 1")[0][1] is None
    point = "st_3dgeomfromtext('POINT Z (1 2 3)')"
    assert one(f"SELECT st_3dastext(st_3dtranslate({point}, dz => 1D, dx => 10D, dy => 0D))")[0][0] == "POINT Z (11 2 4)"
    assert one(f"SELECT st_3dastext(geom => st_3dtranslate(geom => {point}, dx => 0D, dy => 0D, dz => 0D))")[0][0] == "POINT Z (1 2 3)"
    assert one("SELECT st_3dastext(st_3dgeomfromtext(wkt => 'POINT Z (1 2 3)'))")[0][0] == "POINT Z (1 2 3)"
    assert one(f"SELECT st_3dzmax(geom => {point}), st_3ddistance(geom2 => {point}, geom1 => {point})")[0] == Row(3.0, 0.0)
    here = "st_3dsetcrs(st_3dgeomfromtext('POINT Z (85000 446800 5)'), crs => 'EPSG:28992')"
    two, three = one(f"SELECT st_3dtransform({here}, 'EPSG:4326').crs, st_3dtransform({here}, 'EPSG:28992', 'EPSG:4326').crs")[0]
    assert two == three == "EPSG:4326"
    assert one("SELECT st_3dfaceslopes(st_3dfromwkb(wkb)), st_3dfaceazimuths(st_3dfromwkb(wkb)) FROM made WHERE k = 0")[0][0][:3] == [0.0, 0.0, 90.0]
    rows = one("SELECT k, st_3dextent(st_3dtranslate(st_3dfromwkb(wkb), 1D, 0D, 0D)) AS e FROM made GROUP BY k ORDER BY k")
    assert [(r["e"]["min_x"], r["e"]["max_x"]) for r in rows] == [(1.0, 5.0), (1.0, 2.0)]
    assert one("SELECT st_3dextent(st_3dgeomfromtext('POINT Z EMPTY'))")[0][0] is None
    with pytest.raises(Exception, match="different CRSs"):
        one(f"SELECT st_3dextent(g) FROM (SELECT {point} AS g UNION ALL SELECT {here})")
    assert one(f"SELECT st_3dtransform({here}, 4326).crs, st_3dtransform({here}, 28992, 4326).crs, st_3dtransform({here}, target_crs => 4326).crs")[0] == Row("EPSG:4326", "EPSG:4326", "EPSG:4326")


def test_payloads_as_text_and_by_kind(spark):
    from voluma.sources import fixtures as fx

    sql.register(spark)
    spark.createDataFrame([(fx.tetra(),)], "wkb binary").createOrReplaceTempView("tetra")
    payload = "g3d_to_payload(st_3dfromwkb(wkb))"
    row = spark.sql(f"SELECT st_3disclosed(g3d_solid_from_payload(g3d_payload_text({payload}))), try_g3d_geom_from_payload({payload}) IS NULL, g3d_to_payload(g3d_from_payload({payload})) = {payload} FROM tetra").first()
    assert tuple(row) == (True, True, True)
    row = spark.sql("SELECT try_g3d_solid_from_payload('hello') IS NULL, try_g3d_solid_from_payload('\\\\xZZ') IS NULL, try_g3d_solid_from_payload('é') IS NULL, g3d_from_payload(CAST(NULL AS BINARY)) IS NULL").first()
    assert tuple(row) == (True, True, True, True)
    with pytest.raises(Exception, match="not a SOLID_3D payload"):
        spark.sql("SELECT g3d_solid_from_payload(g3d_to_payload(st_3dgeomfromtext('POINT Z (1 2 3)')))").collect()


def test_native_geometry_columns(spark):
    from voluma.sources import fixtures as fx

    spark.conf.set("spark.sql.geospatial.enabled", "true")
    try:
        made = spark.createDataFrame([(fx.polygon_z(),), (None,)], "wkb binary").select(F.st_geomfromwkb("wkb").alias("n"), "wkb")
        made.select(F.st_asbinary("n")).collect()
    except Exception as error:  # a session without geospatial types
        pytest.skip(str(error)[:80])
    rows = made.select(lib.from_geometry(F.col("n")).alias("g"), "wkb").select(lib.call("st_3dfootprintarea", "g"), F.col("g")["bbox"]["max_z"], lib.native("st_3dgeometrytype", F.col("g"))).collect()
    assert sorted(map(tuple, rows), key=repr) == [(12.0, 5.0, "ST_Polygon"), (None, None, None)]
    with pytest.raises(Exception, match="1003"):
        made.select(lib.from_geometry(F.col("n"), solid=True)).collect()
    assert made.select(lib.from_geometry(F.col("n"), solid=True, strict=False).isNull()).distinct().collect()[0][0]


def test_city_models_by_level(spark, tmp_path):
    import json

    from voluma.sources import city_models

    cube = [[[0, 3, 2, 1]], [[4, 5, 6, 7]], [[0, 1, 5, 4]], [[1, 2, 6, 5]], [[2, 3, 7, 6]], [[3, 0, 4, 7]]]
    corners = [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [1, 1, 1], [0, 1, 1]]
    meaning = {"surfaces": [{"type": "GroundSurface"}, {"type": "WallSurface"}], "values": [[0, None, 1, 1, 1, 1]]}
    solid = {"type": "Solid", "lod": "2", "boundaries": [cube], "semantics": meaning}
    model = {"CityObjects": {"a": {"type": "Building", "geometry": [solid, {"type": "MultiSurface", "lod": "0.1", "boundaries": cube[:1]}]}, "b": {"type": "Road"}}, "vertices": corners}
    (tmp_path / "one.json").write_text(json.dumps(model))
    rows = city_models.by_lod(city_models.read_model_files(spark, f"{tmp_path}/one.json"))
    assert rows.columns == ["id", "type", "parents", "crs", "geometry_lod0_1", "geometry_properties_lod0_1", "geometry_lod2_0", "geometry_properties_lod2_0"]
    row = rows.select("id", "geometry_properties_lod2_0.*", lib.call("st_3dvolume", lib.call("st_3dfromwkb", "geometry_lod2_0", "geometry_properties_lod2_0")).alias("v"), lib.call("st_3darea", lib.call("st_geom3dfromwkb", "geometry_lod0_1")).alias("a")).collect()
    assert len(row) == 1 and row[0]["face_semantics"] == [0, None, 1, 1, 1, 1] and json.loads(row[0]["surfaces"]) == meaning["surfaces"]
    assert (row[0]["shells"], row[0]["v"], row[0]["a"]) == ([[6]], pytest.approx(1), pytest.approx(1))
    assert city_models.lod_suffix("2.2") == "2_2" and city_models.lod_suffix("2") == city_models.lod_suffix("2.0")


def test_batch_functions_read_only_their_fields(spark, tmp_path):
    made = spark.createDataFrame([(fx.hollow_cube(),), (None,)], "wkb binary").select(lib.call("st_3dfromwkb", "wkb").alias("g"))
    made.write.parquet(f"{tmp_path}/values")
    stored = spark.read.parquet(f"{tmp_path}/values")
    out = stored.select(lib.call("st_3dvolume", "g").alias("v"), lib.call("st_3darea", F.col("g")).alias("a"), lib.call("st_3dfootprintarea", geom="g").alias("f"))
    assert sorted(map(tuple, out.collect()), key=repr) == [(56.0, 120.0, 20.0), (None, None, None)]
    plan = stored.select(lib.call("st_3dvolume", "g"))._jdf.queryExecution().executedPlan().toString()
    scanned = plan[plan.index("ReadSchema") :]
    assert "solid_shell" in scanned and "ring_idx" not in scanned and "bbox" not in scanned and "parts" not in scanned
