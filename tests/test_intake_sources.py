import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.functions import geometry as G
from gridlore.operators import intake as I
from gridlore.operators.registry import OPERATORS, run
from gridlore.sources import features, geotiff as T, pixels as X
from gridlore.streaming import pixels as Z


def zones(spark, *box):
    return I.zones_of_area(spark, box)


def test_zones(spark):
    df = spark.createDataFrame([(-180.0,), (0.0,), (151.0,), (180.0,)], "lon double")
    assert [r[0] for r in df.select(G.utm_zone(F.col("lon"))).collect()] == [1, 31, 56, 60]
    assert zones(spark, 150.5, -34, 151.5, -33) == ["56S"]
    assert zones(spark, 149, -35, 151, -34) == ["55S", "56S"]
    assert zones(spark, 150, -2, 156, -1) == ["56S"]
    assert sorted(zones(spark, 151, -1, 152, 1)) == ["56N", "56S"]
    with pytest.raises(ValueError):
        zones(spark, 150, -2, 150, -1)


def test_listing(spark):
    pages = {None: {"items": [{"name": "b.tif"}, {"name": "folder/"}, {"name": "x.json"}], "nextPageToken": "t"}, "t": {"items": [{"name": "a.TIFF"}]}}
    calls = []

    def fetch(url):
        calls.append(url)
        return pages["t" if "pageToken" in url else None]

    assert [r["name"] for r in I.list_tiles(spark, 2020, "56S", "gs://bucket/", "/p/", fetch).collect()] == ["a.TIFF", "b.tif"] and len(calls) == 2
    with pytest.raises(ValueError):
        I.list_tiles(spark, 2000, "56S", "b", "p", fetch)
    assert I.object_url("gs://b/", "/n") == "https://storage.googleapis.com/b/n" and I.virtual_path("https://x").startswith("/vsicurl/")


def tiles(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_scene_names_bounds_and_cull(spark):
    got = I.with_scene(tiles(spark, ["h-0000008192-0000000000.tif", "h-0000000000-0000016384.TIFF", "lone.tif"])).orderBy("name").collect()
    assert [(r["scene_key"], r["offset_a"], r["offset_b"]) for r in got] == [("h", 0, 16384), ("h", 8192, 0), ("lone.tif", None, None)]
    anchors = spark.createDataFrame([("h", "h-0000000000-0000000000.tif", 150.0, -34.0, 150.1, -33.9, 8192, 8192, 0, 0), ("lone.tif", "lone.tif", 10.0, 10.0, 10.1, 10.1, 8192, 8192, None, None)], I.ANCHORS)
    names = tiles(spark, [f"h-{a:010d}-{b:010d}.tif" for a in (0, 8192, 16384) for b in (0, 8192)] + ["lone.tif", "other-0000000001-0000000002.tif"])
    boxes = {r["scene_key"]: r for r in I.scene_bounds(names, anchors).collect()}
    assert boxes["h"]["min_lon"] < 150 - 0.2 and boxes["h"]["max_lat"] > -33.9 + 0.2
    assert (boxes["lone.tif"]["min_lon"], boxes["lone.tif"]["max_lat"]) == (10.0, 10.1)
    kept = {r["name"] for r in I.cull(names, anchors, (150.05, -33.95, 150.06, -33.94)).collect()}
    assert "lone.tif" not in kept and len(kept) == 7
    plan = I.tiles_meeting(spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 1.0, 0.0, 2.0, 1.0)], I.FOOTPRINTS), (0.5, 0.5, 1.0, 0.6))
    assert [r["name"] for r in plan.collect()] == ["a"]


def test_cache(spark, tmp_path):
    cache = I.Cache(str(tmp_path), "gs://b", "/p/")
    rows = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0, 2020, "56S"), ("b", 0.0, None, 1.0, 1.0, 2020, "56S"), ("c", 0.0, 0.0, 1.0, 1.0, 2021, "56S")], f"{I.FOOTPRINTS}, year int, zone string")
    assert cache.save(rows)
    assert [r["name"] for r in cache.load(spark, 2020, "56S", I.FOOTPRINTS).collect()] == ["a"]
    assert I.Cache(str(tmp_path), "other", "p").load(spark, 2020, "56S", I.FOOTPRINTS).count() == 0
    assert not I.Cache("/proc/none", "b", "p").save(rows)
    have, miss = I.split_by_cache(tiles(spark, "abc"), tiles(spark, "b"))
    assert [r["name"] for r in have.collect()] == ["b"] and sorted(r["name"] for r in miss.collect()) == ["a", "c"]


def test_load_precedence_and_pixels(spark, tmp_path):
    df = spark.createDataFrame([("g", 2020, 0, 0, [1.0]), ("g", 2021, 5, 5, [2.0])], X.SCHEMA)
    path = str(tmp_path / "px")
    X.write_pixels(df, path, 2)
    assert X.read_pixels(spark, path, [2021], (5, 6, 5, 6)).count() == 1
    plan = X.read_pixels(spark, path, [2021], (5, 6, 5, 6))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(row,5)" in plan
    assert I.load_embedding(spark, layer=df, url="x", year=2020).count() == 2
    assert I.load_embedding(spark, url=path).count() == 2
    with pytest.raises(ValueError):
        I.load_embedding(spark)
    assert X.first_readable(spark, ["/none", f"{path}|layer=1"]).count() == 2
    holes = spark.createDataFrame([(None,), (1.0,)], "value float")
    assert sorted(r[0] for r in X.to_disk_values(holes, "value", "change").collect()) == [-9999, 1]
    assert X.export(df.drop("embedding"), str(tmp_path / "o.csv")) and spark.read.option("header", True).csv(str(tmp_path / "o.csv")).count() == 2
    assert X.safe_stem("a b/c") == "a_b_c"


def test_geotiff_round_trip(spark, tmp_path):
    grid = G.Grid("r", "EPSG:3577", 4, 3, 100.0, 10.0, 0.0, 500.0, 0.0, -10.0, -1.0, 2)
    cube = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    path = str(tmp_path / "r.tif")
    T.write_raster(path, cube, grid, -1)
    h = T.read_header(path)
    assert h.grid == grid and (T.read_rows(path, 0, 3) == cube).all() and (T.read_rows(path, 1, 2) == cube[:, 1:2]).all()
    T.write_raster(str(tmp_path / "i.tif"), np.arange(12, dtype=np.int64).reshape(3, 4), grid)
    assert T.read_rows(str(tmp_path / "i.tif"), 0, 3).dtype == np.int32
    assert T.bounds(path) == (100.0, 470.0, 140.0, 500.0) and T.bounds(str(tmp_path / "none.tif")) is None
    T.register(spark)
    df = spark.read.format("gridtiff").load(path)
    assert {(r["row"], r["col"]): r["embedding"] for r in df.collect()}[2, 3] == [11.0, 23.0]
    rows = T.grids(spark, [path, "/none.tif"]).orderBy("path").collect()
    assert rows[0]["width"] is None and rows[1]["bands"] == 2
    out = T.write_geotiff(df, str(tmp_path / "out"), grid, ["embedding"], -1.0).collect()
    assert (T.read_rows(out[0]["path"], 0, 3) == cube).all()
    with pytest.raises(ValueError):
        open(tmp_path / "bad.tif", "wb").write(b"no")
        T.read_header(str(tmp_path / "bad.tif"))


def _lzw(raw):
    """A plain encoder: a new code for each byte string seen, the table cleared in time."""
    out, bits, held = bytearray(), 0, 0
    def put(code, width):
        nonlocal bits, held
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
    table, width, now = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    size = 258
    for b in raw:
        if now + bytes([b]) in table:
            now += bytes([b])
            continue
        put(table[now], width)
        table[now + bytes([b])] = size
        size += 1
        width = 12 if size > 2047 else 11 if size > 1023 else 10 if size > 511 else 9
        now = bytes([b])
        if size >= 4094:
            put(table[now], width)
            put(256, width)
            table, width, size, now = {bytes([i]): i for i in range(256)}, 9, 258, b""
    if now:
        put(table[now], width)
        size += 1
        width = 12 if size > 2047 else 11 if size > 1023 else 10 if size > 511 else 9
    put(257, width)
    put(0, 7)
    return bytes(out)


def test_geotiff_packings(tmp_path):
    import struct, zlib

    rng = np.random.default_rng(0)
    for data in (b"", b"a" * 5000, bytes(rng.integers(0, 4, 20_000, dtype=np.uint8)), bytes(rng.integers(0, 256, 9000, dtype=np.uint8))):
        assert T._unlzw(_lzw(data)) == data
    cube = rng.normal(size=(1, 5, 7)).astype("<f4")

    def write(path, raw, packing, predictor, big):
        word, head = ("Q", 8) if big else ("I", 4)
        start = (16 if big else 8) + len(raw)
        tags = [(256, 4, 7), (257, 4, 5), (258, 3, 32), (259, 3, packing), (273, 4, 16 if big else 8), (277, 3, 1), (278, 4, 5), (279, 4, len(raw)), (317, 3, predictor), (339, 3, 3)]
        lead = struct.pack("<2sHHHQ", b"II", 43, 8, 0, start) if big else struct.pack("<2sHI", b"II", 42, start)
        table = struct.pack("<Q" if big else "<H", len(tags)) + b"".join(struct.pack(f"<HH{word}", t, k, 1) + struct.pack("<I" if k == 4 else "<H", v).ljust(head, b"\0") for t, k, v in tags) + bytes(head)
        open(path, "wb").write(lead + raw + table)

    plain = cube.tobytes()
    planes = cube[0].astype(">f4").view(np.uint8).reshape(5, 7, 4).transpose(0, 2, 1).reshape(5, 28)
    floating = np.diff(planes, axis=1, prepend=np.zeros((5, 1), np.uint8)).astype(np.uint8).tobytes()
    import zstandard

    for i, (raw, packing, predictor, big) in enumerate([(_lzw(plain), 5, 1, False), (zlib.compress(plain), 8, 1, True), (zstandard.compress(floating), 50000, 3, True), (zlib.compress(floating), 8, 3, False)]):
        path = str(tmp_path / f"{i}.tif")
        write(path, raw, packing, predictor, big)
        assert (T.read_rows(path, 0, 5) == cube).all() and (T.read_rows(path, 2, 4) == cube[:, 2:4]).all()


def test_one_name_one_raster(spark, tmp_path):
    grid = G.Grid("r", "EPSG:3577", 2, 1, 0.0, 10.0, 0.0, 10.0, 0.0, -10.0, None, 1)
    df = spark.createDataFrame([("r", y, 0, c, float(y)) for y in (2020, 2021) for c in (0, 1)], "grid_id string, year int, row int, col int, value float")
    with pytest.raises(ValueError):
        T.write_geotiff(df, str(tmp_path), grid, ["value"], name="x.tif")
    assert [r["path"] for r in T.write_geotiff(df.filter("year = 2020"), str(tmp_path), grid, ["value"], name="x.tif").collect()] == [str(tmp_path / "x.tif")]
    assert len({r["path"] for r in T.write_geotiff(df, str(tmp_path), grid, ["value"]).collect()}) == 2


def test_systems_round_trip_and_fallback(spark):
    df = spark.createDataFrame([(149.99, -30.0, "EPSG:32755"), (132.0, -20.0, "epsg:3577"), (118.3, -43.0, "EPSG:32750"), (10.0, 50.0, "EPSG:32632"), (1.0, 2.0, "EPSG:4326"), (1.0, 2.0, "EPSG:9999"), (1.0, 2.0, "")], "lon double, lat double, crs string")
    x, y = G.project(F.col("lon"), F.col("lat"), F.col("crs"))
    moved = G.held(df, x=x, y=y)
    a, b = G.unproject(F.col("x"), F.col("y"), F.col("crs"))
    for r in moved.select("lon", "lat", "x", a.alias("a"), b.alias("b"), "crs").collect():
        if r["crs"] in ("EPSG:9999", ""):
            assert r["x"] is None
        else:
            assert abs(r["a"] - r["lon"]) < 1e-8 and abs(r["b"] - r["lat"]) < 1e-8
    assert G.or_default("epsg:32756") == "EPSG:32756" and G.or_default("EPSG:9999") == G.or_default(None) == G.TARGET_CRS


def test_fetch_uses_its_cache(spark, tmp_path):
    cache = I.Cache(str(tmp_path), "b", "p")
    header = ("s/a.tif", "EPSG:32755", 20, 20, 786000.0, 6680000.0, 100.0, -100.0)
    asked = []

    def read_headers(names):
        asked.extend(r["name"] for r in names.collect())
        return names.join(spark.createDataFrame([header], I.HEADERS), "name", "left").select(*[c.split()[0] for c in I.HEADERS.split(", ")])

    pixels = spark.createDataFrame([("s/a.tif", r, c, [1]) for r in range(20) for c in range(20)], "tile string, row int, col int, embedding array<tinyint>")
    target = G.Grid("t", "EPSG:32755", 4, 4, 786200.0, 50.0, 0.0, 6679900.0, 0.0, -50.0)
    fetch = lambda url: {"items": [{"name": "s/a.tif"}]}
    for headers in (1, 0):
        got = I.fetch_year(spark, 2021, (149.9, -30.1, 149.99, -29.9), target, read_headers, lambda tiles: pixels, "b", "p", fetch, cache)
        assert got.zones == ["55S"] and got.headers_read == headers and got.pixels.count() == 16
    assert asked == ["s/a.tif"]


def test_warp(spark):
    source = G.Grid("s", "", 4, 4, 0.0, 10.0, 0.0, 40.0, 0.0, -10.0)
    target = G.Grid("t", "", 2, 2, 0.0, 20.0, 0.0, 40.0, 0.0, -20.0)
    df = spark.createDataFrame([(r, c, [float(4 * r + c)]) for r in range(4) for c in range(4)], "row int, col int, embedding array<float>")
    assert {(r["row"], r["col"]): r["embedding"][0] for r in I.warp_nearest(df, source, target).collect()} == {(0, 0): 5, (0, 1): 7, (1, 0): 13, (1, 1): 15}
    with pytest.raises(ValueError):
        I.mosaic([], target)


def test_features(spark, tmp_path):
    (tmp_path / "p.csv").write_text("x,y,class\n1,2,a\n,3,b\n")
    assert [r["class"] for r in features.read_points(spark, str(tmp_path / "p.csv")).collect()] == ["a"]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": "7", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {"class": "z"}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [5, 6]}, "properties": {"class": "y"}}, {"type": "Feature", "geometry": None, "properties": {}}]}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    got = features.read_geojson(spark, str(tmp_path / "f.json"), "class string").orderBy("feature_id").collect()
    assert [(r["feature_id"], r["geom_type"], r["class"]) for r in got] == [(1, "point", "y"), (7, "polygon", "z")] and got[0]["rings"][0][0]["y"] == 6


def test_operators_by_id(spark):
    assert len(OPERATORS) == 12
    df = spark.createDataFrame([("g", y, 0, 0, [1.0, float(y - 2020)]) for y in (2020, 2021)], X.SCHEMA)
    assert run("change", df, "euclidean").first()["value"] == 1
    with pytest.raises(KeyError):
        run("nothing")


def test_streams(spark, tmp_path):
    rows = [("g", 2020 + i, 0, 0, v) for i, v in enumerate(([1.0, 0.0], [0.0, 1.0], [1.0, 0.0]))]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], X.SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    src = Z.read_stream(spark, str(tmp_path / "in"))
    q = Z.similarity_stream(src, [1.0, 0.0], 0.9).writeStream.format("memory").queryName("sims").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sims").filter("mask = 1").count() == 2
    q = Z.trajectory_stream(src).writeStream.format("memory").queryName("steps").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert max(r["total"] for r in spark.table("steps").collect()) == pytest.approx(2)
