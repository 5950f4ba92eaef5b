"""Data sources and the object sink: round trips, splits, holes, failures."""

import datetime
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.sources import binary, formats, png


@pytest.fixture(scope="module")
def ready(spark):
    formats.register(spark)
    return spark


def test_float_rasters_are_split_by_rows(ready, tmp_path):
    values = np.arange(60, dtype="f4").reshape(10, 6)
    values[2, 3] = -9999
    (tmp_path / "a.tif").write_bytes(binary.write_geotiff(values, -93.0, 41.0, 0.001, 0.002, -9999))
    (tmp_path / "b.TIF").write_bytes(binary.write_geotiff(values[:1], -93.0, 41.0, 0.001, 0.002))
    (tmp_path / "c.txt").write_text("none")
    for split in (64, 1 << 20):
        df = ready.read.format("float_raster").option("splitBytes", split).load(str(tmp_path))
        got = {(r.path[-5:], r.x, r.y): r.value for r in df.collect()}
        want = {("a.tif", x, y): float(values[y, x]) for y in range(10) for x in range(6) if (y, x) != (2, 3)} | {("b.TIF", x, 0): float(values[0, x]) for x in range(6)}
        assert got == want and df.count() == len(want)
    assert df.rdd.getNumPartitions() == 2
    heads = ready.read.format("raster_heads").load(f"file://{tmp_path}").orderBy("path").collect()
    assert [(h.width, h.height, h.no_data) for h in heads] == [(6, 10, -9999.0), (6, 1, None)]
    assert heads[0].south == pytest.approx(41 - 0.02) and heads[0].gsd_m == pytest.approx(111.32)
    assert ready.read.format("float_raster").load(str(tmp_path / "none")).count() == 0


def test_polygons_and_attributes(ready, tmp_path):
    rings = [np.array([[0, 0], [0, 3], [4, 3], [4, 0]], float) + i for i in range(7)]
    shp, shx, dbf = binary.write_shapefile(rings, [{"name": f"plot {i}", "rate": i * 1.5} for i in range(7)])
    for name, raw in (("f.shp", shp), ("f.shx", shx), ("f.dbf", dbf)):
        (tmp_path / name).write_bytes(raw)
    for split in (100, 1 << 20):
        got = ready.read.format("polygon_file").option("splitBytes", split).load(str(tmp_path)).orderBy("record").collect()
        assert [(r.record, r.part) for r in got] == [(i, 0) for i in range(7)]
        for r, ring in zip(got, binary.read_shapefile(shp), strict=True):
            assert [(p.lng, p.lat) for p in r.ring] == [tuple(p) for p in ring.tolist()]
        table = ready.read.format("attribute_table").option("splitBytes", split).load(str(tmp_path))
        assert table.dtypes[1:] == [("record", "int"), ("name", "string"), ("rate", "double")]
        assert [(r.record, r.name, r.rate) for r in table.orderBy("record").collect()] == [(i, f"plot {i}", i * 1.5) for i in range(7)]


def filtered(pixels, kind):
    """The scan lines of an image under one filter of the format."""
    h, w, n = pixels.shape
    out = b""
    for y in range(h):
        line = bytearray()
        for x in range(w):
            for c in range(n):
                a = int(pixels[y, x - 1, c]) if x else 0
                b = int(pixels[y - 1, x, c]) if y else 0
                d = int(pixels[y - 1, x - 1, c]) if x and y else 0
                p = a + b - d
                near = min(((abs(p - v), i, v) for i, v in enumerate((a, b, d))))[2]
                line.append((int(pixels[y, x, c]) - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        out += bytes([kind]) + bytes(line)
    return out


def test_images():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (9, 7, 4)).astype(np.uint8)
    assert np.array_equal(png.decode(png.encode(image)), image)
    for colour, n in png.CHANNELS.items():
        for kind in range(5):
            head = png._chunk(b"IHDR", __import__("struct").pack(">IIBBBBB", 7, 9, 8, colour, 0, 0, 0))
            raw = png.SIGNATURE + head + png._chunk(b"IDAT", zlib.compress(filtered(image[..., :n], kind))) + png._chunk(b"IEND", b"")
            got = png.decode(raw)
            assert np.array_equal(got[..., 0], image[..., 0]) and np.array_equal(got[..., 3], image[..., n - 1] if n in (2, 4) else np.full((9, 7), 255))
    with pytest.raises(ValueError):
        png.decode(b"GIF89a")


BOX = {"north": 41.0005, "south": 40.9985, "west": -93.0025, "east": -92.9995, "zoom": 18}


def test_a_mosaic_counts_its_holes(ready, tmp_path):
    x0, x1, y0, y1 = formats.tile_range(BOX["north"], BOX["south"], BOX["east"], BOX["west"], BOX["zoom"])
    tiles = [(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]
    assert len(tiles) > 3
    pixels = []
    rng = np.random.default_rng(2)
    images = {t: rng.integers(0, 256, (256, 256, 4)).astype(np.uint8) for t in tiles[2:4]}
    for (x, y), image in images.items():
        for py, px in ((0, 0), (0, 255), (7, 9)):
            pixels.append((1, 18, x, y, px, py, *map(int, image[py, px])))
    baked = formats.bake_tiles(ready.createDataFrame(pixels, "owner int, z int, tile_x int, tile_y int, x int, y int, r int, g int, b int, a int"), "owner")
    formats.put_objects(baked, str(tmp_path), upsert=True)
    formats.put_objects(baked, str(tmp_path), upsert=True)  # again, and nothing changes
    x, y = tiles[0]
    (tmp_path / "1" / "18" / str(x)).mkdir(parents=True, exist_ok=True)
    (tmp_path / "1" / "18" / str(x) / f"{y}.png").write_bytes(b"broken")
    reader = ready.read.format("tile_mosaic").options(**BOX)
    df = reader.load(str(tmp_path / "1"))
    s = formats.mosaic_summary(df).first()
    some = sum(p[-1] > 0 for p in pixels)
    assert (s.tiles, s.missing_tiles, s.imagery) == (len(tiles), len(tiles) - 2, some)
    got = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in df.filter("a > 0").collect()}
    assert got == {((p[2] - x0) * 256 + p[4], (p[3] - y0) * 256 + p[5]): p[6:] for p in pixels if p[-1] > 0}
    with pytest.raises(Exception, match="lower zoom"):
        ready.read.format("tile_mosaic").options(**{**BOX, "zoom": 22}).load(str(tmp_path)).count()


def test_objects_are_put_once(ready, tmp_path):
    folder = tmp_path / "store"
    df = ready.createDataFrame([(f"a/{i}", bytes([i])) for i in range(8)], "key string, content binary").repartition(4)
    formats.put_objects(df, str(folder))
    stored = lambda: {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}
    assert stored() == {f"a/{i}": bytes([i]) for i in range(8)} and not list(folder.glob(".staging*"))
    with pytest.raises(Exception, match="exists"):
        formats.put_objects(df, str(folder))
    formats.put_objects(df.withColumn("content", F.lit(b"new")), str(folder), upsert=True)
    assert set(stored().values()) == {b"new"}
    twice = ready.createDataFrame([("b/1", b"x"), ("b/1", b"y")], "key string, content binary")
    for bad in (twice, ready.createDataFrame([("../b", b"x")], twice.schema), ready.createDataFrame([(None, b"x")], twice.schema)):
        with pytest.raises(Exception):
            formats.put_objects(bad, str(folder), upsert=True)
    assert len(stored()) == 8 and not list(folder.glob(".staging*"))


def test_a_task_that_fails_leaves_nothing(ready, tmp_path):
    folder = tmp_path / "store"
    fail = F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
    df = ready.range(0, 8, 1, 4).select(fail.alias("key"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception, match="lost"):
        formats.put_objects(df, str(folder))
    assert [p for p in folder.rglob("*") if p.is_file()] == []


def test_an_attempt_that_is_lost_doubles_nothing(tmp_path):
    writer = formats.ObjectWriter({"path": str(tmp_path)})
    rows = [{"key": "one", "content": b"1"}]
    writer.write(iter(rows))  # an attempt whose executor went
    writer.commit([writer.write(iter(rows)), None])
    assert [(p.name, p.read_bytes()) for p in tmp_path.rglob("*") if p.is_file()] == [("one", b"1")]


def test_reports_and_forecasts(ready, tmp_path):
    at = datetime.datetime(2026, 8, 20, 6, 0, 0)
    reports = ready.createDataFrame([(1, 2, 3, at, b"%PDF"), (1, 2, 4, at, b"%PDF2")], "user_id int, field_id int, scan_id int, made_at timestamp, content binary").withColumn("summary", F.struct(F.lit(5.5).alias("treated_acres")))
    rows = formats.archive_reports(reports, str(tmp_path / "blobs"), str(tmp_path / "archive")).collect()
    assert sorted(r.storage_path for r in rows) == [f"1/2/{s}/{int(at.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)}.pdf" for s in (3, 4)]
    archived = ready.read.parquet(str(tmp_path / "archive")).collect()
    assert len(archived) == 2 and {r.summary for r in archived} == {'{"treated_acres":5.5}'}
    assert all((tmp_path / "blobs" / r.storage_path).read_bytes().startswith(b"%PDF") for r in archived)
    old = at - datetime.timedelta(minutes=30)
    f = ready.createDataFrame([(41.00012, -93.0, old, 1.0), (41.0, -93.0, at, 2.0), (42.0, -93.0, old, 3.0)], "lat double, lng double, saved_at timestamp, t double").withColumn("data", F.struct("t"))
    formats.store_forecasts(f, str(tmp_path))
    formats.store_forecasts(f, str(tmp_path))
    (tmp_path / "forecast" / "broken.json").write_text("{")
    got = formats.cached_forecasts(ready, str(tmp_path), "struct<t:double>", at + datetime.timedelta(minutes=5)).collect()
    assert [(r.key, r.data.t) for r in got] == [("41.000,-93.000.json", 2.0)]
