import http.server
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.plans import layers, pipelines
from rasterloom.plans.cache import SharedJob
from rasterloom.plans.options import fetch_size, merge
from rasterloom.sources import cog, tiff

from .test_sources import META, X, Y, ZOOM, make

SCHEMA = "dataset string, z int, x int, y int, band int, width int, height int, nodata double, cell_size double, pixels array<float>"


def frame(spark, size, xs=(0, 1), bands=1, hole=(), z=3):
    rows = []
    for x in xs:
        for b in range(1, bands + 1):
            r, c = np.mgrid[0:size, 0:size]
            v = (50 + 40 * np.sin(c / 3 + x) * np.cos(r / 4)) * b if x not in hole else np.full((size, size), -9999.0)
            rows.append(("d", z, x, 2, b, size, size, -9999.0, None, v.astype(np.float32).ravel().tolist()))
    return spark.createDataFrame(rows, SCHEMA)


def test_every_tile_has_its_own_bounds(spark):
    got = {r.x: np.array(r.positions).reshape(-1, 3) for r in pipelines.terrain(frame(spark, 17), merge(type="terrain"), 1.0).collect()}
    side = 2 * np.pi * 6378137 / 8
    for x, p in got.items():
        assert p[:, 0].min() == pytest.approx(-20037508.342789244 + x * side, rel=1e-6) and p[:, 0].max() == pytest.approx(-20037508.342789244 + (x + 1) * side, rel=1e-6)
        assert p[:, 1].max() == pytest.approx(20037508.342789244 - 2 * side, rel=1e-6)


def test_errors_by_zoom(spark):
    over = spark.createDataFrame([("d", 0, 4, 3), ("d", 1, 3, 25)], "dataset string, image_index int, zoom int, mesh_max_error int")
    tiles = frame(spark, 17, (0,), z=4).unionByName(frame(spark, 17, (0,), z=3))
    got = {r.z: (r.max_error, len(r.pixels)) for r in pipelines.mesh_errors(tiles, over).collect()}
    assert got == {4: (3.0, 289), 3: (25.0, 289)}
    assert {r.max_error for r in pipelines.mesh_errors(tiles, over, 7.0).collect()} == {7.0}
    n = {r.z: len(r.indices) for r in pipelines.terrain(tiles, merge(type="terrain"), overviews=over).collect()}
    assert n[4] > n[3]


def test_kernel_tiles_lose_their_halo(spark):
    o = merge(type="terrain", use_slope=True)
    assert fetch_size(o) == 258 and fetch_size(merge(type="terrain")) == 257 and fetch_size(merge()) == 256 and fetch_size(merge(use_relief_glaze=True)) == 258
    tiles = frame(spark, 18, hole=(1,))
    out = layers.get_heightmap(tiles, o, 1.0)
    mesh = out.mesh.collect()
    assert [(r.x, r.raw_width, r.raw_height) for r in mesh] == [(0, 17, 17)]
    source = np.array(tiles.where("x = 0").first().pixels, np.float32).reshape(18, 18)
    np.testing.assert_array_equal(np.array(mesh[0].raw, np.float32).reshape(17, 17), source[1:, 1:])
    assert [(r.x, r.width, len(r.pixels)) for r in out.derived.collect()] == [(0, 16, 256)]
    assert out.texture.count() == 256 and out.texture.where("a = 254").count() == 256


@pytest.mark.parametrize(("options", "pixels"), [({"use_swiss_relief": True}, 256), ({"use_hillshade": True, "use_single_color": True}, 256), ({"skip_texture": True}, None), ({}, 289), ({"use_heat_map": True}, 289)])
def test_textures(spark, options, pixels):
    o = merge(type="terrain", **options)
    out = layers.get_map(frame(spark, 18, (0,)), o, max_error=1.0)
    assert out.texture is None if pixels is None else out.texture.count() == pixels
    assert (out.derived is None) == (not (o.use_slope or o.use_hillshade or o.use_swiss_relief))


def test_swiss_relief_changes_the_texture_and_pictures_without_a_mask_are_null(spark):
    tiles = frame(spark, 18, (0,))
    plain, swiss = (layers.get_heightmap(tiles, merge(type="terrain", use_heat_map=True, color_scale_value_range=(0, 100), **k), 1.0).texture for k in ({}, {"use_swiss_relief": True}))
    at = lambda df: {(r.row, r.col): (r.r, r.g, r.b) for r in df.collect()}
    a, b = at(plain), at(swiss)
    assert all(b[k][0] <= a[k[0] + 1, k[1] + 1][0] for k in b if (k[0] + 1, k[1] + 1) in a) and b != a
    none = pipelines.tile(tiles, merge(use_swiss_relief=True, null_color=(1, 2, 3, 4)))
    assert none.select("r", "g", "b", "a").distinct().collect() == [(1, 2, 3, 4)] and none.count() == 324
    assert pipelines.unmasked_glaze(tiles).where("a > 0").count() == 0


def test_channels(spark):
    two = frame(spark, 4, (0, 1), bands=2).where("not (x = 1 and band = 2)")
    o = merge(use_channel=2, null_color=(9, 9, 9, 9), color_scale_value_range=(0, 200))
    got = pipelines.bitmap(two, o)
    assert got.where("x = 1 and a = 9").count() == 16 and got.where("x = 0 and a = 254").count() == 16
    assert pipelines.bitmap(two, merge(use_channel=5, num_of_channels=2, null_color=(9, 9, 9, 9))).where("a = 9").count() == 32


def test_auto_range_leaves_classes_and_clips_alone(spark):
    tiles = spark.createDataFrame([("d", 1, 0, 0, 1, 2, 2, None, 1.0, [0.0, 10.0, 20.0, 30.0])], SCHEMA)
    classes = (("red", (0, 15)), ("blue", (15, 40)))
    for auto in (False, True):
        got = pipelines.bitmap(tiles, merge(use_color_classes=True, color_classes=classes, use_auto_range=auto)).orderBy("row", "col").collect()
        assert [(r.r, r.b) for r in got] == [(255, 0), (255, 0), (0, 255), (0, 255)]
    heat = pipelines.bitmap(tiles, merge(use_auto_range=True, clip_high=25.0, clipped_color=(1, 1, 1, 1))).orderBy("row", "col").collect()
    assert heat[3].a == 1 and heat[0].a == 254 and heat[0].r != heat[2].r


@pytest.mark.parametrize(("check", "kept"), [("full", {0, 2}), ("border+center", {0}), ("other", {0, 1, 2})])
def test_no_data_checks(spark, check, kept):
    """Tile 1 is empty in band 1 only; tile 2 has data at one inner pixel that no probe hits."""
    inner = frame(spark, 17, (2,), hole=(2,)).withColumn("pixels", F.transform("pixels", lambda v, i: F.when(i == 3 * 17 + 2, F.lit(5.0).cast("float")).otherwise(v)))
    tiles = frame(spark, 17, (0,)).unionByName(frame(spark, 17, (1,), hole=(1,))).unionByName(inner).unionByName(frame(spark, 17, (1,)).withColumn("band", F.lit(2)))
    got = pipelines.with_data(tiles, merge(type="terrain", no_data_check=check))
    assert {r.x for r in got.collect()} == kept


def test_layer_keeps_what_it_made(spark):
    layer = layers.Layer(frame(spark, 17), type="terrain")
    a, b = layer.heightmap(3, 1.0), layer.heightmap(3, 1.0)
    assert a.mesh is b.mesh and a.texture is b.texture and layer.raster(3) is layer.raster(3)
    assert layer.heightmap(3, 2.0).mesh is not a.mesh and layer.heightmap(3, 1.0, skip_texture=True).texture is None
    other = layer.restyled(use_color_classes=True, color_classes=(("red", (0, 100)),))
    assert other.raster(3) is layer.raster(3) and other.heightmap(3, 1.0).texture is not a.texture
    assert a.mesh.is_cached and "raw" not in layers.Layer(frame(spark, 17), type="terrain", pickable=False).heightmap(3, 1.0).mesh.columns
    layer.clear()
    assert not layer.results.frames and layer.rasters.frames
    glaze = layers.Layer(frame(spark, 18), use_relief_glaze=True)
    assert glaze.picture(3).count() == 512 and glaze.mask(3) is glaze.restyled(max_glaze_alpha=9).mask(3)
    bands = layers.Layer(frame(spark, 17, (0,), bands=2), type="terrain", cache_all_bands=True, use_channel=2)
    assert bands.heightmap(3, 1.0).mesh.first().max_z == pytest.approx(2 * bands.restyled(use_channel=1).heightmap(3, 1.0).mesh.first().max_z)
    assert len(bands.bands.frames) == 1


def test_running_jobs_end_when_the_last_caller_leaves(spark):
    job, failed = SharedJob(spark, "slow"), []

    def work():
        with job:
            try:
                spark.range(8, numPartitions=8).mapInArrow(_sleepy, "id long").count()
            except Exception as e:
                failed.append(str(e))

    t = threading.Thread(target=work)
    t.start()
    for _ in range(100):
        if job.callers:
            break
        threading.Event().wait(0.1)
    threading.Event().wait(3)
    assert job.leave()
    t.join(60)
    assert failed and "cancel" in failed[0].lower()


def _sleepy(batches):
    import time

    for b in batches:
        time.sleep(40)
        yield b


def test_filters_cut_partitions(spark, tmp_path):
    make(tmp_path / "a.tif")
    cog.register(spark)
    t = spark.read.format("cog").options(paths=str(tmp_path / "a.tif"), mode="tiles", tilespertask=1).load()
    assert t.rdd.getNumPartitions() == 4
    one = t.where(f"z = {ZOOM} and x = {X} and y <= {Y} and band = 2")
    assert one.rdd.getNumPartitions() == 1 and [(r.x, r.y, r.band) for r in one.collect()] == [(X, Y, 2)]
    assert t.where(F.col("x").isin(X, X + 7)).select("x").distinct().count() == 1
    assert t.where(f"z = {ZOOM - 1}").count() == t.where(f"z = {ZOOM - 1}").select("x", "y", "band").distinct().count() > 0
    assert {r.band for r in t.where("band in (1, 3)").collect()} == {1}
    many = spark.read.format("cog").options(paths=str(tmp_path / "a.tif"), mode="tiles", headers=0, parts=3, tilespertask=2).load()
    assert many.rdd.getNumPartitions() == 3 and many.count() == 8


def test_files_stay_open(tmp_path):
    make(tmp_path / "a.tif")
    path = str(tmp_path / "a.tif")
    assert cog.opened(path) is cog.opened(path)
    before = cog.opened(path)
    make(tmp_path / "a.tif", np.uint8)
    assert cog.opened(path) is not before and cog.opened(path).sample_type == "UInt8"


def test_ranges_over_http(tmp_path):
    full = make(tmp_path / "a.tif", metadata=META)
    data, asked = (tmp_path / "a.tif").read_bytes(), []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            first, last = (int(v) for v in self.headers["Range"].removeprefix("bytes=").split("-"))
            asked.append((first, last))
            self.send_response(206)
            self.end_headers()
            self.wfile.write(data[first : last + 1])

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/a.tif"
    for block in (4096, 0):
        asked.clear()
        t = tiff.Tiff.open(tiff.RangeFile(url, block))
        np.testing.assert_array_equal(t.window(0, 0, 0, 64, 64), full[:64, :64])
        assert sum(b - a + 1 for a, b in asked) < len(data) and (not block or len(asked) == len(set(asked)))
    server.shutdown()


def test_blocks_are_bounded(tmp_path, monkeypatch):
    f = tiff.RangeFile.__new__(tiff.RangeFile)
    f.url, f.block_size, f.blocks, f.file = "u", 10, tiff.OrderedDict(), None
    monkeypatch.setattr(tiff, "KEPT_BYTES", 30)
    f._fetch = lambda at, n: bytes(range(at, at + n))
    assert f.read(5, 60) == bytes(range(5, 65)) and len(f.blocks) == 3


def test_codecs_can_be_added(tmp_path):
    full = make(tmp_path / "j.tif", np.uint8, compression=tiff.JPEG)
    tiff.register_codec(tiff.JPEG, lambda data, image: data)
    try:
        np.testing.assert_array_equal(tiff.Tiff.open(tiff.RangeFile(str(tmp_path / "j.tif"))).window(0, 0, 0, 8, 8), full[:8, :8])
    finally:
        tiff.register_codec(tiff.JPEG, None)


def test_accessors(spark, tmp_path):
    make(tmp_path / "a.tif", metadata=META)
    cog.register(spark)
    layer = layers.Layer(frame(spark, 16), spark.read.format("cog").option("paths", str(tmp_path / "a.tif")).load())
    assert layer.zoom_range().first()[1:] == (ZOOM - 1, ZOOM)
    assert [(r.band, r.label) for r in layer.band_descriptions().collect()] == [(1, "first"), (2, "second")]
    b = layer.bounds_lonlat().first()
    assert b.west < b.east and b.south < b.north


def test_layer_of_a_file(spark, tmp_path):
    """From the file to the picture, the mesh and the texture: tiles come with the halo that the options need."""
    y, x = np.mgrid[0:600, 0:600]
    full = (100 + 40 * np.sin(x / 30) * np.cos(y / 25)).astype(np.float32)[:, :, None]
    side = cog.CIRCUMFERENCE / 2**ZOOM
    path = str(tmp_path / "d.tif")
    tiff.write_cog(path, [full, full[::2, ::2].copy()], side / 256, (X * side - cog.HALF, cog.HALF - Y * side))
    picture = layers.Layer.from_cog(spark, [path], color_scale_value_range=(60, 140)).picture(ZOOM)
    assert picture.where(f"x = {X} and y = {Y}").count() == 256 * 256
    terrain = layers.Layer.from_cog(spark, [path], type="terrain", use_slope=True)
    out = terrain.heightmap(ZOOM, 2.0)
    row = out.mesh.where(f"x = {X} and y = {Y}").first()
    assert row.raw_width == 257 and len(row.raw) == 257 * 257 and row.raw[0] == pytest.approx(float(full[1, 1, 0]))
    p = np.array(row.positions).reshape(-1, 3)
    assert p[:, 0].min() == pytest.approx(X * side - cog.HALF, rel=1e-6) and p[:, 0].max() == pytest.approx((X + 1) * side - cog.HALF, rel=1e-6)
    assert out.texture.where(f"x = {X} and y = {Y}").count() == 256 * 256 and out.derived.where(f"x = {X} and y = {Y}").first().width == 256
    auto = terrain.heightmap(ZOOM - 1).mesh.first()  # the error of the overview
    assert auto is not None and auto.z == ZOOM - 1
