import numpy as np
import pytest

from rasterloom.functions.geo import CIRCUMFERENCE, HALF
from rasterloom.sources import cog, sinks, tiff

META = '<GDALMetadata><Item name="DESCRIPTION" sample="0">first</Item><Item name="DESCRIPTION" sample="1">second</Item></GDALMetadata>'
ZOOM, X, Y = 10, 500, 300
RES = CIRCUMFERENCE / 256 / 2**ZOOM


def make(path, dtype=np.float32, bands=2, **options):
    rng = np.random.default_rng(1)
    full = rng.integers(0, 100, (300, 280, bands)).astype(dtype)
    side = CIRCUMFERENCE / 2**ZOOM
    tiff.write_cog(str(path), [full, full[::2, ::2].copy()], RES, (X * side - HALF, HALF - Y * side), **options)
    return full


@pytest.mark.parametrize("compression", [tiff.RAW, tiff.DEFLATE, tiff.LZW, tiff.PACKBITS])
@pytest.mark.parametrize("dtype", [np.uint8, np.int16, np.float32, np.float64])
@pytest.mark.parametrize("planar", [False, True])
def test_round_trip(tmp_path, compression, dtype, planar):
    full = make(tmp_path / "a.tif", dtype, compression=compression, planar=planar)
    t = tiff.Tiff.open(tiff.RangeFile(str(tmp_path / "a.tif")))
    assert len(t.images) == 2
    np.testing.assert_array_equal(t.window(0, 10, 20, 270, 290), full[20:290, 10:270])
    np.testing.assert_array_equal(t.window(1, 0, 0, 140, 150), full[::2, ::2])


def test_lzw_of_long_data():
    data = bytes(np.random.default_rng(2).integers(0, 7, 60_000).astype(np.uint8))
    assert tiff.unlzw(tiff.lzw(data)) == data


def test_codecs_that_are_not_there(tmp_path):
    make(tmp_path / "j.tif", np.uint8, compression=tiff.JPEG)
    with pytest.raises(ValueError, match="JPEG"):
        tiff.Tiff.open(tiff.RangeFile(str(tmp_path / "j.tif"))).window(0, 0, 0, 8, 8)


def test_catalog_overviews_and_tiles(spark, tmp_path):
    full = make(tmp_path / "a.tif", nodata="-9999", metadata=META)
    cog.register(spark)
    path = str(tmp_path / "a.tif")
    row = spark.read.format("cog").option("paths", path).load().first()
    assert (row.num_bands, row.sample_type, row.nodata, row.band_labels) == (2, "Float32", -9999.0, ["first", "second"])
    assert (row.min_zoom, row.max_zoom) == (ZOOM - 1, ZOOM)
    levels = spark.read.format("cog").option("paths", path).option("mode", "overviews").load().orderBy("image_index").collect()
    assert [(r.width, r.height, r.zoom) for r in levels] == [(280, 300, ZOOM), (140, 150, ZOOM - 1)]
    t = spark.read.format("cog").options(paths=path, mode="tiles", z=ZOOM).load()
    got = {(r.x, r.y, r.band): np.array(r.pixels).reshape(256, 256) for r in t.collect()}
    assert {k[:2] for k in got} == {(X, Y), (X + 1, Y), (X, Y + 1), (X + 1, Y + 1)}
    np.testing.assert_array_equal(got[X, Y, 2], full[:256, :256, 1])
    edge = got[X + 1, Y + 1, 1]
    np.testing.assert_array_equal(edge[:44, :24], full[256:, 256:, 0])
    assert (edge[44:] == -9999).all() and (edge[:, 24:] == -9999).all()
    halo = spark.read.format("cog").options(paths=path, mode="tiles", z=ZOOM, fetch=258, xmax=X, ymax=Y).load().collect()
    assert [r.width for r in halo] == [258, 258]
    binary = cog.from_binary(spark.read.format("binaryFile").load(path), "tiles", ZOOM)
    assert binary.drop("dataset").exceptAll(t.drop("dataset")).count() == 0


def test_untiled_or_wrong_files(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"not a tiff at all")
    with pytest.raises(ValueError, match="no TIFF"):
        cog.Cog(str(tmp_path / "x.tif"))


def test_sinks(spark, tmp_path):
    px = spark.createDataFrame([("a", r, c, r, c, 7, 254) for r in range(2) for c in range(3)], "dataset string, row int, col int, r int, g int, b int, a int")
    row = sinks.pack_rgba(px, ("dataset",)).first()
    assert (row.width, row.height) == (3, 2) and bytes(row.rgba)[:8] == bytes([0, 0, 7, 254, 0, 1, 7, 254])
    assert sinks.png(3, 2, bytes(row.rgba)).startswith(b"\x89PNG")
    t = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "dataset string, z int, v int")
    sinks.write_tiles(t, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("z = 2").count() == 1
