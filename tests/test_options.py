import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import color
from rasterloom.operators import kernels
from rasterloom.plans import pipelines
from rasterloom.plans.options import MODES, Options, has_texture, merge


def modes(o):
    return [m for m in MODES if getattr(o, m)]


def test_modes():
    assert modes(merge()) == ["use_heat_map"]
    assert modes(merge(use_single_color=True)) == ["use_single_color"]
    plain = merge(type="terrain")
    assert modes(plain) == ["use_single_color"] and plain.color == plain.terrain_color
    assert modes(merge(type="terrain", use_slope=True)) == ["use_heat_map"]
    assert modes(merge(type="terrain", use_slope=True, skip_texture=True)) == ["use_single_color"]
    assert has_texture(Options(), {"use_heat_map": True}) and not has_texture(Options(skip_texture=True), {"use_heat_map": True})
    assert kernels.mode(True, True, True) == "relief" and kernels.mode(False, True, True) == "slope"
    with pytest.raises(TypeError):
        merge(no_such=1)


def test_colors():
    assert color.parse("#f00", 9) == (255, 0, 0, 9) and color.parse((1, 2, 3, 4), 9) == (1, 2, 3, 4) and color.parse("rgb(1, 2, 3)") == (1, 2, 3, 255)
    assert color.parse("Orange") == (255, 165, 0, 255) and len(color.palette("ylorrd")) == 9
    for bad in ("nocolor", "#12345"):
        with pytest.raises(ValueError):
            color.parse(bad)
    with pytest.raises(ValueError):
        color.palette("nopalette")


@pytest.fixture(scope="module")
def tiles(spark):
    def make(size, hole=False):
        y, x = np.mgrid[0:size, 0:size]
        v = np.full((size, size), -9999.0) if hole else 50 + 40 * np.sin(x / 3) * np.cos(y / 4)
        return ("d", 1, int(hole), 0, 1, size, size, -9999.0, 30.0, v.astype(np.float32).ravel().tolist())

    schema = "dataset string, z int, x int, y int, band int, width int, height int, nodata double, cell_size double, pixels array<float>"
    return lambda size: spark.createDataFrame([make(size), make(size, True)], schema)


def test_bitmap_and_auto_range(tiles):
    got = pipelines.tile(tiles(16), merge(color_scale_value_range=(0, 100)))
    assert got.where("x = 0 and a = 254").count() == 256 and got.where("x = 1 and a = 0").count() == 256
    assert pipelines.tile(tiles(16), merge(use_auto_range=True)).where("x = 0").select("r", "g", "b").distinct().count() > 20


def test_terrain(tiles):
    rows = pipelines.tile(tiles(17), merge(type="terrain"), max_error=1.0, bounds=(0, 0, 16, 16)).collect()
    assert len(rows) == 1 and len(rows[0].indices) % 3 == 0 and rows[0].max_z > 80


def test_glaze_matches_window_form(spark, tiles):
    got = pipelines.tile(tiles(18), merge(use_relief_glaze=True))
    assert got.where("x = 0").count() == 256
    px = pipelines.to_pixels(tiles(18).where("x = 0"), ("dataset",))
    mask = kernels.neighbours(px, ("dataset",)).withColumn("m", kernels.relief_mask(kernels.slope(F.lit(30.0)), kernels.multi_hillshade(F.lit(30.0))))
    own = kernels.tile_kernel(tiles(18).where("x = 0"), "relief")
    a = {(r.row, r.col): r.v for r in pipelines.to_pixels(own, ("dataset",)).collect()}
    b = {(r.row - 1, r.col - 1): float(r.m) for r in mask.collect()}
    assert a == b


def test_all_bands(tiles):
    two = tiles(17).withColumn("band", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("pixels", F.transform("pixels", lambda v: v * F.col("band")))
    got = {r.band: r.max_z for r in pipelines.all_bands(two.withColumn("nodata", F.col("nodata") * F.col("band")), merge(type="terrain"), max_error=0.0).collect()}
    assert set(got) == {1, 2} and got[2] == pytest.approx(2 * got[1])
    one = pipelines.bitmap(two.where("band = 1"), merge(use_channel=1))
    both = pipelines.all_bands(two, merge())
    assert both.where("band = 1").drop("band").exceptAll(one).count() == 0
