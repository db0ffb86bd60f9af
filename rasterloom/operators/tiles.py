"""Assembling tiles: windows, padding, halos, borders, crops, empty-tile tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import js_round
from ..functions.pixel import is_nodata

#: Pixels fetched for each use of a tile of 256 (fixed values).
FETCH = {"image": 256, "terrain": 257, "kernel": 258, "glaze": 258}


def tile_window(min_x: Column, max_y: Column, origin_x: Column, origin_y: Column, resolution: Column, width: Column, height: Column, fetch: int) -> dict[str, Column]:
    """The tile's window in the image, clamped to it, and how much is missing on the left and top; empty: no overlap."""
    x, y = js_round((min_x - origin_x) / resolution).cast("int"), js_round((origin_y - max_y) / resolution).cast("int")
    x0, y0 = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y)
    x1, y1 = F.least(width, x + fetch), F.least(height, y + fetch)
    return {"x0": x0, "y0": y0, "x1": x1, "y1": y1, "missing_left": x0 - x, "missing_top": y0 - y, "empty": (x1 <= x0) | (y1 <= y0)}


def empty_tile(size: int, channels: int, nodata: Column) -> Column:
    return F.array_repeat(F.coalesce(nodata, F.lit(0.0)).cast("float"), size * size * channels)


def cut(pixels: DataFrame, size: int, halo: int = 0, centred: bool = False) -> DataFrame:
    """tile_row, tile_col, row, col, v: pixels dealt to tiles of size with halo more rows and columns, at the right and bottom or (centred) on all sides.

    A pixel goes to each tile whose window holds it: a few copies at most, without a join.
    """
    before = halo // 2 if centred else 0
    last = lambda c: F.floor((F.col(c) + before) / size)
    first = lambda c: F.greatest(F.lit(0), F.ceil((F.col(c) + before - (size + halo) + 1) / size))
    tiles = pixels.withColumns({"tile_row": F.explode(F.sequence(first("row"), last("row")))}).withColumn("tile_col", F.explode(F.sequence(first("col"), last("col"))))
    place = lambda c, t: (F.col(c) - F.col(t) * size + before).cast("int")
    return tiles.withColumns({"row": place("row", "tile_row"), "col": place("col", "tile_col"), "tile_row": F.col("tile_row").cast("int"), "tile_col": F.col("tile_col").cast("int")})


def pad(tiles: DataFrame, size: int, keys: tuple[str, ...], nodata: float | None = None) -> DataFrame:
    """Every pixel of every tile: keys, row, col, v, with noData, else 0, where the tile has none. One exchange gathers a tile's pixels."""
    fill, at = F.lit(0.0 if nodata is None else float(nodata)), (F.col("row") * size + F.col("col")).cast("int")
    own = tiles.groupBy(*keys).agg(F.collect_list(F.struct(at.alias("at"), F.coalesce("v", fill).alias("v"))).alias("p"))
    lacking = F.array_except(F.sequence(F.lit(0), F.lit(size * size - 1)), F.transform("p", lambda x: x["at"]))
    whole = own.select(*keys, F.inline(F.concat("p", F.transform(lacking, lambda i: F.struct(i.alias("at"), fill.alias("v"))))))
    return whole.select(*keys, F.floor(F.col("at") / size).cast("int").alias("row"), (F.col("at") % size).cast("int").alias("col"), "v")


def backfill_border(tiles: DataFrame, size: int, keys: tuple[str, ...]) -> DataFrame:
    """One more row and column, copies of the last ones."""
    wide = lambda c: F.explode(F.when(F.col(c) == size - 1, F.array(F.lit(size - 1), F.lit(size))).otherwise(F.array(F.col(c).cast("int"))))
    return tiles.select(*keys, wide("row").alias("row"), "col", "v").select(*keys, "row", wide("col").alias("col"), "v")


def mesh_raster(tiles: DataFrame) -> DataFrame:
    """Without the first row and column."""
    return tiles.where("row >= 1 and col >= 1").withColumns({"row": (F.col("row") - 1).cast("int"), "col": (F.col("col") - 1).cast("int")})


def crop(tiles: DataFrame, height: int, width: int) -> DataFrame:
    return tiles.where((F.col("row") < height) & (F.col("col") < width))


def texture_raster(v: Column, nodata: Column, multiplier: float) -> Column:
    """Values times the multiplier; noData stays noData times the multiplier."""
    return (F.when(is_nodata(v, nodata), nodata * multiplier).otherwise(v * multiplier)).cast("float")


def nodata_tiles(tiles: DataFrame, nodata: Column, keys: tuple[str, ...], strategy: str = "full", size: int | None = None) -> DataFrame:
    """keys of tiles that are noData throughout: full, or border+center (borders and five probes only)."""
    own = tiles
    if strategy == "border+center":
        a, b, c, e = size // 4, size // 2, 3 * size // 4, size - 1
        r, k = F.col("row"), F.col("col")
        probes = (r == b) & (k == b)
        for i, j in ((a, a), (a, c), (c, a), (c, c)):
            probes |= (r == i) & (k == j)
        own = tiles.where(r.isin(0, e) | k.isin(0, e) | probes)
    return own.groupBy(*keys).agg(F.bool_and(is_nodata(F.col("v"), nodata)).alias("hole")).where("hole").select(*keys)


def drop_nodata_tiles(tiles: DataFrame, nodata: Column, keys: tuple[str, ...], **options) -> DataFrame:
    return tiles.join(nodata_tiles(tiles, nodata, keys, **options), list(keys), "left_anti")


def to_arrays(pixels: DataFrame, keys: tuple[str, ...], width: int) -> DataFrame:
    """Tiles (keys, width, height, pixels) of pixels (keys, row, col, v); a tile's pixels are gathered, so their number is the tile's size."""
    rows = pixels.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row", "col", "v"))).alias("p"))
    return rows.select(*keys, F.lit(width).alias("width"), (F.size("p") / width).cast("int").alias("height"), F.transform("p", lambda x: x["v"].cast("float")).alias("pixels"))


def to_pixels(tiles: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    at = F.col("pos")
    return tiles.select(*keys, "width", F.posexplode("pixels").alias("pos", "v")).select(*keys, F.floor(at / F.col("width")).cast("int").alias("row"), (at % F.col("width")).cast("int").alias("col"), F.col("v").cast("double").alias("v"))


def band(tiles: DataFrame, channels: int, channel: int) -> DataFrame:
    """One channel (from 0) of pixel-interleaved arrays."""
    return tiles.withColumn("pixels", F.transform(F.sequence(F.lit(0), (F.size("pixels") / channels).cast("int") - 1), lambda i: F.get("pixels", i * channels + channel)))


def select_band(pixels: DataFrame, use_channel: int | None = None, use_channel_index: int | None = None, default: int = 1) -> DataFrame:
    """Rows of one band (from 1); an index from 0 wins over a channel from 1."""
    k = default if use_channel_index is None and use_channel is None else use_channel if use_channel_index is None else use_channel_index + 1
    return pixels.where(F.col("band") == k)


def auto_range(pixels: DataFrame, nodata: Column, keys: tuple[str, ...], default: tuple[float, float] = (0.0, 255.0)) -> DataFrame:
    """lo and hi of each tile's valid values; the default where there are none."""
    ok = ~(F.isnan("v") | is_nodata(F.col("v"), nodata))
    agg = pixels.groupBy(*keys).agg(F.min(F.when(ok, F.col("v"))).alias("lo"), F.max(F.when(ok, F.col("v"))).alias("hi"))
    return agg.withColumns({"lo": F.coalesce("lo", F.lit(default[0])), "hi": F.coalesce("hi", F.lit(default[1]))})


def z_range(tiles: DataFrame) -> DataFrame:
    """lo and hi over tiles (lo, hi), without null tiles and values that aren't finite."""
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    return tiles.agg(F.min(ok("lo")).alias("lo"), F.max(ok("hi")).alias("hi"))


def residual_rms(pixels: DataFrame, a: str, b: str, keys: tuple[str, ...]) -> DataFrame:
    d = F.col(a) - F.col(b)
    return pixels.groupBy(*keys).agg(F.sqrt(F.sum(d * d) / F.count("*")).alias("rms"))


def focal(pixels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Mean, least and greatest value of each 3x3 neighbourhood."""
    from .kernels import NEIGHBOURS, neighbours

    cols = [F.col(n) for n in NEIGHBOURS]
    return neighbours(pixels, keys).select(*keys, "row", "col", (sum(cols[1:], cols[0]) / 9).alias("mean"), F.least(*cols).alias("least"), F.greatest(*cols).alias("most"))




def resample(pixels: DataFrame, keys: tuple[str, ...], size: int, to: int, linear: bool = True) -> DataFrame:
    """Tiles of size pixels a side as tiles of `to` a side: bilinear between pixel centres, or the nearest pixel."""
    step = size / to
    place = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(size - 1.0), (F.col(c) + 0.5) * step - 0.5))
    grid = pixels.select(*keys).distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(to - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(to - 1))))
    own = pixels.select(*keys, "row", "col", "v")
    if not linear:
        near = lambda c: F.least(F.lit(size - 1), F.floor((F.col(c) + 0.5) * step)).cast("int")
        return grid.withColumns({"row": near("r"), "col": near("c")}).join(own, [*keys, "row", "col"]).select(*keys, F.col("r").alias("row"), F.col("c").alias("col"), "v")
    y, x = place("r"), place("c")
    y0, x0 = F.floor(y), F.floor(x)
    corners = F.array(*(F.struct((y0 + i).alias("row"), (x0 + j).alias("col"), ((1 - (y - y0) if not i else y - y0) * (1 - (x - x0) if not j else x - x0)).alias("w")) for i in (0, 1) for j in (0, 1)))
    parts = grid.select(*keys, "r", "c", F.inline(corners)).where("w > 0").withColumns({"row": F.col("row").cast("int"), "col": F.col("col").cast("int")})
    return parts.join(own, [*keys, "row", "col"]).groupBy(*keys, "r", "c").agg(F.sum(F.col("w") * F.col("v")).alias("v")).select(*keys, F.col("r").alias("row"), F.col("c").alias("col"), "v")
