"""Point queries: picks and sample grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bounds_lonlat, lonlat_to_tile, lonlat_to_uv, pixel_to_lonlat, tile_bounds, uv_to_pixel


def pick_coordinate(coordinate: Column) -> Column:
    """longitude, latitude, elevation of an array of three numbers; else null."""
    ok = (F.size(coordinate) == 3) & ~F.exists(coordinate, lambda x: x.isNull())
    return F.when(ok, F.struct(F.get(coordinate, F.lit(0)).alias("longitude"), F.get(coordinate, F.lit(1)).alias("latitude"), F.get(coordinate, F.lit(2)).alias("elevation")))


def bitmap_pixel(u: Column, v: Column, width: int, height: int) -> tuple[Column, Column]:
    return F.floor(u * width).cast("int"), F.floor(v * height).cast("int")


def terrain_pixel(u: Column, v: Column, width: int, height: int) -> tuple[Column, Column]:
    own = lambda t, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(t * (n - 1)))).cast("int")
    return own(u, width), own(v, height)


def sample_grid(points: DataFrame, pixels: DataFrame, bounds: tuple[float, float, float, float], width: int, height: int, grid: int = 3) -> DataFrame:
    """For each point (id, lon, lat), the n x n pixels around its own that lie in the raster: id, row, col, lon, lat, elevation."""
    west, south, east, north = (F.lit(float(b)) for b in bounds)
    px, py = uv_to_pixel(*lonlat_to_uv(F.col("lon"), F.col("lat"), west, south, east, north), F.lit(width), F.lit(height))
    k = grid // 2
    steps = F.sequence(F.lit(-k), F.lit(grid - 1 - k))
    near = points.withColumns({"px": px, "py": py}).select("id", "px", "py", F.explode(steps).alias("dy")).select("id", (F.col("py") + F.col("dy")).alias("row"), F.explode(steps).alias("dx"), "px")
    near = near.select("id", "row", (F.col("px") + F.col("dx")).alias("col")).where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    lon, lat = pixel_to_lonlat(F.col("col"), F.col("row"), F.lit(width), F.lit(height), west, south, east, north)
    return near.join(pixels.select("row", "col", "v"), ["row", "col"]).where("v is not null").select("id", "row", "col", lon.alias("lon"), lat.alias("lat"), F.col("v").alias("elevation"))


def uv_or_box(u: Column, v: Column, lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """A pick's own u and v, or, without them, those of its coordinate in the tile's box (linear on the Mercator plane)."""
    x, y = lonlat_to_uv(lon, lat, west, south, east, north)
    return F.coalesce(u, x), F.coalesce(v, y)


def tile_box(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north of a tile, in degrees."""
    b = tile_bounds(x, y, z)
    box = bounds_lonlat(b["min_x"], b["min_y"], b["max_x"], b["max_y"])
    return box["west"], box["south"], box["east"], box["north"]


def at_tiles(points: DataFrame, tiles: DataFrame, z: int) -> DataFrame:
    """points (lon, lat and more) with the columns of their tile at a zoom (tiles: z, x, y, width, height, pixels and more), and px, py, their
    pixel in it. The join is on the tile, so only tiles that are asked for meet points, and their pixels are looked up in place."""
    x, y = lonlat_to_tile(F.col("lon"), F.col("lat"), z)
    own = points.withColumns({"x": x, "y": y}).join(tiles.where(F.col("z") == z), ["x", "y"])
    u, v = lonlat_to_uv(F.col("lon"), F.col("lat"), *tile_box(F.col("x"), F.col("y"), F.col("z")))
    px, py = uv_to_pixel(u, v, F.col("width"), F.col("height"))
    return own.withColumns({"px": px, "py": py})


def pixel_value(row: Column, col: Column) -> Column:
    """The pixel of a tile's array; null outside of the tile."""
    inside = row.between(0, F.col("height") - 1) & col.between(0, F.col("width") - 1)
    return F.when(inside, F.get("pixels", row * F.col("width") + col))


def sample_tiles(points: DataFrame, tiles: DataFrame, z: int, grid: int = 3) -> DataFrame:
    """For each point (id, lon, lat), the n x n pixels around its own that lie in its tile: id, x, y, row, col, lon, lat, elevation."""
    k = grid // 2
    steps = F.sequence(F.lit(-k), F.lit(grid - 1 - k))
    near = at_tiles(points.select("id", "lon", "lat"), tiles, z).withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    row, col = F.col("py") + F.col("dy"), F.col("px") + F.col("dx")
    lon, lat = pixel_to_lonlat(col, row, F.col("width"), F.col("height"), *tile_box(F.col("x"), F.col("y"), F.col("z")))
    out = near.select("id", "x", "y", row.alias("row"), col.alias("col"), lon.alias("lon"), lat.alias("lat"), pixel_value(row, col).alias("elevation"))
    return out.where("elevation is not null")
