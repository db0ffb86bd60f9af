"""Web-Mercator and tile-grid functions on Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tile grid: earth circumference, half of it, resolution of zoom 0 at 256 pixels.
CIRCUMFERENCE = 2 * math.pi * 6378137
HALF = 20037508.342789244
ORIGIN = (-HALF, HALF)
BASE_RESOLUTION = 156543.03125


def js_round(x: Column) -> Column:
    """Half up, towards positive infinity."""
    return F.floor(x + 0.5)


def lon_of(x: Column) -> Column:
    return x / HALF * 180.0


def lat_of(y: Column) -> Column:
    return F.lit(180 / math.pi) * (2 * F.atan(F.exp(y / HALF * math.pi)) - math.pi / 2)


def mercator_x(lon: Column) -> Column:
    return lon / 180.0 * HALF


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) / math.pi * HALF


def zoom_from_resolution(tile_size: Column, resolution: Column) -> Column:
    return js_round(F.log2(F.lit(CIRCUMFERENCE) / (resolution * tile_size))).cast("int")


def zoom_range(tile_size: Column, resolution: Column, images: Column) -> tuple[Column, Column]:
    """Least and greatest zoom; overviews are taken to be consecutive."""
    top = zoom_from_resolution(tile_size, resolution)
    return (top - (images - 1)).cast("int"), top


def bounds_lonlat(x0: Column, y0: Column, x1: Column, y1: Column) -> dict[str, Column]:
    """West, south, east, north of a box in metres whose corners come in any order."""
    return {"west": lon_of(F.least(x0, x1)), "south": lat_of(F.least(y0, y1)), "east": lon_of(F.greatest(x0, x1)), "north": lat_of(F.greatest(y0, y1))}


def _grid_resolution(z: Column, tile_size: int) -> Column:
    return F.lit(CIRCUMFERENCE / tile_size) / F.pow(F.lit(2.0), z)


def tile_bounds(x: Column, y: Column, z: Column, tile_size: int = 256) -> dict[str, Column]:
    """A tile's box in metres; y grows downwards."""
    side = tile_size * _grid_resolution(z, tile_size)
    min_x, max_y = F.lit(ORIGIN[0]) + x * side, F.lit(ORIGIN[1]) - y * side
    return {"min_x": min_x, "min_y": max_y - side, "max_x": min_x + side, "max_y": max_y}


def cell_size(y: Column, z: Column, tile_size: int = 256) -> Column:
    """Metres on the ground of a pixel at the tile's middle latitude."""
    lat = F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * (y + 0.5) / F.pow(F.lit(2.0), z))))
    return F.lit(CIRCUMFERENCE) / F.pow(F.lit(2.0), z) * F.cos(lat) / tile_size


def cell_size_or(cell: Column, min_x: Column, max_x: Column) -> Column:
    """The given cell size, or a 256th of the box's width."""
    return F.coalesce(cell, (max_x - min_x) / 256.0)


def _y_of_lat(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def lonlat_to_uv(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """u from the west, v from the north, linear on the Mercator plane."""
    top = _y_of_lat(north)
    return (lon - west) / (east - west), (top - _y_of_lat(lat)) / (top - _y_of_lat(south))


def uv_to_pixel(u: Column, v: Column, width: Column, height: Column) -> tuple[Column, Column]:
    return F.floor(u * (width - 1)).cast("int"), F.floor(v * (height - 1)).cast("int")


def pixel_to_lonlat(px: Column, py: Column, width: Column, height: Column, west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column]:
    top = _y_of_lat(north)
    y = top - py / (height - 1) * (top - _y_of_lat(south))
    return west + px / (width - 1) * (east - west), F.degrees(2 * F.atan(F.exp(y)) - math.pi / 2)


def lonlat_to_tile(lon: Column, lat: Column, z: Column | int) -> tuple[Column, Column]:
    """Column and row of the tile that holds a point."""
    n = F.pow(F.lit(2.0), F.lit(z) if isinstance(z, int) else z)
    rad = F.radians(lat)
    return F.floor((lon + 180.0) / 360.0 * n).cast("int"), F.floor((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n).cast("int")
