"""3x3 kernels on pixels (row, col, v and tile keys) by lines, and on tiles (arrays of pixels) as numpy over Arrow batches.

The form by lines gathers pixels in lines and brings each line to its neighbours: two exchanges. The Arrow form needs none: a tile
carries its halo.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixel import f32, is_nodata
from ..session import ship

#: Lights of the multi-directional hillshade: azimuth, altitude, weight; the least value of the relief table (fixed values).
LIGHTS, RELIEF_FLOOR = ((315.0, 45.0, 0.60), (225.0, 35.0, 0.25), (0.0, 35.0, 0.15)), 0.010
NEIGHBOURS = ("nw", "n", "ne", "w", "c", "e", "sw", "s", "se")


def neighbours(pixels: DataFrame, keys: tuple[str, ...] = (), value: str = "v") -> DataFrame:
    """pixels plus nw ... se, for pixels that have all of them; a missing pixel is nobody's neighbour.

    Two exchanges, of whole lines: one gathers a line's pixels, one brings a line to those above and below it. Tasks hold three lines.
    """
    more = [c for c in pixels.columns if c not in (*keys, "row", "col")]
    lines = pixels.groupBy(*keys, "row").agg(F.sort_array(F.collect_list(F.struct("col", *more))).alias("cells"))
    col = lambda k: F.get("cells", k)["col"]
    lacking = lambda i: F.array_repeat(F.lit(None).cast(pixels.schema[value].dataType), F.when(i > 0, col(i) - col(i - 1) - 1).otherwise(0).cast("int"))
    dense = F.size("cells") == col(F.size("cells") - 1) - col(F.lit(0)) + 1
    gapped = F.flatten(F.transform("cells", lambda x, i: F.concat(lacking(i), F.array(x[value]))))
    values = F.when(dense, F.transform("cells", lambda x: x[value])).otherwise(gapped)
    lines = lines.select(*keys, "row", "cells", F.struct(col(F.lit(0)).alias("first"), values.alias("values")).alias("line"))
    step = F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("step")
    spread = lines.select(*keys, "row", "cells", "line", step).withColumns({"row": (F.col("row") + F.col("step")).cast(pixels.schema["row"].dataType)})
    only = lambda k, c: F.max(F.when(F.col("step") == k, F.col(c)))  # noqa: E731  one line is not null
    near = spread.groupBy(*keys, "row").agg(only(1, "line").alias("a"), only(0, "line").alias("m"), only(-1, "line").alias("b"), only(0, "cells").alias("cells"))
    at = lambda part, x, d: F.get(F.col(f"{part}.values"), (x["col"] + d - F.col(f"{part}.first")).cast("int"))
    own = lambda x: [x[c].alias(c) for c in ("col", *more)] + [at(p, x, d).alias(n) for n, (p, d) in zip(NEIGHBOURS, ((p, d) for p in "amb" for d in (-1, 0, 1)), strict=True)]
    whole = near.where("a is not null and m is not null and b is not null").select(*keys, "row", F.inline(F.transform("cells", lambda x: F.struct(*own(x)))))
    for n in NEIGHBOURS:
        whole = whole.where(F.col(n).isNotNull())
    return whole.select(*pixels.columns, *NEIGHBOURS)


def gradients(cell: Column, north_up: bool = False) -> tuple[Column, Column]:
    """Horn's dz/dx, and dz/dy as south minus north, or as north minus south."""
    c = {n: F.col(n) for n in NEIGHBOURS}
    dx = ((c["ne"] + 2 * c["e"] + c["se"]) - (c["nw"] + 2 * c["w"] + c["sw"])) / (8 * cell)
    dy = ((c["sw"] + 2 * c["s"] + c["se"]) - (c["nw"] + 2 * c["n"] + c["ne"])) / (8 * cell)
    return dx, -dy if north_up else dy


def _valid(value: Column, nodata: Column | None) -> Column:
    """A 32-bit float; NaN where the centre pixel is noData (its neighbours are not looked at)."""
    return f32(value) if nodata is None else F.when(is_nodata(F.col("c"), nodata), F.lit(float("nan")).cast("float")).otherwise(f32(value))


def slope(cell: Column, z_factor: float = 1.0, nodata: Column | None = None) -> Column:
    """Degrees, over neighbours()."""
    dx, dy = gradients(cell)
    return _valid(F.degrees(F.atan(z_factor * F.sqrt(dx * dx + dy * dy))), nodata)


def _shade(dx: Column, dy: Column, azimuth: float, altitude: float, z_factor: float) -> Column:
    zenith = math.radians(90 - altitude)
    turn = 360 - azimuth + 90
    turn = math.radians(turn - 360 if turn >= 360 else turn)
    steep = F.atan(z_factor * F.sqrt(dx * dx + dy * dy))
    return math.cos(zenith) * F.cos(steep) + math.sin(zenith) * F.sin(steep) * F.cos(turn - F.atan2(dy, -dx))


def hillshade(cell: Column, azimuth: float = 315, altitude: float = 45, z_factor: float = 1.0, nodata: Column | None = None) -> Column:
    dx, dy = gradients(cell, True)
    return _valid(F.greatest(F.lit(0.0), F.least(F.lit(255.0), 255 * _shade(dx, dy, azimuth, altitude, z_factor))), nodata)


def multi_hillshade(cell: Column, z_factor: float = 1.0, nodata: Column | None = None) -> Column:
    dx, dy = gradients(cell, True)
    total = sum((w * F.greatest(F.lit(0.0), _shade(dx, dy, az, alt, z_factor)) for az, alt, w in LIGHTS), F.lit(0.0))
    return _valid(F.least(F.lit(255.0), total * 255), nodata)


def relief_weight(hill: Column, steep: Column, weight: float = 0.5) -> Column:
    """The relief table's entry for a hillshade and a slope of 0..255."""
    return f32(F.greatest(F.lit(RELIEF_FLOOR), hill / 255.0 * (1 - steep / 255.0 * weight)))


def relief_mask(slope_deg: Column, hill: Column, weight: float = 0.5) -> Column:
    """1..255, or 0 where the slope is NaN."""
    s = F.greatest(F.lit(0), F.least(F.lit(255), (slope_deg.cast("double") * 255 / 90).cast("int")))
    h = F.greatest(F.lit(0.0), F.least(F.lit(255.0), hill.cast("double"))).cast("int")
    return F.when(F.isnan(slope_deg), 0).otherwise(F.greatest(F.lit(1), (relief_weight(h, s, weight).cast("double") * 255).cast("int")))


def relief(pixels: DataFrame, cell: Column, z_factor: float = 1.0, weight: float = 0.5, nodata: Column | None = None) -> DataFrame:
    """neighbours() with slope, shade (from several lights) and mask; gradients, steepness and aspect are columns, computed once each."""
    dx, dy = gradients(cell, True)
    steep = F.atan(z_factor * F.sqrt(F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy")))
    own = pixels.withColumns({"__dx": dx, "__dy": dy}).withColumns({"__steep": steep, "__aspect": F.atan2("__dy", -F.col("__dx"))})
    own = own.withColumns({"__cos": F.cos("__steep"), "__sin": F.sin("__steep")})
    parts = []
    for azimuth, altitude, share in LIGHTS:
        zenith, turn = math.radians(90 - altitude), math.radians((450 - azimuth) % 360)
        parts.append(share * F.greatest(F.lit(0.0), math.cos(zenith) * F.col("__cos") + math.sin(zenith) * F.col("__sin") * F.cos(turn - F.col("__aspect"))))
    total = sum(parts, F.lit(0.0))
    own = own.withColumns({"slope": _valid(F.degrees("__steep"), nodata), "shade": _valid(F.least(F.lit(255.0), total * 255), nodata)})
    return own.withColumn("mask", relief_mask(F.col("slope"), F.col("shade"), weight)).drop("__dx", "__dy", "__steep", "__aspect", "__cos", "__sin")


def relief_table(spark, weight: float = 0.5) -> DataFrame:
    """hill, steep and entry for all 65,536 pairs."""
    ids = spark.range(65536)
    h, s = F.floor(F.col("id") / 256).cast("int"), (F.col("id") % 256).cast("int")
    return ids.select(h.alias("hill"), s.alias("steep"), relief_weight(h, s, weight).alias("entry"))


def mode(use_relief: bool, use_slope: bool, use_hillshade: bool) -> str | None:
    """Relief before slope before hillshade."""
    return "relief" if use_relief else "slope" if use_slope else "hillshade" if use_hillshade else None


# --- the Arrow form -------------------------------------------------------------------------------------------------------


def kernel_arrays(grid: np.ndarray, cell: float, kind: str, z_factor: float = 1.0, nodata: float | None = None, weight: float = 0.5, azimuth: float = 315, altitude: float = 45) -> np.ndarray:
    """slope, hillshade, multi_hillshade or relief of a grid with a halo of one pixel."""
    z = grid.astype(np.float64)
    r = {n: z[i : z.shape[0] - 2 + i, j : z.shape[1] - 2 + j] for n, (i, j) in zip(NEIGHBOURS, np.ndindex(3, 3), strict=True)}
    dx = ((r["ne"] + 2 * r["e"] + r["se"]) - (r["nw"] + 2 * r["w"] + r["sw"])) / (8 * cell)
    dy = ((r["sw"] + 2 * r["s"] + r["se"]) - (r["nw"] + 2 * r["n"] + r["ne"])) / (8 * cell)
    steep = np.arctan(z_factor * np.sqrt(dx * dx + dy * dy))

    def shade(az: float, alt: float) -> np.ndarray:
        zenith, turn = math.radians(90 - alt), math.radians((450 - az) % 360)
        return math.cos(zenith) * np.cos(steep) + math.sin(zenith) * np.sin(steep) * np.cos(turn - np.arctan2(-dy, -dx))

    degrees = np.degrees(steep).astype(np.float32)
    if kind == "slope":
        out = degrees
    elif kind == "hillshade":
        out = np.clip(255 * shade(azimuth, altitude), 0, 255).astype(np.float32)
    else:
        out = np.minimum(255, 255 * sum(w * np.maximum(0, shade(az, alt)) for az, alt, w in LIGHTS)).astype(np.float32)
    hole = np.zeros(out.shape, bool) if nodata is None else np.isnan(r["c"]) if np.isnan(nodata) else r["c"].astype(np.float32) == np.float32(nodata)
    if kind == "relief":
        s = np.clip((np.nan_to_num(degrees).astype(np.float64) * 255 / 90).astype(int), 0, 255)
        h = np.nan_to_num(np.clip(out.astype(np.float64), 0, 255)).astype(int)
        entry = np.maximum(RELIEF_FLOOR, h / 255 * (1 - s / 255 * weight)).astype(np.float32)
        return np.where(hole | np.isnan(degrees), 0, np.maximum(1, (entry.astype(np.float64) * 255).astype(int))).astype(np.float32)
    return np.where(hole, np.float32(np.nan), out)


def tile_kernel(tiles: DataFrame, kind: str, keys: tuple[str, ...] = ("dataset", "z", "x", "y", "band"), **options) -> DataFrame:
    """The kernel of each tile (keys, width, height, nodata, cell_size, pixels with halo): keys, width, height, pixels without halo."""
    ship(tiles.sparkSession)
    own = tiles.select(*keys, "width", "height", "nodata", "cell_size", "pixels")
    schema = own.select(*keys, "width", "height", F.col("pixels").cast("array<float>").alias("pixels")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = len(keys)
            w, h, nd, cell = (b.column(k + i).to_pylist() for i in range(4))
            out = [kernel_arrays(np.asarray(p.values, np.float32).reshape(h[i], w[i]), cell[i], kind, nodata=nd[i], **options).ravel() for i, p in enumerate(b.column(k + 4))]
            cols = [*(b.column(i) for i in range(k)), pa.array([x - 2 for x in w], pa.int32()), pa.array([x - 2 for x in h], pa.int32()), pa.array(out, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return own.mapInArrow(run, schema)
