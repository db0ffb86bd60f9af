"""Whole tiles: pictures, terrain (mesh, derived surface, texture) and glazes from options. Each is a function of DataFrames.

A tile is a row (keys, band, width, height, nodata, cell_size, pixels); terrain tiles have one pixel a side more than a picture, tiles for
kernels and glazes two (options.fetch_size). No tile is joined with another one, so nothing here is shuffled but what a docstring names.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, lod
from ..functions.color import parse
from ..functions.pixel import f32, is_invalid
from ..operators import kernels, mesh, style
from ..operators.tiles import texture_raster, to_pixels
from ..session import ship
from .options import Options, has_texture, is_kernel

KEYS = ("dataset", "z", "x", "y")
#: planar_config of bands that lie one after the other; their colours aren't tested for noData (a fixed value).
PLANAR = 2


def channel(o: Options) -> int:
    return o.use_channel_index + 1 if o.use_channel_index is not None else o.use_channel or 1


def _band(tiles: DataFrame, o: Options) -> DataFrame:
    return tiles.where(F.col("band") == channel(o))


def _nodata(o: Options) -> Column:
    return F.coalesce(F.lit(o.no_data_value).cast("double"), F.col("nodata"))


def _hole(v: Column, nodata: Column) -> Column:
    return F.coalesce(f32(v).eqNullSafe(f32(nodata)) & nodata.isNotNull(), F.lit(False))


def _colored(df: DataFrame, rgba, *keep: str) -> DataFrame:
    return df.select(*KEYS, *keep, *(c.cast("int").alias(n) for n, c in zip("rgba", rgba, strict=True)))


def null_tiles(tiles: DataFrame, o: Options) -> DataFrame:
    """Pictures of tiles (keys, width, height) in the null colour throughout."""
    at = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("at")
    own = tiles.select(*KEYS, "width", at).select(*KEYS, F.floor(F.col("at") / F.col("width")).cast("int").alias("row"), (F.col("at") % F.col("width")).cast("int").alias("col"))
    return _colored(own, style.constant(parse(o.null_color)), "row", "col")


def _own_range(pixels: Column, nodata: Column, default: tuple[float, float]) -> tuple[Column, Column]:
    """Least and greatest valid value of a tile's array."""
    valid = F.filter(pixels, lambda v: ~is_invalid(v, nodata))
    return tuple(F.coalesce(f(valid).cast("double"), F.lit(float(d))) for f, d in zip((F.array_min, F.array_max), default, strict=True))


def bitmap(tiles: DataFrame, o: Options, sample_type: str = "Float32") -> DataFrame:
    """keys, row, col, r, g, b, a of tiles (keys, band, width, height, nodata, pixels). Without a channel, three or four bands are colours.

    With use_auto_range a tile's own range of valid values takes the place of the configured one (of the heat map and of opacity;
    classes, exact values and clip bounds stay). A channel that a tile doesn't have gives the null colour throughout, and so does
    use_swiss_relief, which needs a mask (terrain_texture has one). Only colours from several bands and the search for tiles
    without the channel exchange rows.
    """
    if o.use_swiss_relief:
        return null_tiles(tiles.where("band = 1"), o)
    names = [*KEYS, "nodata"]
    if o.use_channel is None and o.use_channel_index is None and (o.num_of_channels or 1) in (3, 4):
        px = to_pixels(tiles, (*names, "band")).groupBy(*names, "row", "col").agg(*(F.max(F.when(F.col("band") == k, F.col("v"))).alias(f"b{k}") for k in range(1, 5)))
        return _colored(px, style.style_rgb(F.col("b1"), F.col("b2"), F.col("b3"), o, None if o.planar_config == PLANAR else _nodata(o), F.col("b4") if o.num_of_channels == 4 else None), "row", "col")
    k, own = channel(o), _band(tiles, o)
    if k < 1 or o.num_of_channels is not None and k > o.num_of_channels:
        return null_tiles(tiles.where("band = 1"), o)
    span = None
    if o.use_auto_range:
        low, high = _own_range(F.col("pixels"), _nodata(o), o.color_scale_value_range)
        own, names, span = own.withColumns({"lo": low, "hi": high}), [*names, "lo", "hi"], (F.col("lo"), F.col("hi"))
    out = _colored(to_pixels(own, tuple(names)), style.style(F.col("v"), o, _nodata(o), sample_type, span), "row", "col")
    if k == 1:
        return out
    keys = tiles.where(F.col("band") == k).select(*(F.col(c).alias(f"has_{c}") for c in KEYS)).distinct()
    first = tiles.where("band = 1").select(*KEYS, "width", "height")
    lacking = first.join(keys, [first[c] == keys[f"has_{c}"] for c in KEYS], "left_anti")
    return out.unionByName(null_tiles(lacking, o))


def relief_masks(tiles: DataFrame, o: Options) -> DataFrame:
    """The relief mask of tiles with a halo of two: the first band as it is. Without a cell size, a 256th of the tile's width."""
    own = _bounded(tiles.where("band = 1"), None)
    own = own.withColumn("cell_size", geo.cell_size_or(F.col("cell_size"), F.col("min_x"), F.col("max_x")))
    return kernels.tile_kernel(own, "relief", (*KEYS, "band"), z_factor=o.z_factor, weight=o.swiss_slope_weight)


def glaze(tiles: DataFrame, o: Options, masks: DataFrame | None = None) -> DataFrame:
    """The relief glaze of tiles with a halo of two, or of masks that are known. A tile without a first band has no mask: transparent."""
    own = relief_masks(tiles, o) if masks is None else masks
    return _colored(to_pixels(own, KEYS), style.style_glaze(F.col("v"), o.max_glaze_alpha), "row", "col")


def unmasked_glaze(tiles: DataFrame) -> DataFrame:
    """The glaze of tiles (keys, width, height) whose mask is missing: transparent."""
    return null_tiles(tiles, Options(null_color=(0, 0, 0, 0)))


def elevations(tiles: DataFrame, o: Options) -> DataFrame:
    """tiles of one band, with terrain elevations for pixels."""
    nd = _nodata(o)
    value = lambda v: F.when(_hole(v, nd) | F.isnan(v) | (F.abs(v * o.multiplier) > 3.4e38), float(o.terrain_min_value)).otherwise(v * o.multiplier).cast("float")
    return _band(tiles, o).withColumn("pixels", F.transform("pixels", value))


def _probes(strategy: str) -> Column:
    """The places of a tile's array that the test for noData looks at."""
    w, h = F.col("width"), F.col("height")
    if strategy != "border+center":
        return F.sequence(F.lit(0), w * h - 1)
    across, down = F.sequence(F.lit(0), w - 1), F.sequence(F.lit(0), h - 1)
    at = lambda a, b: F.floor(h * b).cast("int") * w + F.floor(w * a).cast("int")
    inner = F.array(*(at(a, b) for a, b in ((0.5, 0.5), (0.25, 0.25), (0.75, 0.25), (0.25, 0.75), (0.75, 0.75))))
    return F.concat(across, F.transform(across, lambda i: (h - 1) * w + i), F.transform(down, lambda i: i * w), F.transform(down, lambda i: i * w + w - 1), inner)


def with_data(tiles: DataFrame, o: Options) -> DataFrame:
    """The band's tiles that aren't noData throughout, by no_data_check: full, or border+center. Any other check looks at all bands of
    a tile (one exchange of a flag a band)."""
    nd = _nodata(o)
    places = _probes(o.no_data_check)
    empty = F.forall("pixels", lambda v: _hole(v, nd)) if o.no_data_check != "border+center" else F.forall(places, lambda i: _hole(F.get("pixels", i), nd))
    if o.no_data_check in ("full", "border+center"):
        return _band(tiles, o).where(~empty)
    some = tiles.where(~empty).select(*(F.col(c).alias(f"has_{c}") for c in KEYS)).distinct()
    own = _band(tiles, o)
    return own.join(some, [own[c] == some[f"has_{c}"] for c in KEYS], "left_semi")


MESH = "positions array<float>, uvs array<float>, indices array<int>, min_z double, max_z double"


def mesh_arrays(grid: np.ndarray, bounds: tuple[float, float, float, float], max_error: float, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Positions, texture coordinates and indices, with a skirt below the outer edges; the range is that before the skirt."""
    points, index = mesh.triangulate(grid, max_error, o.tesselator)
    cells = max(grid.shape[0] - 1, 1)
    sx, sy = (bounds[2] - bounds[0]) / cells, (bounds[3] - bounds[1]) / cells
    z = grid[points[:, 1], points[:, 0]].astype(np.float64) * o.vertical_exaggeration
    xyz = np.stack([points[:, 0] * sx + bounds[0], -points[:, 1] * sy + bounds[3], z], 1)
    uv = points / float(cells)
    low, high = float(z.min()), float(z.max())
    drop = o.terrain_skirt_height * o.vertical_exaggeration
    if drop > 0:
        sides = np.concatenate([index[:, [0, 1]], index[:, [1, 2]], index[:, [2, 0]]])
        pairs, count = np.unique(np.sort(sides, axis=1), axis=0, return_counts=True)
        edges = pairs[count % 2 == 1]
        base, i = len(xyz), np.arange(len(edges))
        ends = edges.ravel()
        xyz = np.concatenate([xyz, xyz[ends] - [0, 0, drop]])
        uv = np.concatenate([uv, uv[ends]])
        e0, e1, b = edges[:, 0], edges[:, 1], base + 2 * i
        index = np.concatenate([index, np.stack([e0, b + 1, e1], 1), np.stack([b + 1, e0, b], 1)])
    return xyz.astype(np.float32), uv.astype(np.float32), index.astype(np.int32), low, high


def _bounded(tiles: DataFrame, bounds: tuple[float, float, float, float] | None) -> DataFrame:
    """tiles with min_x, min_y, max_x, max_y: the given box for all, or each tile's own on the grid, in metres."""
    box = geo.tile_bounds(F.col("x"), F.col("y"), F.col("z")) if bounds is None else dict(zip(("min_x", "min_y", "max_x", "max_y"), (F.lit(float(b)) for b in bounds), strict=True))
    return tiles.withColumns({k: v.cast("double") for k, v in box.items()})


def mesh_errors(tiles: DataFrame, overviews: DataFrame, explicit: float | None = None) -> DataFrame:
    """tiles with max_error: the explicit one if not 0, else that of the overview (dataset, image_index, zoom, mesh_max_error) which serves
    the tile's zoom, else the default. overviews has a few rows a dataset; a row for each dataset and zoom is joined."""
    wanted = tiles.select("dataset", "z").distinct()
    picked = lod.overview_pick(wanted, overviews).join(overviews.select("dataset", "image_index", "mesh_max_error"), ["dataset", "image_index"]).select("dataset", "z", "mesh_max_error")
    own = lod.resolve_error(F.lit(explicit).cast("double"), F.col("mesh_max_error").cast("double"))
    return tiles.join(picked, ["dataset", "z"], "left").withColumn("max_error", own).drop("mesh_max_error")


def terrain(tiles: DataFrame, o: Options, max_error: float | None = None, bounds: tuple[float, float, float, float] | None = None, overviews: DataFrame | None = None) -> DataFrame:
    """keys, MESH, raw (the mesh's elevations), raw_width and raw_height of tiles that have any data.

    Tiles of 2^k + 1 pixels a side are meshed as they are; of tiles of 2^k + 2 (with a halo for kernels) the first row and column
    are left out. Bounds are each tile's own, unless given. The error is max_error (None: 4); with overviews, None and 0 mean
    what they say for the tile's zoom.
    """
    ship(tiles.sparkSession)
    own = _bounded(elevations(with_data(tiles, o), o), bounds)
    own = own.withColumn("max_error", F.lit(float(lod.DEFAULT_ERROR if max_error is None else max_error))) if overviews is None else mesh_errors(own, overviews, max_error)
    grids = own.select(*KEYS, "width", "height", "pixels", "min_x", "min_y", "max_x", "max_y", "max_error")

    def run(batches):
        for b in batches:
            rows, raws = [], []
            for w, h, p, *more in zip(*(b.column(i).to_pylist() for i in (4, 5)), b.column(6), *(b.column(i).to_pylist() for i in range(7, 12)), strict=True):
                grid = np.asarray(p.values, np.float32).reshape(h, w)
                grid = grid[1:, 1:] if w > 2 and (w - 2) & (w - 3) == 0 else grid
                rows.append(mesh_arrays(grid, tuple(more[:4]), more[4], o))
                raws.append(grid)
            cols = [pa.array([r[i].ravel() for r in rows], t) for i, t in enumerate((pa.list_(pa.float32()), pa.list_(pa.float32()), pa.list_(pa.int32())))]
            more = [pa.array([r[i] for r in rows], pa.float64()) for i in (3, 4)] + [pa.array([g.ravel() for g in raws], pa.list_(pa.float32()))] + [pa.array([g.shape[i] for g in raws], pa.int32()) for i in (1, 0)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), *cols, *more], [*KEYS, "positions", "uvs", "indices", "min_z", "max_z", "raw", "raw_width", "raw_height"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grids.select(*KEYS).schema)
    return grids.mapInArrow(run, f"{kinds}, {MESH}, raw array<float>, raw_width int, raw_height int")


def terrain_derived(tiles: DataFrame, o: Options, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """keys, width, height and pixels of the derived surface of tiles with a halo of two: relief mask before slope before hillshade, in
    the mode that the options ask for. noData stays noData for the kernel. Without a cell size, a 256th of the tile's width."""
    kind = kernels.mode(o.use_swiss_relief, o.use_slope, o.use_hillshade)
    if kind is None:
        raise ValueError("the options ask for no derived surface")
    nd = _nodata(o)
    value = lambda v: F.when(_hole(v, nd) & nd.isNotNull(), f32(nd)).when(F.isnan(v) | (F.abs(v * o.multiplier) > 3.4e38), float(o.terrain_min_value)).otherwise(v * o.multiplier).cast("float")
    own = _bounded(with_data(tiles, o), bounds)
    own = own.withColumns({"cell_size": geo.cell_size_or(F.col("cell_size"), F.col("min_x"), F.col("max_x")), "pixels": F.transform("pixels", value), "nodata": nd})
    more = {"azimuth": o.hillshade_azimuth, "altitude": o.hillshade_altitude} if kind == "hillshade" else {"weight": o.swiss_slope_weight} if kind == "relief" else {}
    return kernels.tile_kernel(own, kind, KEYS, z_factor=o.z_factor, **more)


def terrain_texture(tiles: DataFrame, o: Options, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """keys, row, col, r, g, b, a of the terrain's texture: elevations darkened by the relief mask, or the styled derived surface, or the
    styled source without its last row and column. No rows where the options ask for no texture.

    The relief texture joins a tile's elevations with its mask (one exchange of whole tiles)."""
    if not has_texture(o):
        return bitmap(tiles.limit(0), replace(o, type="image", use_swiss_relief=False))
    if not is_kernel(o):
        nd = _nodata(o)
        own = with_data(tiles, o).withColumn("size", F.least("width", F.col("width") - 1))
        px = to_pixels(own, (*KEYS, "nodata", "size")).where("row < size and col < size")
        v = texture_raster(F.col("v"), nd, o.multiplier)
        return _colored(px, style.style(v.cast("double"), o, nd * o.multiplier), "row", "col")
    derived = terrain_derived(tiles, o, bounds)
    if not o.use_swiss_relief:
        return _colored(to_pixels(derived, KEYS), style.style(F.col("v"), o, F.lit(o.no_data_value).cast("double")), "row", "col")
    base = elevations(with_data(tiles, o), o).select(*KEYS, F.col("width").alias("full"), "nodata", F.col("pixels").alias("heights"))
    both = base.join(derived.select(*KEYS, "width", F.col("pixels").alias("mask")), list(KEYS))
    px = both.select(*KEYS, "full", "width", "nodata", "heights", F.posexplode("mask").alias("at", "mask"))
    row, col = F.floor(F.col("at") / F.col("width")).cast("int"), (F.col("at") % F.col("width")).cast("int")
    px = px.select(*KEYS, row.alias("row"), col.alias("col"), "nodata", F.get("heights", (row + 1) * F.col("full") + col + 1).cast("double").alias("v"), F.col("mask").cast("int").alias("mask"))
    return _colored(px, style.style_relief(F.col("v"), F.col("mask"), o, _nodata(o)), "row", "col")


def tile(tiles: DataFrame, o: Options, **options) -> DataFrame:
    """The product that the options ask for: terrain mesh, glaze or picture."""
    return terrain(tiles, o, **options) if o.type == "terrain" else glaze(tiles, o) if o.use_relief_glaze else bitmap(tiles, o)


def progressive(tiles: DataFrame, least_zoom: int, o: Options) -> tuple[DataFrame, DataFrame]:
    """Two passes: the overview first, then the detail."""
    return tile(tiles.where(F.col("z") <= least_zoom), o), tile(tiles.where(F.col("z") > least_zoom), o)


def all_bands(tiles: DataFrame, o: Options, **options) -> DataFrame:
    """Every band's product from one read: keys, band and the product's columns. Each band is taken as a tile of one channel."""
    single = replace(o, use_channel=1, use_channel_index=None, num_of_channels=1)
    own = tiles.withColumn("dataset", F.struct("dataset", "band")).withColumn("band", F.lit(1))
    if options.get("overviews") is not None:  # they know datasets; each band's tiles take their dataset's
        bands = tiles.select("dataset", "band").distinct()
        options["overviews"] = options["overviews"].join(bands, "dataset").withColumn("dataset", F.struct("dataset", "band"))
    out = tile(own, single, **options)
    rest = [c for c in out.columns if c not in KEYS]
    return out.select(F.col("dataset.dataset").alias("dataset"), "z", "x", "y", F.col("dataset.band").alias("band"), *rest)
