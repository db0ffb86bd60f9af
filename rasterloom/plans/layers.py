"""A layer: tiles with options, the products asked of them, and what is kept between two requests."""

from __future__ import annotations

from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import cog
from . import pipelines
from .cache import MASKS, RASTERS, RESULTS, FrameCache, SharedJob
from .options import Options, fetch_size, has_texture, is_kernel, merge

#: Results of whole sets of bands are kept without a bound, by all that they depend on.
UNBOUNDED = 1 << 30


class Heightmap(NamedTuple):
    """A terrain's mesh (with raw, its elevations), derived surface (None without kernels) and texture (None if none is asked for)."""

    mesh: DataFrame
    derived: DataFrame | None
    texture: DataFrame | None


def get_bitmap(tiles: DataFrame, o: Options, sample_type: str = "Float32") -> DataFrame:
    return pipelines.bitmap(tiles, o, sample_type)


def get_heightmap(tiles: DataFrame, o: Options, max_error: float | None = None, bounds=None, overviews: DataFrame | None = None) -> Heightmap:
    derived = pipelines.terrain_derived(tiles, o, bounds) if is_kernel(o) else None
    texture = pipelines.terrain_texture(tiles, o, bounds) if has_texture(o) else None
    return Heightmap(pipelines.terrain(tiles, o, max_error, bounds, overviews), derived, texture)


def get_map(tiles: DataFrame, o: Options, **more) -> DataFrame | Heightmap | None:
    """A picture, a glaze, a heightmap, or None for any other type."""
    if o.type == "terrain":
        return get_heightmap(tiles, o, **more)
    if o.type == "image":
        return pipelines.glaze(tiles, o) if o.use_relief_glaze else get_bitmap(tiles, o)
    return None


class Layer:
    """Products of a table of tiles. What was made is persisted and found again: products by zoom, options and error (RESULTS frames),
    tiles by zoom (RASTERS), relief masks by what they depend on (MASKS), products of all bands.

    pickable: whether products keep the values they were made from; Spark prunes the columns that nobody reads.
    """

    def __init__(self, tiles: DataFrame, catalog: DataFrame | None = None, overviews: DataFrame | None = None, pickable: bool = True, **options):
        self.tiles, self.catalog, self.overviews, self.pickable, self.given = tiles, catalog, overviews, pickable, options
        self.options = merge(**options)
        self.results, self.rasters, self.masks, self.bands = FrameCache(RESULTS), FrameCache(RASTERS), FrameCache(MASKS), FrameCache(UNBOUNDED)

    @classmethod
    def from_cog(cls, spark: SparkSession, paths: list[str], **options) -> Layer:
        """A layer of files: its tiles are fetched with the halo that the options need, and read for the zooms that are asked for."""
        cog.register(spark)
        read = lambda mode, **more: spark.read.format("cog").options(paths=",".join(paths), mode=mode, blocksize=merge(**options).block_size, **more).load()
        return cls(read("tiles", fetch=fetch_size(merge(**options))), read("catalog"), read("overviews"), **options)

    def restyled(self, **options) -> Layer:
        """The layer with other options; tiles and masks that were read stay, products that were made do, too, under their own options."""
        out = Layer(self.tiles, self.catalog, self.overviews, self.pickable, **{**self.given, **options})
        out.results, out.rasters, out.masks, out.bands = self.results, self.rasters, self.masks, self.bands
        return out

    def raster(self, z: int) -> DataFrame:
        return self.rasters.get(z, lambda: self.tiles.where(F.col("z") == z))

    def mask(self, z: int) -> DataFrame:
        o = self.options
        return self.masks.get((z, o.z_factor, o.swiss_slope_weight), lambda: pipelines.relief_masks(self.raster(z), o))

    def _key(self, what: str, z: int, *more) -> tuple:
        return (what, z, repr(self.options), *more)

    def picture(self, z: int) -> DataFrame:
        """The picture or glaze of a zoom."""
        o = self.options
        make = (lambda: pipelines.glaze(self.raster(z), o, self.mask(z))) if o.use_relief_glaze else (lambda: get_bitmap(self.raster(z), o))
        return self.results.get(self._key("picture", z), make)

    def heightmap(self, z: int, max_error: float | None = None, skip_texture: bool | None = None) -> Heightmap:
        o = self.options if skip_texture is None else replace(self.options, skip_texture=skip_texture)
        if o.cache_all_bands:
            return Heightmap(self.band_meshes(z, max_error).where(F.col("band") == pipelines.channel(o)).drop("band"), None, None)
        made = get_heightmap(self.raster(z), o, max_error, overviews=self.overviews)
        keep = lambda name, frame: None if frame is None else self.results.get(self._key(name, z, max_error, o.skip_texture), lambda: frame)
        mesh = keep("mesh", made.mesh)
        return Heightmap(mesh if self.pickable else mesh.drop("raw", "raw_width", "raw_height"), keep("derived", made.derived), keep("texture", made.texture))

    def band_meshes(self, z: int, max_error: float | None = None) -> DataFrame:
        """The meshes of all bands of a zoom from one read."""
        o = replace(self.options, use_channel=1, use_channel_index=None)
        return self.bands.get(("bands", z, repr(o), max_error), lambda: pipelines.all_bands(self.raster(z), o, max_error=max_error, overviews=self.overviews))

    def shared(self, z: int) -> SharedJob:
        """A scope for the jobs of a zoom's product: they are cancelled when the last caller has left."""
        return SharedJob(self.tiles.sparkSession, f"layer-{id(self.results)}-{hash(self._key('job', z)) & 0xFFFFFFFF:x}")

    def clear(self) -> None:
        """Forgets products, not tiles."""
        self.results.clear()

    def zoom_range(self) -> DataFrame:
        return cog.zoom_range(self.catalog)

    def bounds_lonlat(self) -> DataFrame:
        return cog.bounds_lonlat(self.catalog)

    def band_descriptions(self) -> DataFrame:
        return cog.band_descriptions(self.catalog)
