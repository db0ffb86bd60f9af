"""Level-of-detail functions: overviews, zooms and mesh errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geo import BASE_RESOLUTION, js_round

#: Error multipliers at the greatest and the least zoom, the bounds of an error, and the error without any lookup (fixed values).
FINE, COARSE, LEAST, MOST, DEFAULT_ERROR = 0.5, 3.0, 0.5, 100.0, 4.0


def overview_lookup(images: DataFrame) -> DataFrame:
    """resolution and zoom of each image (dataset, image_index, width, base_res): image 0 is the finest."""
    w = Window.partitionBy("dataset").orderBy("image_index")
    res = F.col("base_res") * F.first("width").over(w) / F.col("width")
    return images.withColumn("resolution", res).withColumn("zoom", js_round(F.log2(F.lit(BASE_RESOLUTION) / F.col("resolution"))).cast("int"))


def overview_pick(wanted: DataFrame, images: DataFrame) -> DataFrame:
    """The image for each wanted zoom (dataset, z): the nearest one, and of two as near the finer; beyond either end the last one."""
    levels = images.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("image_index", "zoom"))).alias("levels"))  # a few for each dataset
    top, bottom = F.array_max(F.transform("levels", lambda x: x["zoom"])), F.array_min(F.transform("levels", lambda x: x["zoom"]))
    order = F.transform("levels", lambda x: F.struct(F.abs(x["zoom"] - F.col("z")).alias("d"), x["image_index"].alias("image_index")))
    last = F.element_at("levels", -1)["image_index"]
    pick = F.when(F.col("z") > top, 0).when(F.col("z") < bottom, last).otherwise(F.array_min(order)["image_index"])
    return wanted.join(levels, "dataset").withColumn("image_index", pick.cast("int")).drop("levels")


def error_multiplier(z: Column, least: Column, most: Column) -> Column:
    return F.when(z >= most, FINE).when(z <= least, COARSE).otherwise(COARSE + (z - least) / (most - least) * (FINE - COARSE))


def mesh_max_error(z: Column, resolution: Column, least: Column, most: Column) -> Column:
    return js_round(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), resolution * error_multiplier(z, least, most)))).cast("int")


def resolve_error(explicit: Column, auto: Column) -> Column:
    """The explicit error if not 0, else the looked-up one, else the default."""
    return F.coalesce(F.nullif(explicit, F.lit(0.0)), auto, F.lit(DEFAULT_ERROR))
