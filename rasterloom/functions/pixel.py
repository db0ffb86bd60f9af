"""Per-pixel functions: noData tests, scaling, decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values beyond this are no elevations (a fixed value).
HUGE = 3.4e38


def f32(x: Column) -> Column:
    return x.cast("float")


def is_nodata(v: Column, nodata: Column) -> Column:
    """Equal as 32-bit floats, NaN equal to NaN; never for an undefined noData."""
    return F.coalesce(f32(v).eqNullSafe(f32(nodata)) & nodata.isNotNull(), F.lit(False))


def is_invalid(v: Column, nodata: Column) -> Column:
    return F.isnan(v) | is_nodata(v, nodata)


def all_nodata(r: Column, g: Column, b: Column, nodata: Column) -> Column:
    return is_nodata(r, nodata) & is_nodata(g, nodata) & is_nodata(b, nodata)


def scale(v: Column, in_min: Column, in_max: Column, out_min: Column, out_max: Column) -> Column:
    """Linear and unclamped; an empty input range gives out_min."""
    return F.when(in_min == in_max, out_min).otherwise(out_min + (v - in_min) / (in_max - in_min) * (out_max - out_min))


def terrain_value(v: Column, nodata: Column, multiplier: float = 1.0, least: float = 0.0) -> Column:
    """Elevation as a 32-bit float; least where there is none."""
    m = v * multiplier
    return f32(F.when(is_nodata(v, nodata) | F.isnan(m) | (F.abs(m) > HUGE), F.lit(float(least))).otherwise(m))


def kernel_input(terrain: Column, source: Column, nodata: Column) -> Column:
    """The terrain with noData put back where the source has it."""
    return F.when(is_nodata(source, nodata), f32(nodata)).otherwise(terrain)


def alpha_of(percent: Column) -> Column:
    """0 to 255 from percent: floor(percent * 2.55), so 100 gives 254."""
    return F.floor(percent * F.lit(2.55)).cast("int")


def clamp_byte(x: Column) -> Column:
    """Clamped to 0..255 and rounded half to even; NaN gives 0."""
    return F.when(F.isnan(x), 0).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)))).cast("int")


def rgb_elevation(r: Column, g: Column, b: Column, scalers: tuple[float, float, float], offset: float) -> Column:
    return r * scalers[0] + g * scalers[1] + b * scalers[2] + offset
