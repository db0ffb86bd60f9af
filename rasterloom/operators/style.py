"""Raster values to colours: r, g, b, a as Columns, from options; tables are literal arrays, so no join is needed."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.color import Color, palette, parse, ramp, span
from ..functions.pixel import all_nodata, clamp_byte, is_invalid, scale
from ..plans.options import Options

#: Entries of the table for smooth ramps (a fixed value).
SMOOTH = 1024
RGBA = tuple[Column, Column, Column, Column]


def constant(color: Color) -> RGBA:
    return tuple(F.lit(int(c)) for c in color)


def choose(cases: list[tuple[Column, RGBA]], other: RGBA) -> RGBA:
    """The first case that holds."""
    out = []
    for k in range(4):
        c = None
        for cond, rgba in cases:
            c = F.when(cond, rgba[k]) if c is None else c.when(cond, rgba[k])
        out.append(c.otherwise(other[k]) if c is not None else other[k])
    return tuple(c.cast("int") for c in out)


def alpha255(o: Options) -> int:
    return math.floor(o.alpha * 2.55)


def in_class(v: Column, entry, last: bool) -> Column:
    """An interval's condition: lower bound in, upper out, but in for the last one; bounds given in part leave the rest out."""
    _, (low, high), *given = entry
    flags = list(given[0]) if given and given[0] is not None else [True, last]
    flags += [False] * (2 - len(flags))
    return ((v >= low) if flags[0] else (v > low)) & ((v <= high) if flags[1] else (v < high))


#: The range of a heat map and of opacity: numbers, or Columns (a tile's own range); None: as the options say.
Range = tuple[float | Column, float | Column] | None


def value_color(v: Column, o: Options, nodata: Column, own: Range = None) -> RGBA:
    """One value's colour: invalid, then single colour, classes, exact values, heat map, else unidentified."""
    a = alpha255(o)
    low, high = own or o.color_scale_value_range
    invalid = (is_invalid(v, nodata), constant(parse(o.null_color)))
    none = constant(parse(o.unidentified_color))
    if o.use_single_color:
        return choose([invalid], constant(parse(o.color, a)))
    if o.use_color_classes:
        classes = [(in_class(v, e, k == len(o.color_classes) - 1), constant(parse(e[0], a))) for k, e in enumerate(o.color_classes)]
        return choose([invalid, *classes], none)
    if o.use_colors_based_on_values:
        return choose([invalid, *((v == F.lit(float(x)), constant(parse(c, a))) for x, c in o.colors_based_on_values)], none)
    if o.use_heat_map:
        return choose([invalid], (*ramp(v, palette(o.color_scale), low, high), F.lit(a)))
    return choose([invalid], none)


def clipped(v: Column, o: Options) -> Column:
    """Bounds count as clipped."""
    out = F.lit(False)
    if o.clip_low is not None:
        out |= v <= o.clip_low
    if o.clip_high is not None:
        out |= v >= o.clip_high
    return out


def style_direct(v: Column, o: Options, nodata: Column, own: Range = None) -> RGBA:
    """Clip before anything else, then the value's colour (8-bit data, and whatever has no table)."""
    return choose([(clipped(v, o), constant(parse(o.clipped_color)))], value_color(v, o, nodata, own))


def smooth_index(v: Column, low: float | Column, high: float | Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(SMOOTH - 1), F.floor((v - low) / span(low, high) * (SMOOTH - 1)))).cast("int")


def style_smooth(v: Column, o: Options, nodata: Column, own: Range = None) -> RGBA:
    """A heat map by its table of 1,024 entries: invalid first; clipping looks at the entry's own value."""
    low, high = own or o.color_scale_value_range
    at = low + smooth_index(v, low, high) / (SMOOTH - 1.0) * (high - low)
    heat = choose([(clipped(at, o), constant(parse(o.clipped_color)))], (*ramp(at, palette(o.color_scale), low, high), F.lit(alpha255(o))))
    return choose([(is_invalid(v, nodata), constant(parse(o.null_color)))], heat)


def with_opacity(rgba: RGBA, v: Column, o: Options, nodata: Column, own: Range = None) -> RGBA:
    """Alpha from the value, for valid values (clipped ones, too)."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in own or o.color_scale_value_range)
    part = clamp_byte(scale(v, low, high, F.lit(0.0), F.lit(255.0)))
    return (*rgba[:3], F.when(is_invalid(v, nodata), rgba[3]).otherwise(part).cast("int"))


def style_rgb(r: Column, g: Column, b: Column, o: Options, nodata: Column | None, a: Column | None = None) -> RGBA:
    """Bands as colours; all three noData: null colour (without nodata, as for planar data, no test)."""
    own = (r.cast("int"), g.cast("int"), b.cast("int"), F.lit(alpha255(o)) if a is None else a.cast("int"))
    return own if nodata is None else choose([(all_nodata(r, g, b, nodata), constant(parse(o.null_color)))], own)


def style_relief(v: Column, mask: Column, o: Options, nodata: Column) -> RGBA:
    """The base colour darkened by the relief mask; never clipped."""
    low, high = o.color_scale_value_range
    at = low + smooth_index(v, low, high) / (SMOOTH - 1.0) * (high - low)
    heat = o.use_heat_map and not (o.use_single_color or o.use_color_classes or o.use_colors_based_on_values)
    base = (*ramp(at, palette(o.color_scale), low, high), F.lit(alpha255(o))) if heat else value_color(v, o, nodata)
    light = 0.4 + 0.6 * mask / 255.0
    return choose([(is_invalid(v, nodata), constant(parse(o.null_color)))], (*(F.floor(c * light).cast("int") for c in base[:3]), base[3]))


def style_glaze(mask: Column, max_alpha: float = 128) -> RGBA:
    """Black or white over the map, by how far the mask is from the middle."""
    dark = mask < 128
    grey = F.when(mask == 0, 0).when(dark, 0).otherwise(255)
    part = F.pow(F.abs(mask - 128) / 128.0, F.when(dark, 0.6).otherwise(0.8))
    return grey, grey, grey, F.when(mask == 0, 0).otherwise(F.floor(part * 255 * max_alpha / 255.0)).cast("int")


def style(v: Column, o: Options, nodata: Column, sample_type: str = "Float32", own: Range = None) -> RGBA:
    """The path that the sample type and the options ask for."""
    pure = o.use_heat_map and not (o.use_single_color or o.use_color_classes or o.use_colors_based_on_values or o.use_data_for_opacity)
    smooth = pure and sample_type in ("Float32", "UInt16", "Int16")
    rgba = style_smooth(v, o, nodata, own) if smooth else style_direct(v, o, nodata, own)
    return with_opacity(rgba, v, o, nodata, own) if o.use_data_for_opacity else rgba
