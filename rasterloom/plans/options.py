"""Options of a raster's picture or terrain, and which mode they ask for."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Options:
    type: str = "image"
    block_size: int = 65536
    format: str | None = None
    use_channel: int | None = None
    use_channel_index: int | None = None
    no_data_value: float | None = None
    multiplier: float = 1.0
    vertical_exaggeration: float = 1.0
    num_of_channels: int | None = None
    planar_config: int | None = None
    tesselator: str = "martini"
    terrain_color: Any = (200, 200, 200, 255)
    terrain_skirt_height: float = 100.0
    terrain_min_value: float = 0.0
    use_heat_map: bool = True
    use_colors_based_on_values: bool = False
    use_color_classes: bool = False
    use_auto_range: bool = False
    use_data_for_opacity: bool = False
    use_single_color: bool = False
    blurred_texture: bool = True
    skip_texture: bool = False
    clip_low: float | None = None
    clip_high: float | None = None
    color: Any = (255, 0, 255, 255)
    color_scale: Any = "YlOrRd"
    color_scale_value_range: tuple[float, float] = (0.0, 255.0)
    colors_based_on_values: Any = ()
    color_classes: Any = ()
    alpha: float = 100.0
    max_glaze_alpha: float = 128.0
    null_color: Any = (0, 0, 0, 0)
    unidentified_color: Any = (0, 0, 0, 0)
    clipped_color: Any = (0, 0, 0, 0)
    clamp_to_terrain: Any = None
    use_slope: bool = False
    use_hillshade: bool = False
    hillshade_azimuth: float = 315.0
    hillshade_altitude: float = 45.0
    z_factor: float = 1.0
    use_swiss_relief: bool = False
    swiss_slope_weight: float = 0.5
    use_relief_glaze: bool = False
    no_data_check: str = "full"
    disable_lighting: bool = False
    cache_all_bands: bool = False
    disable_worker_pool: bool = False


MODES = ("use_heat_map", "use_single_color", "use_color_classes", "use_colors_based_on_values")


def merge(**given: Any) -> Options:
    names = {f.name for f in fields(Options)}
    if unknown := set(given) - names:
        raise TypeError(f"no such options: {', '.join(sorted(unknown))}")
    return resolve_mode(Options(**given), given)


def resolve_mode(o: Options, given: dict[str, Any]) -> Options:
    """A mode that the user asks for turns off all others; plain terrain gets its own colour; else the heat map stays."""
    asked = {m for m in MODES if given.get(m)}
    if asked:
        return replace(o, **{m: m in asked for m in MODES})
    if o.type == "terrain" and (o.skip_texture or not (o.use_slope or o.use_hillshade or o.use_swiss_relief)):
        return replace(o, **{m: m == "use_single_color" for m in MODES}, color=o.terrain_color)
    return o


def has_texture(o: Options, given: dict[str, Any] | None = None) -> bool:
    """Whether a terrain tile needs a picture at all: by resolved options, or by those that were given."""
    asked = given if given is not None else {f.name: getattr(o, f.name) for f in fields(o)}
    return not o.skip_texture and any(asked.get(k) for k in (*MODES, "use_swiss_relief"))


def is_kernel(o: Options) -> bool:
    """Whether terrain needs slope, hillshade or relief, and so a halo."""
    return o.use_slope or o.use_hillshade or o.use_swiss_relief


def fetch_size(o: Options, tile: int = 256) -> int:
    """Pixels to fetch a side: a terrain mesh has one more than the tile, kernels and glazes two."""
    return tile + (2 if is_kernel(o) else 1) if o.type == "terrain" else tile + 2 * bool(o.use_relief_glaze)
