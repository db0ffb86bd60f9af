"""All registered raster queries and the DuckDB SQL that checks them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, lod, metadata, pixel
from ..functions.color import palette
from ..operators import kernels, mesh, picking, style, tiles
from . import fixtures as fx
from . import pipelines
from .options import Options, merge

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
C = F.col


def nd():
    return F.lit(-9999.0)


def cell():
    return F.lit(fx.CELL)


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def r6(c, name: str | None = None, digits: int = 6):
    out = F.round(c.cast("double"), digits)
    return out.alias(name) if name else out


def duck(rows: str) -> str:
    """Literal rows with DuckDB's double literals."""
    import re

    return re.sub(r"(-?[0-9.]+(?:e[+-]?\d+)?)D\b", r"\1::double", rows)


PI, HALF, CIRC = repr(math.pi), repr(geo.HALF), repr(geo.CIRCUMFERENCE)

# --- metadata ---------------------------------------------------------------------------------------------------------------

TAGS = "(1, 8), (1, 16), (1, 32), (2, 8), (2, 16), (2, 32), (3, 32), (3, 64), (4, 32), (cast(null as int), cast(null as int)), (1, cast(null as int))"


@query(f"""select f, b, case when f is null or b is null then 'UInt8' else (case f when 1 then 'UInt' when 2 then 'Int' when 3 then 'Float' else 'Unknown' end) || b end kind
from {fx.literal_sql(TAGS, "f, b")}""")
def sample_type(spark, d):
    return fx.literal(spark, TAGS, "f, b").withColumn("kind", metadata.sample_type(C("f"), C("b")))


STRINGS = "(1, '-9999'), (2, ' nan '), (3, 'NaN'), (4, ''), (5, 'abc'), (6, ' 12.5 '), (7, '-3.4e38'), (8, '0'), (9, '1x'), (10, cast(null as string))"


@query(f"""select k, case when s = 'nan' then 'NaN' else printf('%.4g', try_cast(s as double)) end n
from (select k, lower(trim(t)) s from {fx.literal_sql(STRINGS.replace("as string", "as varchar"), "k, t")})""")
def nodata_parse(spark, d):
    n = metadata.nodata_value(C("t"))
    return fx.literal(spark, STRINGS, "k, t").select("k", F.when(F.isnan(n), "NaN").otherwise(F.format_string("%.4g", n)).alias("n")).withColumn("n", F.when(C("n") == "-3.400e+38", "-3.4e+38").when(C("n") == "-9999", "-9999").when(C("n") == "12.50", "12.5").when(C("n") == "0.000", "0").when(C("n") == "null", None).otherwise(C("n")))


XML = ", ".join(
    f"({k}, '{x}', {n})"
    for k, (x, n) in enumerate((
        ('<GDALMetadata><Item name="DESCRIPTION" sample="0" role="description">2024-01</Item><Item name="DESCRIPTION" sample="1">2024-02</Item></GDALMetadata>', 3),
        ('<GDALMetadata><Item name="SCALE" sample="0">2</Item></GDALMetadata>', 2), ('<Item sample="0" name="DESCRIPTION">late</Item>', 1), ('<Item name="DESCRIPTION" sample="7">far</Item>', 2), ("", 1),
    ))
)
@query(f"""with x as (select * from {fx.literal_sql(XML, "k, x, n")}), i as (select k, unnest(range(0, n))::int band from x),
p as (select k, unnest(string_split(x, '<Item')[2:]) t from x), g as (select k, split_part(t, '>', 1) tag, substr(t, strpos(t, '>') + 1) rest from p where contains(t, '>')),
a as (select k, substr(tag, strpos(tag, 'name="DESCRIPTION"')) tail, split_part(rest, '<', 1) label from g where contains(tag, 'name="DESCRIPTION"') and contains(rest, '</Item>')),
m as (select k, try_cast(split_part(substr(tail, strpos(tail, ' sample="') + 9), '"', 1) as int) band, label from a where contains(tail, ' sample="'))
select i.k, i.band, coalesce(label, '') label from i left join m on i.k = m.k and i.band = m.band""")
def band_labels(spark, d):
    return fx.literal(spark, XML, "k, x, n").select("k", F.posexplode(metadata.band_labels(C("x"), C("n"))).alias("band", "label"))


URLS = "(1, 'https://t/{z}/{x}/{y}.png'), (2, 'https://t/{x}{x}/{y}/{z}'), (3, 'https://c/a.tif'), (4, 'https://c/a.TIF?x=1'), (5, 'https://c/a.Tif'), (6, 'https://c/{x}/{y}')"


@query(f"""select k, contains(u, '{{x}}') and contains(u, '{{y}}') and contains(u, '{{z}}') service, contains(u, '.tif') or contains(u, '.TIF') cog,
regexp_replace(regexp_replace(regexp_replace(u, '\\{{x\\}}', '3'), '\\{{y\\}}', '5'), '\\{{z\\}}', '4') url from {fx.literal_sql(URLS, "k, u")}""")
def tile_url(spark, d):
    u = C("u")
    return fx.literal(spark, URLS, "k, u").select("k", metadata.is_tile_service(u).alias("service"), metadata.is_cog(u).alias("cog"), metadata.tile_url(u, F.lit(3), F.lit(5), F.lit(4)).alias("url"))


# --- geo --------------------------------------------------------------------------------------------------------------------

_MY = f"ln(tan({PI} / 4 + radians(lat) / 2)) / {PI} * {HALF}"


@query(f"""select id, round(x / {HALF} * 180, 9) lon, round(180 / {PI} * (2 * atan(exp(y / {HALF} * {PI})) - {PI} / 2), 9) lat
from (select id, lon / 180 * {HALF} x, {_MY} y from ({fx.POINTS}))""")
def mercator_to_lonlat(spark, d):
    p = fx.points(spark, d).select("id", geo.mercator_x(C("lon")).alias("x"), geo.mercator_y(C("lat")).alias("y"))
    return p.select("id", r6(geo.lon_of(C("x")), "lon", 9), r6(geo.lat_of(C("y")), "lat", 9))


RES = ", ".join(f"({t}, {r!r}D, {n})" for t in (256, 512) for r in (0.3, 1.19, 9.55, 38.21851414258813, 611.5, 156543.03125) for n in (1, 5))


@query(f"select tile, res, floor(log2({CIRC} / (res * tile)) + 0.5)::int zoom from (select distinct tile, res from {fx.literal_sql(duck(RES), 'tile, res, n')})")
def zoom_from_resolution(spark, d):
    return fx.literal(spark, RES, "tile, res, n").select("tile", "res", geo.zoom_from_resolution(C("tile"), C("res")).alias("zoom")).distinct()


@query(f"select tile, res, n, (z - (n - 1))::int min_zoom, z max_zoom from (select *, floor(log2({CIRC} / (res * tile)) + 0.5)::int z from {fx.literal_sql(duck(RES), 'tile, res, n')})")
def zoom_range(spark, d):
    lo, hi = geo.zoom_range(C("tile"), C("res"), C("n"))
    return fx.literal(spark, RES, "tile, res, n").select("*", lo.alias("min_zoom"), hi.alias("max_zoom"))


_BOUNDS = f"(select z, x, y, -{HALF} + x * s min_x, {HALF} - (y + 1) * s min_y, -{HALF} + (x + 1) * s max_x, {HALF} - y * s max_y from (select *, {CIRC} / pow(2.0::double, z) s from {fx.literal_sql(fx.GRID, 'z, x, y')}))"


@query(f"select z, x, y, round(min_x, 4) min_x, round(min_y, 4) min_y, round(max_x, 4) max_x, round(max_y, 4) max_y from {_BOUNDS}")
def tile_bounds(spark, d):
    b = geo.tile_bounds(C("x"), C("y"), C("z"))
    return fx.grid(spark).select("z", "x", "y", *(r6(c, n, 4) for n, c in b.items()))


_LATY = f"180 / {PI} * (2 * atan(exp({{}} / {HALF} * {PI})) - {PI} / 2)"


@query(f"""select z, x, y, round(min_x / {HALF} * 180, 6) west, round({_LATY.format("min_y")}, 6) south, round(max_x / {HALF} * 180, 6) east, round({_LATY.format("max_y")}, 6) north from {_BOUNDS}""")
def bounds_lonlat(spark, d):
    b = geo.tile_bounds(C("x"), C("y"), C("z"))
    own = fx.grid(spark).select("z", "x", "y", *(c.alias(n) for n, c in b.items()))
    return own.select("z", "x", "y", *(r6(c, n) for n, c in geo.bounds_lonlat(C("max_x"), C("min_y"), C("min_x"), C("max_y")).items()))


@query(f"""select z, y, round({CIRC} / pow(2.0::double, z) * cos(atan(sinh({PI} * (1 - 2 * (y + 0.5::double) / pow(2.0::double, z))))) / 256, 6) cell, round(coalesce(null, 512.0::double / 256), 6) fallback
from (select distinct z, y from {fx.literal_sql(fx.GRID, "z, x, y")})""")
def cell_size(spark, d):
    return fx.grid(spark).select("z", "y").distinct().select("z", "y", r6(geo.cell_size(C("y"), C("z")), "cell"), r6(geo.cell_size_or(F.lit(None).cast("double"), F.lit(0.0), F.lit(512.0)), "fallback"))


_V = "(ln(tan({pi} / 4 + radians(60::double) / 2)) - ln(tan({pi} / 4 + radians(lat) / 2))) / (ln(tan({pi} / 4 + radians(60::double) / 2)) - ln(tan({pi} / 4 + radians(-60::double) / 2)))".format(pi=PI)


@query(f"""select id, floor(round((lon + 180) / 360 * 255, 9))::int px, floor(round(({_V}) * 255, 9))::int py from ({fx.POINTS})""")
def lonlat_to_pixel(spark, d):
    u, v = geo.lonlat_to_uv(C("lon"), C("lat"), F.lit(-180.0), F.lit(-60.0), F.lit(180.0), F.lit(60.0))
    return fx.points(spark, d).select("id", F.floor(F.round(u * 255, 9)).cast("int").alias("px"), F.floor(F.round(v * 255, 9)).cast("int").alias("py"))


_TOP, _LOW = f"ln(tan({PI} / 4 + radians(60::double) / 2))", f"ln(tan({PI} / 4 + radians(-60::double) / 2))"


@query(f"""select "row", col, round(-180 + col / 63.0::double * 360, 6) lon, round(degrees(2 * atan(exp({_TOP} - "row" / 63.0::double * ({_TOP} - {_LOW}))) - {PI} / 2), 6) lat from ({fx.DEM})""")
def pixel_to_lonlat(spark, d):
    lon, lat = geo.pixel_to_lonlat(C("col"), C("row"), F.lit(64), F.lit(64), F.lit(-180.0), F.lit(-60.0), F.lit(180.0), F.lit(60.0))
    return fx.dem(spark, d).select("row", "col", r6(lon, "lon"), r6(lat, "lat"))


@query(f"""select x, y, count(*)::bigint n from (select floor((lon + 180) / 360 * 1024)::int x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / {PI}) / 2 * 1024)::int y from ({fx.POINTS})) group by all""")
def points_to_tiles(spark, d):
    x, y = geo.lonlat_to_tile(C("lon"), C("lat"), 10)
    return fx.points(spark, d).groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"))


# --- levels of detail -------------------------------------------------------------------------------------------------------

_PYR = fx.literal_sql(duck(fx.PYRAMID), fx.PYRAMID_COLUMNS)
_LOOKUP = f"(select *, floor(log2({geo.BASE_RESOLUTION!r} / resolution) + 0.5)::int zoom from (select *, base_res * first_value(width) over (partition by dataset order by image_index) / width resolution from {_PYR}))"


def _pyramid(spark):
    return lod.overview_lookup(fx.literal(spark, fx.PYRAMID, fx.PYRAMID_COLUMNS))


@query(f"select dataset, image_index, width, round(resolution, 6) resolution, zoom from {_LOOKUP}")
def overview_lookup(spark, d):
    return _pyramid(spark).select("dataset", "image_index", "width", r6(C("resolution"), "resolution"), "zoom")


@query(f"""with o as (select * from {_LOOKUP}), w as (select dataset, z from (select distinct dataset from o), (select unnest(range(0, 16))::int z)),
e as (select dataset, max(zoom) hi, min(zoom) lo, max(image_index) last from o group by 1)
select w.dataset, z, case when z > hi then 0 when z < lo then last else (select image_index from o where o.dataset = w.dataset order by abs(zoom - z), image_index limit 1) end::int image_index from w join e using (dataset)""")
def overview_pick(spark, d):
    levels = _pyramid(spark)
    wanted = levels.select("dataset").distinct().withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return lod.overview_pick(wanted, levels)


ZOOMS = ", ".join(f"({z}, {r!r}D)" for z in range(5, 17) for r in (0.1, 4.7, 38.2, 400.0))
_MULT = "case when z >= 14 then 0.5::double when z <= 8 then 3.0::double else 3.0::double + (z - 8)::double / 6 * -2.5::double end"


@query(f"select distinct z, round({_MULT}, 6) multiplier from {fx.literal_sql(duck(ZOOMS), 'z, res')}")
def error_multiplier(spark, d):
    return fx.literal(spark, ZOOMS, "z, res").select("z", r6(lod.error_multiplier(C("z"), F.lit(8), F.lit(14)), "multiplier")).distinct()


@query(f"select z, res, floor(greatest(0.5::double, least(100.0::double, res * ({_MULT}))) + 0.5)::int error from {fx.literal_sql(duck(ZOOMS), 'z, res')}")
def mesh_max_error(spark, d):
    return fx.literal(spark, ZOOMS, "z, res").select("z", "res", lod.mesh_max_error(C("z"), C("res"), F.lit(8), F.lit(14)).alias("error"))


ERRORS = "(1, 0.0D, 7.0D), (2, 3.0D, 7.0D), (3, cast(null as double), 7.0D), (4, cast(null as double), cast(null as double)), (5, 0.0D, cast(null as double))"


@query(f"select k, coalesce(nullif(e, 0), auto, 4.0::double) error from {fx.literal_sql(duck(ERRORS), 'k, e, auto')}")
def resolve_error(spark, d):
    return fx.literal(spark, ERRORS, "k, e, auto").select("k", lod.resolve_error(C("e"), C("auto")).alias("error"))


# --- tiles ------------------------------------------------------------------------------------------------------------------

IMAGE = (-8000.3, 9000.7, 38.21851414258813, 900, 700)


@query(f"""with t as (select z, x, y, -{HALF} + x * s min_x, {HALF} - y * s max_y from (select 12 z, unnest(range(2044, 2052)) x, {CIRC} / 4096 s), (select unnest(range(2044, 2052)) y)),
w as (select *, floor((min_x - ({IMAGE[0]}::double)) / {IMAGE[2]} + 0.5)::int wx, floor(({IMAGE[1]}::double - max_y) / {IMAGE[2]} + 0.5)::int wy from t)
select z, x::int x, y::int y, greatest(0, wx)::int x0, greatest(0, wy)::int y0, least(900, wx + 258)::int x1, least(700, wy + 258)::int y1, (greatest(0, wx) - wx)::int missing_left, (greatest(0, wy) - wy)::int missing_top,
least(900, wx + 258) <= greatest(0, wx) or least(700, wy + 258) <= greatest(0, wy) "empty" from w""")
def tile_window(spark, d):
    at = F.explode(F.sequence(F.lit(2044), F.lit(2051)))
    t = spark.range(1).select(F.lit(12).alias("z"), at.alias("x")).select("z", "x", at.alias("y"))
    b = geo.tile_bounds(C("x"), C("y"), C("z"))
    w = tiles.tile_window(b["min_x"], b["max_y"], F.lit(IMAGE[0]), F.lit(IMAGE[1]), F.lit(IMAGE[2]), F.lit(IMAGE[3]), F.lit(IMAGE[4]), tiles.FETCH["kernel"])
    return t.select("z", "x", "y", *(c.alias(n) for n, c in w.items()))


@query("select 0 k, len(p)::int n, p[1]::double v from (select list_transform(range(0, 32), lambda i: -9999.0::float) p) union all select 1, len(p)::int, p[1]::double from (select list_transform(range(0, 64), lambda i: 0.0::float) p)")
def empty_tile(spark, d):
    ids = spark.range(2).select(C("id").cast("int").alias("k"))
    p = F.when(C("k") == 0, tiles.empty_tile(4, 2, F.lit(-9999.0))).otherwise(tiles.empty_tile(8, 1, F.lit(None).cast("double")))
    return ids.select("k", F.size(p).alias("n"), F.get(p, F.lit(0)).cast("double").alias("v"))


KEYS = ("tile_row", "tile_col")
_T8 = '(select floor("row" / 8)::int tile_row, floor(col / 8)::int tile_col, ("row" % 8)::int "row", (col % 8)::int col, v from ({}))'


def _tiles8(raster):
    return tiles.cut(raster, 8)


@query(f"""with t as (select * from {_T8.format(fx.EMB)}), g as (select tile_row, tile_col, unnest(range(0, 8))::int "row" from (select distinct tile_row, tile_col from t)), h as (select *, unnest(range(0, 8))::int col from g)
select tile_row, tile_col, "row", col, coalesce(v, -9999.0::double) v from h left join t using (tile_row, tile_col, "row", col)""")
def pad_tile(spark, d):
    return tiles.pad(_tiles8(fx.emb(spark, d)), 8, KEYS, -9999.0).select(*KEYS, "row", "col", "v")


@query(f"""with p as (select *, ("row" - greatest(0, "row" - 2))::int x from ({fx.DEM}))
select tile_row, tile_col, ("row" - tile_row * 8)::int "row", (col - tile_col * 8)::int col, v from
(select "row", col, v, unnest(list_distinct([floor("row" / 8)::int, greatest(0, floor(("row" - 2) / 8))::int])) tile_row from p),
lateral (select unnest(list_distinct([floor(col / 8)::int, greatest(0, floor((col - 2) / 8))::int])) tile_col)""")
def halo_tile(spark, d):
    return tiles.cut(fx.dem(spark, d), 8, halo=2).select(*KEYS, "row", "col", "v")


@query(f"""with t as (select * from {_T8.format(fx.DEM)}), r as (select tile_row, tile_col, unnest(case when "row" = 7 then [7, 8] else ["row"] end)::int "row", col, v from t)
select tile_row, tile_col, "row", unnest(case when col = 7 then [7, 8] else [col] end)::int col, v from r""")
def backfill_border(spark, d):
    return tiles.backfill_border(_tiles8(fx.dem(spark, d)), 8, KEYS)


@query(f"""select tile_row, tile_col, ("row" - 1)::int "row", (col - 1)::int col, v from {_T8.format(fx.DEM)} where "row" >= 1 and col >= 1""")
def mesh_raster(spark, d):
    return tiles.mesh_raster(_tiles8(fx.dem(spark, d))).select(*KEYS, "row", "col", "v")


@query(f"""select tile_row, tile_col, "row", col, v from {_T8.format(fx.DEM)} where "row" < 5 and col < 6""")
def crop_raster(spark, d):
    return tiles.crop(_tiles8(fx.dem(spark, d)), 5, 6).select(*KEYS, "row", "col", "v")


@query(f"""select "row", col, round((case when v::float = -9999::float then -9999.0::double * 2.5::double else v * 2.5::double end)::float::double, 4) v from ({fx.holes_sql(fx.EMB)})""")
def texture_raster(spark, d):
    return fx.holes(fx.emb(spark, d)).select("row", "col", r6(tiles.texture_raster(C("v"), nd(), 2.5), "v", 4))


_BLOCKED = f"""select "row", col, case when (floor("row" / 8) + floor(col / 8)) % 3 = 0 then -9999.0::double else v end v from ({fx.EMB})"""


def _blocked(spark, d):
    return fx.emb(spark, d).withColumn("v", F.when((F.floor(C("row") / 8) + F.floor(C("col") / 8)) % 3 == 0, F.lit(-9999.0)).otherwise(C("v")))


@query(f"select tile_row, tile_col from {_T8.format(_BLOCKED)} group by 1, 2 having bool_and(v::float = -9999::float)")
def nodata_tiles_full(spark, d):
    return tiles.nodata_tiles(_tiles8(_blocked(spark, d)), nd(), KEYS)


@query(f"""select tile_row, tile_col from {_T8.format(_BLOCKED)} where "row" in (0, 7) or col in (0, 7) or ("row" = 4 and col = 4) or ("row" in (2, 6) and col in (2, 6)) group by 1, 2 having bool_and(v::float = -9999::float)""")
def nodata_tiles_probe(spark, d):
    return tiles.nodata_tiles(_tiles8(_blocked(spark, d)), nd(), KEYS, "border+center", 8)


@query(f"""with t as (select * from {_T8.format(_BLOCKED)}), x as (select tile_row, tile_col from t group by 1, 2 having bool_and(v::float = -9999::float))
select tile_row, tile_col, count(*)::bigint n from t anti join x using (tile_row, tile_col) group by 1, 2""")
def nodata_tiles_dropped(spark, d):
    return tiles.drop_nodata_tiles(_tiles8(_blocked(spark, d)), nd(), KEYS).groupBy(*KEYS).agg(F.count("*").alias("n"))


@query(f"select band, \"row\", col, v from ({fx.BANDS})")
def bands_long(spark, d):
    wide = fx.bands(spark, d).groupBy("row", "col").agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "v"))), lambda x: x["v"]).alias("pixels"))
    return wide.select("row", "col", F.posexplode("pixels").alias("k", "v")).select((C("k") + 1).cast("int").alias("band"), "row", "col", "v")


@query(f'select "row", col, v from ({fx.BANDS}) where band = 3')
def band_select(spark, d):
    return tiles.select_band(fx.bands(spark, d), use_channel=1, use_channel_index=2).select("row", "col", "v")


@query(f"""select "row", col::int col, v::float::double v from (select "row", unnest(range(0, 32)) col, unnest(list_transform(range(0, 32), lambda i: embedding[2 * i + 2])) v from (select vec_id::int "row", embedding from embeddings))""")
def deinterleave(spark, d):
    t = fx.read(spark, d, "embeddings").select(C("vec_id").cast("int").alias("row"), C("embedding").alias("pixels"))
    return tiles.band(t, 2, 1).select("row", F.posexplode("pixels").alias("col", "v")).withColumn("v", C("v").cast("double"))


# --- pixels -----------------------------------------------------------------------------------------------------------------

_H = fx.holes_sql(fx.EMB)
_HN = fx.holes_sql(fx.EMB, "'nan'")


@query(f"""select 'number' kind, count(*) filter (where v::float = -9999::float)::bigint n_nodata, count(*) filter (where isnan(v) or v::float = -9999::float)::bigint n_invalid, count(*)::bigint n from ({_H})
union all select 'nan', count(*) filter (where isnan(v))::bigint, count(*) filter (where isnan(v))::bigint, count(*)::bigint from ({_HN})""")
def nodata_mask(spark, d):
    def count(kind, nodata):
        nd = F.lit(nodata)
        own = fx.holes(fx.emb(spark, d), nodata)
        return own.agg(F.count(F.when(pixel.is_nodata(C("v"), nd), 1)).alias("n_nodata"), F.count(F.when(pixel.is_invalid(C("v"), nd), 1)).alias("n_invalid"), F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "*")

    return count("number", -9999.0).unionByName(count("nan", float("nan")))


_B4 = f"""(select "row", col, max(v) filter (where band = 1) b1, max(v) filter (where band = 2) b2, max(v) filter (where band = 3) b3, max(v) filter (where band = 4) b4 from ({fx.BANDS}) group by 1, 2)"""


def _wide(spark, d):
    return fx.bands(spark, d).groupBy("row", "col").agg(*(F.max(F.when(C("band") == k, C("v"))).alias(f"b{k}") for k in range(1, 5)))


@query(f"""select "row", col, (b1 % 3)::float = 1::float and (b2 % 3)::float = 1::float and (b3 % 3)::float = 1::float hole from {_B4}""")
def rgb_nodata(spark, d):
    return _wide(spark, d).select("row", "col", pixel.all_nodata(C("b1") % 3, C("b2") % 3, C("b3") % 3, F.lit(1.0)).alias("hole"))


@query(f"""select "row", col, round(10.0::double + (v + 0.5::double) / 1.0::double * 80, 6) s, 10.0::double flat from ({fx.EMB})""")
def linear_scale(spark, d):
    lit = lambda x: F.lit(float(x))
    return fx.emb(spark, d).select("row", "col", r6(pixel.scale(C("v"), lit(-0.5), lit(0.5), lit(10), lit(90)), "s"), pixel.scale(C("v"), lit(1), lit(1), lit(10), lit(90)).alias("flat"))


_TERRAIN = "(case when v::float = -9999::float or isnan(v * 3.0::double) or abs(v * 3.0::double) > 3.4e38::double then -1.0::double else v * 3.0::double end)::float"


@query(f"""select "row", col, round({_TERRAIN}::double, 5) t from ({_H})""")
def terrain_decode(spark, d):
    return fx.holes(fx.emb(spark, d)).select("row", "col", r6(pixel.terrain_value(C("v"), nd(), 3.0, -1.0), "t", 5))


@query(f"""select "row", col, round((case when v::float = -9999::float then -9999::float else {_TERRAIN} end)::double, 5) t from ({_H})""")
def kernel_input(spark, d):
    return fx.holes(fx.emb(spark, d)).select("row", "col", r6(pixel.kernel_input(pixel.terrain_value(C("v"), nd(), 3.0, -1.0), C("v"), nd()), "t", 5))


@query("select p::int p, floor(p::double * 2.55::double)::int a from (select unnest(range(0, 101)) p)")
def alpha_scale(spark, d):
    return spark.range(101).select(C("id").cast("int").alias("p"), pixel.alpha_of(C("id")).alias("a"))


# --- kernels ----------------------------------------------------------------------------------------------------------------


def _near(raster: str) -> str:
    return f"""(select * from (select *, lag(w) over d nw, lag(c) over d n, lag(e) over d ne, lead(w) over d sw, lead(c) over d s, lead(e) over d se from
(select "row", col, v c, lag(v) over a w, lead(v) over a e from ({raster}) window a as (partition by "row" order by col)) window d as (partition by col order by "row"))
where nw is not null and n is not null and ne is not null and w is not null and e is not null and sw is not null and s is not null and se is not null)"""


_DX = "(((ne + 2 * e + se) - (nw + 2 * w + sw)) / (8 * 0.5::double))"
_DY = "(((sw + 2 * s + se) - (nw + 2 * n + ne)) / (8 * 0.5::double))"
_STEEP = f"atan(sqrt({_DX} * {_DX} + {_DY} * {_DY}))"
_SLOPE = f"degrees({_STEEP})::float"


def _shade_sql(az: float, alt: float) -> str:
    zen, turn = math.radians(90 - alt), math.radians((360 - az + 90) - 360 if 360 - az + 90 >= 360 else 360 - az + 90)
    return f"({math.cos(zen)!r}::double * cos({_STEEP}) + {math.sin(zen)!r}::double * sin({_STEEP}) * cos({turn!r}::double - atan2(-{_DY}, -{_DX})))"


_HILL = f"greatest(0.0::double, least(255.0::double, 255 * {_shade_sql(315, 45)}))::float"
_MULTI = "least(255.0::double, (" + " + ".join(f"{w!r}::double * greatest(0.0::double, {_shade_sql(az, alt)})" for az, alt, w in kernels.LIGHTS) + ") * 255)::float"


def _kernel(spark, d, holes: bool = False):
    raster = fx.emb(spark, d)
    return kernels.neighbours(fx.holes(raster) if holes else raster)


@query(f"""select "row", col, round({_DX}, 6) dx, round({_DY}, 6) dy from {_near(fx.EMB)}""")
def horn_gradient(spark, d):
    dx, dy = kernels.gradients(cell())
    return _kernel(spark, d).select("row", "col", r6(dx, "dx"), r6(dy, "dy"))


@query(f"""select "row", col, round({_SLOPE}::double, 4) slope from {_near(fx.EMB)}""")
def slope(spark, d):
    return _kernel(spark, d).select("row", "col", r6(kernels.slope(cell()), "slope", 4))


@query(f"""select "row", col, case when c::float = -9999::float then -1 else round({_SLOPE}::double, 4) end slope from {_near(_H)}""")
def slope_nodata(spark, d):
    s = kernels.slope(cell(), nodata=nd())
    return _kernel(spark, d, True).select("row", "col", F.when(F.isnan(s), -1.0).otherwise(r6(s, digits=4)).alias("slope"))


@query(f"""select "row", col, round({_HILL}::double, 3) shade from {_near(fx.EMB)}""")
def hillshade(spark, d):
    return _kernel(spark, d).select("row", "col", r6(kernels.hillshade(cell()), "shade", 3))


@query(f"""select "row", col, round({_MULTI}::double, 3) shade from {_near(fx.EMB)}""")
def multi_hillshade(spark, d):
    return _kernel(spark, d).select("row", "col", r6(kernels.multi_hillshade(cell()), "shade", 3))


_LUT = "greatest(0.010::double, {h} / 255.0::double * (1 - {s} / 255.0::double * 0.5::double))::float"


@query(f"select h::int hill, s::int steep, round({_LUT.format(h='h', s='s')}::double, 6) entry from (select unnest(range(0, 256)) h), (select unnest(range(0, 256)) s)")
def relief_lut(spark, d):
    return kernels.relief_table(spark).select("hill", "steep", r6(C("entry"), "entry"))


_MASK = f"""(select "row", col, c, greatest(1, trunc({_LUT.format(h="h", s="s")}::double * 255)::int)::int mask from
(select "row", col, c, least(255, greatest(0, trunc({_SLOPE}::double * 255 / 90)::int)) s, trunc(least(255.0::double, greatest(0.0::double, {_MULTI}::double)))::int h from {_near(fx.EMB)}))"""


def _masks(spark, d):
    return kernels.relief(_kernel(spark, d), cell())


@query(f"""select "row", col, mask from {_MASK}""")
def relief_mask(spark, d):
    return _masks(spark, d).select("row", "col", "mask")


@query(f"""select "row", col, round((nw + n + ne + w + c + e + sw + s + se) / 9, 6) mean, round(least(nw, n, ne, w, c, e, sw, s, se), 6) least, round(greatest(nw, n, ne, w, c, e, sw, s, se), 6) most from {_near(fx.EMB)}""")
def focal_statistics(spark, d):
    return tiles.focal(fx.emb(spark, d), ()).select("row", "col", r6(C("mean"), "mean"), r6(C("least"), "least"), r6(C("most"), "most"))


def _arrow_tiles(spark, d):
    t = tiles.to_arrays(tiles.cut(fx.emb(spark, d).where("row < 448"), 62, halo=2).where("tile_col = 0 and tile_row < 7"), KEYS, 64)
    return t.select(*KEYS, "width", "height", F.lit(None).cast("double").alias("nodata"), cell().alias("cell_size"), "pixels")


@query(f"""select floor(("row" - 1) / 62)::int tile_row, 0 tile_col, (("row" - 1) % 62)::int "row", (col - 1)::int col, round({_SLOPE}::double, 3) slope from {_near(fx.EMB)} where "row" between 1 and 434""")
def slope_arrow(spark, d):
    out = kernels.tile_kernel(_arrow_tiles(spark, d), "slope", KEYS)
    return tiles.to_pixels(out, KEYS).select(*KEYS, "row", "col", r6(C("v"), "slope", 3))


_IN62 = """floor(("row" - 1) / 62)::int tile_row, 0 tile_col, (("row" - 1) % 62)::int "row", (col - 1)::int col"""


@query(f"""select {_IN62}, round({_HILL}::double, 2) shade from {_near(fx.EMB)} where "row" between 1 and 434""")
def hillshade_arrow(spark, d):
    return tiles.to_pixels(kernels.tile_kernel(_arrow_tiles(spark, d), "hillshade", KEYS), KEYS).select(*KEYS, "row", "col", r6(C("v"), "shade", 2))


@query(f"""select {_IN62}, mask from {_MASK} where "row" between 1 and 434""")
def relief_arrow(spark, d):
    return tiles.to_pixels(kernels.tile_kernel(_arrow_tiles(spark, d), "relief", KEYS), KEYS).select(*KEYS, "row", "col", C("v").cast("int").alias("mask"))


# --- styling ----------------------------------------------------------------------------------------------------------------

_YOR = [c[:3] for c in palette("YlOrRd")]


def _ramp_sql(v: str, low: float, high: float, k: int) -> str:
    n = len(_YOR) - 1
    t = f"(greatest(0.0::double, least(1.0::double, (({v}) - ({low!r}::double)) / {high - low!r}::double)) * {n})"
    at = f"[{', '.join(f'{c[k]}.0::double' for c in _YOR)}]"
    i = f"least(floor({t})::int, {n - 1})"
    return f"floor({at}[{i} + 1] + ({t} - {i}) * ({at}[least({i} + 1, {n}) + 1] - {at}[{i} + 1]) + 0.5::double)::int"


def _heat_sql(v: str, low: float, high: float) -> list[str]:
    return [_ramp_sql(v, low, high, k) for k in range(3)] + ["254"]


def _pick(cases: list[tuple[str, list]], other: list) -> str:
    out = []
    for k, n in enumerate("rgba"):
        whens = " ".join(f"when {c} then {v[k]}" for c, v in cases)
        out.append(f"(case {whens} else {other[k]} end)::int {n}" if cases else f"{other[k]}::int {n}")
    return ", ".join(out)


_BAD = ("isnan(v) or v::float = -9999::float", [0, 0, 0, 0])
RANGE = (-0.3, 0.4)


def _rgba(df, rgba, *keep):
    return df.select(*(keep or ("row", "col")), *(c.alias(n) for n, c in zip("rgba", rgba, strict=True)))


def _styled(spark, d, o: Options, how=style.style_direct, raster=None):
    own = fx.holes(fx.emb(spark, d)) if raster is None else raster
    return _rgba(own, how(C("v"), o, nd()))


@query(f"""select "row", col, {_pick([_BAD], [10, 20, 30, 254])} from ({_H})""")
def style_single(spark, d):
    return _styled(spark, d, merge(use_single_color=True, color=[10, 20, 30]))


CLASSES = (("#ff0000", (-0.1, 0.0)), ("#00ff00", (0.0, 0.1), (False, True)), ((1, 2, 3, 9), (0.1, 0.2), (True,)), ("blue", (0.2, 0.3)))
_CLASS_CASES = [
    _BAD, ("v >= -0.1::double and v < 0.0::double", [255, 0, 0, 254]), ("v > 0.0::double and v <= 0.1::double", [0, 255, 0, 254]), ("v >= 0.1::double and v < 0.2::double", [1, 2, 3, 9]),
    ("v >= 0.2::double and v <= 0.3::double", [0, 0, 255, 254]),
]


@query(f"""select "row", col, {_pick(_CLASS_CASES, [0, 0, 0, 0])} from ({_H})""")
def style_classes(spark, d):
    return _styled(spark, d, merge(use_color_classes=True, color_classes=CLASSES))


@query(f"""select "row", col, {_pick([("v = 1", [255, 0, 0, 254]), ("v = 7", [0, 0, 255, 254]), ("v = 50", [9, 8, 7, 6])], [5, 5, 5, 5])} from ({fx.CLASSES})""")
def style_exact(spark, d):
    o = merge(use_colors_based_on_values=True, colors_based_on_values=((1, "red"), (7, "blue"), (50, (9, 8, 7, 6))), unidentified_color=(5, 5, 5, 5))
    return _styled(spark, d, o, raster=fx.classes(spark, d))


@query(f"""select "row", col, {_pick([_BAD], _heat_sql("v", *RANGE))} from ({_H})""")
def style_heatmap_exact(spark, d):
    return _styled(spark, d, merge(color_scale_value_range=RANGE))


@query(f"""with lut as (select i::int i, {_pick([("i <= 5", [1, 1, 1, 1])], _heat_sql("i", 0.0, 50.0))} from (select unnest(range(0, 256)) i)) select "row", col, r, g, b, a from ({fx.CLASSES}) join lut on v = i""")
def style_lut8(spark, d):
    return _styled(spark, d, merge(color_scale_value_range=(0.0, 50.0), clip_low=5.0, clipped_color=(1, 1, 1, 1)), raster=fx.classes(spark, d))


_IDX = "greatest(0, least(1023, floor((v - (-0.3::double)) / 0.7::double * 1023)))::int"
_AT = f"(-0.3::double + ({_IDX}) / 1023.0::double * 0.7::double)"
OWN = (-0.3, -0.3 + 0.7)


@query(f"""select "row", col, {_pick([_BAD], _heat_sql(_AT, *OWN))} from ({_H})""")
def style_lut1024(spark, d):
    return _styled(spark, d, merge(color_scale_value_range=OWN), style.style_smooth)


@query(f"""select "row", col, {_pick([_BAD, (f"{_AT} <= -0.25::double or {_AT} >= 0.3::double", [7, 7, 7, 7])], _heat_sql(_AT, *OWN))} from ({_H})""")
def style_clip(spark, d):
    return _styled(spark, d, merge(color_scale_value_range=OWN, clip_low=-0.25, clip_high=0.3, clipped_color=(7, 7, 7, 7)), style.style_smooth)


@query(f"""select "row", col, {_pick([("v <= -0.25::double or v >= 0.3::double", [7, 7, 7, 7]), _BAD], _heat_sql("v", *RANGE))} from ({_H})""")
def style_clip_direct(spark, d):
    return _styled(spark, d, merge(color_scale_value_range=RANGE, clip_low=-0.25, clip_high=0.3, clipped_color=(7, 7, 7, 7)))


@query(f"""select "row", col, {_pick([_BAD, ("v >= -0.1::double and v <= 0.1::double", [1, 2, 3, 254])], [4, 4, 4, 4])} from ({_H})""")
def style_priority(spark, d):
    o = Options(use_color_classes=True, color_classes=(((1, 2, 3), (-0.1, 0.1)),), use_colors_based_on_values=True, colors_based_on_values=((0, "red"),), use_heat_map=True, unidentified_color=(4, 4, 4, 4))
    return _styled(spark, d, o)


@query(f"""select "row", col, {_pick([_BAD], [10, 20, 30, "round_even(greatest(0.0::double, least(255.0::double, (v + 0.3::double) / 0.7::double * 255)), 0)"])} from ({_H})""")
def style_opacity(spark, d):
    o = merge(use_single_color=True, color=[10, 20, 30], use_data_for_opacity=True, color_scale_value_range=(-0.3, 0.4))
    return _styled(spark, d, o, lambda v, o, nd: style.style(v, o, nd))


@query(f"""select "row", col, {_pick([("(b1 % 3)::float = 1::float and (b2 % 3)::float = 1::float and (b3 % 256)::float = 1::float", [0, 0, 0, 0])], ["(b1 % 3)", "(b2 % 3)", "(b3 % 256)", "(b4 % 256)"])} from {_B4}""")
def style_rgb(spark, d):
    w = _wide(spark, d)
    return _rgba(w, style.style_rgb(C("b1") % 3, C("b2") % 3, C("b3") % 256, Options(), F.lit(1.0), C("b4") % 256))


@query(f"""select "row", col, (b1 % 256)::int r, (b2 % 256)::int g, (b3 % 256)::int b, 254 a from {_B4}""")
def style_rgb_planar(spark, d):
    w = _wide(spark, d)
    return _rgba(w, style.style_rgb(C("b1") % 256, C("b2") % 256, C("b3") % 256, Options(), None))


@query(f"""select tile_row, tile_col, coalesce(min(v) filter (where ok), 0.0::double) lo, coalesce(max(v) filter (where ok), 255.0::double) hi from (select *, not (isnan(v) or v::float = -9999::float) ok from {_T8.format(_BLOCKED)}) group by 1, 2""")
def auto_range(spark, d):
    return tiles.auto_range(_tiles8(_blocked(spark, d)), nd(), KEYS)


_LIGHT = "(0.4::double + 0.6::double * mask / 255.0::double)"
_SWISS = [f"floor(({x}) * {_LIGHT})" for x in _heat_sql(_AT, *OWN)[:3]] + ["254"]


@query(f"""select "row", col, {_pick([_BAD], _SWISS)} from (select "row", col, c v, mask from {_MASK})""")
def style_swiss(spark, d):
    m = _masks(spark, d).withColumn("v", C("c"))
    return _rgba(m, style.style_relief(C("v"), C("mask"), merge(color_scale_value_range=OWN), nd()))


@query("""select m::int mask, (case when m < 128 then 0 else 255 end)::int r, (case when m < 128 then 0 else 255 end)::int g, (case when m < 128 then 0 else 255 end)::int b,
(case when m = 0 then 0 else floor(pow(abs(m - 128) / 128.0::double, case when m < 128 then 0.6::double else 0.8::double end) * 255 * 128 / 255.0::double) end)::int a from (select unnest(range(0, 256)) m)""")
def style_glaze(spark, d):
    m = spark.range(256).select(C("id").cast("int").alias("mask"))
    return _rgba(m, style.style_glaze(C("mask")), "mask")


# --- meshes -----------------------------------------------------------------------------------------------------------------


def _mesh_input(spark, d):
    t = tiles.to_arrays(tiles.cut(fx.emb(spark, d).where("row < 33 * 8 and col < 33"), 33).where("tile_row < 8 and tile_col = 0"), KEYS, 33)
    return t.withColumn("pixels", F.transform("pixels", lambda x: (x * 100).cast("float")))


#: The bound of the meshes' errors, and the side of their tiles in cells.
BOUND, SIDE = 20.0, 32


def _rtin_sql() -> str:
    """The right-triangulated mesh in SQL: all triangles of the hierarchy, errors from the finest level up, splits from the coarsest down."""
    last = 2 * int(math.log2(SIDE)) - 1
    both = "select l + 1 l, c0 a0, c1 a1, a0 b0, a1 b1, (a0 + b0) // 2 c0, (a1 + b1) // 2 c1 from {0} union all select l + 1, b0, b1, c0, c1, (a0 + b0) // 2, (a1 + b1) // 2 from {0}"
    steps = [
        f"""g as materialized (select tile_row, list(z order by y, x) z from (select floor("row" / 33)::int tile_row, ("row" % 33)::int y, col x, (v * 100)::float::double z from ({fx.EMB}) where "row" < 264 and col < 33) group by 1)""",
        f"l0 as materialized (select * from (values (0, 0, 0, {SIDE}, {SIDE}, {SIDE}, 0), (0, {SIDE}, {SIDE}, 0, 0, 0, {SIDE})) r(l, a0, a1, b0, b1, c0, c1))",
    ]
    steps += [f"l{k + 1} as materialized ({both.format(f'l{k}')})" for k in range(last)]
    for k in range(last, -1, -1):
        z = lambda x, y: f"z[({y}) * {SIDE + 1} + ({x}) + 1]"
        own = f"o{k} as materialized (select tile_row, t.*, (a0 + b0) // 2 mx, (a1 + b1) // 2 my, abs(({z('a0', 'a1')} + {z('b0', 'b1')}) / 2 - {z('(a0 + b0) // 2', '(a1 + b1) // 2')}) e from g, l{k} t)"
        if k == last:
            steps += [own, f"e{k} as materialized (select tile_row, mx, my, max(e) e from o{k} group by all)"]
        else:
            below = f"""select o.tile_row, o.mx, o.my, greatest(o.e, p.e, q.e) e from o{k} o join e{k + 1} p on p.tile_row = o.tile_row and p.mx = (o.c0 + o.a0) // 2 and p.my = (o.c1 + o.a1) // 2
 join e{k + 1} q on q.tile_row = o.tile_row and q.mx = (o.b0 + o.c0) // 2 and q.my = (o.b1 + o.c1) // 2"""
            steps += [own, f"e{k} as materialized (select tile_row, mx, my, max(e) e from ({below}) group by all)"]
    steps.append("s0 as materialized (select tile_row, l0.* from (select distinct tile_row from g), l0)")
    for k in range(last + 1):
        steps.append(f"d{k} as materialized (select s.*, e > {BOUND!r}::double deeper from s{k} s join e{k} m on m.tile_row = s.tile_row and m.mx = (s.a0 + s.b0) // 2 and m.my = (s.a1 + s.b1) // 2)")
        steps.append(f"s{k + 1} as materialized (select tile_row, c0 a0, c1 a1, a0 b0, a1 b1, (a0 + b0) // 2 c0, (a1 + b1) // 2 c1 from d{k} where deeper union all select tile_row, b0, b1, c0, c1, (a0 + b0) // 2, (a1 + b1) // 2 from d{k} where deeper)")
    leaves = " union all ".join([f"select tile_row, a0, a1, b0, b1, c0, c1 from d{k} where not deeper" for k in range(last + 1)] + [f"select * from s{last + 1}"])
    return f"""with {(","  + chr(10)).join(steps)}, f as materialized ({leaves}),
v as (select tile_row, count(distinct (x, y)) n from (select tile_row, unnest([(a0, a1), (b0, b1), (c0, c1)]) p, p[1] x, p[2] y from f) group by 1)
select tile_row, 0 tile_col, any_value(v.n)::bigint n_vertices, count(*)::bigint n_triangles, {2 * SIDE * SIDE}::bigint area2 from f join v using (tile_row) group by tile_row"""


@query(_rtin_sql())
def mesh_rtin_stats(spark, d):
    return mesh.mesh_stats(mesh.mesh_tiles(_mesh_input(spark, d), BOUND, "martini", KEYS), KEYS)


@query(f"""select distinct floor("row" / 33)::int tile_row, 0 tile_col, {2 * SIDE * SIDE}::bigint area2, {(SIDE + 1) ** 2}::bigint n_covered, true bounded, true refined from ({fx.EMB}) where "row" < 264""")
def mesh_tin_stats(spark, d):
    """Every pixel is covered and no farther from the mesh than the bound; a coarse mesh is farther, and has fewer triangles."""
    own = _mesh_input(spark, d)
    fine, coarse = (mesh.mesh_tiles(own, e, "delatin", KEYS) for e in (BOUND, 1e9))
    errors = lambda m: mesh.vertical_errors(m.drop("width").join(own.select(*KEYS, "width", "height", "pixels"), list(KEYS)), KEYS)
    two = errors(coarse).select(*KEYS, F.col("max_error").alias("coarse"))
    out = errors(fine).join(mesh.mesh_stats(fine, KEYS), list(KEYS)).join(two, list(KEYS))
    return out.select(*KEYS, "area2", "n_covered", (C("max_error") <= BOUND + 1e-6).alias("bounded"), ((C("coarse") > BOUND) & (C("n_triangles") > 2)).alias("refined"))


BOX = (100.0, 200.0, 612.0, 712.0)


@query(f"""select "row", col, col * 2.0::double + 100.0::double x, -"row" * 2.0::double + 712.0::double y, v * 1.5::double z, col / 256.0::double u, "row" / 256.0::double v from ({fx.DEM})""")
def vertex_attrs(spark, d):
    a = mesh.vertex_attributes(C("col"), C("row"), C("v"), 257, BOX, 1.5)
    return fx.dem(spark, d).select("row", "col", "v").select("row", "col", *(c.alias(n) for n, c in a.items()))


@query(f"""select min(col * 2.0::double + 100) min_x, min(-"row" * 2.0::double + 712) min_y, round(min(v), 6) min_z, max(col * 2.0::double + 100) max_x, max(-"row" * 2.0::double + 712) max_y, round(max(v), 6) max_z from ({fx.DEM})""")
def mesh_bbox(spark, d):
    a = mesh.vertex_attributes(C("col"), C("row"), C("v"), 257, BOX)
    box = mesh.bounding_box(fx.dem(spark, d).select(*(a[n].alias(n) for n in "xyz")))
    return box.select(*(r6(C(c), c) if c.endswith("z") else C(c) for c in box.columns))


def _grid_triangles(spark, n: int = 16):
    cells = spark.range((n - 1) * (n - 1)).select((F.floor(C("id") / (n - 1)) * n + C("id") % (n - 1)).cast("int").alias("v"))
    return cells.select(F.inline(F.array(F.struct(C("v").alias("a"), (C("v") + 1).alias("b"), (C("v") + n).alias("c")), F.struct((C("v") + 1).alias("a"), (C("v") + n + 1).alias("b"), (C("v") + n).alias("c")))))


_TRI = """(select v a, v + 1 b, v + 16 c from (select ((i // 15) * 16 + i % 15)::int v from (select unnest(range(0, 225)) i)) union all select v + 1, v + 17, v + 16 from (select ((i // 15) * 16 + i % 15)::int v from (select unnest(range(0, 225)) i)))"""
_EDGES = f"(select least(p, q)::int p, greatest(p, q)::int q from (select a p, b q from {_TRI} union all select b, c from {_TRI} union all select c, a from {_TRI}) group by 1, 2 having count(*) % 2 = 1)"


@query(f"select p, q from {_EDGES}")
def outer_edges(spark, d):
    return mesh.outer_edges(_grid_triangles(spark))


SIDES = ", ".join(f"({i}, {x}, {y}, '{s}')" for i, (x, y, s) in enumerate([(0, y, "west") for y in (3, 0, 2)] + [(9, y, "east") for y in (1, 5, 2)] + [(x, 9, "south") for x in (4, 0, 7)] + [(x, 0, "north") for x in (6, 1, 3)]))
_SIDE_SQL = " union all ".join(f"select '{s}' side, vid p, lead(vid) over (order by {o}, vid) q from {fx.literal_sql(SIDES, 'vid, x, y, side')} where side = '{s}'" for s, o in (("west", "y"), ("east", "y desc"), ("south", "x desc"), ("north", "x")))


@query(f"select side, p, q from ({_SIDE_SQL}) where q is not null")
def edge_indices(spark, d):
    v = fx.literal(spark, SIDES, "vid, x, y, side")
    out = [mesh.side_edges(v, s).select(F.lit(s).alias("side"), "p", "q") for s in ("west", "east", "south", "north")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"""with e as (select (row_number() over (order by p, q) - 1)::int i, p, q from {_EDGES}), ends as (select i, 0 k, p vid from e union all select i, 1, q from e)
select (256 + 2 * i + k)::int vid, (vid % 16)::double x, (vid // 16)::double y, (vid % 7)::double - 15.0::double z from ends""")
def skirt(spark, d):
    n = 16
    v = spark.range(n * n).select(C("id").cast("int").alias("vid"), (C("id") % n).cast("double").alias("x"), F.floor(C("id") / n).cast("double").alias("y"), (C("id") % 7).cast("double").alias("z"), F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
    e = mesh.numbered(mesh.outer_edges(_grid_triangles(spark)))
    return mesh.skirt(v, e, 10.0, n * n, 1.5)[0].select("vid", "x", "y", "z")


@query(f"""with e as (select (row_number() over (order by p, q) - 1)::int i, p, q from {_EDGES}), ends as (select i, 0 k, p vid from e union all select i, 1, q from e)
select m::int m, (256 + 2 * i + k)::int vid, (vid % 16)::double + m x, (vid // 16)::double y, (vid % 7)::double * m - 15.0::double z from ends, (select unnest([1, 2, 3]) m)""")
def skirt_tiles(spark, d):
    """Skirts of several meshes at once."""
    n, m = 16, F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("m")
    v = spark.range(n * n).select(C("id").cast("int").alias("vid"), m).select("m", "vid", ((C("vid") % n) + C("m")).cast("double").alias("x"), F.floor(C("vid") / n).cast("double").alias("y"), (C("vid") % 7 * C("m")).cast("double").alias("z"), F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
    e = mesh.numbered(mesh.outer_edges(_grid_triangles(spark).select("*", m), ("m",)), ("m",))
    return mesh.skirt(v, e, 10.0, F.lit(n * n), 1.5, ("m",))[0].select("m", "vid", "x", "y", "z")


@query(f"""with e as (select (row_number() over (order by p, q) - 1)::int i, p, q from {_EDGES}) select p a, 256 + 2 * i + 1 b, q c from e union all select 256 + 2 * i + 1, p, 256 + 2 * i from e""")
def skirt_triangles(spark, d):
    v = spark.range(1).select(C("id").cast("int").alias("vid"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
    return mesh.skirt(v, mesh.numbered(mesh.outer_edges(_grid_triangles(spark))), 10.0, 256)[1]


# --- aggregates and picking -------------------------------------------------------------------------------------------------


@query(f"""select min(lo) lo, max(hi) hi from (select tile_row, tile_col, min(v) filter (where ok) lo, max(v) filter (where ok) hi from (select *, v::float <> -9999::float ok from {_T8.format(_BLOCKED)}) group by 1, 2) where lo is not null""")
def z_range(spark, d):
    ok = F.when(~pixel.is_nodata(C("v"), nd()), C("v"))
    return tiles.z_range(_tiles8(_blocked(spark, d)).groupBy(*KEYS).agg(F.min(ok).alias("lo"), F.max(ok).alias("hi")))


@query(f"""select tile_row, tile_col, round(sqrt(sum((v - m) * (v - m)) / count(*)), 6) rms from (select *, avg(v) over (partition by tile_row, tile_col) m from {_T8.format(fx.EMB)}) group by 1, 2""")
def residual_rms(spark, d):
    t = _tiles8(fx.emb(spark, d))
    m = t.groupBy(*KEYS).agg(F.avg("v").alias("m"))
    return tiles.residual_rms(t.join(m, list(KEYS)), "v", "m", KEYS).select(*KEYS, r6(C("rms"), "rms"))


PICKS = "(1, array(1.0D, 2.0D, 3.0D)), (2, array(1.0D, 2.0D)), (3, array(1.0D, cast(null as double), 3.0D)), (4, cast(null as array<double>))"


@query("""select k, case when whole then c[1] end longitude, case when whole then c[2] end latitude, case when whole then c[3] end elevation from
(select k, c, len(c) = 3 and len(list_filter(c, lambda x: x is not null)) = 3 whole from (values (1, [1.0::double, 2.0, 3.0]), (2, [1.0::double, 2.0]), (3, [1.0::double, null, 3.0]), (4, null::double[])) t(k, c))""")
def pick_coord(spark, d):
    p = fx.literal(spark, PICKS, "k, c").select("k", picking.pick_coordinate(C("c")).alias("p"))
    return p.select("k", "p.longitude", "p.latitude", "p.elevation")


_PX = f"select id, floor((lon + 180) / 360 * 63)::int px, floor(({_V}) * 63)::int py from ({fx.POINTS}) where id % 10 = 0"


@query(f"""with p as ({_PX}), o as (select unnest([-1, 0, 1]) o), n as (select id, (py + a.o)::int "row", (px + b.o)::int col from p, o a, o b)
select id, "row", col, round(-180 + col / 63.0::double * 360, 6) lon, round(degrees(2 * atan(exp({_TOP} - "row" / 63.0::double * ({_TOP} - {_LOW}))) - {PI} / 2), 6) lat, round(v, 6) elevation from n join ({fx.DEM}) using ("row", col)""")
def sample_grid(spark, d):
    p = fx.points(spark, d).where("id % 10 = 0")
    out = picking.sample_grid(p, fx.dem(spark, d), (-180.0, -60.0, 180.0, 60.0), 64, 64)
    return out.select("id", "row", "col", r6(C("lon"), "lon"), r6(C("lat"), "lat"), r6(C("elevation"), "elevation"))


_UV = "select event_id id, ((event_id * 37) % 1000) / 1000.0::double u, ((event_id * 91) % 1000) / 1000.0::double v from events"


def _uv(spark, d):
    e = C("event_id")
    return fx.read(spark, d, "events").select(e.alias("id"), ((e * 37) % 1000 / 1000.0).alias("u"), ((e * 91) % 1000 / 1000.0).alias("v"))


@query(f"""select id, band, b.v value from (select id, floor(v * 64)::int "row", floor(u * 64)::int col from ({_UV})) p join ({fx.BANDS}) b using ("row", col)""")
def pick_bitmap(spark, d):
    px, py = picking.bitmap_pixel(C("u"), C("v"), 64, 64)
    return _uv(spark, d).select("id", py.alias("row"), px.alias("col")).join(fx.bands(spark, d), ["row", "col"]).select("id", "band", C("v").alias("value"))


@query(f"""select id, round(b.v, 6) elevation from (select id, greatest(0, least(63, floor(v * 63)))::int "row", greatest(0, least(63, floor(u * 63)))::int col from ({_UV})) p join ({fx.DEM}) b using ("row", col)""")
def pick_terrain(spark, d):
    px, py = picking.terrain_pixel(C("u"), C("v"), 64, 64)
    return _uv(spark, d).select("id", py.alias("row"), px.alias("col")).join(fx.dem(spark, d), ["row", "col"]).select("id", r6(C("v"), "elevation"))


@query(f"""select id, mask from (select id, floor(v * 64)::int "row", floor(u * 64)::int col from ({_UV})) p join {_MASK} using ("row", col)""")
def pick_derived(spark, d):
    px, py = picking.bitmap_pixel(C("u"), C("v"), 64, 64)
    return _uv(spark, d).select("id", py.alias("row"), px.alias("col")).join(_masks(spark, d), ["row", "col"]).select("id", "mask")


@query(f"""select "row", col, round((b1 % 256) * 256.0::double + (b2 % 256) * 1.0::double + (b3 % 256) / 256.0::double - 32768.0::double, 6) z from {_B4}""")
def decode_rgb_elevation(spark, d):
    return _wide(spark, d).select("row", "col", r6(pixel.rgb_elevation(C("b1") % 256, C("b2") % 256, C("b3") % 256, (256.0, 1.0, 1 / 256.0), -32768.0), "z"))


# --- tile pipelines ---------------------------------------------------------------------------------------------------------


def _tile_frame(raster: DataFrame, size: int, halo: int, rows: int, cols: int, nodata: float | None = -9999.0) -> DataFrame:
    """Tiles (dataset e, z 4, x, y, band 1) of a raster; x counts tile rows, y tile columns."""
    t = tiles.to_arrays(tiles.cut(raster, size, halo=halo).where(f"tile_row < {rows} and tile_col < {cols}"), KEYS, size + halo)
    return t.select(F.lit("e").alias("dataset"), F.lit(4).alias("z"), C("tile_row").alias("x"), C("tile_col").alias("y"), F.lit(1).alias("band"), "width", "height", F.lit(nodata).cast("double").alias("nodata"), cell().alias("cell_size"), "pixels")


TILE_RGBA = ("x", "y", "row", "col", "r", "g", "b", "a")


@query(f"""select x, 0 y, round((-{HALF} + x * s)::float::double / 1000, 1) west, round((-{HALF} + (x + 1) * s)::float::double / 1000, 1) east, round(({HALF} - s)::float::double / 1000, 1) south,
round({HALF}::float::double / 1000, 1) north, 289::bigint n_raw from (select unnest(range(0, 8))::int x, {CIRC} / 16 s)""")
def terrain_bounds(spark, d):
    t = _tile_frame(fx.emb(spark, d), 16, 1, 8, 1)
    m = pipelines.terrain(t, merge(type="terrain"), 0.05).select("x", "y", "raw", F.posexplode("positions").alias("k", "p"))
    side = lambda f, k: r6(f(F.when(C("k") % 3 == k, C("p"))) / 1000, digits=1)
    return m.groupBy("x", "y").agg(side(F.min, 0).alias("west"), side(F.max, 0).alias("east"), side(F.min, 1).alias("south"), side(F.max, 1).alias("north"), F.max(F.size("raw")).cast("bigint").alias("n_raw"))


_DOUBLED = f"""select "row", col, (case when v::float = -9999::float then v else v * 2 end)::float::double v from ({_H})"""


@query(f"""select floor(("row" - 1) / 62)::int x, 0 y, (("row" - 1) % 62)::int "row", (col - 1)::int col, case when c::float = -9999::float then -1 else round({_SLOPE}::double, 3) end slope from {_near(_DOUBLED)} where "row" between 1 and 434""")
def terrain_derived(spark, d):
    t = _tile_frame(fx.holes(fx.emb(spark, d)), 62, 2, 7, 1)
    out = tiles.to_pixels(pipelines.terrain_derived(t, merge(type="terrain", use_slope=True, multiplier=2.0)), ("x", "y"))
    return out.select("x", "y", "row", "col", F.when(F.isnan("v"), -1.0).otherwise(r6(C("v"), digits=3)).alias("slope"))


@query(f"""select floor(("row" - 1) / 62)::int x, 0 y, (("row" - 1) % 62)::int "row", (col - 1)::int col, r, g, b, a from (select "row", col, {_pick([_BAD], _SWISS)} from (select "row", col, c v, mask from {_MASK})) where "row" between 1 and 434""")
def terrain_texture(spark, d):
    """Elevations under Swiss relief."""
    t = _tile_frame(fx.emb(spark, d), 62, 2, 7, 1)
    return pipelines.terrain_texture(t, merge(type="terrain", use_swiss_relief=True, color_scale_value_range=OWN)).select(*TILE_RGBA)


@query(f"""select floor(("row" - 1) / 62)::int x, 0 y, (("row" - 1) % 62)::int "row", (col - 1)::int col, r, g, b, a from (select "row", col, {_pick([("c::float = -9999::float", [0, 0, 0, 0])], [10, 20, 30, 254])} from {_near(_DOUBLED)}) where "row" between 1 and 434""")
def terrain_texture_slope(spark, d):
    """A derived surface in one colour: no texture where there is no data."""
    t = _tile_frame(fx.holes(fx.emb(spark, d)), 62, 2, 7, 1)
    return pipelines.terrain_texture(t, merge(type="terrain", use_slope=True, use_single_color=True, color=[10, 20, 30], multiplier=2.0)).select(*TILE_RGBA)


_TWICE = f"""select "row", col, (case when v::float = -9999::float then -19998.0::double else v * 2 end)::float::double v from ({_H})"""


@query(f"""select floor("row" / 16)::int x, floor(col / 16)::int y, ("row" % 16)::int "row", (col % 16)::int col, {_pick([("v = -19998", [0, 0, 0, 0])], _heat_sql(_AT, *OWN))} from ({_TWICE}) where "row" < 128 and col < 48""")
def terrain_texture_source(spark, d):
    """The source as a texture: without its last row and column, multiplied, noData left out."""
    t = _tile_frame(fx.holes(fx.emb(spark, d)), 16, 1, 8, 3)
    o = merge(type="terrain", use_heat_map=True, color_scale_value_range=OWN, multiplier=2.0)
    return pipelines.terrain_texture(t, o).select(*TILE_RGBA)


def _ramp_by(v: str, low: str, high: str, k: int) -> str:
    """A channel of the ramp over SQL expressions."""
    n = len(_YOR) - 1
    t = f"(greatest(0.0::double, least(1.0::double, (({v}) - {low}) / (case when {high} = {low} then 1.0::double else {high} - {low} end))) * {n})"
    at, i = f"[{', '.join(f'{c[k]}.0::double' for c in _YOR)}]", f"least(floor({t})::int, {n - 1})"
    return f"floor({at}[{i} + 1] + ({t} - {i}) * ({at}[least({i} + 1, {n}) + 1] - {at}[{i} + 1]) + 0.5::double)::int"


_TILED = f"""(select *, coalesce(min(v) filter (where ok) over w, 0.0::double) lo, coalesce(max(v) filter (where ok) over w, 255.0::double) hi
from (select *, not (isnan(v) or v::float = -9999::float) ok from {_T8.format(_BLOCKED)}) window w as (partition by tile_row, tile_col))"""
_AT_TILE = "(lo + greatest(0, least(1023, floor((v - lo) / (case when hi = lo then 1.0::double else hi - lo end) * 1023)))::int / 1023.0::double * (hi - lo))"
_WHERE8 = "tile_row < 40"


def _blocked_tiles(spark, d):
    return _tile_frame(_blocked(spark, d), 8, 0, 40, 8)


@query(f"""select tile_row x, tile_col y, "row", col, {_pick([_BAD], [_ramp_by(_AT_TILE, "lo", "hi", k) for k in range(3)] + ["254"])} from {_TILED} where {_WHERE8}""")
def bitmap_auto_range(spark, d):
    return pipelines.bitmap(_blocked_tiles(spark, d), merge(use_auto_range=True)).select(*TILE_RGBA)


@query(f"""select tile_row x, tile_col y, "row", col, {_pick([("v <= -0.25::double", [7, 7, 7, 7]), *_CLASS_CASES], [0, 0, 0, 0])} from {_TILED} where {_WHERE8}""")
def bitmap_auto_range_classes(spark, d):
    """A tile's own range changes neither classes nor clip bounds."""
    o = merge(use_auto_range=True, use_color_classes=True, color_classes=CLASSES, clip_low=-0.25, clipped_color=(7, 7, 7, 7))
    return pipelines.bitmap(_blocked_tiles(spark, d), o).select(*TILE_RGBA)


@query(f"""select tile_row x, tile_col y, "row", col, {_pick([("(tile_row + tile_col) % 2 = 0", [9, 8, 7, 6]), (_BAD[0], [9, 8, 7, 6])], [10, 20, 30, 254])} from {_T8.format(_BLOCKED)} where {_WHERE8}""")
def bitmap_missing_channel(spark, d):
    """Every other tile lacks the channel."""
    t = _blocked_tiles(spark, d)
    two = t.unionByName(t.where("(x + y) % 2 = 1").withColumn("band", F.lit(2)))
    return pipelines.bitmap(two, merge(use_channel=2, null_color=(9, 8, 7, 6), use_single_color=True, color=[10, 20, 30])).select(*TILE_RGBA)


@query(f"""select tile_row x, tile_col y from {_T8.format(_BLOCKED)} where {_WHERE8} group by 1, 2 having not bool_and(v::float = -9999::float) or (tile_row + tile_col) % 2 = 1""")
def nodata_tiles_all_bands(spark, d):
    """An unknown check: a tile without data in its band stays if another band has some."""
    t = _blocked_tiles(spark, d)
    two = t.unionByName(t.where("(x + y) % 2 = 1").withColumns({"band": F.lit(2), "pixels": F.transform("pixels", lambda v: F.lit(1.0).cast("float"))}))
    return pipelines.with_data(two, merge(type="terrain", no_data_check="whatever")).select("x", "y")


# --- picks in tiles ---------------------------------------------------------------------------------------------------------

_VALUE = "((x * 31 + y * 17 + {row} * 7 + {col} * 3) % 101)"


def _world(spark):
    """All tiles of zoom 3, 16 pixels a side, of known values."""
    t = spark.range(64).select(F.lit(3).alias("z"), (C("id") % 8).cast("int").alias("x"), F.floor(C("id") / 8).cast("int").alias("y"), F.lit(16).alias("width"), F.lit(16).alias("height"))
    return t.withColumn("pixels", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: ((C("x") * 31 + C("y") * 17 + F.floor(i / 16) * 7 + i % 16 * 3) % 101).cast("float")))


_LAT8 = f"degrees(2 * atan(exp({HALF} / {HALF} * {PI} * (1 - {{}} / 4.0::double))) - {PI} / 2)"
_MERC = f"ln(tan({PI} / 4 + radians({{}}) / 2))"
_IN_TILE = f"""(select *, floor(round((lon - west) / 45 * 15, 7))::int px, floor(round((({_MERC.format("north")}) - ({_MERC.format("lat")})) / (({_MERC.format("north")}) - ({_MERC.format("south")})) * 15, 7))::int py from
(select *, x * 45.0::double - 180 west, {_LAT8.format("y")} north, {_LAT8.format("(y + 1)")} south from
(select id, lon, lat, floor((lon + 180) / 360 * 8)::int x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / {PI}) / 2 * 8)::int y from ({fx.POINTS}))))"""


@query(f"""select id, x, y, "row", col, ({_VALUE.format(row='"row"', col="col")})::double elevation from
(select id, x, y, py + a.o "row", px + b.o col from {_IN_TILE}, (select unnest([-1, 0, 1]) o) a, (select unnest([-1, 0, 1]) o) b) where "row" between 0 and 15 and col between 0 and 15""")
def sample_tiles(spark, d):
    """Grids of pixels around points, each inside the point's tile."""
    p = fx.points(spark, d).withColumns({"lon": C("lon") + 1e-9, "lat": C("lat") - 1e-9})
    return picking.sample_tiles(p, _world(spark), 3).select("id", "x", "y", "row", "col", C("elevation").cast("double").alias("elevation"))


@query(f"""select id, floor(round(coalesce(case when id % 2 = 0 then (id % 100) / 100.0::double end, (lon + 180) / 360) * 63, 7))::int px, floor(round(coalesce(case when id % 2 = 0 then (id % 90) / 90.0::double end, {_V}) * 63, 7))::int py from ({fx.POINTS})""")
def pick_fallback(spark, d):
    """Picks with their own u and v, and others by their coordinate."""
    even = C("id") % 2 == 0
    box = (F.lit(-180.0), F.lit(-60.0), F.lit(180.0), F.lit(60.0))
    u, v = picking.uv_or_box(F.when(even, C("id") % 100 / 100.0), F.when(even, C("id") % 90 / 90.0), C("lon"), C("lat"), *box)
    return fx.points(spark, d).select("id", F.floor(F.round(u * 63, 7)).cast("int").alias("px"), F.floor(F.round(v * 63, 7)).cast("int").alias("py"))
