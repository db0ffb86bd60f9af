"""Rasters and literal tables that queries run on, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = 0.5


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def emb(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as a raster of 64 columns."""
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "x")).select("row", "col", F.col("x").cast("double").alias("v"))


EMB = 'select vec_id::int "row", unnest(range(0, 64))::int col, unnest(embedding)::double v from embeddings'


def _cents(price: str) -> F.Column:
    return F.round(F.col(price) * 100).cast("bigint")


def dem(spark: SparkSession, d: str) -> DataFrame:
    """Mean prices on a grid of suppliers by parts."""
    row, col = (F.col("l_suppkey") % 64).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col")
    return read(spark, d, "lineitem").groupBy(row, col).agg((F.sum(_cents("l_extendedprice")) / F.count("*") / 100.0).alias("v"))


DEM = 'select (l_suppkey % 64)::int "row", (l_partkey % 64)::int col, sum(round(l_extendedprice * 100)::bigint)::double / count(*) / 100.0::double v from lineitem group by 1, 2'


def classes(spark: SparkSession, d: str) -> DataFrame:
    """Part sizes (1 to 50) as an 8-bit raster."""
    return read(spark, d, "part").select(F.floor(F.col("p_partkey") / 64).cast("int").alias("row"), (F.col("p_partkey") % 64).cast("int").alias("col"), F.col("p_size").cast("double").alias("v"))


CLASSES = 'select floor(p_partkey / 64)::int "row", (p_partkey % 64)::int col, p_size::double v from part'


def bands(spark: SparkSession, d: str) -> DataFrame:
    """Four bands on the grid of dem: count, quantity, least and greatest price in cents."""
    row, col = (F.col("l_suppkey") % 64).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col")
    g = read(spark, d, "lineitem").groupBy(row, col).agg(F.count("*").alias("b1"), F.sum(F.col("l_quantity").cast("bigint")).alias("b2"), F.min(_cents("l_extendedprice")).alias("b3"), F.max(_cents("l_extendedprice")).alias("b4"))
    return g.select("row", "col", F.posexplode(F.array("b1", "b2", "b3", "b4")).alias("k", "x")).select("row", "col", (F.col("k") + 1).cast("int").alias("band"), F.col("x").cast("double").alias("v"))


BANDS = """select "row", col, unnest([1, 2, 3, 4])::int band, unnest([b1, b2, b3, b4])::double v from (select (l_suppkey % 64)::int "row", (l_partkey % 64)::int col,
count(*)::bigint b1, sum(l_quantity::bigint)::bigint b2, min(round(l_extendedprice * 100)::bigint) b3, max(round(l_extendedprice * 100)::bigint) b4 from lineitem group by 1, 2)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return read(spark, d, "events").select(e.alias("id"), ((e * 7919) % 360000 / 1000.0 - 180).alias("lon"), ((e * 104729) % 170000 / 1000.0 - 85).alias("lat"))


POINTS = "select event_id id, ((event_id * 7919) % 360000) / 1000.0::double - 180 lon, ((event_id * 104729) % 170000) / 1000.0::double - 85 lat from events"


def holes(raster: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """The raster with noData where values are below -0.2."""
    return raster.withColumn("v", F.when(F.col("v") < -0.2, F.lit(nodata)).otherwise(F.col("v")))


def holes_sql(raster: str, nodata: str = "-9999.0") -> str:
    return f'select "row", col, case when v < -0.2::double then {nodata}::double else v end v from ({raster})'


def literal(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"select * from values {rows} as t({columns})")


def literal_sql(rows: str, columns: str) -> str:
    return f"(values {rows}) t({columns})"


PYRAMID = "('a', 0, 4096, 38.21851414258813D), ('a', 1, 2048, 38.21851414258813D), ('a', 2, 1024, 38.21851414258813D), ('a', 3, 512, 38.21851414258813D), ('gap', 0, 4096, 38.21851414258813D), ('gap', 1, 2048, 38.21851414258813D), ('gap', 3, 512, 38.21851414258813D)"
PYRAMID_COLUMNS = "dataset, image_index, width, base_res"
#: Tiles of zooms 0 to 6, at the corners and in the middle.
GRID = ", ".join(f"({z}, {x}, {y})" for z in range(7) for x, y in sorted({(0, 0), (2**z - 1, 2**z - 1), (2**z // 2, 2**z // 3)}))


def grid(spark: SparkSession) -> DataFrame:
    return literal(spark, GRID, "z, x, y")
