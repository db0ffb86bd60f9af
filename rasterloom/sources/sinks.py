"""Writing tiles: partitioned Parquet, and PNG bytes of RGBA pixels."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tiles(tiles: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "z")) -> None:
    tiles.write.mode("overwrite").partitionBy(*by).parquet(path)


def pack_rgba(pixels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, width, height and rgba (four bytes a pixel, row by row) of pixels (keys, row, col, r, g, b, a)."""
    value = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in "rgba"))
    own = pixels.groupBy(*keys).agg(F.max("col").alias("w"), F.max("row").alias("h"), F.sort_array(F.collect_list(F.struct("row", "col", value.alias("x")))).alias("p"))
    return own.select(*keys, (F.col("w") + 1).alias("width"), (F.col("h") + 1).alias("height"), F.unhex(F.array_join(F.transform("p", lambda x: x["x"]), "")).alias("rgba"))


def png(width: int, height: int, rgba: bytes) -> bytes:
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = b"".join(b"\0" + rgba[4 * width * y : 4 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
