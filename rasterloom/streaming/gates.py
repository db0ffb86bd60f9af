"""Streaming operators: a running elevation range, and the gate that holds details back until an overview has come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: Between two updates of the range; shares of a dataset's waiting tiles, so that no dataset waits on one task (the first a fixed value).
DEBOUNCE, SHARES = "200 milliseconds", 16


def running_z_range(tiles: DataFrame, key: str = "dataset") -> DataFrame:
    """The least and greatest elevation so far of each dataset's tiles (lo, hi): it only ever widens."""
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    return tiles.groupBy(key).agg(F.min(ok("lo")).alias("lo"), F.max(ok("hi")).alias("hi"))


def debounced(ranges: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, every: str = DEBOUNCE) -> DataStreamWriter:
    """A writer, yet to be started, that gives take() the last range of each dataset that changed, at most once in `every`."""
    return ranges.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def progressive(tiles: DataFrame, time: str | None = None, patience: str = "1 hour", shares: int = SHARES) -> DataFrame:
    """dataset, z, x, y of arriving tiles (dataset, z, min_zoom, x, y) that may be shown: those of the least zoom at once, finer ones when one
    such tile of their dataset has come, before or after them.

    Finer tiles are joined with the datasets' openings, so they wait as rows of the join's state, dealt to `shares` keys a dataset. With
    a time column, tiles and openings older than `patience` leave the state (watermarks on both sides); without one all wait.
    """
    own = tiles if time is None else tiles.withWatermark(time, patience)
    keep = ["dataset", "z", "x", "y", *([time] if time else [])]
    first = own.where("z <= min_zoom")
    opening = first.select("dataset", *([F.col(time).alias("opened")] if time else []), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    opening = opening.dropDuplicates(["dataset", "share"]) if time is None else opening.dropDuplicatesWithinWatermark(["dataset", "share"])
    finer = own.where("z > min_zoom").select(*keep, F.pmod(F.xxhash64("x", "y"), F.lit(shares)).cast("int").alias("share"))
    a, b = finer.alias("a"), opening.alias("b")
    on = (F.col("a.dataset") == F.col("b.dataset")) & (F.col("a.share") == F.col("b.share"))
    if time:
        wait = F.expr(f"interval {patience}")
        on &= (F.col("b.opened") <= F.col(f"a.{time}") + wait) & (F.col(f"a.{time}") <= F.col("b.opened") + wait)
    late = a.join(b, on).select(*(F.col(f"a.{c}") for c in ("dataset", "z", "x", "y")))
    return first.select("dataset", "z", "x", "y").unionByName(late)


def shown(tiles: DataFrame) -> DataFrame:
    """The same over a finite table: tiles of the least zoom, and all others of datasets that have one."""
    ready = tiles.where("z <= min_zoom").select("dataset").distinct()
    return tiles.join(ready, "dataset", "left_semi").select("dataset", "z", "x", "y")
