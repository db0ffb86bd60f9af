"""Keeping results: persisted frames by key with a bound on their number, shared while they are made, and jobs that end with their last caller."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession

#: Frames kept of tile results, rasters and relief masks (fixed values).
RESULTS, RASTERS, MASKS = 32, 64, 64


class FrameCache:
    """The least recently used frames are unpersisted beyond the limit. A key holds all that the frame depends on, options included."""

    def __init__(self, limit: int = RESULTS):
        self.limit, self.frames, self.lock = limit, OrderedDict(), threading.Lock()

    def get(self, key: Hashable, make: Callable[[], DataFrame]) -> DataFrame:
        """The frame of the key; made and persisted once, also for callers that ask at the same time."""
        with self.lock:
            if key not in self.frames:
                self.frames[key] = make().persist()
            self.frames.move_to_end(key)
            while len(self.frames) > self.limit:
                self.frames.popitem(last=False)[1].unpersist()
            return self.frames[key]

    def clear(self) -> None:
        with self.lock:
            for f in self.frames.values():
                f.unpersist()
            self.frames.clear()


class SharedJob:
    """Jobs under one tag: they are cancelled when the last caller has left."""

    def __init__(self, spark: SparkSession, tag: str):
        self.context, self.tag, self.callers, self.lock = spark.sparkContext, tag, 0, threading.Lock()

    def __enter__(self) -> SharedJob:
        with self.lock:
            self.callers += 1
        self.context.addJobTag(self.tag)
        return self

    def __exit__(self, *_) -> None:
        self.context.removeJobTag(self.tag)
        self.leave()

    def leave(self) -> bool:
        """Whether this was the last caller, so that what still runs was cancelled."""
        with self.lock:
            self.callers = max(0, self.callers - 1)
            last = self.callers == 0
        if last:
            self.context.cancelJobsWithTag(self.tag)
        return last
