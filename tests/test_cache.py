import numpy as np
from pyspark.sql import functions as F

from rasterloom.functions.metadata import same_urls, valid_urls
from rasterloom.operators.tiles import resample
from rasterloom.plans.cache import FrameCache, SharedJob


def test_frames_are_kept_up_to_the_limit(spark):
    made = []

    def make(k):
        made.append(k)
        return spark.range(k)

    cache = FrameCache(2)
    for k in (1, 2, 1, 3, 1, 2):
        assert cache.get(k, lambda k=k: make(k)).count() == k
    assert made == [1, 2, 3, 2]
    cache.clear()
    assert not cache.frames


def test_jobs_end_with_the_last_caller(spark):
    job = SharedJob(spark, "tile-1")
    with job:
        job.callers += 1
        assert spark.range(10).count() == 10
    assert job.callers == 1 and job.leave() and not job.callers


def test_urls():
    assert valid_urls(None) and valid_urls("a") and valid_urls(["a", "b"]) and not valid_urls([1]) and not valid_urls(3)
    assert same_urls(["a"], ["a"]) and not same_urls("a", ["a"]) and same_urls(None, None) and not same_urls(["a"], ["b"])


def test_resample(spark):
    px = spark.range(16).select(F.lit(1).alias("k"), F.floor(F.col("id") / 4).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"), F.col("id").cast("double").alias("v"))
    grid = lambda df, n: np.array([r.v for r in df.orderBy("row", "col").collect()]).reshape(n, n)
    half = grid(resample(px, ("k",), 4, 2), 2)
    np.testing.assert_allclose(half, [[2.5, 4.5], [10.5, 12.5]])
    np.testing.assert_allclose(grid(resample(px, ("k",), 4, 4), 4), np.arange(16).reshape(4, 4))
    assert grid(resample(px, ("k",), 4, 8, linear=False), 8)[::2, ::2].tolist() == np.arange(16).reshape(4, 4).tolist()
