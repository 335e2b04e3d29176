"""Bootstrap of a curve's peak: whole profiles are resampled, in partial sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import profiles as pf

#: Poisson(1) distribution function at 0 to 7.
_STEPS = np.cumsum(np.exp(-1.0) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7]))


def weights(ids: np.ndarray, resamples: int) -> np.ndarray:
    """How often each row is in each resample: Poisson(1), from a hash of the row's id (64 bits) and the resample."""
    x = ids.astype(np.uint64)[:, None] + (np.arange(resamples, dtype=np.uint64) + np.uint64(1))[None] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = (x ^ (x >> np.uint64(31))) / 2.0**64
    return np.searchsorted(_STEPS, u.ravel(), side="right").reshape(u.shape).astype(float)


def resampled_sums(rows: DataFrame, key: str, row_id: str, profile: str, resamples: int) -> DataFrame:
    """(key, b, i, s, w): sums of the weighted profiles of each resample, element by element, and of the weights.

    A task sums its own profiles with one matrix product a key and batch, so what is
    shuffled is as many curves as there are resamples, keys and batches, whatever the
    number of rows.  Profiles of a key have one length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for name, own in frame.groupby(key, dropna=False, sort=False):
                matrix = np.stack(own["profile"].to_numpy())
                w = weights(own["h"].to_numpy().view(np.uint64), resamples)
                sums, n = w.T @ matrix, matrix.shape[1]
                yield pa.RecordBatch.from_pydict(
                    {
                        key: pa.array([name] * (resamples * n), batch.schema.field(key).type), "b": np.repeat(np.arange(resamples, dtype=np.int32), n), "i": np.tile(np.arange(n, dtype=np.int32), resamples),
                        "s": sums.ravel(), "w": np.repeat(w.sum(0), n),
                    }
                )

    kind = rows.schema[key].dataType.simpleString()
    partial = rows.where(F.col(profile).isNotNull()).select(key, F.xxhash64(row_id).alias("h"), F.col(profile).alias("profile")).mapInArrow(run, f"`{key}` {kind}, b int, i int, s double, w double")
    return partial.groupBy(key, "b", "i").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))


def peak_bootstrap(rows: DataFrame, key: str, row_id: str, profile: str, along: Column, smooth: float, resamples: int = 200) -> DataFrame:
    """(key, low, high): 2.5 and 97.5 percentiles of the peak offset of the mean profile over resamples of whole profiles.

    ``along``: the offsets, over the columns of ``rows`` that each key has one value
    of.  Without resamples both are NaN.
    """
    keys = rows.groupBy(key).agg(F.first(along, ignorenulls=True).alias("__along"))
    if not resamples:
        return keys.select(key, F.lit(float("nan")).alias("low"), F.lit(float("nan")).alias("high"))
    sums = resampled_sums(rows, key, row_id, profile, resamples).where("w > 0")
    curves = sums.groupBy(key, "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("s") / F.col("w")).alias("v")))), lambda p: p["v"]).alias("curve"))
    smoothed = curves.join(keys, key).withColumn("curve", pf.smoothed(F.col("curve"), smooth))
    peaks = smoothed.select(key, pf.peak_offset(F.col("curve"), F.col("__along")).alias("peak"))
    return peaks.groupBy(key).agg(F.percentile("peak", F.lit(0.025)).alias("low"), F.percentile("peak", F.lit(0.975)).alias("high"))
