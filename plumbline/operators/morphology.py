"""Shapes of label sets: exact distances to the background, and junctions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import blocks as bk
from plumbline.operators.voxels import AXES


def envelope(f: np.ndarray) -> np.ndarray:
    """Least of f(q) + (p - q)^2 over q at every p, by the lower envelope of the parabolas."""
    n = len(f)
    sites = np.flatnonzero(np.isfinite(f))
    if not len(sites):
        return np.full(n, np.inf)
    hull, start = [int(sites[0])], [-np.inf]  # parabolas of the envelope, and where each begins
    for q in map(int, sites[1:]):
        while True:
            r = hull[-1]
            cross = ((f[q] + q * q) - (f[r] + r * r)) / (2 * (q - r))
            if cross > start[-1]:
                break
            hull.pop()
            start.pop()
        hull.append(q)
        start.append(cross)
    at = np.asarray(hull)[np.searchsorted(start, np.arange(n), side="left") - 1]
    return f[at] + (np.arange(n) - at) ** 2


def _along(length: int):
    """Squared distances of the places of a line of that length, from those so far; all other places have none."""

    @F.pandas_udf("array<double>")
    def least(place: pd.Series, d2: pd.Series) -> pd.Series:
        found = []
        for p, d in zip(place, d2, strict=True):
            line = np.zeros(length)
            line[p] = d
            found.append(envelope(line)[p])
        return pd.Series(found)

    return least


def background_distance(voxels: DataFrame, key: str, shape: dict[str, int]) -> DataFrame:
    """(key, z, y, x, distance): exact Euclidean distance of each voxel of the set to the nearest place outside the set.

    Places beyond the volume's faces are no background; a set that fills its volume
    has infinite distances.  One pass along each axis, a line of voxels at a time:
    a line is at most as long as the volume's side, and only voxels of the set are
    rows, as all others have distance zero.
    """
    out = voxels.select(key, *[F.col(a).cast("int").alias(a) for a in AXES]).distinct().withColumn("d2", F.lit(float("inf")))
    for axis in AXES:
        along = _along(shape[axis])
        others = [a for a in AXES if a != axis]
        lines = out.groupBy(key, *others).agg(F.collect_list(F.struct(axis, "d2")).alias("l"))
        after = lines.select(key, *others, F.explode(F.arrays_zip(F.col(f"l.{axis}").alias("p"), along(F.col(f"l.{axis}"), F.col("l.d2")).alias("d"))).alias("e"))
        out = after.select(key, *others, F.col("e.p").alias(axis), F.col("e.d").alias("d2"))
    return out.select(key, *AXES, F.sqrt("d2").alias("distance"))


def distance_stats(distances: DataFrame, key: str) -> DataFrame:
    """Per key: twice the distance as median, 95th percentile, maximum and mean."""
    t = 2.0 * F.col("distance")
    return distances.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.median(t).alias("median"), F.percentile(t, F.lit(0.95)).alias("p95"), F.max(t).alias("max"), F.avg(t).alias("mean"))


def _spread(seeds: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """What the seeds reach within ``inside`` through the 26 neighbours; leading axis: one cube each."""
    reached = seeds & inside
    while True:
        wide = np.pad(reached, ((0, 0), (1, 1), (1, 1), (1, 1)))
        for a in (1, 2, 3):
            wide = wide | np.roll(wide, 1, a) | np.roll(wide, -1, a)
        grown = wide[:, 1:-1, 1:-1, 1:-1] & inside
        if (grown == reached).all():
            return reached
        reached = grown


def arms(label: np.ndarray, radius: int) -> np.ndarray:
    """For cubes of side 2 radius + 1 around voxels of a set: in how many pieces the set meets the ball's shell.

    Only what is tied to the middle voxel within the ball counts.
    """
    grid = np.stack(np.meshgrid(*[np.arange(-radius, radius + 1)] * 3, indexing="ij"))
    far = np.sqrt((grid**2).sum(0))
    ball = far <= radius + 0.5
    middle = np.zeros_like(ball)
    middle[radius, radius, radius] = True
    home = _spread(np.broadcast_to(middle, label.shape), label & ball)
    left = home & (far >= radius - 0.5)
    n = np.zeros(len(label), np.int64)
    while left.any():
        some = left.reshape(len(left), -1)
        first = np.zeros_like(some)
        rows = np.flatnonzero(some.any(1))
        first[rows, some[rows].argmax(1)] = True
        n[rows] += 1
        left = left & ~_spread(first.reshape(left.shape), left)
    return n


def junctions(voxels: DataFrame, key: str, radius: int = 5, samples: int | None = 4000, seed: int = 0) -> DataFrame:
    """(key, z, y, x, arms) of sampled voxels: where a sheet forks, its piece in a ball meets the shell more than once.

    A sampling operator: the first ``samples`` voxels of a key in the order of their
    md5 (None: all).  A sample's work is bounded by its ball; blocks with a halo of
    the radius hold all that it needs.
    """
    side = max(bk.SIDE, 2 * radius)
    rows = voxels.select(key, *[F.col(a).cast("int").alias(a) for a in AXES]).distinct().withColumn("__draw", F.lit(1.0))
    if samples is not None:
        draw = F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(key).cast("string"), *[F.col(a).cast("string") for a in AXES]))
        turn = F.row_number().over(Window.partitionBy(key).orderBy(draw, *AXES))
        chosen = rows.withColumn("__turn", turn).where(F.col("__turn") <= samples).select(key, *AXES, F.lit(2.0).alias("__draw"))
        rows = rows.unionByName(chosen)  # the larger value of a voxel stands
    else:
        rows = rows.withColumn("__draw", F.lit(2.0))

    def work(c: np.ndarray):
        inner = c[radius:-radius, radius:-radius, radius:-radius]
        drawn, n = inner == 2.0, np.zeros(inner.shape, np.int64)
        there, at = ~np.isnan(c), np.argwhere(inner == 2.0)
        for i in range(0, len(at), 256):
            some = at[i : i + 256]
            cubes = np.stack([there[z : z + 2 * radius + 1, y : y + 2 * radius + 1, x : x + 2 * radius + 1] for z, y, x in some])
            n[tuple(some.T)] = arms(cubes, radius)
        return drawn, {"arms": n}

    return bk.each_block(bk.blocks(rows, key, "__draw", side, radius), key, work, {"arms": "long"}, side, radius)


def junction_density(found: DataFrame, key: str) -> DataFrame:
    """Per key: voxels sampled, those at a junction, and their share."""
    forks = F.count_if(F.col("arms") >= 2)
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("n_samples"), forks.alias("junctions"), (forks / F.count(F.lit(1))).alias("junction_fraction"))
