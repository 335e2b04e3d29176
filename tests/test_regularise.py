"""Regularising a wobbling label, the field of corrections, and the stack writer."""

import os

import numpy as np
import pytest
from plumbline.operators import resampling, warp
from plumbline.sources import stacks, tiff
from plumbline.verbs import audit
from pyspark.sql import functions as F


def voxels(spark, a, name="v"):
    rows = [(name, *map(int, p), float(a[tuple(p)])) for p in np.argwhere(np.ones_like(a))]
    return spark.createDataFrame(rows, "volume string, z int, y int, x int, value double")




def plain_field(shape, deltas, cell, smooth):
    """Blur over measured cells with the ends going on, faces filled, middles interpolated: by plain loops."""
    n = [int(np.ceil(s / cell)) for s in shape]
    grid, known = np.zeros(n), np.zeros(n, bool)
    for k, d in deltas.items():
        grid[k], known[k] = d, True
    reach = int(4 * smooth + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / smooth) ** 2)
    num, den = grid * known, known.astype(float)
    for axis in range(3):
        pick = lambda a, k: np.take(a, np.clip(np.arange(n[axis]) + k, 0, n[axis] - 1), axis)  # noqa: B023, E731
        num, den = (sum(wk * pick(a, k) for k, wk in zip(range(-reach, reach + 1), w, strict=True)) for a in (num, den))
    soft = np.where(den > 1e-9, num / np.maximum(den, 1e-9), 0)
    near = known.copy()
    for axis in range(3):
        for s in (1, -1):
            moved = np.roll(known, s, axis)
            edge = [slice(None)] * 3
            edge[axis] = 0 if s == 1 else -1
            moved[tuple(edge)] = False
            near |= moved
    soft[~near] = 0
    out = np.zeros(shape)
    for p in np.ndindex(*shape):
        u = [min(max((c + 0.5) / cell - 0.5, 0), m - 1) for c, m in zip(p, n, strict=True)]
        f = [min(int(c), m - 2) if m > 1 else 0 for c, m in zip(u, n, strict=True)]
        for d in np.ndindex(2, 2, 2):
            i = tuple(min(a + b, m - 1) for a, b, m in zip(f, d, n, strict=True))
            out[p] += soft[i] * np.prod([c - a if b else 1 - c + a for c, a, b in zip(u, f, d, strict=True)])
    return out


def test_the_field_is_the_plain_one(spark):
    shape, cell = (10, 14, 9), 4
    deltas = {(0, 0, 0): 1.5, (0, 1, 0): -0.5, (2, 3, 2): 2.0}
    cells = spark.createDataFrame([("v", *k, d + 1.0, "ok") for k, d in deltas.items()] + [("v", 1, 1, 1, 9.0, "low_snr")], "volume string, cz int, cy int, cx int, offset double, status string")
    summary = spark.createDataFrame([("v", 1.0)], "volume string, global_offset_raw double")
    want = plain_field(shape, deltas, cell, 0.5)
    points = spark.createDataFrame([("v", ",".join(map(str, p)), *map(int, p)) for p in np.ndindex(*shape)], "volume string, pid string, z int, y int, x int")
    got = warp.field_at(points, warp.delta_cells(cells, summary, shape, cell), shape, cell, "pid").collect()
    assert len(got) == np.prod(shape)
    for r in got:
        assert r.shift == pytest.approx(want[tuple(map(int, r.pid.split(",")))], abs=1e-9)


def test_a_wobble_shrinks_and_an_unreliable_volume_stays(spark):
    rng = np.random.default_rng(8)
    z = np.arange(32)
    scan = np.broadcast_to((40 + 140 * np.exp(-0.5 * ((z - 16) / 1.6) ** 2))[:, None, None], (32, 36, 12)) + rng.normal(0, 3, (32, 36, 12))
    label = np.full((36, 12), 14)
    label[12:24] = 17  # the ridge is at 16: offsets 2, -1, 2
    rows = [("v", int(label[y, x]), y, x) for y, x in np.ndindex(36, 12)]
    df = spark.createDataFrame(rows, "volume string, z int, y int, x int")
    image = voxels(spark, scan)
    up = df.select("volume", F.concat_ws(",", "z", "y", "x").alias("pid"), *[F.col(a).cast("double").alias(a) for a in "zyx"], F.lit(1.0).alias("nz"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("nx"))
    cells, summary = audit.align(image, up, (32, 36, 12), 6.0, cell=12, least=20, resamples=0)
    new, report = audit.regularise(up, cells, summary, (32, 36, 12), 12)
    r = report.first()
    assert r.changed and r.reason is None and r.max_abs_shift > 1 and r.voxels_before == 432
    after = {}
    for v in new.collect():
        after.setdefault(v.y, []).append(v.z)
    middle = [np.mean(after[y]) for y in range(15, 21)]
    ends = [np.mean(after[y]) for y in (0, 1, 2, 33, 34, 35)]
    assert abs(np.mean(middle) - np.mean(ends)) < 0.7 * 3
    for gate, reason in ((F.lit(False), "global offset unreliable"), (F.lit(True), "no resolved cells")):
        some = cells if reason.startswith("global") else cells.limit(0)
        new, report = audit.regularise(up, some, summary.withColumn("reliable", gate), (32, 36, 12), 12)
        assert report.first().reason == reason and not report.first().changed
        assert {tuple(x) for x in new.collect()} == set(rows)


def test_label_points_face_the_brighter_side(spark):
    z = np.arange(24)
    scan = np.broadcast_to((z * 3.0)[:, None, None], (24, 12, 12))
    df = spark.createDataFrame([("v", 10 + y // 4, y, x) for y in range(12) for x in range(12)], "volume string, z int, y int, x int")
    got = audit.label_points(df, voxels(spark, scan), 12, 6).collect()
    assert len(got) == 144 and all(r.nz > 0 for r in got) and len({r.component for r in got}) == 1


def test_peak_interval_is_that_of_the_same_weights(spark):
    from plumbline.functions import profiles as pf

    rng = np.random.default_rng(9)
    offsets = np.arange(-6, 6.25, 0.5)
    rows = [("k", i, [float(v) for v in np.exp(-0.5 * ((offsets - 1.5) / 1.2) ** 2) + rng.normal(0, 1.5, len(offsets))]) for i in range(200)]
    df = spark.createDataFrame(rows, "volume string, pid long, profile array<double>").repartition(3)
    got = resampling.peak_bootstrap(df, "volume", "pid", "profile", pf.offsets(6.0, 0.5), 1.0, 40).first()
    ids = np.array([r.h for r in df.select("pid", F.xxhash64("pid").alias("h")).orderBy("pid").collect()])
    w = resampling.weights(ids.view(np.uint64), 40)
    assert 0.9 < w.mean() < 1.1 and (w.sum(0) > 0).all()
    curves = (w.T @ np.array([r[2] for r in rows])) / w.sum(0)[:, None]
    each = spark.createDataFrame([(b, [float(x) for x in c]) for b, c in enumerate(curves)], "b int, curve array<double>")
    peaks = [r.p for r in each.select(pf.peak_offset(pf.smoothed(F.col("curve"), 1.0), pf.offsets(6.0, 0.5)).alias("p")).collect()]
    assert [got.low, got.high] == pytest.approx(np.percentile(peaks, [2.5, 97.5]))
    none = resampling.peak_bootstrap(df, "volume", "pid", "profile", pf.offsets(6.0, 0.5), 1.0, 0).first()
    assert np.isnan(none.low) and np.isnan(none.high)


def test_stacks_come_back_and_a_failed_task_leaves_none(spark, tmp_path):
    rng = np.random.default_rng(10)
    a = rng.integers(0, 3, (5, 6, 7))
    df = voxels(spark, a.astype(float)).where("value > 0").union(voxels(spark, a[:1].astype(float), "w").where("value > 0"))
    shapes = spark.createDataFrame([("v", 5, 6, 7), ("w", 2, 6, 7), ("empty", 1, 2, 2)], "volume string, n_pages int, height int, width int")
    folder = str(tmp_path / "labels")
    stacks.write_stacks(stacks.pages(df, shapes), folder)
    assert sorted(os.listdir(folder)) == ["empty.tif", "v.tif", "w.tif"]
    back = tiff.voxels(tiff.volume_planes(spark, folder))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    pages = stacks.pages(df, shapes).withColumn("dtype", F.when((F.col("volume") == "w") & (F.col("z") == 1), "no such type").otherwise(F.col("dtype")))
    other = str(tmp_path / "failed")
    with pytest.raises(Exception):  # noqa: B017
        stacks.write_stacks(pages, other)
    assert not [f for f in os.listdir(other) if f.endswith(".tif")]
