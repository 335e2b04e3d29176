"""Blocks with a halo, exact distances, junctions: against dense arrays."""

from itertools import product

import numpy as np
import pytest
from plumbline.operators import blocks, morphology, voxels
from pyspark.sql import functions as F


def table(spark, mask, name="v"):
    return spark.createDataFrame([(name, *map(int, p)) for p in np.argwhere(mask)], "volume string, z int, y int, x int")


def test_envelope_is_the_least_over_all_sites():
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 40):
        f = np.where(rng.random(n) < 0.4, np.inf, rng.integers(0, 60, n)).astype(float)
        p = np.arange(n)
        want = (f[None] + (p[:, None] - p[None]) ** 2).min(1) if n else f
        assert morphology.envelope(f) == pytest.approx(want)


def test_distances_are_exact(spark):
    rng = np.random.default_rng(2)
    mask = rng.random((9, 20, 13)) < 0.9
    mask[2:8, 3:15, 2:9] = True
    full = np.ones((9, 20, 13), bool)
    df = table(spark, mask).union(table(spark, full, "full"))
    got = morphology.background_distance(df, "volume", {"z": 9, "y": 20, "x": 13}).collect()
    outside = np.argwhere(~mask)
    for r in got:
        if r.volume == "full":
            assert r.distance == np.inf
        else:
            assert r.distance == pytest.approx(np.sqrt(((outside - [r.z, r.y, r.x]) ** 2).sum(1)).min())
    assert len(got) == mask.sum() + full.size
    assert morphology.distance_stats(morphology.background_distance(df, "volume", {"z": 9, "y": 20, "x": 13}), "volume").count() == 2


def plain_arms(mask, at, radius):
    grid = {d: sum(c * c for c in d) ** 0.5 for d in product(range(-radius, radius + 1), repeat=3)}
    ball = {d for d, far in grid.items() if far <= radius + 0.5 and all(0 <= a + c < s for a, c, s in zip(at, d, mask.shape, strict=True)) and mask[tuple(np.add(at, d))]}

    def piece(seed, among):
        out, open_ = set(), [seed]
        while open_:
            d = open_.pop()
            if d in out:
                continue
            out.add(d)
            open_ += [n for s in product((-1, 0, 1), repeat=3) if (n := tuple(np.add(d, s))) in among and n not in out]
        return out

    home = piece((0, 0, 0), ball)
    shell = {d for d in home if grid[d] >= radius - 0.5}
    n = 0
    while shell:
        shell -= piece(next(iter(shell)), shell)
        n += 1
    return n


def test_junctions_of_a_fork_and_of_near_sheets(spark):
    size = 30
    fork = np.zeros((size, size, size), bool)
    fork[15, :, :15] = True
    for k in range(15):
        fork[min(15 + k, 29), :, 15 + k // 1 if 15 + k < 30 else 29] = True
        fork[max(15 - k, 0), :, 15 + k if 15 + k < 30 else 29] = True
    near = np.zeros((size, size, size), bool)
    near[12], near[16] = True, True
    for name, mask in (("fork", fork), ("near", near)):
        found = morphology.junctions(table(spark, mask, name), "volume", 5, None).collect()
        assert len(found) == mask.sum()
        rng = np.random.default_rng(3)
        for k in rng.choice(len(found), 40, replace=False):
            r = found[k]
            assert r.arms == plain_arms(mask, (r.z, r.y, r.x), 5)
    some = morphology.junctions(table(spark, fork, "fork").union(table(spark, near, "near")), "volume", 5, 100)
    got = {r.volume: r for r in morphology.junction_density(some, "volume").collect()}
    assert got["fork"].n_samples == got["near"].n_samples == 100
    assert got["fork"].junction_fraction > 0.2 and got["near"].junction_fraction < 0.03  # a corner of the volume cuts a shell in two


@pytest.mark.parametrize("side,halo", [(16, 1), (4, 1), (5, 5), (8, 4)])
def test_blocks_hold_their_halo(spark, side, halo):
    rng = np.random.default_rng(4)
    a = rng.random((11, 9, 14))
    a[rng.random(a.shape) < 0.5] = np.nan
    rows = [("v", *map(int, p), float(a[tuple(p)])) for p in np.argwhere(~np.isnan(a))]
    df = spark.createDataFrame(rows, "volume string, z int, y int, x int, value double")
    wide = np.pad(a, side + halo, constant_values=np.nan)
    for r in blocks.blocks(df, "volume", "value", side, halo).collect():
        low = [b * side + side for b in (r.bz, r.by, r.bx)]
        n = side + 2 * halo
        part = wide[tuple(slice(c, c + n) for c in low)]
        pad = np.full((n, n, n), np.nan)
        pad[tuple(slice(0, s) for s in part.shape)] = part
        np.testing.assert_array_equal(blocks.cube(np.array(r.at), np.array(r.v), n), pad)


def test_samples_in_blocks_are_the_joined_ones(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_POINTS", 40)
    rng = np.random.default_rng(5)
    a = rng.random((20, 20, 20))
    df = spark.createDataFrame([("v", *map(int, p), float(a[tuple(p)])) for p in np.argwhere(a > 0.3)], "volume string, z int, y int, x int, value double")
    points = [("v", k, *map(float, p)) for k, p in enumerate(rng.random((300, 3)) * 26 - 3)] + [("none", 1, 1.0, 1.0, 1.0), ("v", 7, 5.0, 5.0, 5.0), ("v", 7, 5.0, 5.0, 5.0)]
    p = spark.createDataFrame(points, "volume string, pid int, z double, y double, x double")
    got = blocks.trilinear(p, blocks.blocks(df, "volume"), "volume", "pid").collect()
    assert len(got) == len(points)
    want = {}
    a = np.where(a > 0.3, a, 0)
    for v, k, *at in points:
        total = 0.0
        f = np.floor(at).astype(int)
        for d in product((0, 1), repeat=3):
            c = f + d
            if v == "v" and (c >= 0).all() and (c < 20).all():
                total += a[tuple(c)] * np.prod([t - i if s else 1 - t + i for t, i, s in zip(at, f, d, strict=True)])
        want.setdefault((v, k), set()).add(round(total, 9))
    for r in got:
        assert round(r.sample, 9) in {y for x in want[r.volume, r.pid] for y in (x, round(x + 1e-9, 9), round(x - 1e-9, 9))}


def test_erosion_in_blocks(spark):
    rng = np.random.default_rng(6)
    mask = rng.random((18, 20, 17)) < 0.85
    shape = {"z": 18, "y": 20, "x": 17}
    df = table(spark, mask)
    wide = np.pad(mask, 1, constant_values=True)
    want = mask.copy()
    for a in range(3):
        for s in (-1, 1):
            want &= np.roll(wide, s, a)[1:-1, 1:-1, 1:-1]
    assert {(r.z, r.y, r.x) for r in voxels.eroded(df, "volume", shape).collect()} == set(map(tuple, np.argwhere(want).tolist()))
    assert voxels.eroded(df.where(F.lit(False)), "volume", shape).count() == 0


def test_rank_sum_tails_are_counted():
    from itertools import combinations

    from plumbline.operators import ranks

    for n1, n2 in ((1, 1), (2, 3), (4, 4), (5, 3), (1, 9)):
        sums = [sum(c) - n1 * (n1 - 1) // 2 for c in combinations(range(n1 + n2), n1)]
        for u in range(-1, n1 * n2 + 2):
            assert ranks.lower_tail(n1, n2, u) == pytest.approx(np.mean([s <= u for s in sums])), (n1, n2, u)
    assert 0.49 < ranks.lower_tail(8, 5000, 20_000) < 0.51


def test_exact_and_normal_p(spark):
    from itertools import combinations

    from plumbline.operators import ranks

    rng = np.random.default_rng(11)
    rows = [("small", i < 5, float(v)) for i, v in enumerate(rng.permutation(14))] + [("tied", i < 5, float(v)) for i, v in enumerate([1, 1, 2, 3, 4, 5, 6, 7, 8])] + [("large", i < 20, float(v)) for i, v in enumerate(rng.random(50))] + [("empty", True, 1.0)]
    df = spark.createDataFrame(rows, "k string, g boolean, v double")
    got = {r.k: r for r in ranks.mann_whitney_less(df, ["k"], F.col("g"), "v").collect()}
    assert {k for k, r in got.items() if r.exact} == {"small"}
    own = [sum(c) - 10 for c in combinations(range(14), 5)]
    assert got["small"].p == pytest.approx(np.mean([s <= got["small"].u for s in own]))
    assert got["empty"].p == 1.0 and 0 < got["large"].p < 1


def test_cross_sections_step_along_the_arc(spark):
    from plumbline.operators import surfaces

    rows = [("m", 0, c, 10.0 + (3.0 * max(c - 5, 0)), 4.0, 4.0 * min(c, 5) + 2.0, 1.0, 0.0, 0.0, True) for c in range(10)] + [("m", 1, c, 1.0, 1.0, float(c), 1.0, 0.0, 0.0, True) for c in range(5)]
    mesh = spark.createDataFrame(rows, "mesh string, r int, c int, z double, y double, x double, nz double, ny double, nx double, valid boolean")
    placed = surfaces.strip_places(mesh, ["mesh", "r"], "c", ["z", "x"], 1.0).orderBy("r", "i").collect()
    total = 5 * 4.0 + 4 * 3.0
    assert {r.r for r in placed} == {0} and [r.i for r in placed] == list(range(32))
    want = np.linspace(0, total, 32)
    assert [r.arc for r in placed] == pytest.approx(list(want))
    assert [r.z for r in placed] == pytest.approx([10 + max(w - 20, 0) for w in want]) and [r.x for r in placed] == pytest.approx([2 + min(w, 20) for w in want])
    volume = spark.createDataFrame([("m", z, 4, x, float(z)) for z in range(0, 40) for x in range(0, 30)], "mesh string, z int, y int, x int, value double")
    got = surfaces.cross_sections(mesh, volume, 2.0).collect()
    assert len(got) == 32 * 5
    for r in got:
        assert r.sample == pytest.approx(placed[r.i].z + r.depth)
