"""Profile functions, voxel joins and detectors against NumPy."""

import numpy as np
import pytest
from plumbline.functions import profiles as pf
from plumbline.operators import ranks, surfaces, voxels
from plumbline.verbs import audit
from pyspark.sql import functions as F


def _smooth(v, sigma):
    reach = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(v, reach, "symmetric"), k / k.sum(), "valid")


def test_profile_functions(spark):
    offsets = np.arange(-20, 20.25, 0.5)
    rows = [(k, [float(x) for x in 10 * np.exp(-0.5 * ((offsets - c) / 1.5) ** 2) + 8 * np.exp(-0.5 * ((offsets - c - 12) / 1.5) ** 2)]) for k, c in enumerate((-3.25, 0.0, 2.4))]
    df = spark.createDataFrame(rows, "k int, profile array<double>").withColumn("curve", pf.smoothed(F.col("profile"), 2.0)).withColumn("along", pf.offsets(20, 0.5))
    got = df.select("k", "curve", "along", pf.peak_offset(F.col("curve"), F.col("along")).alias("peak"), pf.neighbour_ridges(F.col("curve"), F.col("along")).alias("n"), pf.winding_spacing(F.col("curve"), F.col("along")).alias("w")).collect()
    for r, (_, v), c in zip(got, rows, (-3.25, 0.0, 2.4), strict=True):
        assert r.along == pytest.approx(offsets)
        assert r.curve == pytest.approx(_smooth(np.array(v), 2.0))
        assert r.peak == pytest.approx(c, abs=0.2)
        assert r.n.spacing == pytest.approx(12, abs=0.6) and r.w == pytest.approx(12, abs=1.1)
        assert r.n.radius == pytest.approx(np.clip(abs(r.n.centre) + 0.45 * r.n.spacing, 3, 16))


def test_flat_profile_refuses(spark):
    df = spark.createDataFrame([([1.0] * 41,)], "p array<double>").select(pf.winding_spacing(F.col("p"), pf.offsets(10, 0.5)).alias("w"), pf.neighbour_ridges(F.col("p"), pf.offsets(10, 0.5)).alias("n"))
    r = df.first()
    assert np.isnan(r.w) and r.n.spacing is None and r.n.radius == 6.0


def _voxels(spark, a, name="v"):
    return spark.createDataFrame([(name, *map(int, at), float(a[tuple(at)])) for at in np.argwhere(a)], "volume string, z int, y int, x int, value double")


def test_trilinear(spark):
    rng = np.random.default_rng(2)
    a = rng.random((6, 7, 8)) + 1
    points = [(k, "v", *map(float, p)) for k, p in enumerate(rng.random((40, 3)) * [7, 8, 9] - 1)]
    df = spark.createDataFrame(points, "pid int, volume string, z double, y double, x double")
    got = {r.pid: r.sample for r in voxels.trilinear(df, _voxels(spark, a), "volume", "pid").collect()}
    clamped = {r.pid: r.sample for r in voxels.trilinear(df, _voxels(spark, a), "volume", "pid", outside="clamp", shape={"z": 6, "y": 7, "x": 8}).collect()}

    def at(p, pad):
        p = np.clip(p, 0, np.array(a.shape) - 1) if pad == "edge" else np.array(p)
        f = np.floor(p).astype(int)
        total = 0.0
        for d in np.ndindex(2, 2, 2):
            i = f + d
            if (i >= 0).all() and (i < a.shape).all():
                total += np.prod(np.where(d, p - f, 1 - p + f)) * a[tuple(i)]
        return total

    for k, _, *p in points:
        assert got[k] == pytest.approx(at(p, "zero")) and clamped[k] == pytest.approx(at(p, "edge"))


def test_erosion_and_components(spark):
    a = np.zeros((9, 12, 12), bool)
    a[2:7, 1:8, 1:8] = True
    a[8, 10, 10] = a[7, 11, 11] = True
    depth, left = np.zeros(a.shape, int), a.copy()
    while left.any():
        depth += left
        p = np.pad(left, 1, constant_values=True)
        left = left & p[2:, 1:-1, 1:-1] & p[:-2, 1:-1, 1:-1] & p[1:-1, 2:, 1:-1] & p[1:-1, :-2, 1:-1] & p[1:-1, 1:-1, 2:] & p[1:-1, 1:-1, :-2]
    v = _voxels(spark, a)
    got = {(r.z, r.y, r.x): r.depth for r in voxels.erosion_depth(v, "volume", {"z": 9, "y": 12, "x": 12}, bulk=1.0).collect()}
    assert got == {tuple(map(int, at)): int(depth[tuple(at)]) for at in np.argwhere(a)}
    labelled = voxels.components(v, "volume")
    assert labelled.select("component").distinct().count() == 2
    flat = voxels.planarity(voxels.components(_voxels(spark, np.ones((1, 9, 9))), "volume"), "volume").first()
    assert flat.planarity == pytest.approx(0.0) and flat.e1 == pytest.approx(20 / 3 * 81 / 80, rel=1e-6)


def test_full_volumes_are_dealt_to_blocks_once(spark, monkeypatch):
    """Four erosions are one pass, so a volume that stops at the probe is dealt once (four times before)."""
    dealt, deal = [], voxels.blocks.blocks
    monkeypatch.setattr(voxels.blocks, "blocks", lambda *a, **k: dealt.append(1) or deal(*a, **k))
    full = voxels.erosion_depth(_voxels(spark, np.ones((40, 6, 6))), "volume", {"z": 40, "y": 6, "x": 6})
    assert {(r.depth, r.standing) for r in full.collect()} == {(4, True)} and len(dealt) == 1


def test_planarity_is_the_least_share_of_the_trace(spark):
    rng = np.random.default_rng(8)
    bent = np.zeros((14, 14, 14), bool)
    bent[3:5, 1:13, 2:11] = True
    bent[3:9, 1:3, 2:11] = True
    ball = sum((i - 6) ** 2 for i in np.indices((14, 14, 14))) <= 25
    specks = rng.random((14, 14, 14)) < 0.004
    for a in (bent, ball, specks):
        labelled = voxels.components(_voxels(spark, a), "volume")
        want = []
        for r in labelled.groupBy("component").agg(F.collect_list(F.array("z", "y", "x")).alias("p")).collect():
            if len(r.p) >= 64:
                e = np.linalg.eigvalsh(np.cov(np.array(r.p, float), rowvar=False))
                want.append(e[0] / e.sum())
        got = sorted(r.planarity for r in voxels.planarity(labelled, "volume").collect())
        assert got == pytest.approx(sorted(want), abs=1e-9)
        s = voxels.planarity_summary(voxels.planarity(labelled, "volume"), "volume").collect()
        assert [(x.median_planarity, x.worst_planarity) for x in s] == ([(pytest.approx(np.median(want)), pytest.approx(max(want)))] if want else [])


def _ladder(mask, most, probe=4, bulk=0.5):
    depth, left, total = np.zeros(mask.shape, int), mask.copy(), mask.sum()
    for step in range(1, most + 1):
        depth[left] = step
        p = np.pad(left, 1, constant_values=True)
        left = left & p[2:, 1:-1, 1:-1] & p[:-2, 1:-1, 1:-1] & p[1:-1, 2:, 1:-1] & p[1:-1, :-2, 1:-1] & p[1:-1, 1:-1, 2:] & p[1:-1, 1:-1, :-2]
        if not left.any() or (step >= probe and left.sum() > bulk * total):
            break
    t = 2.0 * depth[mask]
    return [np.median(t), np.percentile(t, 95), t.max(), t.mean(), left.sum() / total]


def test_thickness_stops_at_bulk_and_counts_what_stands(spark):
    thin, bulk, deep = np.zeros((26, 26, 26), bool), np.zeros((26, 26, 26), bool), np.zeros((26, 26, 26), bool)
    thin[10:13] = True
    bulk[:, :, 1:] = True
    deep[2:24, 2:24, 2:24] = True
    rows = _voxels(spark, thin, "thin").union(_voxels(spark, bulk, "bulk")).union(_voxels(spark, deep, "deep"))
    for most in (24, 6):
        got = {r.volume: [r["median"], r.p95, r["max"], r["mean"], r.saturated] for r in voxels.thickness_stats(rows, "volume", dict.fromkeys("zyx", 26), most).collect()}
        for name, mask in (("thin", thin), ("bulk", bulk), ("deep", deep)):
            assert got[name] == pytest.approx(_ladder(mask, most)), (name, most)


def test_nearest_neighbours_are_complete(spark):
    rng = np.random.default_rng(9)
    clouds = {"even": rng.random((60, 3)) * 50, "far": np.r_[rng.random((50, 3)), [[900.0, -700.0, 3.0]], rng.random((9, 3)) * 4000], "few": rng.random((3, 3)), "same": np.ones((7, 3)), "flat": np.c_[np.zeros(40), rng.random((40, 2)) * 30]}
    rows = [(key, i, *map(float, p)) for key, c in clouds.items() for i, p in enumerate(c)]
    df = spark.createDataFrame(rows, "k string, id int, z double, y double, x double")
    got = {(r.k, r.id, r.turn): (r.neighbour, r.distance) for r in voxels.nearest_neighbours(df, "k", "id", 5).collect()}
    want = {}
    for key, c in clouds.items():
        d = np.sqrt(((c[:, None] - c) ** 2).sum(2))
        for i in range(len(c)):
            for turn, j in enumerate(sorted(range(len(c)), key=lambda j: (d[i, j], j))[:5], 1):
                want[key, i, turn] = (j, pytest.approx(d[i, j], abs=1e-9))
    assert got == want
    assert voxels.knn_edges(df, "k", "id", 2).where("k = 'few'").count() == 6
    seeds = df.where("id < 3").withColumn("name", F.concat("k", F.lit("-"), "id"))
    named = {(r.k, r.id): r.name for r in voxels.nearest_values(df, seeds.withColumnRenamed("id", "sid"), "k", "id", "sid", ["name"]).collect()}
    for key, c in clouds.items():
        d = np.sqrt(((c[:, None] - c[:3]) ** 2).sum(2))
        assert all(named[key, i] == f"{key}-{min(range(3), key=lambda j: (d[i, j], j))}" for i in range(len(c)))


def test_point_normals_are_the_direction_of_least_extent(spark):
    rng = np.random.default_rng(10)
    p = np.c_[rng.normal(0, 0.05, 120), rng.random((120, 2)) * 10] @ np.linalg.qr(rng.normal(size=(3, 3)))[0]
    df = spark.createDataFrame([("v", i, *map(float, q)) for i, q in enumerate(p)], "k string, id int, z double, y double, x double")
    d = ((p[:, None] - p) ** 2).sum(2)
    for r in voxels.point_normals(df, "k", "id", 12).collect():
        _, v = np.linalg.eigh(np.cov(p[np.argsort(d[r.id], kind="stable")[:12]], rowvar=False))
        assert abs(np.dot(v[:, 0], [r.nz, r.ny, r.nx])) == pytest.approx(1, abs=1e-6)


def _wrapped(depth=60, side=28):
    z = np.arange(depth)
    line = sum(120 * np.exp(-0.5 * ((z - c) / 2.0) ** 2) for c in range(6, depth, 16)) + 5
    return np.repeat(line, side * side).reshape(depth, side, side)


def test_seam_is_found_where_it_is_planted_and_only_there(spark):
    volume = _voxels(spark, _wrapped()).drop("volume")
    rows = []
    for r in range(12):
        for c in range(12):
            wobble = float(0.2 * np.sin(3.7 * r + 1.3 * c))
            rows.append(("clean", r, c, 22.0 + wobble, 2.0 * r + 2, 2.0 * c + 2, True))
            rows.append(("seam", r, c, (38.0 if c >= 6 else 22.0) + wobble, 2.0 * r + 2, 2.0 * c + 2, True))
            rows.append(("dark", r, c, 900.0, 2.0 * r + 2, 2.0 * c + 2, True))
    mesh = spark.createDataFrame(rows, "mesh string, r int, c int, z double, y double, x double, valid boolean")
    got = {r.mesh: r for r in surfaces.sheet_switches(mesh, volume).collect()}
    assert got["clean"].adequate and got["clean"].n_seams == 0
    assert got["clean"].winding_spacing == pytest.approx(16, abs=1)
    assert [(s.axis, s.line) for s in got["seam"].seams] == [(1, 5)]
    assert got["dark"].degenerate and got["dark"].n_seams == 0
    assert got["seam"].max_z > 5 > got["clean"].max_z


def test_alignment_finds_a_planted_offset(spark):
    rng = np.random.default_rng(4)
    z = np.arange(40)
    a = np.broadcast_to((40 + 140 * np.exp(-0.5 * ((z - 20) / 1.6) ** 2))[:, None, None], (40, 24, 24)) + rng.normal(0, 3, (40, 24, 24))
    points = [("v", k, 17.0, float(y), float(x), 1.0, 0.0, 0.0) for k, (y, x) in enumerate(np.ndindex(24, 24))]
    p = spark.createDataFrame(points, "volume string, pid int, z double, y double, x double, nz double, ny double, nx double")
    cells, summary = audit.align(_voxels(spark, a), p, (40, 24, 24), radius=8.0, cell=12, least=20)
    assert summary.first().median == pytest.approx(3.0, abs=0.3)
    r = summary.first()
    assert r.global_low <= r.global_offset_raw <= r.global_high and r.global_high - r.global_low < 0.5
    weak = audit.align(_voxels(spark, a), p, (40, 24, 24), radius=8.0, cell=12, least=20, least_snr=1000.0, resamples=0)[1].first()
    assert not weak.reliable and weak.global_offset is None and weak.global_offset_raw == pytest.approx(3.0, abs=0.3)
    auto = audit.align(_voxels(spark, a), p, (40, 24, 24), cell=12, least=20, resamples=0, naive=True)[1].first()
    assert auto.radius == 6.0 and np.isnan(auto.global_low) and auto.global_offset_raw == pytest.approx(3.0, abs=0.3) and auto.naive_abs_median == pytest.approx(3.0, abs=0.5)


def test_mad_floor_gives_zero_scores(spark):
    flat = spark.createDataFrame([("m", k, 1.0 if k else 50.0) for k in range(9)], "mesh string, line int, dip double")
    assert {r.z for r in ranks.line_scores(flat, ["mesh"], "line", "dip").collect()} == {0.0}
    few = spark.createDataFrame([("m", k, float(k * k)) for k in range(3)], "mesh string, line int, dip double")
    assert {r.z for r in ranks.line_scores(few, ["mesh"], "line", "dip").collect()} == {0.0}


def test_mann_whitney_and_auc(spark):
    rng = np.random.default_rng(6)
    rows = [("k", "a" if i < 30 else "b", float(v)) for i, v in enumerate(np.round(np.r_[rng.normal(0, 1, 30), rng.normal(0.7, 1, 40)], 1))]
    df = spark.createDataFrame(rows, "k string, g string, v double")
    a, b = ([v for _, g, v in rows if g == s] for s in "ab")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    got = ranks.mann_whitney_less(df, ["k"], F.col("g") == "a", "v").first()
    assert got.u == pytest.approx(u) and 0 < got.p < 0.05
    assert ranks.auc(df, ["k"], F.col("g") == "a", "v").first().auc == pytest.approx(1 - u / 1200)


def test_walk_for_the_next_winding_follows_the_grid_step(spark):
    steps = spark.createDataFrame([("a", 3.0), ("b", 10.0), ("c", 40.0)], "mesh string, grid_step double")
    for r in surfaces.walk_length(steps).withColumn("along", surfaces.along_walk()).collect():
        span = max(6 * {"a": 3, "b": 10, "c": 40}[r.mesh], 40.0)
        assert r.along == pytest.approx(np.arange(-span, span + 1.0, max(span / 120.0, 0.5)))


def _sheet_mesh(step=3.0, n=16):
    at = {(r, c): r * n + c for r in range(n) for c in range(n)}
    v = [("m", i, 22.0, step * r + 2, step * c + 2) for (r, c), i in at.items()]
    f = [("m", k, *t) for k, t in enumerate(t for r in range(n - 1) for c in range(n - 1) for t in ((at[r, c], at[r, c + 1], at[r + 1, c]), (at[r, c + 1], at[r + 1, c + 1], at[r + 1, c])))]
    return v, f


def test_seams_of_triangle_meshes(spark):
    volume = _voxels(spark, _wrapped(side=52)).drop("volume")
    v, f = _sheet_mesh()
    rng = np.random.default_rng(3)
    flat = [(m, i, z + float(rng.normal(0, 0.2)), y, x) for m, i, z, y, x in v]
    cut = [("cut", i, z + (16.0 if x > 24 else 0.0), y, x) for _, i, z, y, x in flat]
    nick = [("nick", i, z + (16.0 if x > 24 and 14 < y < 21 and x < 31 else 0.0), y, x) for _, i, z, y, x in flat]
    vertices = spark.createDataFrame(flat + cut + nick, "mesh string, v int, z double, y double, x double")
    faces = spark.createDataFrame(f + [("cut", *t[1:]) for t in f] + [("nick", *t[1:]) for t in f], "mesh string, f int, a int, b int, c int")
    got = {r.mesh: r for r in surfaces.triangle_switches(vertices, faces, volume).collect()}
    assert all(r.adequate and r.winding_spacing == pytest.approx(16, abs=1) for r in got.values())
    assert got["m"].n_seams == 0 and got["nick"].n_seams == 0 and got["nick"].max_z > 5
    assert got["cut"].n_seams == 1 and got["cut"].seams[0].span_fraction > 0.9
    assert got["cut"].edge_length == pytest.approx(3.0, abs=0.2)
    edges = surfaces.unique_edges(faces, ("mesh",)).where("mesh = 'cut'")
    dips = edges.withColumn("dip", F.when(F.col("u") < 6, 50.0).otherwise(F.col("v") % 7 * 0.1))
    own = vertices.where("mesh = 'cut'")
    r = surfaces.flagged_components(edges, dips, own, span=0.0).first()
    ends = {i for e in edges.where("u < 6").collect() for i in (e.u, e.v)}
    p = np.array([c[2:] for c in cut if c[1] in ends])
    q = np.array([c[2:] for c in cut])
    centred = p - p.mean(0)
    along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
    assert r.span_fraction == pytest.approx((along.max() - along.min()) / (q.max(0) - q.min(0)).max()) and r.n_vertices == len(ends)


def test_displaced_vertices_move_one_side(spark):
    v, f = _sheet_mesh(n=5)
    vertices, faces = spark.createDataFrame(v, "mesh string, v int, z double, y double, x double"), spark.createDataFrame(f, "mesh string, f int, a int, b int, c int")
    moved = {r.v: r.z for r in surfaces.displaced_vertices(vertices, surfaces.triangle_normals(vertices, faces), 7.0).collect()}
    ys = {i: y for _, i, _, y, _ in v}
    assert {i for i, z in moved.items() if abs(z - 22.0) > 1e-6} == {i for i, y in ys.items() if y > np.median(list(ys.values()))}
    assert {abs(round(z - 22.0, 6)) for z in moved.values()} == {0.0, 7.0}


def test_polarity_and_edge_dip(spark):
    df = spark.createDataFrame([([5.0, 5.0, 1.0, 1.0, 1.0, 5.0, 5.0], [9.0, 4.0, 6.0, 8.0]), ([1.0, 1.0, 5.0, 5.0, 5.0, 1.0, 1.0], [None, 4.0, 6.0])], "p array<double>, s array<double>")
    got = df.select(pf.polarity(F.col("p"), "auto").alias("auto"), pf.polarity(F.col("p"), "dark").alias("dark"), pf.edge_dip(F.col("s")).alias("dip")).collect()
    assert got[0].auto == [-5.0, -5.0, -1.0, -1.0, -1.0, -5.0, -5.0] and got[1].auto == [1.0, 1.0, 5.0, 5.0, 5.0, 1.0, 1.0]
    assert got[1].dark[2] == -5.0 and [r.dip for r in got] == [4.0, None]


def test_onsheet_verdicts_and_comparison(spark):
    rng = np.random.default_rng(12)
    rows = [(m, float(v), 0.5) for m, c in (("base", 20), ("good", 18), ("poor", 7), ("off", 2)) for v in rng.normal(c, 1, 40)]
    blocks = spark.createDataFrame(rows, "mesh string, range double, peak_offset double")
    got = {r.mesh: r for r in audit.onsheet(blocks, "base").collect()}
    assert {m: r.verdict for m, r in got.items()} == {"base": "ON SHEET", "good": "ON SHEET", "poor": "marginal", "off": "OFF SHEET"}
    ranges = np.array([v for m, v, _ in rows if m == "poor"])
    assert got["poor"]["median"] == pytest.approx(np.median(ranges)) and got["poor"].iqr_share == pytest.approx((np.percentile(ranges, 75) - np.percentile(ranges, 25)) / np.median(ranges))
    r = audit.compare(blocks, "poor", "good").first()
    assert r.p < 1e-6 and r.u == 0
    zero = spark.createDataFrame([("z", 0.0), ("z", 0.0), ("z", 0.0), ("z", 4.0)], "mesh string, range double")
    assert ranks.spread_summary(zero, ["mesh"], "range").first().iqr_share == pytest.approx(1.0 / 1e-9)


def test_bootstraps_of_medians_and_pairs(spark):
    rng = np.random.default_rng(14)
    v = rng.normal(5, 2, 300)
    df = spark.createDataFrame([("k", i, float(x), float(x + g)) for i, (x, g) in enumerate(zip(v, rng.normal(0.5, 1, 300)))] + [("k", 900, None, 1.0), ("few", 901, 1.0, 2.0)], "k string, id int, a double, b double")
    got = {r.k: r for r in ranks.bootstrap(df, ["k"], "id", "a", 400, "median").collect()}
    boot = [np.median(rng.choice(v, 300)) for _ in range(2000)]
    assert got["k"].estimate == pytest.approx(np.median(v)) and [got["k"].low, got["k"].high] == pytest.approx(np.percentile(boot, [2.5, 97.5]), abs=0.15)
    assert got["few"].low is None
    r = {x.k: x for x in ranks.paired_bootstrap(df, ["k"], "id", "a", "b", 400).collect()}["k"]
    assert r.n == 300 and 0.2 < r.low < r.estimate < r.high < 0.8 and r.excludes_zero
    whole = ranks.bootstrap(df.where("k = 'k'"), [], "id", "a", 100).first()
    assert whole.low < np.mean(v) < whole.high


def test_medians_of_resamples_are_found_in_ranges(spark, monkeypatch):
    """Ties, constant keys, NaN, one or two rows: the medians are those of weighted percentiles."""
    monkeypatch.setattr(ranks, "RANGE_ROWS", 40)
    rng = np.random.default_rng(15)
    rows = [(k, i, float(x) + 0.0) for k, values in {"even": rng.normal(0, 3, 201).round(1), "same": np.full(90, 2.5), "two": [1.0, 4.0], "one": [7.0], "far": [*rng.normal(1e6, 1, 60), np.nan, np.nan]}.items() for i, x in enumerate(values)]
    df = spark.createDataFrame([*rows, ("even", 900, None), ("none", 901, None)], "k string, id long, v double")
    values = df.where("v is not null").select("k", F.col("id").alias("__id"), F.col("v").alias("__v"))
    got = ranks._resampled_medians(values, ["k"], 30)
    want = ranks._resampled(values, -1, 30).groupBy("k", "__b").agg(F.percentile("__v", F.lit(0.5), F.col("__w")).alias("__s"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("k", "__b", "__s").collect()))
    read = []
    monkeypatch.setattr(ranks, "written", lambda frame, tag, write=ranks.written: read.append((tag, frame.count())) or write(frame, tag))
    found = {r.k: r for r in ranks.bootstrap(df, ["k"], "id", "v", 30, "median").collect()}
    assert found["even"].n == 201 and found["even"].estimate == np.median([v for k, _, v in rows if k == "even"]) and found["two"].low is None and "none" not in found
    assert [tag for tag, _ in read] == ["ranges", "middles", "medians"] and read[1][1] <= 2 * read[2][1]


def test_normals_turn_to_the_brighter_side(spark):
    volume = _voxels(spark, np.broadcast_to((np.arange(20) + 1.0)[:, None, None], (20, 8, 8)))
    points = spark.createDataFrame([("v", k, 10.0, float(k), 4.0, s, 0.0, 0.0) for k, s in enumerate((-1.0, -1.0, 1.0, -1.0))], "volume string, pid int, z double, y double, x double, nz double, ny double, nx double")
    assert [r.nz for r in surfaces.oriented(points, volume, ["volume"]).orderBy("pid").collect()] == [1.0, 1.0, -1.0, 1.0]
    field = points.select("volume", "pid", F.lit(1.0).alias("gz"), F.lit(0.0).alias("gy"), F.lit(0.0).alias("gx"))
    assert [r.nz for r in surfaces.oriented_by(points, field, ["volume"]).orderBy("pid").collect()] == [1.0, 1.0, -1.0, 1.0]


def test_interpolation_and_naive_alignment(spark):
    xs, ys = [0.0, 1.0, 4.0, 6.0], [2.0, 5.0, -1.0, 3.0]
    at = [-1.0, 0.0, 0.25, 1.0, 3.9, 6.0, 8.0]
    df = spark.createDataFrame([(x, xs, ys) for x in at], "x double, xs array<double>, ys array<double>")
    assert [r.v for r in df.select(pf.interpolated(F.col("x"), F.col("xs"), F.col("ys")).alias("v")).collect()] == pytest.approx(list(np.interp(at, xs, ys)))
    offsets = np.arange(-6, 6.25, 0.5)
    rows = spark.createDataFrame([("v", [float(x) for x in np.exp(-0.5 * (offsets - c) ** 2)]) for c in (-2.0, 1.0, 1.5)], "volume string, profile array<double>")
    r = surfaces.naive_alignment(rows, "volume", 6, 0.5).first()
    assert (r.n, r["median"], r.abs_median) == (3, pytest.approx(1.0, abs=0.02), pytest.approx(1.5, abs=0.02))
    assert (r.unresolved_share, r.share_2, r["mean"]) == (0.0, pytest.approx(1 / 3), pytest.approx(1 / 6, abs=0.02))
    edge = spark.createDataFrame([("v", [float(x) for x in np.exp(-0.5 * (offsets - c) ** 2)]) for c in (1.0, 5.9)], "volume string, profile array<double>")
    r = surfaces.naive_alignment(edge, "volume", 6, 0.5).first()
    assert r.unresolved_share == 0.5 and r["mean"] == pytest.approx(1.0, abs=0.02)


def test_samples_of_walks_are_no_rows(spark, monkeypatch):
    """Edges and normals meet the volume by lists of walks; before, each sample was a row of ``trilinear``."""
    monkeypatch.setattr(surfaces, "trilinear", None)
    volume = spark.createDataFrame([(z, 0, 0, float(z)) for z in range(40)], "z int, y int, x int, value double")
    edges = spark.createDataFrame([(1, 2.0, 0.0, 0.0, 34.0, 0.0, 0.0), (2, 90.0, 0.0, 0.0, 99.0, 0.0, 0.0)], "id int, az double, ay double, ax double, bz double, by double, bx double")
    assert {(r.id, r.dip) for r in surfaces.edge_dips(edges, volume, ["id"]).collect()} == {(1, 2.0 - 4.0), (2, 0.0)}


def test_walks_make_only_the_samples_of_their_block(monkeypatch):
    """Before, each walk of a list made all of its samples, however few lie in the block."""
    from plumbline.operators import blocks

    rng = np.random.default_rng(16)
    made, samples = [], blocks._samples
    monkeypatch.setattr(blocks, "MOST_SAMPLES", 64)
    monkeypatch.setattr(blocks, "_samples", lambda *a: (made.append(len(w)) or (w, i) for w, i in samples(*a)))
    o, d = list(rng.integers(-8, 40, (3, 90)) / 2.0), list(rng.choice([0.0, 0.5, -0.3, 1e-17, 1.0], (3, 90)))
    n, first, gap, block, dense = 241, -60.0, 0.5, np.array([0, 1, 0]), rng.random((18, 18, 18))
    w, i, got = blocks.walk_samples(o, d, n, first, gap, block, dense)
    at = [a[:, None] + b[:, None] * (first + np.arange(n) * gap) for a, b in zip(o, d, strict=True)]
    here = np.logical_and.reduce([np.floor(x / 16) == b for x, b in zip(at, block, strict=True)])
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == set(map(tuple, np.argwhere(here).tolist())) and len(w) == here.sum()
    for k, j, s in zip(w, i, got, strict=True):
        p = [x[k, j] - 16 * b + 1 for x, b in zip(at, block, strict=True)]
        f = [int(np.floor(x)) for x in p]
        assert s == pytest.approx(sum(np.prod([x - g if e else 1 - x + g for x, g, e in zip(p, f, c, strict=True)]) * dense[tuple(g + e for g, e in zip(f, c, strict=True))] for c in np.ndindex(2, 2, 2)))
    assert sum(made) <= here.sum() + 4 * 90 and max(made) <= 64 + n < here.size


def test_sums_of_walks_are_made_once(spark, monkeypatch):
    """An explode that asks for the size of the results made them twice."""
    plans, write = [], surfaces.written
    monkeypatch.setattr(surfaces, "written", lambda df, tag: plans.append((tag, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, tag))
    volume = spark.createDataFrame([(z, 0, 0, float(z)) for z in range(40)], "z int, y int, x int, value double")
    facing = spark.createDataFrame([("m", 20.0, 0.0, 0.0, 1.0, 0.0, 0.0), ("m", 10.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "mesh string, z double, y double, x double, nz double, ny double, nx double")
    walks = surfaces.walk_length(spark.createDataFrame([("m", 1.0)], "mesh string, grid_step double"))
    r = surfaces.spacing_profiles(facing, volume, walks).first()
    along = np.arange(len(r.profile)) * 0.5 - 40.0
    ramp = lambda p: np.where((p >= 0) & (p <= 39), p, np.where((p > 39) & (p < 40), 39 * (40 - p), 0.0))
    assert r.n == 2 and r.profile == pytest.approx(list((ramp(20 + along) + ramp(10 + along)) / 2))
    assert [p.count("ArrowEvalPython") for tag, p in plans if tag == "walk-sums"] == [1]


def test_depths_have_no_bound(spark):
    """Exact to the last voxel; before, peeling stopped after 24 erosions, or where half of a volume stood after four."""
    rng = np.random.default_rng(17)
    deep, holes = np.ones((64, 4, 3), bool), rng.random((9, 10, 11)) < 0.97
    deep[0, 1, 1] = False
    masks = {"deep": deep, "holes": holes, "full": np.ones((5, 6, 4), bool)}
    rows = [(f"{n}|{'|'.join(map(str, a.shape))}", *map(int, at)) for n, a in masks.items() for at in np.argwhere(a)] + [("holes|9|10|11", 9, 0, 0), ("holes|9|10|11", 0, 0, 0)]
    df = spark.createDataFrame(rows, "volume string, z int, y int, x int")
    sides = {a: F.split_part("volume", F.lit("|"), F.lit(k)).cast("int") for k, a in enumerate("zyx", 2)}
    got = {(r.volume.split("|")[0], r.z, r.y, r.x): (r.depth, r.standing) for r in voxels.erosion_depth(df, "volume", sides, None).collect()}
    holes[0, 0, 0] = True
    for n, a in masks.items():
        out = np.argwhere(~a)
        for at in np.argwhere(a):
            want = (int(np.abs(out - at).sum(1).min()), False) if len(out) else (None, True)
            assert got.pop((n, *map(int, at))) == want
    assert got == {("holes", 9, 0, 0): (None, True)}
    stats = {r.volume.split("|")[0]: r for r in voxels.thickness_stats(df, "volume", sides).collect()}
    assert stats["deep"]["max"] > 2 * 24 and stats["deep"].saturated == 0.0 and (stats["full"]["median"], stats["full"].saturated) == (None, 1.0)
    assert {r.standing for r in voxels.erosion_depth(df.where("volume like 'deep%'"), "volume", sides).collect()} == {True, False}  # the ladder takes sizes from columns too


@pytest.mark.parametrize("steps", [voxels.ALL_AROUND, voxels.FACES])
def test_components_are_pairs_of_blocks_only_where_blocks_meet(spark, monkeypatch, steps):
    """Sets of many blocks are whole, and edges are pairs of blocks' sets; before, every pair of neighbouring voxels was an edge."""
    rng = np.random.default_rng(18)
    a, b = rng.random((13, 11, 17)) < (0.12 if len(steps) > 6 else 0.35), np.ones((12, 12, 12), bool)
    rows = [(n, *(int(x) - 5 for x in at)) for n, m in (("a", a), ("b", b)) for at in np.argwhere(m)]
    df = spark.createDataFrame([*rows, rows[0]], "volume string, z int, y int, x int")
    edges, run = [], voxels.connected_components
    monkeypatch.setattr(voxels, "connected_components", lambda e: edges.append(e.count()) or run(e))
    left, want = set(rows), {}
    for first in sorted(rows):
        todo = [first] if first in left else []
        while todo:
            at = todo.pop()
            if at in left:
                left.remove(at)
                want[at] = ",".join(map(str, first))
                todo += [(at[0], at[1] + d[0], at[2] + d[1], at[3] + d[2]) for d in steps]
    for side in (4, voxels.PASS_SIDE):
        got = [(tuple(r[:4]), r[4]) for r in voxels.components(df, "volume", steps, side).select("volume", *"zyx", "component").collect()]
        assert len(got) == len(want) and dict(got) == want
    assert edges[1] < edges[0] < len(want)
