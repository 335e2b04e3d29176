"""Spanning signs against Prim, nearest foreign points against all distances, normals of folded sheets."""

import numpy as np
import pytest
from plumbline.operators import orientation
from pyspark.sql import functions as F


def prim(n, edges):
    """Signs along the minimum spanning forest; edges of equal weight go by their ends."""
    around = {}
    for w, a, b, f in edges:
        around.setdefault(a, []).append((w, min(a, b), max(a, b), b, f))
        around.setdefault(b, []).append((w, min(a, b), max(a, b), a, f))
    sign, root = {}, {}
    for seed in range(n):
        if seed in sign or seed not in around:
            continue
        sign[seed], root[seed] = 1.0, seed
        open_ = [(e, seed) for e in around[seed]]
        while open_:
            (w, lo, hi, to, f), at = min(open_)
            open_.remove(((w, lo, hi, to, f), at))
            if to in sign:
                continue
            sign[to], root[to] = sign[at] * (-1 if f else 1), seed
            open_ += [(e, to) for e in around[to]]
    return {(k, root[k], sign[k]) for k in sign}


def test_spanning_signs_are_those_of_prim(spark):
    rng = np.random.default_rng(3)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 500, (1100, 2)).tolist() if a != b and (a < 400) == (b < 400)}
    edges = [(round(float(w), 1), a, b, bool(f)) for (a, b), w, f in zip(sorted(pairs), rng.random(len(pairs)), rng.integers(0, 2, len(pairs)), strict=True)]
    df = spark.createDataFrame(edges, "weight double, a long, b long, flip boolean")
    got = {tuple(r) for r in orientation.spanning_signs(df.union(df.select("weight", "b", "a", "flip"))).collect()}
    assert got == prim(500, edges)
    assert orientation.spanning_signs(df.limit(0)).collect() == []


def test_edges_that_close_cycles_in_a_task_go_first(spark, monkeypatch):
    """Ties, parallel edges, missing and NaN weights: signs are those of nodes by name, which are not thinned."""
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), float(w), bool(f)) for (a, b), w, f in zip(rng.integers(0, 60, (3000, 2)), rng.integers(0, 9, 3000), rng.integers(0, 2, 3000), strict=True)]
    rows += [(70 + i, 71 + i, w, True) for i, w in enumerate([None, float("nan"), 0.0, -0.0, None])] + [(70, 75, float("nan"), False), (71, 75, None, False), (71, 75, None, True), (5, 5, 0.0, True), (None, 6, 0.0, True)]
    df = spark.createDataFrame(rows, "a long, b long, weight double, flip boolean").repartition(3, "weight")
    monkeypatch.setattr(orientation, "FOREST_EDGES", 400)
    links, write = [], orientation.written
    monkeypatch.setattr(orientation, "written", lambda frame, tag: links.append(frame.count()) or write(frame, tag) if tag == "links" else write(frame, tag))
    got = {tuple(r) for r in orientation.spanning_signs(df).collect()}
    assert links[0] < 500  # all pairs before: more than 1400
    named = df.withColumns({c: F.lpad(F.col(c).cast("string"), 4, "0") for c in "ab"})
    assert got == {(int(r.node), int(r.component), r.sign) for r in orientation.spanning_signs(named).collect()}


@pytest.mark.parametrize("kind", ["clusters", "sheets", "many", "ties"])
def test_nearest_foreign_points_are_those_of_all_distances(spark, kind):
    rng = np.random.default_rng(5)
    rows = []
    for key in ("u", "v"):
        if kind == "clusters":
            points = np.concatenate([rng.normal(rng.random(3) * 200, 3, (30, 3)) for _ in range(6)])
            groups = np.repeat(np.arange(6), 30)
        elif kind == "sheets":
            y, x = np.mgrid[0:12, 0:12]
            points = np.concatenate([np.stack([np.full(144, 14.0 * w), y.ravel(), x.ravel()], 1) for w in (0, 1, 3)])
            groups = np.repeat(np.arange(3), 144)
        elif kind == "many":
            points, groups = rng.random((200, 3)) * 50, np.arange(200)
        else:
            points, groups = np.zeros((9, 3)), np.repeat(np.arange(3), 3)
        rows += [(key, f"g{g}", k, *map(float, p)) for k, (g, p) in enumerate(zip(groups, points, strict=True))]
    rows += [("alone", "g", 1, 0.0, 0.0, 0.0), ("alone", "g", 2, 0.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "key string, g string, id long, z double, y double, x double")
    want = {}
    for key in ("u", "v"):
        mine = [r for r in rows if r[0] == key]
        p, g = np.array([r[3:] for r in mine]), np.array([r[1] for r in mine])
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
        d[g[:, None] == g[None]] = np.inf
        for name in set(g):
            own = np.flatnonzero(g == name)
            best = min((d[i].min(), mine[i][2], mine[int(np.argmin(d[i]))][2]) for i in own)
            want[key, name] = best
    got = {(r.key, r.g): (r.distance, r.a, r.b) for r in orientation.nearest_foreign(df, "key", "g", "id").collect()}
    assert got.keys() == want.keys()
    for k, (distance, a, b) in got.items():
        assert distance == pytest.approx(want[k][0]) and (a, b) == want[k][1:]


def test_normals_of_folded_sheets_agree(spark):
    """Two half cylinders, one inside the other: normals all point away from the axis, or all to it."""
    rng = np.random.default_rng(7)
    rows = []
    for radius in (20, 34):
        for t in np.linspace(0.05, 3.1, int(radius * 1.6)):
            for x in range(0, 12, 2):
                s = float(rng.choice([-1, 1]))
                rows.append(("v", len(rows), radius * np.sin(t), radius * np.cos(t), float(x), s * np.sin(t), s * np.cos(t), 0.0))
    df = spark.createDataFrame([(k, i, *map(float, r)) for k, i, *r in rows], "volume string, pid long, z double, y double, x double, nz double, ny double, nx double")
    out = orientation.consistent_normals(df, "volume", "pid", 6)
    outward = out.select("component", F.signum(F.col("nz") * F.col("z") + F.col("ny") * F.col("y")).alias("s"))
    assert out.count() == len(rows)
    assert outward.distinct().count() == 1
