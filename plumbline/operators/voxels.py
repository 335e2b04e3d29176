"""Dense 3-D work as joins over voxel tables.

A voxel table has integer coordinates and a key of the volume they belong to.
Neighbourhoods are worked on in blocks with a halo, or are equi-joins on shifted
coordinates, so no task holds a volume.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import blocks
from plumbline.operators.graph import connected_components
from plumbline.storage import written

AXES = ("z", "y", "x")
FACES = [d for d in product((-1, 0, 1), repeat=3) if sum(map(abs, d)) == 1]
ALL_AROUND = [d for d in product((-1, 0, 1), repeat=3) if any(d)]
MOST_EROSIONS = 24  #: rungs of the thickness ladder
ONE_PASS = 4  #: erosions of one pass over the blocks
PASS_SIDE = 32  #: side of its blocks
LEAST_CLOUD = 8  #: voxels that a plane is fitted to


def shifted(voxels: DataFrame, steps: list[tuple[int, int, int]], keep: list[str]) -> DataFrame:
    """Each voxel once for every step, moved by it."""
    moves = F.explode(F.array(*[F.struct(*[F.lit(s).alias(f"d{a}") for a, s in zip(AXES, step, strict=True)]) for step in steps]))
    return voxels.select(*keep, *AXES, moves.alias("__d")).select(*keep, *[(F.col(a) + F.col(f"__d.d{a}")).alias(a) for a in AXES])


def eroded(voxels: DataFrame, key: str, shape: dict[str, int]) -> DataFrame:
    """Voxels whose six neighbours are all in the set; a face of the volume is no background."""

    def work(c: np.ndarray):
        there = ~np.isnan(c)
        beside = sum(np.roll(there, s, a)[1:-1, 1:-1, 1:-1].astype(np.int64) for a in range(3) for s in (-1, 1))
        return there[1:-1, 1:-1, 1:-1], {"n": beside}

    edge = sum([((F.col(a) == 0).cast("int") + (F.col(a) == shape[a] - 1).cast("int")) for a in AXES[1:]], (F.col("z") == 0).cast("int") + (F.col("z") == shape["z"] - 1).cast("int"))
    return blocks.each_block(blocks.blocks(voxels, key, None), key, work, {"n": "long"}).where(F.col("n") + edge >= 6).select(key, *AXES)


def background_depth(voxels: DataFrame, key: str, shape: dict[str, int]) -> DataFrame:
    """(key, z, y, x, depth): each voxel's city-block distance to the nearest place of its volume without one, which is how many erosions it takes.

    Null where the volume has no such place, and for a voxel outside of it.  The
    distance is taken along one axis after the other: what ends a run of voxels on a
    line is background, so no path past it is shorter, and within the run the least of
    distance and way counts.  So three windows over lines give any depth, however large.
    """
    sides = {a: F.lit(shape[a]) if isinstance(shape[a], int) else shape[a] for a in AXES}
    inside = reduce(lambda s, t: s & t, [(F.col(a) >= 0) & (F.col(a) < sides[a]) for a in AXES])
    out = voxels.select(key, *[F.col(a).cast("int").alias(a) for a in AXES]).distinct().withColumns({"__in": inside, "depth": F.lit(None).cast("int")})
    for a in reversed(AXES):
        here, line = F.col(a), [key, "__in", *[b for b in AXES if b != a]]
        runs = out.withColumn("__run", here - F.row_number().over(Window.partitionBy(*line).orderBy(a)))
        run = Window.partitionBy(*line, "__run")
        ends = [F.when(F.min(a).over(run) > 0, here - F.min(a).over(run) + 1), F.when(F.max(a).over(run) < sides[a] - 1, F.max(a).over(run) - here + 1)]
        upto = [w.rowsBetween(Window.unboundedPreceding, 0) for w in (run.orderBy(a), run.orderBy(F.desc(a)))]
        ways = [F.min(F.col("depth") - here).over(upto[0]) + here, F.min(F.col("depth") + here).over(upto[1]) - here]
        out = runs.withColumn("depth", F.least(*ends, *ways)).drop("__run")
    return out.select(key, *AXES, F.when(F.col("__in"), F.col("depth")).alias("depth"))


def erosion_depth(voxels: DataFrame, key: str, shape: dict[str, int], most: int | None = MOST_EROSIONS, probe: int = 4, bulk: float = 0.5) -> DataFrame:
    """(key, z, y, x, depth, standing): after how many erosions a voxel goes.

    Without ``most``, depths are exact at any size and only voxels that no erosion
    takes, in a volume without background, are ``standing``, with a null depth.  With
    it this is the reference's ladder, which asks whether a mask is a sheet: a
    key's peeling stops after ``most`` erosions, or after ``probe`` or more once
    over a ``bulk`` share of its voxels still stands: that is no sheet.  Voxels
    left then are ``standing``, and their depth is a lower bound.  Blocks whose halo
    is ``ONE_PASS`` deep take that many erosions at a time, and only what is left of
    keys that go on is dealt again.
    """
    if most is None:
        return background_depth(voxels, key, shape).withColumn("standing", F.col("depth").isNull())
    left = written(voxels.select(key, *[F.col(a).cast("int").alias(a) for a in AXES]).distinct(), "erosion")
    total = left.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    depths = None
    for done in range(0, most, ONE_PASS):
        steps = min(ONE_PASS, most - done)

        def work(c: np.ndarray, corner: list[int], sides: list[int]):
            there = ~np.isnan(c)
            beyond = np.zeros_like(there)  # places outside of the volume are no background
            for k in range(3):
                place = np.arange(c.shape[k]) + corner[k] - ONE_PASS
                beyond |= ((place < 0) | (place >= sides[k])).reshape([-1 if k == n else 1 for n in range(3)])
            inner = (slice(ONE_PASS, -ONE_PASS),) * 3
            alive, depth = there | beyond, np.ones_like(c[inner], np.int64)
            for _ in range(steps):  # noqa: B023
                after = alive.copy()
                for k in range(3):
                    after &= np.roll(alive, 1, k) & np.roll(alive, -1, k)
                alive = after | beyond
                depth += alive[inner]
            return there[inner], {"d": depth}

        found = written(blocks.each_block(blocks.blocks(left, key, None, PASS_SIDE, ONE_PASS), key, work, {"d": "long"}, PASS_SIDE, ONE_PASS, shape), "erosion")
        counts = found.groupBy(key).agg(*[F.count_if(F.col("d") > s).alias(f"n{s}") for s in range(1, steps + 1)]).join(total, key)
        stops = [F.when(F.lit(done + s == most) | (F.lit(done + s >= probe) & (F.col(f"n{s}") > bulk * F.col("total"))), done + s) for s in range(1, steps + 1)]
        depth, stop = F.col("d") + done, F.col("stop")
        judged = found.join(counts.select(key, F.coalesce(*stops).alias("stop")), key).withColumn("standing", F.coalesce(depth > stop, F.lit(False)))
        judged = judged.select(key, *AXES, F.least(depth, stop).cast("int").alias("depth"), "standing", (stop.isNull() & (F.col("d") > steps)).alias("open"))
        judged = written(judged, "erosion")
        ended = judged.where("not open").drop("open")
        depths = ended if depths is None else depths.unionByName(ended)
        left = judged.where("open").select(key, *AXES)
        if left.isEmpty():
            break
    return depths


def thickness_stats(voxels: DataFrame, key: str, shape: dict[str, int], most: int | None = None) -> DataFrame:
    """Per key: twice the depth as median, 95th percentile, maximum, mean, and the share that stands.

    Exact without ``most``, as ``erosion_depth`` is; the statistics of a volume without background are null then.
    """
    t = 2.0 * F.col("depth")
    return erosion_depth(voxels, key, shape, most).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.median(t).alias("median"), F.percentile(t, F.lit(0.95)).alias("p95"), F.max(t).alias("max"), F.avg(t).alias("mean"), F.avg(F.col("standing").cast("double")).alias("saturated")
    )


def _least_of_sets(there: np.ndarray, steps: list[tuple[int, int, int]]) -> np.ndarray:
    """The place, by its index in the flat cube, of the first voxel of the connected set that each voxel is in; only of use where ``there``."""
    place, of = np.flatnonzero(there), np.full(there.shape, -1)
    of[there] = np.arange(len(place))
    ends = [np.empty((2, 0), np.int64)]
    for d in steps:
        a, b = (of[tuple(slice(max(s * k, 0), there.shape[n] + min(s * k, 0)) for n, k in enumerate(d))] for s in (-1, 1))
        both = (a >= 0) & (b >= 0)
        ends.append(np.stack([a[both], b[both]]))
    pairs, least = np.concatenate(ends, 1), np.arange(len(place))
    while pairs.size:
        pairs = least[pairs]
        pairs = pairs[:, pairs[0] != pairs[1]]
        np.minimum.at(least, pairs.max(0), pairs.min(0))
        while (least[least] != least).any():
            least = least[least]
    out = np.zeros(there.shape, np.int64)
    out[there] = place[least]
    return out


def components(voxels: DataFrame, key: str, steps: list[tuple[int, int, int]] = ALL_AROUND, side: int = PASS_SIDE) -> DataFrame:
    """(key, z, y, x, component): connected sets (26 neighbours by default), named by their least voxel.

    Sets are found within blocks first, and their least voxels stand for them.  Only
    voxels with a neighbour in another block are joined to it, so the rounds run on
    pairs of blocks' sets and not on pairs of voxels.
    """
    half = [d for d in steps if d > (0, 0, 0)]

    def work(c: np.ndarray):
        there = ~np.isnan(c)
        return there, {"place": _least_of_sets(there, half)}

    found = blocks.each_block(blocks.blocks(voxels, key, None, side, 0), key, work, {"place": "long"}, side, 0)
    within = [F.floor(F.col("place") / side**2), F.floor(F.col("place") / side) % side, F.col("place") % side]
    root = F.struct(F.col(key).alias("key"), *[(F.floor(F.col(a) / side) * side + p).cast("int").alias(a) for a, p in zip(AXES, within, strict=True)])
    named = written(found.select(key, *AXES, root.alias("root")), "voxels")
    rim = reduce(lambda s, t: s | t, [F.pmod(F.col(a), F.lit(side)).isin(0, side - 1) for a in AXES])
    beside = shifted(named.where(rim).select(key, *AXES, F.struct("root", *[F.floor(F.col(a) / side).alias(a) for a in AXES]).alias("own")), half, [key, "own"])
    beside = beside.where(reduce(lambda s, t: s | t, [F.floor(F.col(a) / side) != F.col(f"own.{a}") for a in AXES])).select(key, *AXES, F.col("own.root").alias("a"))
    edges = beside.join(named.where(rim).withColumnRenamed("root", "b").hint("merge"), [key, *AXES]).select("a", "b").distinct()
    joined = connected_components(edges).withColumnRenamed("node", "root")
    each = named.join(joined.hint("merge"), "root", "left").withColumn("component", F.coalesce("component", "root"))
    return each.select(key, *AXES, F.concat_ws(",", *[F.col(f"component.{c}").cast("string") for c in ("key", *AXES)]).alias("component"))


def component_stats(labelled: DataFrame, key: str, least: int = 64) -> DataFrame:
    """Per key: components, those of ``least`` voxels or more, the largest one's share, and the small ones' share."""
    sizes = labelled.groupBy(key, "component").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    return sizes.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_components"), F.count_if(F.col("n") >= least).alias("n_large"), (F.max("n") / total).alias("largest_share"), (F.coalesce(F.sum(F.when(F.col("n") < least, F.col("n"))), F.lit(0)) / total).alias("fragment_share")
    )


def planarity(labelled: DataFrame, key: str, most: int = 16, least: int = 64) -> DataFrame:
    """(key, component, n, e1, e2, e3, planarity) of the ``most`` largest components of ``least`` voxels or more; of equal ones that with the least voxel first.

    Planarity is the least eigenvalue's share of the covariance's trace: 0 for a
    plane, a third for a ball; null where the trace is zero.  Eigenvalues of a
    symmetric 3 x 3 matrix have a closed form.
    """
    each = labelled.groupBy(key, "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*AXES)).alias("first"), *covariances()).where(F.col("n") >= max(least, LEAST_CLOUD))
    top = with_eigenvalues(each.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))).where(F.col("turn") <= most))
    return top.select(key, "component", "n", "e1", "e2", "e3", (F.col("e3") / F.nullif(F.col("czz") + F.col("cyy") + F.col("cxx"), F.lit(0.0))).alias("planarity"))


def planarity_summary(flatness: DataFrame, key: str) -> DataFrame:
    """Per key: components measured, and the median and largest planarity."""
    return flatness.groupBy(key).agg(F.count("planarity").alias("n_measured"), F.median("planarity").alias("median_planarity"), F.max("planarity").alias("worst_planarity"))


def eigenvalues(zz: Column, zy: Column, zx: Column, yy: Column, yx: Column, xx: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix, largest first (the trigonometric solution)."""
    q = (zz + yy + xx) / 3
    p2 = (zz - q) * (zz - q) + (yy - q) * (yy - q) + (xx - q) * (xx - q) + 2 * (zy * zy + zx * zx + yx * yx)
    p = F.sqrt(p2 / 6)
    a, b, c = (zz - q), (yy - q), (xx - q)
    det = a * (b * c - yx * yx) - zy * (zy * c - yx * zx) + zx * (zy * yx - b * zx)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(p > 0, det / (2 * p * p * p)).otherwise(0.0)))
    phi = F.acos(r) / 3
    first, third = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2.0943951023931953)
    return first, 3 * q - first - third, F.greatest(third, F.lit(0.0))


COVARIANCE = [f"c{a}{b}" for i, a in enumerate(AXES) for b in AXES[i:]]


def covariances(prefix: str = "") -> list[Column]:
    """Aggregates czz, czy, czx, cyy, cyx, cxx of the points in ``prefix`` z, y, x."""
    return [F.covar_samp(f"{prefix}{a}", f"{prefix}{b}").alias(f"c{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]]


def with_eigenvalues(rows: DataFrame) -> DataFrame:
    """``rows`` with e1 >= e2 >= e3 of the matrix in the ``COVARIANCE`` columns."""
    return rows.withColumns(dict(zip(("e1", "e2", "e3"), eigenvalues(*map(F.col, COVARIANCE)), strict=True)))


def principal_axis(p: str, q: str) -> Column:
    """Unit eigenvector (array z, y, x) of the matrix in ``COVARIANCE`` for the eigenvalue that is neither ``p`` nor ``q``.

    Each column of (A - p)(A - q) is such a vector; the longest is taken, and the
    z axis where all three vanish.
    """
    zz, zy, zx, yy, yx, xx = map(F.col, COVARIANCE)
    matrix = [[zz, zy, zx], [zy, yy, yx], [zx, yx, xx]]
    less = lambda e: [[matrix[r][c] - F.col(e) if r == c else matrix[r][c] for c in range(3)] for r in range(3)]
    first, second = less(p), less(q)
    columns = [[sum((first[r][k] * second[k][c] for k in (1, 2)), first[r][0] * second[0][c]) for r in range(3)] for c in range(3)]
    sized = F.array(*[F.struct(sum((x * x for x in v[1:]), v[0] * v[0]).alias("n"), F.lit(-c).alias("c"), F.array(*v).alias("v")) for c, v in enumerate(columns)])
    unit = lambda best: F.when(best["n"] > 1e-24, F.transform(best["v"], lambda x: x / F.sqrt(best["n"]))).otherwise(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    return F.get(F.transform(F.array(F.array_max(sized)), unit), F.lit(0))


def block_key(side: int, shift: int = 0) -> list[Column]:
    """Block number of a coordinate along each axis."""
    return [F.floor((F.col(a) + shift) / side).cast("int").alias(f"b{a}") for a in AXES]


def touched_blocks(points: DataFrame, side: int, key: str) -> DataFrame:
    """Distinct blocks that the points' eight surrounding voxels lie in."""
    low, high = (points.select(key, *block_key(side, s)) for s in (0, 1))
    return low.union(high).distinct()


def trilinear(points: DataFrame, voxels: DataFrame, key: str, point_id: str, value: str = "value", outside: str = "zero", shape: dict[str, int] | None = None) -> DataFrame:
    """(key, point_id, sample): trilinear samples of a sparse voxel table at float points.

    Points meet blocks of voxels, so a point is shuffled once and not once a
    corner; a voxel that is not there counts zero (``outside = zero``), or coordinates
    are first cut to the volume (``clamp``, with ``shape``).  A point that is repeated
    is sampled once for each row.
    """
    if outside == "clamp":
        points = points.withColumns({a: F.greatest(F.lit(0.0), F.least(F.lit(float(shape[a] - 1)), F.col(a))) for a in AXES})
    return blocks.trilinear(points, blocks.blocks(voxels, key, value), key, point_id)


def search_edges(references: DataFrame, key: str, k: int) -> DataFrame:
    """(key, __n, __edge, __reach): per key the points, a first cell edge that a ball of some 3 k points fits, and the box's diagonal."""
    spans = [F.max(a) - F.min(a) for a in AXES]
    boxes = references.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[s.alias(f"s{a}") for a, s in zip(AXES, spans, strict=True)])
    longest = F.greatest(*[F.col(f"s{a}").cast("double") for a in AXES], F.lit(1e-3))
    room = reduce(lambda x, y: x * y, [F.greatest(F.col(f"s{a}"), longest * 1e-3) for a in AXES])
    edge = F.least(F.pow(room * (0.75 * k) / F.col("__n"), F.lit(1.0 / 3.0)), longest)
    return boxes.select(key, "__n", edge.alias("__edge"), F.sqrt(sum([F.col(f"s{a}") ** 2 for a in AXES[1:]], F.col("sz") ** 2)).alias("__reach"))


def _cells_within(placed: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, z, y, x): each query with its own cell and those around it within the edge, or all 27 where the edge covers the key's box."""
    moves = F.explode(F.array(*[F.struct(*[F.lit(s).alias(f"d{a}") for a, s in zip(AXES, step, strict=True)]) for step in [(0, 0, 0), *ALL_AROUND]]))
    beyond = [F.col(f"q{a}") / F.col("__edge") - F.col(a) for a in AXES]  # place within the cell, in edges
    away = [F.when(F.col(f"__d.d{a}") == 1, 1 - b).when(F.col(f"__d.d{a}") == -1, b).otherwise(0.0) for a, b in zip(AXES, beyond, strict=True)]
    within = (sum([w * w for w in away[1:]], away[0] * away[0]) <= 1 + 1e-9) | (F.col("__edge") >= F.col("__reach"))
    return placed.withColumn("__d", moves).where(within).select(*keep, *[(F.col(a) + F.col(f"__d.d{a}")).alias(a) for a in AXES])


def nearest_points(queries: DataFrame, references: DataFrame, key: str, query_id: str, reference_id: str, k: int) -> DataFrame:
    """(key, query_id, neighbour, distance, turn): the k nearest references of every query of the same key.

    Both sides are (key, id, z, y, x).  They are dealt to cells and a query meets
    those of the 27 cells around it that lie within the edge; the first edge follows from the key's mean density.
    Queries whose k-th neighbour is not within the edge go on with the edge
    doubled, until it covers the key's box; so the result is complete.  Ties go
    to the smaller id; a key of fewer references gives all of them.
    """
    scale = written(search_edges(references.select(key, *AXES).unionByName(queries.select(key, *AXES)), key, k), "knn-scale")
    counts = references.groupBy(key).agg(F.count(F.lit(1)).alias("__have"))
    scale = written(scale.join(counts, key), "knn-scale")
    left = queries.select(key, F.col(query_id).alias("__q"), *[F.col(a).cast("double").alias(f"q{a}") for a in AXES])
    own = references.select(key, F.col(reference_id).alias("neighbour"), *[F.col(a).cast("double").alias(f"n{a}") for a in AXES])
    distance = F.sqrt(sum([(F.col(f"q{a}") - F.col(f"n{a}")) ** 2 for a in AXES[1:]], (F.col("qz") - F.col("nz")) ** 2))
    turn = F.row_number().over(Window.partitionBy(key, "__q").orderBy("distance", "neighbour"))
    found, grow = None, 1.0
    while True:
        sized = scale.withColumn("__edge", F.col("__edge") * grow)
        cell = lambda p: [F.floor(F.col(f"{p}{a}") / F.col("__edge")).cast("long").alias(a) for a in AXES]  # noqa: B023, E731
        spread = _cells_within(left.join(sized, key).select("*", *cell("q")), [key, "__q", *[f"q{a}" for a in AXES]])
        placed = own.join(sized, key).select(key, "neighbour", *[f"n{a}" for a in AXES], *cell("n"), "__edge", "__reach", "__have")
        pairs = spread.join(placed, [key, *AXES]).select(key, "__q", "neighbour", distance.alias("distance"), "__edge", "__reach", "__have")
        near = pairs.where((F.col("distance") <= F.col("__edge")) | (F.col("__edge") >= F.col("__reach")))
        best = near.withColumn("turn", turn).where(F.col("turn") <= k)
        own_count = F.count(F.lit(1)).over(Window.partitionBy(key, "__q"))
        best = written(best.withColumn("__whole", own_count >= F.least(F.lit(k), F.col("__have"))).select(key, "__q", "neighbour", "distance", "turn", "__whole"), "knn")
        ready = best.where("__whole").drop("__whole")
        found = ready if found is None else found.unionByName(ready)
        left = written(left.join(scale.select(key), key, "left_semi").join(ready.select(key, "__q").distinct(), [key, "__q"], "left_anti"), "knn-open")
        if left.isEmpty():
            return found.withColumnRenamed("__q", query_id)
        grow *= 2.0


def nearest_neighbours(points: DataFrame, key: str, point_id: str, k: int) -> DataFrame:
    """(key, point_id, neighbour, distance, turn): the k nearest points of the key, itself included."""
    return nearest_points(points, points, key, point_id, point_id, k)


def knn_edges(points: DataFrame, key: str, point_id: str, k: int) -> DataFrame:
    """(key, a, b, distance): each point with its k nearest others."""
    near = nearest_neighbours(points, key, point_id, k + 1).where("turn > 1")
    return near.select(key, F.col(point_id).alias("a"), F.col("neighbour").alias("b"), "distance")


def nearest_values(queries: DataFrame, seeds: DataFrame, key: str, query_id: str, seed_id: str, values: list[str]) -> DataFrame:
    """(key, query_id, values): each query with the values of its nearest seed."""
    near = nearest_points(queries, seeds, key, query_id, seed_id, 1).select(key, query_id, F.col("neighbour").alias(seed_id))
    return near.join(seeds.select(key, seed_id, *values), [key, seed_id]).select(key, query_id, *values)


def point_normals(points: DataFrame, key: str, point_id: str, k: int = 40) -> DataFrame:
    """(key, point_id, nz, ny, nx): unsigned unit normals, the direction of least extent among the k nearest points."""
    near = nearest_neighbours(points, key, point_id, k).select(key, point_id, "neighbour")
    around = near.join(points.select(key, F.col(point_id).alias("neighbour"), *AXES), [key, "neighbour"])
    facing = with_eigenvalues(around.groupBy(key, point_id).agg(*covariances())).withColumn("axis", principal_axis("e1", "e2"))
    return facing.select(key, point_id, *[F.get("axis", F.lit(i)).alias(f"n{a}") for i, a in enumerate(AXES)])


def gradient(voxels: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Central differences along each axis, one-sided at the ends of a line of voxels."""
    out = voxels
    for a in AXES:
        w = Window.partitionBy(key, *[b for b in AXES if b != a]).orderBy(a)
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        slope = F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).when(after.isNotNull(), after - here).when(before.isNotNull(), here - before).otherwise(0.0)
        out = out.withColumn(f"g{a}", slope)
    return out


def blurred(voxels: DataFrame, key: str, sigma: float, value: str = "value", truncate: float = 4.0) -> DataFrame:
    """Gaussian blur of a dense voxel table, axis by axis, with weights renormalised at the edges."""
    reach = int(truncate * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    side = max(blocks.SIDE, reach)

    def work(c: np.ndarray):
        there = ~np.isnan(c)
        soft = np.where(there, c, 0.0)
        for a in range(3):
            total, weight = np.zeros_like(soft), np.zeros_like(soft)
            for k, w in zip(range(-reach, reach + 1), kernel, strict=True):
                total += w * np.roll(soft, k, a)
                weight += w * np.roll(there, k, a)
            soft = np.where(there, total / np.maximum(weight, 1e-300), 0.0)
        inner = slice(reach, c.shape[0] - reach)
        return there[inner, inner, inner], {value: soft[inner, inner, inner]}

    return blocks.each_block(blocks.blocks(voxels, key, value, side, reach), key, work, {value: "double"}, side, reach)


def noise_sigma(voxels: DataFrame, key: str, value: str = "value", sigma: float = 1.0) -> DataFrame:
    """1.4826 MAD of the residual after a blur; exact zeros are left out where they are over a fifth; 1e-6 at least."""
    soft = blurred(voxels, key, sigma, value).withColumnRenamed(value, "soft")
    residual = voxels.join(soft, [key, *AXES]).select(key, F.col(value).alias("v"), (F.col(value) - F.col("soft")).alias("r"))
    zeros = residual.groupBy(key).agg(F.avg((F.col("v") == 0).cast("double")).alias("zero_share"))
    kept = residual.join(zeros, key).where((F.col("zero_share") <= 0.2) | (F.col("v") != 0))
    middle = kept.groupBy(key).agg(F.median("r").alias("m"))
    return kept.join(middle, key).groupBy(key).agg(F.greatest(1.4826 * F.median(F.abs(F.col("r") - F.col("m"))), F.lit(1e-6)).alias("noise_sigma"))


def local_contrast(voxels: DataFrame, key: str, value: str = "value", sigma: float = 2.0) -> DataFrame:
    """Per key: mean absolute difference from a blur, as a share of the 1st to 99th percentile range; the median value."""
    soft = blurred(voxels, key, sigma, value).withColumnRenamed(value, "soft")
    q = F.percentile(value, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
    each = voxels.join(soft, [key, *AXES]).groupBy(key).agg(F.avg(F.abs(F.col(value) - F.col("soft"))).alias("difference"), q.alias("q"))
    return each.select(key, (F.col("difference") / F.nullif(F.col("q")[2] - F.col("q")[0], F.lit(0.0))).alias("contrast"), F.col("q")[1].alias("median"))
