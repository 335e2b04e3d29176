"""Surfaces: grid meshes, triangle meshes, mean profiles, and the seam detectors.

A grid mesh is a table (mesh, r, c, z, y, x, valid); a triangle mesh is a table
of vertices (mesh, v, z, y, x) and one of faces (mesh, f, a, b, c).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import profiles as pf
from plumbline.operators import blocks as bk
from plumbline.operators.graph import connected_components
from plumbline.operators.ranks import MAD_SCALE, line_scores
from plumbline.operators.voxels import AXES, covariances, principal_axis, trilinear, with_eigenvalues
from plumbline.storage import written

FEW_STEPS = 17  #: samples along an edge
Z_THRESHOLD = 5.0
LEAST_DIP = 1.0


def _length(a: str, b: str) -> Column:
    return F.sqrt(reduce(lambda s, t: s + t, [(F.col(f"{a}{x}") - F.col(f"{b}{x}")) ** 2 for x in AXES]))


def missing_as_invalid(mesh: DataFrame) -> DataFrame:
    """``valid`` from the coordinates: a channel below zero, or not finite, is a missing vertex."""
    bad = reduce(lambda s, t: s | t, [F.col(a).isNull() | F.isnan(a) | (F.col(a) < 0) | (F.col(a) == float("inf")) for a in AXES])
    return mesh.withColumn("valid", ~bad)


def decimated(mesh: DataFrame, k: int) -> DataFrame:
    """Every k-th row and column, numbered anew."""
    return mesh.where((F.col("r") % k == 0) & (F.col("c") % k == 0)).withColumns({"r": F.floor(F.col("r") / k).cast("int"), "c": F.floor(F.col("c") / k).cast("int")})


def window(mesh: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Rows r0 up to r1 and columns c0 up to c1: a range filter that reaches the scan."""
    return mesh.where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))


def bounds(points: DataFrame, key: str, margin: int = 0) -> DataFrame:
    """Integer bounding box of each key's points, widened by the margin and cut at zero."""
    out = []
    for a in AXES:
        out += [F.greatest(F.floor(F.min(a)) - margin, F.lit(0)).alias(f"{a}0"), (F.ceil(F.max(a)) + margin + 1).alias(f"{a}1")]
    return points.groupBy(key).agg(*out)


def grid_edges(mesh: DataFrame) -> DataFrame:
    """Edges to the next row (axis 0) and the next column (axis 1): (mesh, axis, line, place, a*, b*, both).

    An axis-0 edge from (r, c) lies on line r, an axis-1 edge on line c.  An
    equi-join on the neighbour's place, so a surface is never in one window.
    """
    point = ["z", "y", "x", "valid"]
    first = mesh.select("mesh", "r", "c", *[F.col(p).alias(f"a{p}") for p in point])
    moves = F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.lit(1).alias("dr"), F.lit(0).alias("dc")), F.struct(F.lit(1).alias("axis"), F.lit(0).alias("dr"), F.lit(1).alias("dc"))))
    second = mesh.select("mesh", "r", "c", *[F.col(p).alias(f"b{p}") for p in point], moves.alias("m")).select("mesh", (F.col("r") - F.col("m.dr")).alias("r"), (F.col("c") - F.col("m.dc")).alias("c"), F.col("m.axis").alias("axis"), *[f"b{p}" for p in point])
    joined = first.join(second, ["mesh", "r", "c"])
    return joined.withColumn("line", F.when(F.col("axis") == 0, F.col("r")).otherwise(F.col("c"))).withColumn("place", F.when(F.col("axis") == 0, F.col("c")).otherwise(F.col("r"))).withColumn("both", F.col("avalid") & F.col("bvalid"))


def grid_step(mesh: DataFrame) -> DataFrame:
    """(mesh, n_edges, grid_step): the median length of the valid edges."""
    return grid_edges(mesh).where("both").select("mesh", _length("a", "b").alias("d")).groupBy("mesh").agg(F.count(F.lit(1)).alias("n_edges"), F.median("d").alias("grid_step"))


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def normals(mesh: DataFrame) -> DataFrame:
    """``mesh`` with nz, ny, nx: the cross product of the central differences (one-sided at the rim)."""
    out = mesh
    slopes = {}
    for axis, (by, over) in (("r", ("c", "r")), ("c", ("r", "c"))):
        w = Window.partitionBy("mesh", by).orderBy(over)
        for a in AXES:
            before, after = F.lag(a).over(w), F.lead(a).over(w)
            slopes[f"d{axis}{a}"] = F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).when(after.isNotNull(), after - F.col(a)).otherwise(F.col(a) - before)
    out = out.withColumns(slopes)
    n = _cross([F.col(f"dr{a}") for a in AXES], [F.col(f"dc{a}") for a in AXES])
    size = F.sqrt(sum([x * x for x in n[1:]], n[0] * n[0]))
    return out.withColumns({f"n{a}": F.when(size > 1e-12, x / size).otherwise(0.0) for a, x in zip(AXES, n, strict=True)}).drop(*slopes)


def displaced(mesh_with_normals: DataFrame, distance: Column | float, half: str = "right") -> DataFrame:
    """A planted control: one half of the grid pushed along its normals.

    ``right``: columns from the middle on; ``top``: rows before the middle.
    """
    d = distance if isinstance(distance, Column) else F.lit(float(distance))
    size = mesh_with_normals.groupBy("mesh").agg((F.max("r") + 1).alias("__rows"), (F.max("c") + 1).alias("__cols"))
    moved = mesh_with_normals.join(size, "mesh")
    there = F.col("c") >= F.floor(F.col("__cols") / 2) if half == "right" else F.col("r") < F.floor(F.col("__rows") / 2)
    return moved.withColumns({a: F.when(there, F.col(a) + F.col(f"n{a}") * d).otherwise(F.col(a)) for a in AXES}).drop("__rows", "__cols")


def triangles(mesh: DataFrame) -> DataFrame:
    """(mesh, r, c, half, a, b, d): two triangles for each quad whose four corners are valid.

    Corners are named by their place ``r,c``; the halves are (a, b, d) and
    (b, e, d) with a the corner itself, b to its right, d below, e across.
    """
    good = mesh.where("valid").select("mesh", "r", "c")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("r"), F.lit(j).alias("c")) for i in (0, 1) for j in (0, 1)]))
    corner = good.select("mesh", steps.alias("s"), "r", "c").select("mesh", (F.col("r") - F.col("s.r")).alias("r"), (F.col("c") - F.col("s.c")).alias("c"))
    quads = corner.groupBy("mesh", "r", "c").agg(F.count(F.lit(1)).alias("n")).where("n = 4")
    at = lambda i, j: F.concat_ws(",", (F.col("r") + i).cast("string"), (F.col("c") + j).cast("string"))
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), at(0, 0).alias("a"), at(0, 1).alias("b"), at(1, 0).alias("d")), F.struct(F.lit(1).alias("half"), at(0, 1).alias("a"), at(1, 1).alias("b"), at(1, 0).alias("d"))))
    return quads.select("mesh", "r", "c", halves.alias("t")).select("mesh", "r", "c", "t.*")


def unique_edges(faces: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, u, v): the undirected edges of triangles (a, b, c), each once, u < v."""
    sides = F.explode(F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))]))
    return faces.select(*keys, sides.alias("e")).select(*keys, "e.u", "e.v").where("u <> v").distinct()


def triangle_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh, v, nz, ny, nx): area-weighted vertex normals: summed cross products of the faces around."""
    f = faces
    for corner in "abc":
        f = f.join(vertices.select("mesh", F.col("v").alias(corner), *[F.col(x).alias(f"{corner}{x}") for x in AXES]), ["mesh", corner])
    n = _cross([F.col(f"b{x}") - F.col(f"a{x}") for x in AXES], [F.col(f"c{x}") - F.col(f"a{x}") for x in AXES])
    each = f.select("mesh", F.explode(F.array("a", "b", "c")).alias("v"), *[x.alias(f"n{a}") for a, x in zip(AXES, n, strict=True)])
    total = each.groupBy("mesh", "v").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in AXES])
    size = F.sqrt(sum([F.col(f"n{a}") ** 2 for a in AXES[1:]], F.col("nz") ** 2))
    return total.select("mesh", "v", *[F.when(size > 1e-12, F.col(f"n{a}") / size).otherwise(0.0).alias(f"n{a}") for a in AXES])


def best_window(mesh: DataFrame, size: int) -> DataFrame:
    """(mesh, r, c, n): the densest ``size`` x ``size`` window on a half-window grid; the first of equals.

    Cells are counted by half windows first, then four of them make a window.
    """
    half = size // 2
    cells = mesh.where("valid").groupBy("mesh", F.floor(F.col("r") / half).alias("hr"), F.floor(F.col("c") / half).alias("hc")).agg(F.count(F.lit(1)).alias("n"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("r"), F.lit(j).alias("c")) for i in (0, 1) for j in (0, 1)]))
    sums = cells.select("mesh", "n", steps.alias("s"), "hr", "hc").select("mesh", ((F.col("hr") - F.col("s.r")) * half).alias("r"), ((F.col("hc") - F.col("s.c")) * half).alias("c"), "n").where("r >= 0 and c >= 0").groupBy("mesh", "r", "c").agg(F.sum("n").alias("n"))
    return sums.groupBy("mesh").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))).alias("b")).select("mesh", "b.r", "b.c", (-F.col("b.m")).alias("n"))


def strided_window(mesh: DataFrame, size: int, steps: int = 6) -> DataFrame:
    """(mesh, r, c, n): the densest ``size`` x ``size`` window whose corner lies on ``steps`` strides along each side.

    The stride follows from the mesh's own shape; a vertex counts in each window it lies in.
    """
    shape = mesh.groupBy("mesh").agg(*[F.greatest(F.max(a) + 1 - size, F.lit(0)).alias(f"last_{a}") for a in "rc"])
    stride = {a: F.greatest(F.floor(F.col(f"last_{a}") / steps), F.lit(1)).cast("int") for a in "rc"}
    sized = shape.withColumns({f"s{a}": stride[a] for a in "rc"})
    starts = lambda a: F.sequence(F.greatest(F.ceil((F.col(a) - size + 1) / F.col(f"s{a}")), F.lit(0)).cast("int"), F.least(F.floor(F.col(a) / F.col(f"s{a}")), F.floor(F.col(f"last_{a}") / F.col(f"s{a}"))).cast("int"))
    held = mesh.where("valid").join(sized, "mesh").where(" and ".join(f"greatest(ceil(({a} - {size} + 1) / s{a}), 0) <= least(floor({a} / s{a}), floor(last_{a} / s{a}))" for a in "rc"))
    each = held.withColumn("wr", F.explode(starts("r"))).withColumn("wc", F.explode(starts("c")))
    counts = each.groupBy("mesh", (F.col("wr") * F.col("sr")).alias("r"), (F.col("wc") * F.col("sc")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("mesh").agg(F.min(F.struct((-F.col("n")).alias("m"), "r", "c")).alias("b")).select("mesh", "b.r", "b.c", (-F.col("b.m")).alias("n"))


def chosen_tiles(tiles: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """The first ``most`` tiles (key, tr, tc, ...) of each key in the order of their md5: a sampling operator."""
    draw = F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(key).cast("string"), F.col("tr").cast("string"), F.col("tc").cast("string")))
    turn = F.row_number().over(Window.partitionBy(key).orderBy(draw, "tr", "tc"))
    return tiles.withColumn("__turn", turn).where(F.col("__turn") <= most).drop("__turn")


def arc_lengths(points: DataFrame, keys: list[str], place: str) -> DataFrame:
    """``points`` (keys, place, z, y, x) with ``arc``: the length of the line from its first point."""
    line = Window.partitionBy(*keys).orderBy(place)
    step = F.sqrt(sum([(F.col(a) - F.lag(a).over(line)) ** 2 for a in AXES[1:]], (F.col("z") - F.lag("z").over(line)) ** 2))
    return points.withColumn("__step", F.coalesce(step, F.lit(0.0))).withColumn("arc", F.sum("__step").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def strip_places(points: DataFrame, keys: list[str], place: str, values: list[str], step: float = 1.0, least: int = 8) -> DataFrame:
    """(keys, i, arc, values): ``values`` of a line of points (keys, place, z, y, x, values) at even steps of arc length.

    A line of ``least`` points or more gets one place for each ``step`` of its length,
    two at the least, from its first point to its last.  Each segment makes the places
    that lie on it, so a line is never in one row; points that coincide make none.
    """
    line = Window.partitionBy(*keys).orderBy(place)
    run = arc_lengths(points, keys, place)
    ends = run.groupBy(*keys).agg(F.max("arc").alias("__total"), F.count(F.lit(1)).alias("__n")).where((F.col("__n") >= least) & (F.col("__total") > 0))
    seg = run.select(*keys, place, "arc", *values, F.lead("arc").over(line).alias("__to"), *[F.lead(v).over(line).alias(f"__{v}") for v in values]).join(ends, keys)
    last = F.greatest(F.lit(2), F.floor(F.col("__total") / step)) - 1
    gap = F.col("__total") / last
    first = lambda c: F.when(F.col(c) >= F.col("__total"), last).otherwise(F.least(last, F.ceil(F.col(c) / gap)))
    until = F.when(F.col("__to") >= F.col("__total"), last).otherwise(first("__to") - 1)
    open_ = seg.where(F.col("__to") > F.col("arc")).withColumns({"__first": first("arc").cast("long"), "__until": until.cast("long"), "__gap": gap}).where("__first <= __until")
    each = open_.withColumn("i", F.explode(F.sequence("__first", "__until")))
    share = (F.col("i") * F.col("__gap") - F.col("arc")) / (F.col("__to") - F.col("arc"))
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return each.select(*keys, "i", (F.col("i") * F.col("__gap")).alias("__arc"), *[(F.col(v) + at * (F.col(f"__{v}") - F.col(v))).alias(v) for v in values]).withColumnRenamed("__arc", "arc")


def cross_sections(mesh: DataFrame, volume: DataFrame, reach: float, step: float = 1.0, every: int = 1) -> DataFrame:
    """(mesh, r, i, depth, sample): the volume beside every ``every``-th row of a surface, one column for each ``step`` of arc.

    ``mesh`` with normals (mesh, r, c, z, y, x, nz, ny, nx, valid), ``volume`` (mesh, z, y, x, value).
    """
    own = mesh.where(F.col("valid") & (F.col("r") % every == 0))
    placed = strip_places(own, ["mesh", "r"], "c", [*AXES, *[f"n{a}" for a in AXES]], step)
    long = F.sqrt(reduce(lambda s, t: s + t, [F.col(f"n{a}") ** 2 for a in AXES])) + 1e-9
    depths = F.explode(pf.offsets(reach, step)).alias("depth")
    walked = placed.select("mesh", "r", "i", *AXES, *[(F.col(f"n{a}") / long).alias(f"n{a}") for a in AXES], depths)
    points = walked.select("mesh", F.struct("r", "i", "depth").alias("at"), *[(F.col(a) + F.col(f"n{a}") * F.col("depth")).alias(a) for a in AXES])
    return trilinear(points, volume, "mesh", "at").select("mesh", "at.r", "at.i", "at.depth", "sample")


def naive_alignment(samples: DataFrame, key: str, radius: float | str, step: float, noise: float = 1.0) -> DataFrame:
    """Each point's own largest sample, kept for comparison with cells; it follows the radius.

    Per key: points, mean, median and 90th percentile of the offsets' sizes, the
    shares of one voxel and two or more, of peaks at the search's edge (which the
    others leave out unless all are) and of peaks under three times the noise.
    ``radius`` may be a column.
    """
    curve, r = F.col("__curve"), F.col(radius) if isinstance(radius, str) else F.lit(float(radius))
    each = samples.select(key, r.alias("__r"), pf.smoothed(F.col("profile"), 0.5 / step).alias("__curve")).select(
        key, "__r", ((pf.subvoxel_peak(curve) - (F.size(curve) - 1) / 2.0) * step).alias("o"), (F.array_max(curve) - F.least(F.get(curve, F.lit(0)), F.get(curve, F.size(curve) - 1))).alias("prominence"), pf.value_range(curve).alias("spread")
    )
    judged = each.withColumn("inner", F.abs("o") < F.col("__r") - step)
    some = judged.groupBy(key).agg(F.count_if("inner").alias("__inner"))
    kept = judged.join(some, key).withColumn("v", F.when(F.col("inner") | (F.col("__inner") == 0), F.col("o")))
    size = F.abs("v")
    return kept.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.median(size).alias("abs_median"), F.percentile(size, F.lit(0.9)).alias("abs_p90"), F.avg((size >= 1).cast("double")).alias("share_1"), F.avg((size >= 2).cast("double")).alias("share_2"),
        (1 - F.avg(F.col("inner").cast("double"))).alias("unresolved_share"), F.median("prominence").alias("prominence"), F.median(F.col("prominence") / noise).alias("prominence_snr"), F.avg((F.col("prominence") / noise < 3).cast("double")).alias("flat_share"), F.median("spread").alias("spread"),
    )


def oriented(points: DataFrame, volume: DataFrame, keys: list[str], reach: float = 3.0) -> DataFrame:
    """Points with normals turned, for each of ``keys`` as a whole, to the side where the volume is brighter.

    ``points`` (key, ..., pid, z, y, x, nz, ny, nx), ``volume`` (key, z, y, x,
    value) with ``keys[0]`` as key; the sign is that of the sum of the
    differences ``reach`` voxels to both sides.
    """
    key = keys[0]
    moved = [points.select(key, F.struct("pid", F.lit(s).alias("side")).alias("at"), *[(F.col(a) + s * reach * F.col(f"n{a}")).alias(a) for a in AXES]) for s in (1, -1)]
    sampled = trilinear(moved[0].unionByName(moved[1]), volume, key, "at").select(key, "at.pid", (F.col("at.side") * F.col("sample")).alias("d"))
    signs = points.select(*keys, "pid").join(sampled, [key, "pid"]).groupBy(*keys).agg(F.when(F.sum("d") < 0, -1.0).otherwise(1.0).alias("__sign"))
    return points.join(signs, keys).withColumns({f"n{a}": F.col(f"n{a}") * F.col("__sign") for a in AXES}).drop("__sign")


def oriented_by(points: DataFrame, field: DataFrame, keys: list[str]) -> DataFrame:
    """Points with normals turned, for each of ``keys``, so that the sum of their products with a field (keys[0], pid, gz, gy, gx) is positive."""
    dot = sum([F.col(f"n{a}") * F.col(f"g{a}") for a in AXES[1:]], F.col("nz") * F.col("gz"))
    signs = points.join(field, [keys[0], "pid"]).groupBy(*keys).agg(F.when(F.sum(dot) < 0, -1.0).otherwise(1.0).alias("__sign"))
    return points.join(signs, keys).withColumns({f"n{a}": F.col(f"n{a}") * F.col("__sign") for a in AXES}).drop("__sign")


def mean_profiles(rows: DataFrame, keys: list[str], profile: str, least: int = 1) -> DataFrame:
    """(keys, n, profile): the element-wise mean of each group of ``least`` profiles or more.

    Places are exploded and averaged with partial sums, so a group of any size
    is never collected.
    """
    each = rows.select(*keys, F.posexplode(profile).alias("__i", "__v")).groupBy(*keys, "__i").agg(F.avg("__v").alias("v"), F.count("__v").alias("n"))
    out = each.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("__i", "v"))).alias("p"))
    return out.where(F.col("n") >= least).select(*keys, "n", F.transform("p", lambda s: s["v"]).alias("profile"))


def cell_of(size: float) -> list[Column]:
    return [F.floor(F.col(a) / size).cast("int").alias(f"c{a}") for a in AXES]


def aligned_cells(samples: DataFrame, key: str, radius: float | str, step: float, noise: float | str, cell: float = 64, least: int = 200, smooth: float = 0.5) -> DataFrame:
    """Cells of a label with the offset of the ridge from it, and why a cell has none.

    ``samples`` (key, z, y, x, profile); ``radius`` and ``noise`` may be columns of it
    that each key has one value of.  The profile of a cell is the mean of its points'
    profiles.  A peak at the search's edge is unresolved; that is asked before the
    noise is; each cell has one status.
    """
    own = samples.withColumns({"__r": F.col(radius) if isinstance(radius, str) else F.lit(float(radius)), "__n": F.col(noise) if isinstance(noise, str) else F.lit(float(noise))})
    grouped = mean_profiles(own.select(key, "__r", "__n", *cell_of(cell), "profile"), [key, "__r", "__n", "cz", "cy", "cx"], "profile", least)
    along = pf.offsets(F.col("__r"), step)
    curved = grouped.withColumn("curve", pf.smoothed(F.col("profile"), max(smooth / step, 0.5)))
    found = curved.withColumn("offset", pf.peak_offset(F.col("curve"), along)).withColumn("snr", pf.value_range(F.col("profile")) / (F.greatest("__n", F.lit(1e-12)) / F.sqrt("n")))
    status = F.when(F.abs("offset") >= F.col("__r") - 2 * step, "unresolved").when(F.col("snr") < 3, "low_snr").otherwise("ok")
    return found.select(key, "cz", "cy", "cx", "n", "offset", "snr", status.alias("status"))


def alignment_summary(cells: DataFrame, key: str) -> DataFrame:
    """Per key: resolved and refused cells, and the spread of the resolved offsets."""
    ok = F.when(F.col("status") == "ok", F.col("offset"))
    return cells.groupBy(key).agg(
        F.count(ok).alias("n_cells"), F.count_if(F.col("status") == "unresolved").alias("n_unresolved"), F.count_if(F.col("status") == "low_snr").alias("n_low_snr"), F.median(ok).alias("median"), F.avg(ok).alias("mean"),
        F.median(F.abs(ok)).alias("abs_median"), F.percentile(F.abs(ok), F.lit(0.9)).alias("abs_p90"), F.avg((F.abs(ok) >= 1).cast("double")).alias("share_1"), F.avg((F.abs(ok) >= 2).cast("double")).alias("share_2"), F.max_by(ok, F.abs(ok)).alias("worst"),
    )


def block_profiles(samples: DataFrame, key: str, tile: int, along_radius: float, along_step: float, least_share: float = 0.5) -> DataFrame:
    """On-sheet blocks: (key, tr, tc, n, range, at_zero, peak_offset) of whole tiles.

    ``samples`` (key, r, c, profile), profile null where a vertex is missing.  A
    tile counts if at least half its cells have a profile and its mean profile
    rises above zero.
    """
    tiles = samples.select(key, F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc"), "profile")
    means = mean_profiles(tiles.where("profile is not null"), [key, "tr", "tc"], "profile", int(least_share * tile * tile))
    p, along = F.col("profile"), pf.offsets(along_radius, along_step)
    return means.where(F.array_max(p) > 0).select(key, "tr", "tc", "n", pf.value_range(p).alias("range"), pf.at_middle(p).alias("at_zero"), F.get(along, pf.argmax(p).cast("int")).alias("peak_offset"))


def _volume_blocks(volume: DataFrame) -> DataFrame:
    """(bz, by, bx, at, v): blocks of a volume (z, y, x, value), written, so that Spark knows how small they are."""
    return written(bk.blocks(volume.withColumn("key", F.lit(0)), "key").drop("key"), "volume-blocks")


def edge_dips(edges: DataFrame, volume: DataFrame, ids: list[str], steps: int = FEW_STEPS) -> DataFrame:
    """(ids, dip): lower end minus lowest inner sample along each of the (distinct) edges, in a volume (z, y, x, value).

    An edge is a walk that meets the blocks it passes; a block gives its least end and
    inner sample, so samples are never rows.  Where a sample's
    block is not there, it is zero.
    """
    walks = edges.select(*ids, *[F.col(f"a{a}").alias(f"o{a}") for a in AXES], *[(F.col(f"b{a}") - F.col(f"a{a}")).alias(f"d{a}") for a in AXES], F.lit(steps).alias("n"), F.lit(0.0).alias("first"), F.lit(1.0 / (steps - 1)).alias("gap"))

    def least(walks: int, n: int, walk, i, samples):
        low = np.full((walks, n), np.inf)
        low[walk, i] = samples
        end = np.isin(np.arange(n), (0, n - 1))
        return np.stack([low[:, end].min(1), low[:, ~end].min(1)], 1).ravel()

    met = bk.walk_results(bk.walk_lists(walks, [], ids), _volume_blocks(volume), least, "array<double>", [])
    each = met.select("r", F.posexplode("walks").alias("k", "w")).select(*[F.col(f"w.{i}").alias(i) for i in ids], *[F.get("r", F.col("k") * 2 + j).alias(f"r{j}") for j in range(2)])
    return each.groupBy(*ids).agg((F.min("r0") - F.min("r1")).alias("dip"))


def surface_intensity(mesh: DataFrame, volume: DataFrame) -> DataFrame:
    """(mesh, level, spread): median and 1.4826 MAD of the volume at the valid vertices."""
    points = mesh.where("valid").withColumn("key", F.lit(0))
    sampled = written(trilinear(points, volume.withColumn("key", F.lit(0)), "key", "mesh").select("mesh", "sample"), "levels")
    level = sampled.groupBy("mesh").agg(F.median("sample").alias("level"))
    return sampled.join(level, "mesh").groupBy("mesh").agg(F.first("level").alias("level"), (MAD_SCALE * F.median(F.abs(F.col("sample") - F.col("level")))).alias("spread"))


def walk_length(steps: DataFrame, key: str = "mesh", step: str = "grid_step", reach: float = 6.0) -> DataFrame:
    """(key, span, along_step, n_along) of the walk that looks for the next winding: ``reach`` grid steps, 40 voxels at least."""
    span = F.greatest(reach * F.coalesce(F.col(step), F.lit(0.0)), F.lit(40.0))
    sized = steps.select(key, span.alias("span")).withColumn("along_step", F.greatest(F.col("span") / 120.0, F.lit(0.5)))
    return sized.withColumn("n_along", F.ceil((2.0 * F.col("span") + 1.0) / F.col("along_step") - 1e-9).cast("int"))


def along_walk() -> Column:
    """Offsets of the walk in the columns of ``walk_length``."""
    return F.transform(F.sequence(F.lit(0), F.col("n_along") - 1), lambda i: i * F.col("along_step") - F.col("span"))


def spacing_profiles(facing: DataFrame, volume: DataFrame, walks: DataFrame) -> DataFrame:
    """(mesh, n, profile): mean intensity along the unit normals of points (mesh, pid, z, y, x, nz, ny, nx).

    Walks meet the blocks they pass, and a list of them gives one sum for each place of
    the profile, so samples are never rows; a sample outside of the blocks is zero.
    The sums are written, so that no later join holds memory while the walks run.  An inner
    explode would ask for the size of the results first, and so make them twice.
    """
    each = facing.join(walks, "mesh").select("mesh", *[F.col(a).alias(f"o{a}") for a in AXES], *[F.col(f"n{a}").alias(f"d{a}") for a in AXES], F.col("n_along").alias("n"), (-F.col("span")).alias("first"), F.col("along_step").alias("gap"))
    rows = _volume_blocks(volume)
    ends = rows.agg(*[f(f"b{a}") for a in AXES for f in (F.min, F.max)]).first()
    within = tuple((1, 0) if ends[0] is None else (ends[2 * k], ends[2 * k + 1]) for k in range(3))
    met = bk.walk_results(bk.walk_lists(each, ["mesh"], [], within=within), rows, lambda walks, n, walk, i, samples: np.bincount(i, samples, n), "array<double>", ["mesh"], "inner")
    sums = written(met.select("mesh", F.posexplode_outer("r").alias("i", "s")).groupBy("mesh", "i").agg(F.sum("s").alias("s")), "walk-sums")
    places = facing.groupBy("mesh").agg(F.count(F.lit(1)).alias("n")).join(walks, "mesh").select("mesh", "n", F.explode(F.sequence(F.lit(0), F.col("n_along") - 1)).alias("i"))
    means = places.join(sums, ["mesh", "i"], "left").select("mesh", "i", "n", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("v"))
    return means.groupBy("mesh").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("profile"))


def winding_spacings(facing: DataFrame, volume: DataFrame, steps: DataFrame, step: str = "grid_step") -> DataFrame:
    """(mesh, winding_spacing): distance to the next layer along the normals; ``steps`` (mesh, ``step``)."""
    walks = walk_length(steps, step=step)
    curves = spacing_profiles(facing, volume, walks).join(walks, "mesh").select("mesh", pf.smoothed(F.col("profile"), 3.0).alias("curve"), along_walk().alias("along"))
    return curves.select("mesh", pf.winding_spacing(F.col("curve"), F.col("along")).alias("winding_spacing"))


def sheet_switches(mesh: DataFrame, volume: DataFrame, z_threshold: float = Z_THRESHOLD, steps: int = FEW_STEPS) -> DataFrame:
    """One row a surface: where it appears to jump to a neighbouring layer, or why that cannot be said.

    A grid line whose edges dip together (robust z at the threshold) is a seam.
    A surface darker than ``LEAST_DIP`` is degenerate, and its seams are set
    aside first; one whose grid step exceeds half the winding spacing, or whose
    spacing cannot be measured, is not adequate, and what seams are left are set
    aside as unreliable.  ``max_z`` is always reported.
    """
    volume = written(volume.select(*AXES, "value"), "volume")
    edges = written(grid_edges(mesh).where("both"), "edges")
    dips = edge_dips(edges, volume, ["mesh", "axis", "line", "place"], steps)
    scores = written(line_scores(dips, ["mesh", "axis"], "line", "dip"), "scores")
    seam = F.when(F.col("z") >= z_threshold, F.struct((-F.col("z")).alias("order"), "axis", "line", "z", F.col("line_mean").alias("mean_dip")))
    lines = scores.groupBy("mesh").agg(F.array_sort(F.collect_list(seam)).alias("seams"), F.max("z").alias("max_z"))
    sized = written(edges.groupBy("mesh").agg(F.count(F.lit(1)).alias("n_edges"), F.median(_length("a", "b")).alias("grid_step")), "grid-steps")
    spacing = winding_spacings(normals(mesh).where("valid").withColumn("pid", F.struct("r", "c")), volume, sized)
    joined = sized.join(lines, "mesh", "left").join(spacing, "mesh", "left").join(surface_intensity(mesh, volume), "mesh", "left")
    joined = joined.withColumn("adequate", ~F.isnan("winding_spacing") & (F.col("grid_step") <= 0.5 * F.col("winding_spacing"))).withColumn("degenerate", F.coalesce(F.col("level") < LEAST_DIP, F.lit(False)))
    none = F.array().cast("array<struct<order:double,axis:int,line:int,z:double,mean_dip:double>>")
    seams = F.coalesce("seams", none)
    kept = F.when(F.col("adequate") & ~F.col("degenerate"), seams).otherwise(none)
    return joined.select(
        "mesh", "grid_step", "winding_spacing", (F.col("winding_spacing") / F.nullif("grid_step", F.lit(0.0))).alias("steps_per_winding"), "adequate", "degenerate", "level", "spread", F.coalesce("max_z", F.lit(0.0)).alias("max_z"),
        F.size(kept).alias("n_seams"), F.transform(kept, lambda s: s.dropFields("order")).alias("seams"),
        F.when(F.col("degenerate"), F.size(seams)).otherwise(0).alias("n_degenerate"), F.when(~F.col("adequate") & ~F.col("degenerate"), F.size(seams)).otherwise(0).alias("n_unreliable"),
    )


def edge_lengths(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh, edge_length): the median length of the edges (mesh, u, v)."""
    return _placed(edges, vertices).groupBy("mesh").agg(F.median(_length("a", "b")).alias("edge_length"))


def _placed(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``edges`` (mesh, u, v) with both ends' coordinates, az to bx."""
    for end, p in (("u", "a"), ("v", "b")):
        edges = edges.join(vertices.select("mesh", F.col("v").alias("__v"), *[F.col(a).alias(f"{p}{a}") for a in AXES]).withColumnsRenamed({"mesh": "__m"}), (F.col("mesh") == F.col("__m")) & (F.col(end) == F.col("__v"))).drop("__m", "__v")
    return edges


def displaced_vertices(vertices: DataFrame, facing: DataFrame, distance: Column | float) -> DataFrame:
    """A planted control: the vertices beyond the median of the mesh's widest axis pushed along their normals."""
    low_high = vertices.groupBy("mesh").agg(*[(F.max(a) - F.min(a)).alias(f"s{a}") for a in AXES], *[F.median(a).alias(f"m{a}") for a in AXES])
    widest = F.when((F.col("sz") >= F.col("sy")) & (F.col("sz") >= F.col("sx")), F.col("z") > F.col("mz")).when(F.col("sy") >= F.col("sx"), F.col("y") > F.col("my")).otherwise(F.col("x") > F.col("mx"))
    moved = vertices.join(facing, ["mesh", "v"], "left").join(low_high, "mesh").withColumn("__there", widest)
    return moved.select("mesh", "v", *[F.when(F.col("__there"), F.col(a) + F.coalesce(f"n{a}", F.lit(0.0)) * distance).otherwise(F.col(a)).alias(a) for a in AXES])


def flagged_components(edges: DataFrame, dips: DataFrame, vertices: DataFrame, z_threshold: float = Z_THRESHOLD, least: int = 4, span: float = 0.4) -> DataFrame:
    """Seams of triangle meshes: connected sets of flagged edges that run across the mesh.

    ``edges`` (mesh, u, v), ``dips`` (mesh, u, v, dip), ``vertices`` (mesh, v, z, y, x).
    An edge is flagged by its robust z over the mesh.  A set of ``least`` edges or
    more counts if its vertices reach, along their first axis, over ``span`` of
    the mesh's largest extent.
    """
    named = edges.join(dips, ["mesh", "u", "v"]).withColumn("edge", F.struct("u", "v"))
    scored = line_scores(named, ["mesh"], "edge", "dip").where(F.col("z") >= z_threshold).select("mesh", "edge.u", "edge.v", "z", F.col("line_mean").alias("dip"))
    node = lambda v: F.concat_ws("/", F.col("mesh").cast("string"), F.col(v).cast("string"))
    flagged = written(scored.select("mesh", node("u").alias("a"), node("v").alias("b"), "u", "v", "z", "dip"), "flagged")
    groups = connected_components(flagged).withColumnRenamed("node", "a")
    each = written(flagged.join(groups, "a"), "flagged-sets")
    ends = each.select("mesh", "component", F.explode(F.array("u", "v")).alias("v")).distinct()
    placed = written(ends.join(vertices.select("mesh", "v", *AXES), ["mesh", "v"]), "flagged-ends")
    clouds = with_eigenvalues(placed.groupBy("mesh", "component").agg(F.count(F.lit(1)).alias("n_vertices"), *covariances())).select("mesh", "component", "n_vertices", principal_axis("e2", "e3").alias("axis"))
    along = sum([F.col(a) * F.get("axis", F.lit(i)) for i, a in enumerate(AXES) if i], F.col("z") * F.get("axis", F.lit(0)))
    reach = placed.join(clouds, ["mesh", "component"]).groupBy("mesh", "component").agg(F.first("n_vertices").alias("n_vertices"), (F.max(along) - F.min(along)).alias("reach"))
    extent = vertices.groupBy("mesh").agg(F.greatest(*[F.max(a) - F.min(a) for a in AXES]).alias("extent"))
    sizes = each.groupBy("mesh", "component").agg(F.count(F.lit(1)).alias("n_edges"), F.max("z").alias("max_z"), F.avg("z").alias("mean_z"), F.avg("dip").alias("mean_dip"))
    share = F.coalesce(F.col("reach") / F.when(F.col("extent") > 0, F.col("extent")), F.lit(0.0))
    found = sizes.join(reach, ["mesh", "component"]).join(extent, "mesh").withColumn("span_fraction", share)
    return found.where((F.col("n_edges") >= least) & (F.col("span_fraction") >= span)).select("mesh", "component", "n_edges", "n_vertices", "max_z", "mean_z", "mean_dip", "span_fraction")


def triangle_switches(vertices: DataFrame, faces: DataFrame, volume: DataFrame, z_threshold: float = Z_THRESHOLD, steps: int = FEW_STEPS, least: int = 4, span: float = 0.4) -> DataFrame:
    """One row a triangle mesh: its seams, or why they cannot be told; gates as for grid meshes."""
    edges = written(unique_edges(faces, ("mesh",)), "tri-edges")
    placed = written(_placed(edges, vertices), "tri-placed")
    dips = written(edge_dips(placed, volume, ["mesh", "u", "v"], steps), "tri-dips")
    sized = written(placed.groupBy("mesh").agg(F.count(F.lit(1)).alias("n_edges"), F.median(_length("a", "b")).alias("edge_length")), "tri-steps")
    facing = vertices.join(triangle_normals(vertices, faces), ["mesh", "v"]).withColumnRenamed("v", "pid")
    spacing = winding_spacings(facing, volume, sized, "edge_length")
    scores = line_scores(dips.withColumn("edge", F.struct("u", "v")), ["mesh"], "edge", "dip").groupBy("mesh").agg(F.max("z").alias("max_z"), F.median("line_mean").alias("median_dip"))
    seams = flagged_components(edges, dips, vertices, z_threshold, least, span).groupBy("mesh").agg(F.array_sort(F.collect_list(F.struct((-F.col("span_fraction")).alias("order"), "component", "n_edges", "n_vertices", "max_z", "mean_z", "mean_dip", "span_fraction"))).alias("seams"))
    points = vertices.withColumn("valid", F.lit(True)).withColumns({"r": F.col("v"), "c": F.lit(0)})
    joined = sized.join(scores, "mesh", "left").join(spacing, "mesh", "left").join(seams, "mesh", "left").join(surface_intensity(points, volume), "mesh", "left")
    joined = joined.withColumn("adequate", F.coalesce(~F.isnan("winding_spacing") & (F.col("edge_length") <= 0.5 * F.col("winding_spacing")), F.lit(False))).withColumn("degenerate", F.coalesce(F.col("level") < LEAST_DIP, F.lit(False)))
    found = F.coalesce(F.size("seams"), F.lit(0))
    usable = F.col("adequate") & ~F.col("degenerate")
    return joined.select(
        "mesh", "n_edges", "edge_length", "winding_spacing", "adequate", "degenerate", "level", "spread", F.when(F.col("degenerate"), 0.0).otherwise(F.coalesce("max_z", F.lit(0.0))).alias("max_z"), "median_dip",
        F.when(usable, found).otherwise(0).alias("n_seams"), F.when(usable, F.transform("seams", lambda s: s.dropFields("order"))).alias("seams"), F.when(~F.col("adequate") & ~F.col("degenerate"), found).otherwise(0).alias("n_unreliable"),
    )
