"""The six audits as DataFrame functions: scan, leakage, align, regularise, sheetswitch, onsheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import profiles as pf
from plumbline.operators import boxes, census, corpus, leakage, morphology, orientation, ranks, resampling, splits, surfaces, voxels, warp
from plumbline.sources import tiff
from plumbline.storage import written


SHEET_MOST = 0.5  #: share of a class's voxels that may outlast the erosions before it counts as a region


def scan(spark: SparkSession, labels: str, images: str | None = None, headers_only: bool = False, deep: bool = False, names: DataFrame | None = None, sample: int = 0, seed: int = 0) -> dict[str, DataFrame]:
    """Header census of a collection, and, unless ``headers_only``, what ``label_audit`` finds in its labels.

    ``names`` (name) keeps to these volumes, and ``sample`` to so many drawn ones, before
    anything but the listing is read.
    """
    if sample:
        listed = tiff.files(spark, labels, names).select("name")
        if images:
            listed = listed.union(tiff.files(spark, images, names).select("name"))
        names = written(census.seeded_sample(listed.distinct(), "name", sample, seed), "scan-names")
    heads = written(tiff.volume_headers(spark, labels, tiff.HEADER_BYTES if headers_only else None, names), "scan-headers")
    rows = heads.select("name", F.concat_ws("x", "n_pages", "height", "width").alias("shape"), F.concat_ws("x", "height", "width").alias("plane_shape"), "dtype", "compression", "file_size", "error")
    if images:
        seen = tiff.volume_headers(spark, images, tiff.HEADER_BYTES, names).select("name", "path", F.col("error").alias("image_error"))
        pairs = census.pair(seen, heads.select("name", "path"))
        sides = pairs.select("name", F.col("image").isNotNull().alias("has_image"), F.col("label").isNotNull().alias("has_label")).join(seen.drop("path"), "name", "left")
        rows = rows.join(sides, "name", "full_outer")
    else:
        rows = rows.withColumns({"has_image": F.lit(True), "has_label": F.lit(True), "image_error": F.lit(None).cast("string")})
    if not headers_only:
        rows = rows.withColumn("plane_shape", F.lit(None).cast("string"))
    out = census.header_census(rows) | {"rows": rows}
    if headers_only:
        return out
    all_voxels = tiff.voxels(tiff.volume_planes(spark, labels, names=names), keep_zero=True)
    v = written(all_voxels.withColumn("value", F.col("value").cast("int")), "scan-voxels")
    shape = heads.where("error is null").select(F.col("name").alias("volume"), F.col("n_pages").alias("sz"), F.col("height").alias("sy"), F.col("width").alias("sx"))
    schemes, classes, surfaces_ = label_audit(v, shape, deep, seed=seed)
    of = schemes.groupBy("volume").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("value")), lambda x: x.cast("string"))).alias("scheme"), F.sum("fraction").alias("__read"))
    told = of.join(surfaces_, "volume", "left").withColumnRenamed("volume", "name")
    read = F.coalesce("__read", F.lit(0.0))
    lost = F.when(F.col("error").isNull() & F.col("has_label"), F.when(read == 0, "no page could be read").when(read < 1 - 1e-9, "some pages could not be read"))
    rows = written(rows.join(told, "name", "left").withColumn("label_read_error", lost).drop("__read"), "scan-rows")
    of = of.drop("__read")
    thickest = rows.where("surface_thickness_p95 is not null").select("name", "surface_class", *[c for c in surfaces_.columns if c.startswith("surface_") and c != "surface_class"])
    return out | {
        "rows": rows, "schemes": schemes, "classes": classes, "mode": census.mode_scheme(of, "scheme"), "off_scheme": census.off_scheme(of.withColumn("all", F.lit(0)), ["all"], "scheme").drop("all"),
        "surface_classes": census.counted(rows.where("scheme is not null"), "surface_class"), "thickest": thickest.orderBy(F.desc("surface_thickness_p95"), "name"),
    }


def label_audit(v: DataFrame, shape: DataFrame, deep: bool = False, most: int = voxels.MOST_EROSIONS, samples: int | None = 4000, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Schemes, classes and surface classes of label volumes.

    ``v`` (volume, z, y, x, value) with zeros, ``shape`` (volume, sz, sy, sx).  The first
    four classes other than zero of each volume are measured, each by itself, as a thin
    sheet and a bulky region have no thickness in common.  A class of which half outlasts
    the erosions is a region: its ``skipped`` says so and only its thickness is given.
    Components, planarity and, if ``deep``, junctions of the others follow.  All volumes
    and classes are measured together, whatever their shapes.  A volume without a sheet
    has a null ``surface_class``.
    """
    schemes = written(census.label_scheme(v, shape), "schemes")
    listed = schemes.groupBy("volume").agg(census.class_list(F.collect_list("value")).alias("c"))
    # A class's key carries its volume's sizes, so that one pass serves volumes of all shapes.
    classes = listed.select("volume", F.explode("c").alias("value")).join(shape, "volume").withColumn("cls", F.concat_ws("|", "value", "sz", "sy", "sx", "volume"))
    sizes = {a: F.split_part("cls", F.lit("|"), F.lit(k)).cast("int") for k, a in enumerate("zyx", 2)}
    masks = written(v.join(classes.select("volume", "value", "cls"), ["volume", "value"]).select("cls", "z", "y", "x"), "class-voxels")
    thick = written(voxels.thickness_stats(masks, "cls", sizes, most).drop("n"), "class-thickness")
    sheets = masks.join(thick.where(F.col("saturated") < SHEET_MOST).select("cls"), "cls", "left_semi")
    labelled = written(voxels.components(sheets, "cls"), "class-components")
    found = classes.join(schemes.select("volume", "value", "n", "fraction", "border_touch"), ["volume", "value"])
    found = found.join(thick.withColumnsRenamed({c: f"thickness_{c}" for c in ("median", "p95", "max", "mean")}), "cls", "left")
    found = found.join(voxels.component_stats(labelled, "cls"), "cls", "left").join(voxels.planarity_summary(voxels.planarity(labelled, "cls"), "cls"), "cls", "left")
    if deep:
        found = found.join(morphology.junction_density(morphology.junctions(sheets, "cls", samples=samples, seed=seed), "cls"), "cls", "left")
    why = F.format_string("thickness saturated for %.0f%% of voxels: a region, not a sheet", 100 * F.col("saturated"))
    found = written(found.withColumn("skipped", F.when(F.col("saturated") >= SHEET_MOST, why)).drop("cls", "sz", "sy", "sx"), "classes")
    of = {"fraction": "fraction", "thickness_p95": "thickness_p95", "components": "n_components", "fragment_share": "fragment_share", "worst_planarity": "worst_planarity"} | ({"junction_fraction": "junction_fraction"} if deep else {})
    best = census.surface_class(found).withColumnRenamed("thickness_median", "surface_thickness_median")
    own = found.select("volume", F.col("value").alias("surface_class"), *[F.col(c).alias(f"surface_{n}") for n, c in of.items()])
    return schemes, found, best.join(own, ["volume", "surface_class"], "left")


def leak(names: DataFrame, sizes: DataFrame | None = None, size: int | tuple[int, int, int] = 300, k: int = 5, buffer: int = 0, mode: str = "block", trials: int = 20, surface: DataFrame | None = None, measure_seen: bool = False, consistency: int = 0, present: DataFrame | None = None) -> dict[str, DataFrame]:
    """Overlap of patches, the leakage of the usual split, and a split without it.

    ``surface`` (name, z, y, x): the labelled surface's voxels, in each patch's own
    coordinates.  With it, ``measure_seen`` gives the share of each validation patch's
    surface that training patches cover too, under both splits, and ``consistency``
    asks so many overlapping pairs whether they agree on what they share; ``present``
    (name): the patches that have a label volume (all, if not given), as a pair of which
    one has none is not asked.
    """
    parsed, unparsed = boxes.parse_names(names, sizes, size)
    b = written(parsed.withColumn("id", F.col("name")), "boxes")
    graph = written(boxes.overlap_graph(b, buffer), "graph")
    usual = splits.seeded_split(b.select("name"), k).select(F.col("name").alias("id"), "fold")
    folds = splits.declared_folds(usual, k)
    blocked = splits.declared_folds(splits.blocked_kfold(b, graph, k, mode), k)
    safe = written(leakage.with_buffer_zone(blocked, graph), "folds")
    numbered = splits._numbered(b.select("name"))[0].select(F.col("name").alias("id"), F.col("i").cast("long").alias("i"))
    ids = graph.join(numbered.withColumnRenamed("id", "a").withColumnRenamed("i", "ia"), "a").join(numbered.withColumnRenamed("id", "b").withColumnRenamed("i", "ib"), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"), "fraction")
    n = b.count()
    if n * trials <= splits.MOST_NAMES:
        random = splits.random_trials(b.sparkSession, n, ids, k, trials)
    else:  # such shuffles are drawn in one place; beyond their bound trials go by md5
        random = splits.hashed_trials(b.select("id"), graph, k, trials)
    out = {
        "unparsed": unparsed, "overlap": boxes.overlap_summary(graph), "usual": leakage.split_leakage(folds, graph), "random": random,
        "folds": safe, "stats": leakage.fold_stats(blocked, safe), "residual": leakage.residual_leaks(safe, graph), "splits": splits.splits_json(safe.select("fold", "role", F.col("id").alias("name"))),
    }
    if surface is None or not (measure_seen or consistency):
        return out
    placed = surface.join(b.select("name", *[F.col(f"{a}0").alias(f"__{a}") for a in "zyx"]), "name")
    on = written(placed.select(F.col("name").alias("id"), *[(F.col(a) + F.col(f"__{a}")).alias(a) for a in "zyx"]), "surface-voxels")
    if measure_seen:
        for kind, split in (("usual", folds), ("blocked", safe)):
            each = written(leakage.seen_fraction(on.join(split.where("role = 'val'").select("id").distinct(), "id", "left_semi"), leakage.training_boxes(split, graph, b)), "seen")
            out |= {f"seen_{kind}": each, f"seen_{kind}_summary": leakage.seen_summary(each)}
    if consistency:
        asked = leakage.drawn_pairs(graph, consistency)
        for side in "ab" if present is not None else "":
            asked = asked.join(present.select(F.col("name").alias(side)).distinct(), side, "left_semi")
        pairs = leakage.shared_boxes(asked, b)
        agreed = written(leakage.pair_consistency(on, pairs), "consistency")
        out |= {"consistency": leakage.consistency_summary(agreed), "worst": leakage.worst(agreed)}
    return out


def label_points(label: DataFrame, volume: DataFrame | None = None, k: int = 40, ties: int = 10) -> DataFrame:
    """(volume, pid, z, y, x, nz, ny, nx, component): label voxels (volume, z, y, x) with unit normals of their ``k`` nearest ones.

    Signs run along the surface, so that normals of one component agree; with
    ``volume`` (volume, z, y, x, value) each component faces the brighter side.
    """
    named = written(label.select("volume", F.concat_ws(",", "z", "y", "x").alias("pid"), *[F.col(a).cast("double").alias(a) for a in "zyx"]).dropDuplicates(["volume", "pid"]), "label-points")
    facing = written(named.join(voxels.point_normals(named, "volume", "pid", k), ["volume", "pid"]), "label-axes")
    agreed = written(orientation.consistent_normals(facing, "volume", "pid", ties), "label-normals")
    return agreed if volume is None else surfaces.oriented(agreed, volume, ["volume", "component"])


def _sampled(volume: DataFrame, points: DataFrame, shape: tuple[int, int, int], radius: float | str, step: float) -> DataFrame:
    """(volume, pid, z, y, x, radius, profile) of the points whose whole walk is inside the volume."""
    points = points.withColumn("radius", F.lit(float(radius))) if not isinstance(radius, str) else points
    r = F.col("radius")
    point, normal = F.struct("z", "y", "x"), F.struct(*[F.col(f"n{a}").alias(a) for a in "zyx"])
    inside = points.where(pf.walk_inside(point, normal, r, shape))
    walked = inside.select("volume", "pid", F.posexplode(pf.walk(point, normal, pf.offsets(r, step))).alias("i", "p")).select("volume", F.struct("pid", "i").alias("at"), *[F.col(f"p.{a}").alias(a) for a in "zyx"])
    sampled = voxels.trilinear(walked, volume, "volume", "at", outside="clamp", shape=dict(zip("zyx", shape, strict=True))).select("volume", "at.pid", "at.i", "sample")
    profiles = sampled.groupBy("volume", "pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sample"))), lambda s: s["sample"]).alias("profile"))
    return inside.select("volume", "pid", "z", "y", "x", "radius").join(profiles, ["volume", "pid"])


def ridge_spacing(volume: DataFrame, points: DataFrame, shape: tuple[int, int, int], most: float = 45.0, step: float = 0.5) -> DataFrame:
    """(volume, centre, positive, negative, spacing, radius): the neighbouring ridges of the mean profile, and how far a search may reach."""
    reach = float(min(most, 0.4 * min(shape)))
    means = surfaces.mean_profiles(_sampled(volume, points, shape, reach, step), ["volume"], "profile")
    return means.select("volume", pf.neighbour_ridges(pf.smoothed(F.col("profile"), max(2.0 / step, 1.0)), pf.offsets(reach, step)).alias("n")).select("volume", "n.*")


def align(volume: DataFrame, points: DataFrame, shape: tuple[int, int, int], radius: float | None = None, step: float = 0.5, cell: float = 64, least: int = 200, least_snr: float = 2.0, resamples: int = 200, naive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cells and summary of where a label lies relative to the ridge.

    ``volume`` (volume, z, y, x, value); ``points`` (volume, pid, z, y, x, nz, ny,
    nx): label points with unit normals.  A point counts if its whole walk is
    inside the volume.  Without a radius, each volume's own follows from the spacing
    of its ridges.  The summary's ``global_offset`` is null where the mean profile's
    contrast is under ``least_snr`` times the volume's noise, or the noise could not
    be estimated; the raw figure stays beside it, with its bootstrap interval.
    ``naive``: with the points' own largest samples, for comparison.
    """
    spacing = None
    if radius is None:
        spacing = written(ridge_spacing(volume, points, shape), "spacing")
        points = points.drop("radius").join(spacing.select("volume", "radius"), "volume", "left").withColumn("radius", F.coalesce("radius", F.lit(6.0)))
    noises = written(voxels.noise_sigma(volume, "volume"), "noise")
    rows = written(_sampled(volume, points, shape, "radius" if radius is None else radius, step).join(noises, "volume", "left").withColumn("noise_sigma", F.coalesce("noise_sigma", F.lit(1e-6))), "profiles")
    cells = written(surfaces.aligned_cells(rows, "volume", "radius", step, "noise_sigma", cell, least), "cells")
    along, smooth = pf.offsets(F.col("radius"), step), max(0.5 / step, 0.5)
    whole = surfaces.mean_profiles(rows, ["volume", "radius"], "profile").join(noises, "volume", "left").select(
        "volume", F.col("n").alias("n_points"), "radius", "noise_sigma", pf.value_range(F.col("profile")).alias("contrast"), pf.peak_offset(pf.smoothed(F.col("profile"), smooth), along).alias("global_offset_raw")
    )
    snr = F.col("contrast") / F.col("noise_sigma")
    reliable = F.coalesce((snr >= least_snr) & (F.col("noise_sigma") > 1e-5), F.lit(False))
    gate = whole.withColumns({"global_snr": snr, "reliable": reliable}).withColumn("global_offset", F.when(F.col("reliable"), F.col("global_offset_raw")))
    interval = resampling.peak_bootstrap(rows, "volume", "pid", "profile", along, smooth, resamples)
    gate = gate.join(interval.withColumnsRenamed({"low": "global_low", "high": "global_high"}), "volume", "left")
    if spacing is not None:
        gate = gate.join(spacing.drop("radius").withColumnsRenamed({"centre": "ridge_at", "positive": "ridge_pos", "negative": "ridge_neg"}), "volume", "left")
    if naive:
        own = surfaces.naive_alignment(rows, "volume", "radius", step, noises.agg(F.median("noise_sigma")).first()[0] or 1e-6)
        gate = gate.join(own.withColumnsRenamed({c: f"naive_{c}" for c in own.columns if c != "volume"}), "volume", "left")
    return cells, gate.join(surfaces.alignment_summary(cells, "volume"), "volume", "left")


def regularise(points: DataFrame, cells: DataFrame, summary: DataFrame, shape: tuple[int, int, int], cell: float = 64, most: float = 4.0, smooth: float = 0.5, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The label with its cells drawn to the volume's own offset, and a report of every volume.

    ``points`` as ``label_points`` gives them; ``cells`` and ``summary`` as ``align``
    does.  A volume without a resolved cell, or whose global offset is unreliable, or
    whose cells agree already, comes out as it is, with the reason.
    """
    ok = cells.where("status = 'ok'").groupBy("volume").agg(F.count(F.lit(1)).alias("n_resolved"))
    told = summary.select("volume", "global_offset_raw", "reliable").join(ok, "volume", "full_outer")
    before = points.groupBy("volume").agg(F.count(F.lit(1)).alias("voxels_before"))
    told = before.join(told, "volume", "left").withColumns({"n_resolved": F.coalesce("n_resolved", F.lit(0)), "reliable": F.coalesce("reliable", F.lit(False))})
    open_ = told.where("reliable and n_resolved > 0").select("volume")
    deltas = written(warp.delta_cells(cells.join(open_, "volume", "left_semi"), summary, shape, cell, smooth), "delta-cells")
    far = deltas.groupBy("volume").agg(F.max(F.least(F.abs("value"), F.lit(float(most)))).alias("max_abs_shift"))
    on_label = warp.field_at(points, deltas, shape, cell, "pid").groupBy("volume").agg(F.avg(F.least(F.abs("shift"), F.lit(float(most)))).alias("mean_abs_shift_on_label"))
    told = written(told.join(far, "volume", "left").join(on_label, "volume", "left"), "regularise")
    moving = told.where("reliable and n_resolved > 0 and max_abs_shift >= 1e-3").select("volume")
    own = points.join(moving, "volume", "left_semi")
    old = points.select("volume", *[F.col(a).cast("int").alias(a) for a in "zyx"])
    new = warp.warped(old.join(moving, "volume", "left_semi"), own, deltas.join(moving, "volume", "left_semi"), shape, cell, most, threshold)
    out = written(new.unionByName(old.join(moving, "volume", "left_anti")), "regularised")
    both = old.withColumn("was", F.lit(1)).join(out.withColumn("now", F.lit(1)), ["volume", "z", "y", "x"], "full_outer").groupBy("volume")
    counts = both.agg(F.count("now").alias("voxels_after"), F.count_if(F.col("was").isNull() | F.col("now").isNull()).alias("voxels_moved"))
    reason = F.when(F.col("n_resolved") == 0, "no resolved cells").when(~F.col("reliable"), "global offset unreliable").when(F.col("max_abs_shift") < 1e-3, "every cell already agrees with the volume")
    report = told.join(counts, "volume", "left").withColumns({"reason": reason, "changed": F.coalesce(F.col("voxels_moved") > 0, F.lit(False))})
    return out, report


def _spacings(real: DataFrame) -> DataFrame:
    """(mesh, winding_spacing) of the meshes that have one."""
    return real.where(F.col("winding_spacing").isNotNull() & ~F.isnan("winding_spacing")).select("mesh", "winding_spacing")


def sheetswitch(mesh: DataFrame, volume: DataFrame, plant: float = 0.0, window: int = 0, every: int = 1, z_threshold: float = surfaces.Z_THRESHOLD, steps: int = surfaces.FEW_STEPS) -> DataFrame:
    """Seams of delivered surfaces, and, with ``plant``, of the same ones with one half displaced by so many windings.

    A surface whose winding spacing cannot be measured is not planted.
    """
    own = mesh
    if window:
        best = surfaces.best_window(own, window)
        at = best.select("mesh", F.col("r").alias("r0"), F.col("c").alias("c0"))
        own = own.join(at, "mesh").where((F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r0") + window) & (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c0") + window)).withColumns({"r": F.col("r") - F.col("r0"), "c": F.col("c") - F.col("c0")}).drop("r0", "c0")
    if every > 1:
        own = surfaces.decimated(own, every)
    real = surfaces.sheet_switches(own, volume, z_threshold, steps).withColumn("kind", F.lit("real"))
    if not plant:
        return real
    real = written(real, "switches")
    moved = surfaces.displaced(surfaces.normals(own).join(_spacings(real), "mesh"), plant * F.col("winding_spacing")).select("mesh", "r", "c", "z", "y", "x", "valid")
    return real.unionByName(surfaces.sheet_switches(written(moved, "planted"), volume, z_threshold, steps).withColumn("kind", F.lit("plant")))


def triangle_sheetswitch(vertices: DataFrame, faces: DataFrame, volume: DataFrame, plant: float = 0.0, z_threshold: float = surfaces.Z_THRESHOLD, steps: int = surfaces.FEW_STEPS, span: float = 0.4) -> DataFrame:
    """``sheetswitch`` for triangle meshes; ``span``: how far across a mesh a seam must run."""
    real = surfaces.triangle_switches(vertices, faces, volume, z_threshold, steps, span=span).withColumn("kind", F.lit("real"))
    if not plant:
        return real
    real = written(real, "switches")
    own = vertices.join(_spacings(real), "mesh")
    moved = written(surfaces.displaced_vertices(own, surfaces.triangle_normals(vertices, faces), plant * F.col("winding_spacing")), "planted")
    return real.unionByName(surfaces.triangle_switches(moved, faces.join(_spacings(real).select("mesh"), "mesh", "left_semi"), volume, z_threshold, steps, span=span).withColumn("kind", F.lit("plant")))


def reach_box(points: DataFrame, longest: float, plant: float = 0.0, margin: int = 8) -> tuple[tuple[int, int, int], tuple[int, int, int]] | None:
    """The box around all points (z, y, x) that holds every walk along their normals; None without points.

    ``longest``: the longest edge, which bounds the grid step that the walk's length
    follows from; a winding is no longer than such a walk, so ``plant`` of them are so
    many walks more.
    """
    most = int(max(margin, 6.0 * longest, 40.0) * (1.0 + abs(plant))) + 3
    ends = points.agg(*[f(a) for a in "zyx" for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return None
    return tuple(int(ends[k]) - most for k in (0, 2, 4)), tuple(int(ends[k]) + most + 1 for k in (1, 3, 5))


def sheet_blocks(mesh: DataFrame, volume: DataFrame, reach: float = 70.0, step: float = 1.0, tile: int = 12, most: int = 6, seed: int = 0) -> DataFrame:
    """(mesh, tr, tc, n, range, at_zero, peak_offset) of ``most`` accepted tiles of each grid mesh, in the order of their md5.

    ``volume`` (z, y, x, value).  The tiles that have enough vertices are known from
    the mesh alone; of those only the first three times ``most`` are walked at a time,
    until every mesh has its tiles or none are left.
    """
    facing = written(surfaces.normals(mesh).where("valid"), "facing")
    size = mesh.groupBy("mesh").agg(F.max("r").alias("__rows"), F.max("c").alias("__cols"))
    at = {"tr": F.floor(F.col("r") / tile).cast("int"), "tc": F.floor(F.col("c") / tile).cast("int")}
    tiles = facing.withColumns(at).groupBy("mesh", "tr", "tc").agg(F.count(F.lit(1)).alias("__filled")).join(size, "mesh")
    whole = tiles.where(((F.col("tr") + 1) * tile <= F.col("__rows") + 1) & ((F.col("tc") + 1) * tile <= F.col("__cols") + 1) & (F.col("__filled") >= tile * tile // 2))
    draw = F.md5(F.concat_ws("#", F.lit(str(seed)), F.col("mesh").cast("string"), "tr", "tc"))
    order = written(whole.withColumn("__turn", F.row_number().over(Window.partitionBy("mesh").orderBy(draw, "tr", "tc"))).select("mesh", "tr", "tc", "__turn"), "tiles")
    scan, pass_, out, open_ = volume.withColumn("key", F.lit(0)), 3 * most, None, order.select("mesh").distinct()
    at_turn = 0
    while True:
        chosen = order.where((F.col("__turn") > at_turn) & (F.col("__turn") <= at_turn + pass_)).join(open_, "mesh", "left_semi")
        own = facing.withColumns(at).join(chosen, ["mesh", "tr", "tc"])
        walked = own.select(F.lit(0).alias("key"), "mesh", "r", "c", F.posexplode(pf.walk(F.struct("z", "y", "x"), F.struct(*[F.col(f"n{a}").alias(a) for a in "zyx"]), pf.offsets(reach, step))).alias("i", "p"))
        points = walked.select("key", F.struct("mesh", "r", "c", "i").alias("at"), *[F.col(f"p.{a}").alias(a) for a in "zyx"])
        sampled = voxels.trilinear(points, scan, "key", "at").select("at.*", "sample")
        profiles = sampled.groupBy("mesh", "r", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sample"))), lambda s: s["sample"]).alias("profile"))
        found = written(surfaces.block_profiles(profiles, "mesh", tile, reach, step).join(chosen, ["mesh", "tr", "tc"]), "blocks")
        out = found if out is None else out.unionByName(found)
        at_turn += pass_
        enough = out.groupBy("mesh").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most).select("mesh")
        open_ = order.where(F.col("__turn") > at_turn).select("mesh").distinct().join(enough, "mesh", "left_anti")
        if open_.isEmpty():
            break
    first = F.row_number().over(Window.partitionBy("mesh").orderBy("__turn"))
    return out.withColumn("__first", first).where(F.col("__first") <= most).drop("__first", "__turn")


def onsheet(blocks: DataFrame, baseline: str | None = None, key: str = "mesh") -> DataFrame:
    """Spread of block ranges per surface, with a verdict against the baseline surface's median."""
    columns = [F.sum("n").alias("n_columns")] if "n" in blocks.columns else []
    s = ranks.spread_summary(blocks, [key], "range").join(blocks.groupBy(key).agg(F.median(F.abs("peak_offset")).alias("peak_offset_abs_median"), *columns), key)
    if baseline is None:
        return s.withColumn("verdict", F.lit(None).cast("string"))
    base = s.where(F.col(key) == baseline).agg(F.max("median")).first()[0]
    return s.withColumn("verdict", corpus.verdict(F.col("median"), F.lit(base).cast("double")))


def compare(blocks: DataFrame, a: str, b: str, key: str = "mesh") -> DataFrame:
    """One-sided Mann-Whitney test that surface ``a`` has lower ranges than ``b``."""
    two = blocks.where(F.col(key).isin(a, b)).withColumn("all", F.lit(1))
    medians = two.groupBy("all").agg(F.median(F.when(F.col(key) == a, F.col("range"))).alias("median_a"), F.median(F.when(F.col(key) == b, F.col("range"))).alias("median_b"))
    return ranks.mann_whitney_less(two, ["all"], F.col(key) == a, "range").join(medians, "all").drop("all")
