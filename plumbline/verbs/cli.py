"""Command line: ``python -m plumbline.verbs.cli VERB ...``; results are CSV, JSON and HTML files."""

from __future__ import annotations

import argparse
import os
from functools import reduce

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.operators import boxes, surfaces
from plumbline.operators.splits import write_splits
from plumbline.sources import meshes, reports, stacks, tables, tiff, windows, zarr
from plumbline.storage import written
from plumbline.verbs import audit


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline")
    verbs = top.add_subparsers(dest="verb", required=True)
    scan = verbs.add_parser("scan", help="census of a collection of label volumes")
    scan.add_argument("--labels", required=True)
    scan.add_argument("--images")
    scan.add_argument("--headers-only", action="store_true")
    scan.add_argument("--deep", action="store_true", help="also count places where the label forks")
    scan.add_argument("--names-file", help="keep to these names")
    scan.add_argument("--sample", type=int, default=0, help="a seeded sample of so many volumes")
    scan.add_argument("--seed", type=int, default=0)
    leak = verbs.add_parser("leakage", help="patches that share space, and a split that does not leak")
    leak.add_argument("--labels", help="label volumes: their names, unless there is a names file, and their real sizes")
    leak.add_argument("--images", help="image volumes, for names that have no label")
    leak.add_argument("--names-file")
    leak.add_argument("--patch-size", type=int, nargs="+", default=[300], help="of volumes that cannot be read: one value, or three as z y x")
    leak.add_argument("--assume-patch-size", action="store_true", help="take --patch-size for all and read no volume")
    leak.add_argument("--surface-class", type=int, default=1)
    leak.add_argument("--measure-seen", action="store_true", help="share of each validation patch's surface that training patches cover")
    leak.add_argument("--consistency", type=int, default=0, metavar="N", help="ask N overlapping pairs whether their labels agree")
    leak.add_argument("--k", type=int, default=5)
    leak.add_argument("--buffer", type=int, default=0)
    leak.add_argument("--mode", choices=("block", "component"), default="block")
    leak.add_argument("--trials", type=int, default=200)
    switch = verbs.add_parser("sheetswitch", help="surfaces that jump to a neighbouring layer")
    switch.add_argument("--mesh", required=True)
    switch.add_argument("--volume", required=True)
    switch.add_argument("--plant", type=float, default=0.0, help="also displace one half by so many windings, as a control")
    switch.add_argument("--window", type=int, default=0)
    switch.add_argument("--decimate", type=int, default=1)
    switch.add_argument("--z-threshold", type=float, default=surfaces.Z_THRESHOLD)
    switch.add_argument("--steps", type=int, default=surfaces.FEW_STEPS)
    align = verbs.add_parser("align", help="offset of labels from the ridge in the scan")
    align.add_argument("--naive", action="store_true", help="with the points' own largest samples")
    align.add_argument("--bootstrap", type=int, default=200)
    regularise = verbs.add_parser("regularise", help="labels whose cells agree with their volume's own offset")
    regularise.add_argument("--max-shift", type=float, default=4.0)
    regularise.add_argument("--smooth", type=float, default=0.5, help="in cells")
    for verb in (align, regularise):
        verb.add_argument("--images", required=True)
        verb.add_argument("--labels", required=True)
        verb.add_argument("--surface-class", type=int, default=1)
        verb.add_argument("--radius", type=float, help="of the search; by default from the spacing of the ridges")
        verb.add_argument("--min-global-snr", type=float, default=2.0)
        verb.add_argument("--cell", type=int, default=64)
        verb.add_argument("--min-per-cell", type=int, default=200)
    switch.add_argument("--min-span", type=float, default=0.4, help="of triangle meshes: how far across the mesh a seam runs")
    switch.add_argument("--margin", type=int, default=8, help="voxels beyond the surface's box; never less than the walk needs")
    sheet = verbs.add_parser("onsheet", help="does a surface lie on a sheet?")
    sheet.add_argument("--blocks", help="ready blocks (mesh, range, peak_offset) in a Parquet table")
    sheet.add_argument("--surface-volume", nargs="+", default=[], metavar="ZARR", help="chunks are drawn from these")
    sheet.add_argument("--mesh", help="folder of grid meshes, walked in --volume")
    sheet.add_argument("--volume")
    sheet.add_argument("--chunks", type=int, default=100)
    sheet.add_argument("--tiles", type=int, default=6, help="tiles of each mesh")
    sheet.add_argument("--block-size", type=int, default=12, help="cells along a tile's side")
    sheet.add_argument("--reach", type=float, default=70.0)
    sheet.add_argument("--step", type=float, default=1.0)
    sheet.add_argument("--seed", type=int, default=0)
    sheet.add_argument("--baseline")
    sheet.add_argument("--compare", nargs=2, metavar=("A", "B"))
    for verb in (scan, leak, switch, align, regularise, sheet):
        verb.add_argument("--out", default="plumbline_out")
    return top


def _aligned(spark: SparkSession, args):
    """For each shape of volumes: the shape, its volumes, label points, cells and summary."""
    heads = tiff.volume_headers(spark, args.labels).where("error is null").select(F.col("name").alias("volume"), "n_pages", "height", "width")
    image = tiff.voxels(tiff.volume_planes(spark, args.images), keep_zero=True)
    label = tiff.voxels(tiff.volume_planes(spark, args.labels)).where(F.col("value") == args.surface_class)
    image = written(image, "images")
    points = written(audit.label_points(label, image), "points")
    for size in heads.select("n_pages", "height", "width").distinct().collect():  # as many rows as there are shapes
        own = heads.where((F.col("n_pages") == size[0]) & (F.col("height") == size[1]) & (F.col("width") == size[2]))
        mine = points.join(own, "volume", "left_semi")
        cells, summary = audit.align(image.join(own, "volume", "left_semi"), mine, tuple(size), args.radius, cell=args.cell, least=args.min_per_cell, least_snr=args.min_global_snr, resamples=getattr(args, "bootstrap", 0), naive=getattr(args, "naive", False))
        yield tuple(size), own, mine, cells, written(summary, "summary")


def _leakage(spark: SparkSession, args) -> int:
    if len(args.patch_size) not in (1, 3) or not (args.names_file or args.labels):
        return 2
    size = args.patch_size[0] if len(args.patch_size) == 1 else tuple(args.patch_size)
    if args.names_file:
        names = tables.names(spark, args.names_file)
    else:
        names = tiff.files(spark, args.labels).select("name")
        names = (names.union(tiff.files(spark, args.images).select("name")) if args.images else names).distinct()
    names = written(names, "names")
    if names.isEmpty() or boxes.parse_names(names)[0].isEmpty():
        return 2
    sizes = surface = present = None
    if args.labels:
        present = tiff.files(spark, args.labels, names).select("name")
        if not args.assume_patch_size:
            heads = tiff.volume_headers(spark, args.labels, names=names).where("error is null")
            sizes = written(heads.groupBy("name").agg(F.max("n_pages").alias("sz"), F.max("height").alias("sy"), F.max("width").alias("sx")), "sizes")
        if args.measure_seen or args.consistency:
            label = tiff.voxels(tiff.volume_planes(spark, args.labels, names=names), keep_zero=args.surface_class == 0)
            surface = label.where(F.col("value") == args.surface_class).withColumnRenamed("volume", "name")
    found = audit.leak(names, sizes, size, args.k, args.buffer, args.mode, args.trials, surface, args.measure_seen, args.consistency, present)
    told = {k: found[k] for k in ("overlap", "random", "stats", "seen_usual_summary", "seen_blocked_summary", "consistency", "worst") if k in found}
    shapes = {} if sizes is None else {"sizes_read": sizes.count(), "distinct_sizes": sizes.groupBy("sz", "sy", "sx").count().orderBy(F.desc("count"), "sz", "sy", "sx")}
    counts = {"n_patches": names.count() - found["unparsed"].count(), "n_unparsed": found["unparsed"].count(), "n_residual": found["residual"].count(), "buffer": args.buffer}
    reports.write_summary(f"{args.out}/leakage.json", found["usual"].first().asDict() | counts | shapes | told)
    for kind in ("usual", "blocked"):
        if f"seen_{kind}" in found:
            reports.write_csv(found[f"seen_{kind}"], f"{args.out}/seen_{kind}.csv")
    write_splits(found["folds"].select("fold", "role", F.col("id").alias("name")), f"{args.out}/splits_final.json")
    reports.write_html(f"{args.out}/leakage.html", "leakage", counts, {"usual": found["usual"]} | told)
    return 0


def _kinds(spark: SparkSession, path: str) -> set[str]:
    """Which of tif, obj and ply lie under a path: a few rows, whatever the number of files."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return {r[0] for r in listed.select(F.lower(F.regexp_extract("path", r"\.(tif|obj|ply)$", 1))).distinct().collect()} - {""}


def _grids(spark: SparkSession, args, plant: float = 0.0):
    """Grid meshes, their volume's part that the walks reach, or None where no vertex is valid."""
    mesh = written(tiff.tifxyz(spark, args.mesh), "mesh")
    valid = mesh.where("valid")
    edges = surfaces.grid_edges(mesh).where("both").agg(F.max(surfaces._length("a", "b"))).first()[0] or 0.0
    box = audit.reach_box(valid, edges * max(1, getattr(args, "decimate", 1)), plant, max(getattr(args, "margin", 8), int(getattr(args, "reach", 0)) + 1))
    return None if box is None else (mesh, written(windows.volume_window(spark, args.volume, *box), "window"))


def _sheetswitch(spark: SparkSession, args) -> int:
    """Grid and triangle meshes of a path, each kind in its own table; the volume is read around the surfaces alone."""
    kinds, flagged, n = _kinds(spark, args.mesh), [], 0
    if not kinds:
        return 2
    out = {}
    if "tif" in kinds:
        found = _grids(spark, args, args.plant)
        if found:
            out["sheetswitch"] = audit.sheetswitch(*found, args.plant, args.window, args.decimate, args.z_threshold, args.steps)
    tables_ = [read(spark, args.mesh) for kind, read in (("obj", meshes.obj), ("ply", meshes.ply)) if kind in kinds]
    if tables_:
        vertices, faces = (written(reduce(lambda x, y: x.unionByName(y), [t[k] for t in tables_]), "triangles") for k in (0, 1))
        longest = surfaces._placed(surfaces.unique_edges(faces, ("mesh",)), vertices).agg(F.max(surfaces._length("a", "b"))).first()[0]
        box = audit.reach_box(vertices, longest or 0.0, args.plant, args.margin)
        if box and longest is not None:
            volume = written(windows.volume_window(spark, args.volume, *box), "window")
            out["sheetswitch_triangles"] = audit.triangle_sheetswitch(vertices, faces, volume, args.plant, args.z_threshold, args.steps, args.min_span)
        reports.write_csv(meshes.errors(spark, args.mesh), f"{args.out}/mesh_errors.csv")
    for name, found in out.items():
        found = written(found, name)
        reports.write_csv(found, f"{args.out}/{name}.csv")
        real = found.where("kind = 'real'")
        n += real.count()
        flagged += [r.asDict() for r in real.where("n_seams > 0").select("mesh", "n_seams", "max_z").orderBy(F.desc("max_z"), "mesh").limit(reports.TABLE_ROWS).collect()]
    reports.write_summary(f"{args.out}/sheetswitch_summary.json", {"n_meshes": n, "z_threshold": args.z_threshold, "flagged": sorted(flagged, key=lambda r: (-r["max_z"], r["mesh"]))[: reports.TABLE_ROWS]})
    return 0


def _sheet_blocks(spark: SparkSession, args):
    """Blocks of all sources that were named, and the surfaces that gave none; None without a source."""
    sources, named = [], []
    columns = ["mesh", "n", "range", "at_zero", "peak_offset"]
    if args.blocks:
        sources.append(spark.read.parquet(args.blocks))
    for store in args.surface_volume:
        named.append(store.rstrip("/"))
        sources.append(zarr.drawn_profiles(spark, zarr.array_meta(zarr.meta_texts(spark, [store])), store, args.chunks, args.seed).select(*columns))
    if args.mesh and args.volume:
        found = _grids(spark, args)
        if found:
            named += [r[0] for r in found[0].select("mesh").distinct().collect()]  # the surfaces of one call
            sources.append(audit.sheet_blocks(*found, args.reach, args.step, args.block_size, args.tiles, args.seed).select(*columns))
    if not sources:
        return None, []
    blocks = written(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), sources), "blocks")
    return blocks, sorted(set(named) - {r[0] for r in blocks.select("mesh").distinct().collect()})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    os.makedirs(args.out, exist_ok=True)
    if args.verb == "scan":
        keep = tables.names(spark, args.names_file) if args.names_file else None
        found = audit.scan(spark, args.labels, args.images, args.headers_only, args.deep, keep, args.sample, args.seed)
        volumes = found["rows"].count()
        if not volumes:
            return 2
        reports.write_csv(found["rows"], f"{args.out}/scan.csv")
        if "classes" in found:
            reports.write_csv(found["classes"], f"{args.out}/classes.csv")
        reports.write_summary(f"{args.out}/scan_summary.json", {"n_volumes": volumes} | {k: v for k, v in found.items() if k in ("by_shape", "by_compression", "unreadable", "unpaired", "mode", "off_scheme", "surface_classes")})
        reports.write_html(f"{args.out}/scan.html", "scan", {"volumes": volumes}, {k: v for k, v in found.items() if k != "rows"})
    elif args.verb == "leakage":
        return _leakage(spark, args)
    elif args.verb in ("align", "regularise"):
        found = list(_aligned(spark, args))
        if not found:
            return 2
        union = lambda k: reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [f[k] for f in found])
        reports.write_csv(union(4), f"{args.out}/align.csv")
        reports.write_csv(union(3), f"{args.out}/cells.csv")
        if args.verb == "regularise":
            told = []
            for shape, own, points, cells, summary in found:
                label, report = audit.regularise(points, cells, summary, shape, args.cell, args.max_shift, args.smooth)
                told.append(report)
                stacks.write_stacks(stacks.pages(label.withColumn("value", F.lit(args.surface_class)), own), f"{args.out}/labels")
            reports.write_csv(reduce(lambda x, y: x.unionByName(y), told), f"{args.out}/regularise.csv")
    elif args.verb == "onsheet":
        blocks, empty = _sheet_blocks(spark, args)
        if blocks is None:
            return 2
        told = audit.onsheet(blocks, args.baseline).withColumn("error", F.lit(None).cast("string"))
        if empty:
            told = told.unionByName(spark.createDataFrame([(m, "no usable blocks") for m in empty], "mesh string, error string"), allowMissingColumns=True)
        reports.write_csv(told, f"{args.out}/onsheet.csv")
        if args.compare:
            reports.write_json(audit.compare(blocks, *args.compare), f"{args.out}/compare.json")
    else:
        return _sheetswitch(spark, args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
