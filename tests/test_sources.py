"""File sources, sinks, the command line and the resumable sweep."""

import json
import struct
import zlib

import numpy as np
import pytest
from plumbline.operators import corpus
from plumbline.operators.morphology import arms
from plumbline.sources import meshes, reports, tables, tiff, windows, zarr
from plumbline.streaming import resume
from plumbline.verbs import audit, cli
from pyspark.sql import functions as F


def write_tiff(path, a, order="<", deflate=False):
    a = np.asarray(a)
    a = a[None] if a.ndim == 2 else a
    kind = {"u1": (8, 1), "u2": (16, 1), "f4": (32, 3)}[a.dtype.str[1:]]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    for k, page in enumerate(a):
        data = page.astype(page.dtype.newbyteorder(order)).tobytes()
        data = zlib.compress(data) if deflate else data
        at = len(out)
        tags = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, kind[0]), (259, 3, 8 if deflate else 1), (273, 4, at + 2 + 12 * 8 + 4), (277, 3, 1), (279, 4, len(data)), (339, 3, kind[1])]
        out += struct.pack(order + "H", len(tags))
        for tag, t, v in tags:
            out += struct.pack(order + "HHI", tag, t, 1) + (struct.pack(order + "HH", v, 0) if t == 3 else struct.pack(order + "I", v))
        end = at + 2 + 12 * len(tags) + 4 + len(data)
        out += struct.pack(order + "I", 0 if k == len(a) - 1 else end) + data
    path.write_bytes(bytes(out))


def test_tiff_headers_planes_and_errors(spark, tmp_path):
    a = (np.arange(8 * 5 * 6) % 251).astype(np.uint8).reshape(8, 5, 6)
    write_tiff(tmp_path / "one_0000.tif", a)
    write_tiff(tmp_path / "two.tiff", a.astype(np.uint16), ">", deflate=True)
    (tmp_path / "broken.tif").write_bytes(b"II*\0")
    heads = {r.name: r for r in tiff.volume_headers(spark, str(tmp_path)).collect()}
    assert (heads["one"].n_pages, heads["one"].height, heads["one"].width, heads["one"].dtype, heads["one"].compression) == (8, 5, 6, "uint8", "NONE")
    assert (heads["two"].n_pages, heads["two"].dtype, heads["two"].compression) == (8, "uint16", "ADOBE_DEFLATE")
    assert heads["broken"].error and heads["broken"].n_pages is None
    first = {r.name: r for r in tiff.volume_headers(spark, str(tmp_path), 2048).collect()}
    assert first["two"].n_pages is None and first["one"].depth_inferred
    planes = tiff.volume_planes(spark, str(tmp_path), 2, 4)
    for r in planes.where("error is null").collect():
        assert (np.frombuffer(r.data, r.dtype).reshape(r.height, r.width) == a[r.z]).all() and 2 <= r.z < 4
    assert planes.where("error is not null").count() == 1
    v = tiff.voxels(tiff.volume_planes(spark, str(tmp_path))).groupBy("volume").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")).collect()
    assert {(r.volume, r.n, r.s) for r in v} == {(n, int((a > 0).sum()), float(a.sum())) for n in ("one", "two")}


def striped_tiff(path, a, tall, order="<", deflate=False):
    """Pages of strips of ``tall`` rows; all directories come after all samples."""
    out, pages = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), []
    for page in a:
        strips = []
        for y in range(0, a.shape[1], tall):
            data = page[y : y + tall].astype(page.dtype.newbyteorder(order)).tobytes()
            data = zlib.compress(data) if deflate else data
            strips.append((len(out), len(data)))
            out += data
        pages.append(strips)
    link = 4
    for strips in pages:
        arrays = len(out)
        out += struct.pack(f"{order}{2 * len(strips)}I", *[o for o, _ in strips], *[n for _, n in strips])
        struct.pack_into(order + "I", out, link, len(out))
        n = len(strips)
        tags = [(256, 4, 1, a.shape[2]), (257, 4, 1, a.shape[1]), (258, 3, 1, a.dtype.itemsize * 8), (259, 3, 1, 8 if deflate else 1), (273, 4, n, arrays if n > 1 else strips[0][0]), (277, 3, 1, 1), (278, 4, 1, tall), (279, 4, n, arrays + 4 * n if n > 1 else strips[0][1]), (339, 3, 1, 1)]
        out += struct.pack(order + "H", len(tags))
        for tag, t, count, v in tags:
            out += struct.pack(order + "HHI", tag, t, count) + (struct.pack(order + "HH", v, 0) if t == 3 else struct.pack(order + "I", v))
        link = len(out)
        out += struct.pack(order + "I", 0)
    path.write_bytes(bytes(out))


@pytest.mark.parametrize("order, deflate", [("<", False), (">", True)])
def test_headers_ranges_and_boxes_read_only_their_bytes(spark, tmp_path, order, deflate):
    a = np.random.default_rng(0).integers(0, 60000, (40, 96, 80)).astype(np.uint16)
    striped_tiff(tmp_path / "a vol.tif", a, 8, order, deflate)
    size = (tmp_path / "a vol.tif").stat().st_size
    head = tiff.volume_headers(spark, str(tmp_path)).first()
    assert (head.n_pages, head.height, head.width, head.dtype) == (40, 96, 80, "uint16") and head.file_size == size
    assert head.bytes_read < 45 * tiff.DIRECTORY_BYTES < size / 40
    assert tiff.volume_headers(spark, str(tmp_path), 2048).first().bytes_read == 2048
    whole = tiff.volume_planes(spark, str(tmp_path)).collect()
    assert len(whole) == 40 and all((np.frombuffer(r.data, r.dtype).reshape(96, 80) == a[r.z]).all() for r in whole)
    assert sum(r.bytes_read for r in whole) < 1.05 * size
    some = tiff.volume_planes(spark, str(tmp_path), 10, 14).collect()
    assert sorted(r.z for r in some) == [10, 11, 12, 13] and sum(r.bytes_read for r in some) < 0.13 * size
    box = tiff.volume_box(spark, str(tmp_path), (-3, 20, 70), (6, 30, 900))
    assert sum(r.bytes_read for r in box.collect()) < 0.04 * size  # 6 of 40 pages, 2 of 12 strips each
    got = {(r.z, r.y, r.x): r.value for r in tiff.voxels(box, keep_zero=True).collect()}
    assert got == {(z, y, x): float(a[z, y, x]) for z in range(6) for y in range(20, 30) for x in range(70, 80)}
    assert tiff.volume_box(spark, str(tmp_path), (0, 96, 0), (2, 99, 9)).count() == 0


def test_one_volume_is_read_by_many_tasks_and_breaks_are_rows(spark, tmp_path):
    a = np.arange(50 * 4 * 4).reshape(50, 4, 4).astype(np.uint8)
    striped_tiff(tmp_path / "v.tif", a, 4)
    tasks = tiff.volume_planes(spark, str(tmp_path)).select(F.spark_partition_id().alias("p"), "z").groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(tasks) > 1 and sum(r.n for r in tasks) == 50
    whole = (tmp_path / "v.tif").read_bytes()
    (tmp_path / "v.tif").write_bytes(whole[: len(whole) - 300])  # the chain of directories breaks
    rows = tiff.volume_planes(spark, str(tmp_path)).collect()
    good = [r for r in rows if r.error is None]
    assert 40 < len(good) < 50 and len(rows) == len(good) + 1
    assert all((np.frombuffer(r.data, r.dtype).reshape(4, 4) == a[r.z]).all() for r in good)
    (tmp_path / "none").mkdir()
    assert tiff.volume_planes(spark, str(tmp_path / "none")).count() == 0


def test_tifxyz_in_strips(spark, tmp_path):
    (tmp_path / "m").mkdir()
    rng = np.random.default_rng(1)
    grid = {a: rng.integers(0, 200, (1, 37, 5)).astype(np.uint8) for a in "xyz"}
    for a, v in grid.items():
        striped_tiff(tmp_path / "m" / f"{a}.tif", v, 6)
    rows = tiff.tifxyz(spark, str(tmp_path)).collect()
    assert len(rows) == 37 * 5 and all((r.z, r.y, r.x) == tuple(float(grid[a][0, r.r, r.c]) for a in "zyx") for r in rows)


def test_tifxyz(spark, tmp_path):
    (tmp_path / "m1").mkdir()
    grid = {a: np.arange(12, dtype=np.float32).reshape(3, 4) + k for k, a in enumerate("xyz")}
    grid["x"][1, 2] = -1
    for a, v in grid.items():
        write_tiff(tmp_path / "m1" / f"{a}.tif", v)
    rows = {(r.r, r.c): r for r in tiff.tifxyz(spark, str(tmp_path)).collect()}
    assert len(rows) == 12 and not rows[1, 2].valid and sum(r.valid for r in rows.values()) == 11
    assert (rows[2, 3].z, rows[2, 3].y, rows[2, 3].x) == (13.0, 12.0, 11.0)


def test_zarr_blocks(spark, tmp_path):
    a = (np.arange(6 * 6 * 6) % 254 + 1).astype(np.uint8).reshape(6, 6, 6)
    root = tmp_path / "vol.zarr"
    root.mkdir()
    (root / ".zarray").write_text(json.dumps({"shape": [6, 6, 6], "chunks": [4, 4, 4], "dtype": "|u1", "order": "C", "compressor": {"id": "zlib"}, "dimension_separator": "."}))
    padded = np.zeros((8, 8, 8), np.uint8)
    padded[:6, :6, :6] = a
    for z, y, x in np.ndindex(2, 2, 2):
        if (z, y, x) != (1, 1, 1):
            chunk = padded[4 * z : 4 * z + 4, 4 * y : 4 * y + 4, 4 * x : 4 * x + 4]
            (root / f"{z}.{y}.{x}").write_bytes(b"junk" if (z, y, x) == (0, 1, 1) else zlib.compress(chunk.tobytes()))
    meta = zarr.array_meta(zarr.meta_texts(spark, [str(root)]))
    assert meta.first().error is None
    blocks = zarr.blocks(spark, meta, str(root))
    assert {r.status.split(":")[0] for r in blocks.collect()} == {"ok", "undecodable"}
    got = zarr.voxels(blocks).collect()
    want = a.copy()
    want[4:, 4:, 4:] = 0
    want[:4, 4:, 4:] = 0
    assert len(got) == (want > 0).sum() and all(want[r.z, r.y, r.x] == r.value for r in got)
    assert zarr.box_blocks(blocks, (0, 0, 0), (3, 3, 3), (4, 4, 4)).count() == 1


def write_zarr(root, a, chunks, separator="."):
    root.mkdir(parents=True)
    (root / ".zarray").write_text(json.dumps({"shape": list(a.shape), "chunks": list(chunks), "dtype": a.dtype.str, "order": "C", "compressor": {"id": "zlib"}, "dimension_separator": separator}))
    for at in np.ndindex(*[-(-n // c) for n, c in zip(a.shape, chunks, strict=True)]):
        part = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        whole = np.zeros(chunks, a.dtype)
        whole[tuple(slice(n) for n in part.shape)] = part
        if whole.any():
            path = root / separator.join(map(str, at))
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(zlib.compress(whole.tobytes()))


def test_windows_of_zarr_and_tiff_agree(spark, tmp_path):
    a = np.random.default_rng(5).integers(1, 250, (20, 22, 18)).astype(np.uint8)
    write_zarr(tmp_path / "group.zarr" / "0", a, (8, 8, 8), "/")
    (tmp_path / "group.zarr" / "0" / "2" / "2" / "2").write_bytes(b"junk")  # outside the box
    write_tiff(tmp_path / "v.tif", a)
    low, high = (5, -4, 3), (11, 9, 99)
    want = {(z, y, x): float(a[z, y, x]) for z in range(5, 11) for y in range(9) for x in range(3, 18)}
    for path in ("group.zarr", "v.tif"):
        got = windows.volume_window(spark, str(tmp_path / path), low, high).collect()
        assert {(r.z, r.y, r.x): r.value for r in got} == want
    meta = zarr.array_meta(zarr.meta_texts(spark, [str(tmp_path / "group.zarr"), str(tmp_path / "none.zarr")]))
    assert {r.array.rsplit("/", 2)[-2:][0] + "/" + r.array.rsplit("/", 1)[-1]: r.error for r in meta.collect()}["group.zarr/0"] is None
    assert meta.where("error is not null").count() == 1
    assert zarr.chunk_files(spark, meta, str(tmp_path / "group.zarr"), low, high).count() == 2 * 2 * 3
    with pytest.raises(ValueError, match="unreadable"):
        windows.volume_window(spark, str(tmp_path / "none.zarr"), low, high)


def test_chunks_are_drawn_until_enough_are_accepted(spark, tmp_path):
    import hashlib

    rng = np.random.default_rng(6)
    a = rng.integers(1, 200, (9, 4 * 8, 4 * 6)).astype(np.uint8)
    order = sorted(np.ndindex(8, 6), key=lambda b: hashlib.md5(f"3#{b[0]}#{b[1]}".encode()).hexdigest())
    part = lambda b: (slice(None), slice(4 * b[0], 4 * b[0] + 4), slice(4 * b[1], 4 * b[1] + 4))
    for b in order[:13]:  # the first pass of 14 finds one: all others cover a quarter
        a[part(b)][:, 2:, :] = 0
        a[part(b)][:, :, 2:] = 0
    store = tmp_path / "s.zarr"
    write_zarr(store / "0", a, (9, 4, 4))
    for b in order[13 + 10 + 2 :]:  # nor may what comes after the second pass count
        (store / "0" / f"0.{b[0]}.{b[1]}").write_bytes(b"junk")
    meta = zarr.array_meta(zarr.meta_texts(spark, [str(store)]))
    for shuffles in ("2", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        got = zarr.drawn_profiles(spark, meta, str(store), 3, 3).collect()
        assert [(r.by, r.bx) for r in got] == [tuple(map(int, b)) for b in order[13:16]]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for r in got:
        means = a[part((r.by, r.bx))].reshape(9, 16).mean(1)
        assert (r.n, r.range, r.at_zero, r.peak_offset) == pytest.approx((16, means.max() - means.min(), means[4], means.argmax() - 4))
    few = zarr.drawn_profiles(spark, meta, str(store), 99, 3)
    assert few.count() == 12  # 48 chunks at most 4 a row: 32 tried, 13 thin ones and 7 junk


def test_sheetswitch_and_onsheet_verbs(spark, tmp_path):
    from test_arrays import _sheet_mesh, _wrapped

    rng = np.random.default_rng(3)
    write_zarr(tmp_path / "scan.zarr", _wrapped(side=52).astype(np.uint8), (16, 16, 16))
    v, f = _sheet_mesh()
    (tmp_path / "tri").mkdir()
    bumps = rng.normal(0, 0.2, len(v))
    for name, far in (("flat", 0.0), ("cut", 16.0)):
        points = [f"v {x} {y} {z + bumps[i] + (far if x > 24 else 0)}" for _, i, z, y, x in v]
        (tmp_path / "tri" / f"{name}.obj").write_text("\n".join([*points, *(f"f {a + 1} {b + 1} {c + 1}" for _, _, a, b, c in f)]))
    (tmp_path / "tri" / "bad.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nend_header\n")
    r, c = np.indices((16, 16))
    for name, z in (("on", 22.0), ("off", 30.0)):
        (tmp_path / "tri" / name).mkdir()
        for axis, values in (("z", z + bumps.reshape(16, 16)), ("y", 3.0 * r + 2), ("x", 3.0 * c + 2)):
            write_tiff(tmp_path / "tri" / name / f"{axis}.tif", values.astype(np.float32))
    out, read = tmp_path / "out", lambda n: {r.mesh: r for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out" / n)).collect()}
    assert cli.main(["sheetswitch", "--mesh", str(tmp_path / "tri"), "--volume", str(tmp_path / "scan.zarr"), "--out", str(out)]) == 0
    got = read("sheetswitch_triangles.csv")
    assert got["flat"].n_seams == 0 and got["cut"].n_seams == 1 and got["cut"].winding_spacing == pytest.approx(16, abs=1)
    assert read("sheetswitch.csv")["on"].n_seams == 0 and set(read("mesh_errors.csv")) == {"bad"}
    told = json.loads((out / "sheetswitch_summary.json").read_text())
    assert told["n_meshes"] == 4 and [r["mesh"] for r in told["flagged"]] == ["cut"]
    args = ["onsheet", "--mesh", str(tmp_path / "tri"), "--volume", str(tmp_path / "scan.zarr"), "--reach", "4", "--block-size", "4", "--tiles", "5", "--baseline", "on", "--out", str(out)]
    write_zarr(tmp_path / "empty.zarr", np.pad(np.ones((3, 1, 1), np.uint8), ((0, 0), (0, 7), (0, 7))), (3, 8, 8))
    assert cli.main([*args, "--surface-volume", str(tmp_path / "empty.zarr")]) == 0
    sheets = read("onsheet.csv")
    assert sheets["on"].n == 5 and sheets["on"].n_columns == 80 and sheets["on"].peak_offset_abs_median <= 1 < sheets["off"].peak_offset_abs_median
    assert sheets[str(tmp_path / "empty.zarr")].error == "no usable blocks"


def test_obj_and_ply(spark, tmp_path):
    (tmp_path / "a.obj").write_text("# c\nv 1 2 3\nv 4 5 6\nv 7 8 9\nv 1 1 1\nvn 0 0 1\nf 1/1/1 2/2 3 4\nf -3 -2 -1\n")
    (tmp_path / "none.obj").write_text("v 1 2 3\n")
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 1\n0 2 0\n3 0 0\n3 0 1 2\n")
    (tmp_path / "c.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nend_header\n")
    v, f = meshes.obj(spark, str(tmp_path))
    assert sorted((r.v, r.z, r.y, r.x) for r in v.where("mesh = 'a'").collect()) == [(0, 3, 2, 1), (1, 6, 5, 4), (2, 9, 8, 7), (3, 1, 1, 1)]
    assert sorted((r.a, r.b, r.c) for r in f.collect()) == [(0, 1, 2), (0, 2, 3), (1, 2, 3)]
    v, f = meshes.ply(spark, str(tmp_path))
    assert sorted((r.v, r.z, r.y, r.x) for r in v.collect()) == [(0, 1, 0, 0), (1, 0, 2, 0), (2, 0, 0, 3)] and [(r.a, r.b, r.c) for r in f.collect()] == [(0, 1, 2)]
    assert {r.mesh for r in meshes.errors(spark, str(tmp_path)).collect()} == {"none", "c"}


def test_tables_and_sinks(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("s1\t2.4\tmesh1\tvol\nbad\nx\tnot\ty\tz\n")
    assert [r.um for r in tables.manifest(spark, str(tmp_path / "m.tsv")).collect()] == [2.4]
    (tmp_path / "r").mkdir()
    for k, z in (("a", "1.5"), ("b", "2.5")):
        (tmp_path / "r" / f"{k}.csv").write_text(f"name,max_z,dip_degenerate\nn1,{z},True\n")
    got = tables.results_csv(spark, str(tmp_path / "r")).collect()
    assert [(r.name, r.max_z, r.dip_degenerate) for r in got] == [("n1", "2.5", True)]
    (tmp_path / "j.json").write_text(json.dumps({"results": [{"mesh": "b", "baseline": True}, {"mesh": "e", "error": "x"}, {"mesh": "m", "range": 3.5}]}))
    r = tables.results_json(spark, str(tmp_path / "j.json"), "mesh: string, baseline: boolean, error: string, range: double").first()
    assert (r.baseline.mesh, r.result.mesh, r.result.range) == ("b", "m", 3.5)
    df = spark.createDataFrame([("n", (1, [1, 2]))], "name string, s struct<a: int, b: array<int>>")
    assert reports.flattened(df).columns == ["name", "s.a", "s.b"]
    reports.write_html(str(tmp_path / "o.html"), "t<", {"n": 1.23456}, {"x": df.select("name")})
    assert "t&lt;" in (tmp_path / "o.html").read_text()


def test_names_of_series(spark):
    df = spark.createDataFrame([("20230101x-w012-014",), ("2023010255-w7",), ("none",)], "n string").select(corpus.winding(F.col("n")).alias("w"), corpus.series_day(F.col("n")).alias("d"))
    assert [(r.w, r.d) for r in df.collect()] == [(13.0, None), (7.0, "20230102"), (None, None)]


def test_resumable_sweep(spark, tmp_path):
    src, out, ck = (str(tmp_path / p) for p in ("src", "out", "ck"))
    schema = "name string, value double"
    spark.createDataFrame([("a", 1.0)], schema).write.mode("append").parquet(src)
    measure = lambda df: df.withColumn("twice", F.col("value") * 2)
    resume.sweep(spark, src, schema, out, ck, measure)
    spark.createDataFrame([("b", 2.0)], schema).write.mode("append").parquet(src)
    resume.sweep(spark, src, schema, out, ck, measure)
    assert sorted((r.name, r.twice) for r in spark.read.parquet(out).collect()) == [("a", 2.0), ("b", 4.0)]
    work, done = spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a", None), ("b", "failed")], "name string, error string")
    assert [r.name for r in resume.unmeasured(work, done).collect()] == ["b"]


def test_scan_and_leakage_verbs(spark, tmp_path):
    labels = tmp_path / "labels"
    labels.mkdir()
    for k in range(3):
        a = np.zeros((6, 6, 6), np.uint8)
        a[3] = 1 if k else 2
        write_tiff(labels / f"s_z{30 * k}_y0_x0.tif", a)
    found = audit.scan(spark, str(labels))
    assert found["mode"].first().scheme == "0,1" and found["off_scheme"].count() == 1
    names = tmp_path / "names.txt"
    names.write_text("".join(f"s1_z{z}_y{y}_x0.tif\n" for z in range(0, 1500, 150) for y in range(0, 600, 150)))
    assert cli.main(["leakage", "--names-file", str(names), "--trials", "3", "--out", str(tmp_path / "out")]) == 0
    split = json.loads((tmp_path / "out" / "splits_final.json").read_text())
    assert len(split) == 5 and sorted(n for f in split for n in f["val"]) == sorted(x.removesuffix(".tif") for x in names.read_text().split())
    few = spark.createDataFrame([(f"s1_z{z}_y0_x0",) for z in range(0, 1500, 150)], "name string")
    drawn = audit.leak(few, k=3, trials=4)["random"].first()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(audit.splits, "MOST_NAMES", 20)
        hashed = audit.leak(few, k=3, trials=4)["random"].first()
    assert hashed.trials == drawn.trials == 4 and 0 < hashed.contaminated_pct_mean <= 100
    (tmp_path / "empty.txt").write_text("\n")
    assert cli.main(["leakage", "--names-file", str(tmp_path / "empty.txt"), "--out", str(tmp_path / "out")]) == 2


def patch_volumes(folder):
    """Three patches of two shapes that overlap, one of which disagrees in a corner, and one that has no coordinates."""
    folder.mkdir()
    truth = np.zeros((30, 30, 40), np.uint8)
    truth[10, :, :] = 1
    truth[:, 5, 7] = 1
    at = {"s1_z0_y0_x0": (20, 20, 20), "s1_z0_y0_x10": (20, 20, 20), "s1_z5_y0_x20": (16, 24, 20)}
    held = {}
    for name, shape in at.items():
        z, y, x = (int(part[1:]) for part in name.split("_")[1:])
        a = truth[z : z + shape[0], y : y + shape[1], x : x + shape[2]].copy()
        if x == 10:
            a[10, :4, :4] = 0
        held[name] = ((z, y, x), a)
        write_tiff(folder / f"{name}.tif", a)
    write_tiff(folder / "odd.tif", truth[:4, :4, :4])
    return held


def test_leakage_verb_with_labels(spark, tmp_path):
    held = patch_volumes(tmp_path / "labels")
    out = tmp_path / "out"
    assert cli.main(["leakage", "--labels", str(tmp_path / "labels"), "--k", "3", "--trials", "2", "--measure-seen", "--consistency", "9", "--out", str(out)]) == 0
    told = json.loads((out / "leakage.json").read_text())
    assert (told["n_patches"], told["n_unparsed"], told["sizes_read"], told["overlap"]["n_pairs"], told["n_residual"]) == (3, 1, 4, 2, 0)

    def placed(name):
        (z, y, x), a = held[name]
        return {(i + z, j + y, k + x) for i, j, k in np.argwhere(a == 1)}

    def within(points, name):
        (low, a) = held[name]
        return {p for p in points if all(lo <= q < lo + n for q, lo, n in zip(p, low, a.shape, strict=True))}

    want, ious = {}, []
    for a in held:  # three folds of three patches: all others train
        own = placed(a)
        want[a] = len(set().union(*[within(own, b) for b in held if b != a])) / len(own)
        for b in held:
            if a < b and within(own, b) | within(placed(b), a):
                p, q = within(own, b), within(placed(b), a)
                ious.append(len(p & q) / len(p | q))
    seen = {r.id: float(r.seen) for r in spark.read.option("header", True).csv(str(out / "seen_usual.csv")).collect()}
    assert seen == pytest.approx(want) and told["seen_usual_summary"]["mean"] == pytest.approx(np.mean(list(want.values())))
    assert told["seen_blocked_summary"]["max"] == 0.0
    assert told["consistency"]["n_pairs"] == 2 and told["consistency"]["min"] == pytest.approx(min(ious)) and told["worst"][0]["a"] == "s1_z0_y0_x0"
    names = tmp_path / "names.txt"
    names.write_text("s1_z0_y0_x0\ns1_z0_y0_x10\ns1_z0_y0_x25\n")
    assert cli.main(["leakage", "--names-file", str(names), "--labels", str(tmp_path / "labels"), "--assume-patch-size", "--patch-size", "20", "20", "9", "--k", "2", "--trials", "1", "--out", str(out)]) == 0
    told = json.loads((out / "leakage.json").read_text())
    assert told["overlap"]["n_pairs"] == 0 and "sizes_read" not in told
    names.write_text("odd\n")
    assert cli.main(["leakage", "--names-file", str(names), "--out", str(out)]) == 2


def test_pair_consistency_equals_the_dense_one(spark):
    from plumbline.operators import leakage

    rng = np.random.default_rng(2)
    boxes = {"p": (0, 0, 0), "q": (2, 3, 1), "r": (4, 0, 0), "s": (90, 0, 0)}
    rows = [(n, z + i, y + j, x + k, bool(rng.random() < 0.4)) for n, (z, y, x) in boxes.items() for i, j, k in np.ndindex(6, 6, 6) if n != "s" or (i, j, k) != (0, 0, 0)]
    dense = spark.createDataFrame([tuple(map(lambda v: v.item() if hasattr(v, "item") else v, r)) for r in rows], "id string, z int, y int, x int, on boolean")
    bounds = spark.createDataFrame([(n, z, z + 6, y, y + 6, x, x + 6) for n, (z, y, x) in boxes.items()], "id string, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    graph = spark.createDataFrame([(a, b) for a in boxes for b in boxes if a != b], "a string, b string")
    pairs = leakage.shared_boxes(leakage.drawn_pairs(graph, 99), bounds)
    got = {(r.a, r.b): r for r in leakage.pair_consistency(dense.where("on").drop("on"), pairs).collect()}
    want = {(r.a, r.b): r for r in leakage.overlap_consistency(dense).collect()}
    assert got.keys() == want.keys() == {("p", "q"), ("p", "r"), ("q", "r")}
    for k, w in want.items():
        assert (got[k].n_voxels, got[k].iou, got[k].dice, got[k].disagreement) == pytest.approx((w.n_voxels, w.iou, w.dice, w.disagreement))
    empty = leakage.pair_consistency(dense.where("id = 's'").drop("on"), pairs).collect()
    assert all((r.iou, r.dice, r.n_disagreeing) == (1.0, 1.0, 0) for r in empty)
    assert leakage.drawn_pairs(graph, 2).count() == 2


def test_scan_verb_finds_the_surface(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    flat = np.zeros((24, 26, 28), np.uint8)
    flat[:9] = 2  # a region
    flat[14:17] = 1  # a sheet of three voxels
    fork = np.zeros((24, 24, 24), np.uint8)
    fork[12, :, :13] = 3
    for k in range(12):
        fork[12 + k // 2, :, 12 + k] = fork[12 - k // 2, :, 12 + k] = 3
    bulk = np.full((20, 20, 20), 4, np.uint8)
    for name, a in (("flat", flat), ("fork", fork), ("bulk", bulk)):
        write_tiff(tmp_path / "labels" / f"{name}.tif", a)
    (tmp_path / "labels" / "broken.tif").write_bytes(b"II*\0")
    out = tmp_path / "out"
    assert cli.main(["scan", "--labels", str(tmp_path / "labels"), "--deep", "--out", str(out)]) == 0
    read = lambda n: spark.read.option("header", True).option("inferSchema", True).csv(str(out / n)).collect()
    rows = {r.name: r for r in read("scan.csv")}
    assert (rows["flat"].surface_class, rows["fork"].surface_class, rows["bulk"].surface_class, rows["broken"].surface_class) == (1, 3, None, None)
    assert rows["flat"].surface_thickness_median == 2.0 and rows["flat"].surface_thickness_p95 == 4.0 and rows["flat"].surface_components == 1
    padded = np.pad(flat == 1, 5)  # a volume's corners cut the shell, so that a few voxels of the flat sheet count
    pieces = arms(np.stack([padded[z : z + 11, y : y + 11, x : x + 11] for z, y, x in np.argwhere(flat == 1)]), 5)
    assert rows["flat"].surface_junction_fraction == pytest.approx((pieces >= 2).mean()) and (pieces >= 2).mean() < 0.05 < rows["fork"].surface_junction_fraction
    assert rows["broken"].error and rows["flat"].label_read_error is None
    classes = {(r.volume, r.value): r for r in read("classes.csv")}
    assert "region" in classes["bulk", 4].skipped and classes["bulk", 4].n_components is None and classes["flat", 1].skipped is None
    told = json.loads((out / "scan_summary.json").read_text())
    assert told["n_volumes"] == 4 and told["unreadable"] == {"name": "broken"} and {(r["surface_class"], r["n"]) for r in told["surface_classes"]} == {(1, 1), (3, 1), (None, 1)}
    assert cli.main(["scan", "--labels", str(tmp_path / "labels"), "--headers-only", "--sample", "2", "--out", str(out)]) == 0
    assert len(read("scan.csv")) == 2


def test_align_regularise_and_onsheet_verbs(spark, tmp_path):
    rng = np.random.default_rng(4)
    z = np.arange(40)
    scan = np.broadcast_to((40 + 140 * np.exp(-0.5 * ((z - 20) / 1.6) ** 2))[:, None, None], (40, 24, 24)) + rng.normal(0, 3, (40, 24, 24))
    label = np.zeros((40, 24, 24), np.uint8)
    label[17] = 1
    for folder, name, a in (("images", "s1_z0_y0_x0_0000.tif", np.clip(scan, 0, 255).astype(np.uint8)), ("labels", "s1_z0_y0_x0.tif", label)):
        (tmp_path / folder).mkdir()
        write_tiff(tmp_path / folder / name, a)
    args = ["--images", str(tmp_path / "images"), "--labels", str(tmp_path / "labels"), "--radius", "8", "--cell", "12", "--min-per-cell", "20", "--out", str(tmp_path / "out")]
    assert cli.main(["align", *args]) == 0
    r = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out" / "align.csv")).first()
    assert r.reliable and r.global_offset == pytest.approx(3.0, abs=0.3) and r["median"] == pytest.approx(3.0, abs=0.3) and r.global_snr > 2
    assert cli.main(["regularise", *args]) == 0
    told = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out" / "regularise.csv")).first()
    assert told.reliable and told.voxels_before == 24 * 24 and told.n_resolved == 4
    new = tiff.voxels(tiff.volume_planes(spark, str(tmp_path / "out" / "labels")))
    assert new.count() == told.voxels_after and new.selectExpr("max(abs(z - 17))").first()[0] <= 1
    assert tiff.volume_headers(spark, str(tmp_path / "out" / "labels")).first().n_pages == 40
    spark.createDataFrame([(m, float(v), 0.5) for m, c in (("a", 20), ("b", 4)) for v in range(c, c + 9)], "mesh string, range double, peak_offset double").write.parquet(str(tmp_path / "blocks"))
    assert cli.main(["onsheet", "--blocks", str(tmp_path / "blocks"), "--baseline", "a", "--compare", "b", "a", "--out", str(tmp_path / "out")]) == 0
    got = {r.mesh: r.verdict for r in spark.read.option("header", True).csv(str(tmp_path / "out" / "onsheet.csv")).collect()}
    assert got == {"a": "ON SHEET", "b": "marginal"}
    assert json.loads((tmp_path / "out" / "compare.json").read_text())["p"] < 0.01


@pytest.mark.parametrize("name", ["split_leakage", "midrank", "mean_profiles", "voxel_erosion", "overlap_components", "pooled_mann_whitney", "robustness_grid", "containment_choice", "random_split_baseline", "nearest_seed", "box_gaps", "onsheet_blocks", "profile_peaks", "voxel_planarity"])
def test_registered_queries_match_their_sql(spark, sf, name):
    import duckdb
    from plumbline.plans import more, registry, shapes  # noqa: F401  (they add their queries)

    con = duckdb.connect()
    for t in "customer supplier part orders lineitem events documents embeddings".split():
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.sql(registry.ORACLE_SQL[name])
    names = sorted(want.columns)
    key = lambda rows: sorted((tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)
    got = registry.QUERIES[name](spark, sf).select(*names).collect()
    assert key(map(tuple, got)) == key(want.select(*[f'"{c}"' for c in names]).fetchall())
