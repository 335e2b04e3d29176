"""TIFF headers, planes and boxes, read by byte ranges inside tasks.

Spark lists the files (``binaryFile`` without its content, so nothing is loaded);
tasks then read only the ranges they need, through the file systems that pyarrow
knows (local and mounted folders, HDFS, object stores).  ``bytes_read`` says what a
row has cost.  An unreadable file is a row with an ``error``, never a failed job.
"""

from __future__ import annotations

import struct
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.census import stem
from plumbline.storage import written

HEADER_BYTES = 2048
#: Fixed values of the TIFF format.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, SAMPLE_FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 339
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
CODES = {1: "B", 3: "H", 4: "I", 16: "Q"}
COMPRESSIONS = {1: "NONE", 5: "LZW", 8: "ADOBE_DEFLATE", 32773: "PACKBITS", 32946: "DEFLATE"}
KINDS = {(8, 1): "uint8", (16, 1): "uint16", (32, 1): "uint32", (32, 3): "float32", (64, 3): "float64", (8, 2): "int8", (16, 2): "int16"}
PAGE_OVERHEAD = 166  #: bytes of one page's directory in the collections at hand
DIRECTORY_BYTES = 256  #: read at a directory's place; a longer one is read again
TASK_BYTES = 64 << 20  #: stored bytes for each task that reads pages

HEADER_SCHEMA = "path string, name string, width int, height int, dtype string, compression string, n_pages int, depth_inferred boolean, file_size long, error string, bytes_read long"
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
arrow = lambda schema: pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in schema.split(", ")])

#: a page's place in its file, without its samples
INDEX_SCHEMA = "path string, name string, length long, z int, byte_order string, width int, height int, dtype string, packed int, strip_rows int, offsets array<long>, counts array<long>, error string, bytes_read long"
#: ``y0`` and ``x0`` are where the samples begin in the whole plane
PLANE_SCHEMA = "name string, z int, y0 int, x0 int, height int, width int, dtype string, data binary, error string, bytes_read long"
HEADER_ARROW, INDEX_ARROW, PLANE_ARROW = arrow(HEADER_SCHEMA), arrow(INDEX_SCHEMA), arrow(PLANE_SCHEMA)


class ByteRanges:
    """A file's bytes by place, and how many were read; ``first``: nothing beyond the first bytes is ever asked for."""

    def __init__(self, path: str, size: int | None = None, first: int | None = None):
        if path.startswith("file:"):
            system, at = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        else:
            system, at = fs.FileSystem.from_uri(quote(path, safe=":/@"))
        self.file = system.open_input_file(at)
        self.size, self.bytes_read, self.head = self.file.size() if size is None else size, 0, None
        if first is not None:
            self.size = min(self.size, first)
            self.head = self.get(0, self.size)

    def get(self, place: int, n: int) -> bytes:
        """``n`` bytes from the place on, fewer at the end."""
        n = max(0, min(n, self.size - place))
        if self.head is not None:
            return self.head[place : place + n]
        self.bytes_read += n
        return self.file.read_at(n, place) if n else b""

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def directory(source: ByteRanges, at: int, order: str, wanted: bool = True) -> tuple[dict[int, list[int]], int]:
    """Tags of the directory at that place (none unless ``wanted``), and where the next one begins (0: nowhere)."""
    held = source.get(at, DIRECTORY_BYTES)
    (n,) = struct.unpack_from(order + "H", held)
    end = 2 + 12 * n
    if end + 4 > len(held):
        held = source.get(at, end + 4)
    tags: dict[int, list[int]] = {}
    for k in range(n if wanted else 0):
        tag, kind, count = struct.unpack_from(order + "HHI", held, 2 + 12 * k)
        if kind not in CODES:
            continue
        place, size = 10 + 12 * k, TYPE_SIZES[kind] * count
        raw = held[place : place + size]
        if size > 4:
            raw = source.get(struct.unpack_from(order + "I", held, place)[0], size)
        if len(raw) == size:
            tags[tag] = list(struct.unpack(f"{order}{count}{CODES[kind]}", raw))
    return tags, struct.unpack_from(order + "I", held, end)[0] if end + 4 <= len(held) else 0


def opening(source: ByteRanges) -> tuple[str, int]:
    """Byte order and the first directory's place."""
    data = source.get(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    return order, struct.unpack_from(order + "I", data, 4)[0]


def header(source: ByteRanges, size: int, whole: bool) -> dict:
    """Fields of HEADER_SCHEMA from a file's directories, or from its first bytes alone (``whole`` false).

    From the first bytes the depth follows from the file's size, and only if
    the pages are not compressed.
    """
    order, at = opening(source)
    first, after = directory(source, at, order)
    width, height = first[WIDTH][0], first[HEIGHT][0]
    bits, packed = first.get(BITS, [1])[0], first.get(COMPRESSION, [1])[0]
    out = {"width": width, "height": height, "dtype": KINDS.get((bits, first.get(SAMPLE_FORMAT, [1])[0])), "compression": COMPRESSIONS.get(packed, str(packed)), "n_pages": None, "depth_inferred": not whole}
    if whole:
        pages, seen = 1, {at}
        while after and after not in seen and after < source.size:
            seen.add(after)
            _, after = directory(source, after, order, wanted=False)
            pages += 1
        out["n_pages"] = pages
    elif packed == 1:
        page = width * height * first.get(SAMPLES, [1])[0] * bits // 8
        out["n_pages"] = max(1, round(size / (page + PAGE_OVERHEAD)))
    return out


def files(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """(path, name, length) of the TIFF files under a path; ``names`` (name): of these alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").option("recursiveFileLookup", "true").load(path)
    named = listed.select("path", stem(F.element_at(F.split("path", "/"), -1)).alias("name"), "length")
    return named if names is None else named.join(names.select("name").distinct(), "name", "left_semi").select("path", "name", "length")


def volume_headers(spark: SparkSession, path: str, first_bytes: int | None = None, names: DataFrame | None = None) -> DataFrame:
    """HEADER_SCHEMA rows of all TIFF files under a path; ``first_bytes``: only those are looked at."""

    def parse(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                row = {"path": r["path"], "name": r["name"], "file_size": r["length"]}
                try:
                    with ByteRanges(r["path"], r["length"], first_bytes) as source:
                        row["bytes_read"] = source.bytes_read
                        row |= header(source, r["length"], first_bytes is None) | {"bytes_read": source.bytes_read}
                except Exception as e:  # noqa: BLE001  an unreadable header is a row
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, HEADER_ARROW)

    return files(spark, path, names).mapInArrow(parse, HEADER_SCHEMA)


def page_index(listed: DataFrame, z_from: int = 0, z_to: int | None = None) -> DataFrame:
    """INDEX_SCHEMA rows of the pages in the z range of ``files`` rows: directories alone are read, no samples.

    A file that cannot be followed to the range's end is one row with an ``error``
    after the pages before it.
    """

    def walk(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                try:
                    with ByteRanges(r["path"], r["length"]) as source:
                        order, at = opening(source)
                        z, seen = 0, set()
                        while at and at not in seen and (z_to is None or z < z_to):
                            seen.add(at)
                            before = source.bytes_read if rows else 0
                            tags, after = directory(source, at, order, z >= z_from)
                            if z >= z_from:
                                kind = KINDS[tags.get(BITS, [1])[0], tags.get(SAMPLE_FORMAT, [1])[0]]
                                rows.append(r | {"z": z, "byte_order": order, "width": tags[WIDTH][0], "height": tags[HEIGHT][0], "dtype": kind, "packed": tags.get(COMPRESSION, [1])[0], "strip_rows": min(tags.get(ROWS, [tags[HEIGHT][0]])[0], tags[HEIGHT][0]), "offsets": tags[OFFSETS], "counts": tags[COUNTS], "bytes_read": source.bytes_read - before})
                            at, z = after, z + 1
                except Exception as e:  # noqa: BLE001  an unreadable file is a row
                    rows.append(r | {"error": f"{type(e).__name__}: {e}"})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, INDEX_ARROW)

    return listed.mapInArrow(walk, INDEX_SCHEMA)


def samples(source: ByteRanges, page: dict, y_from: int = 0, y_to: int | None = None) -> tuple[int, np.ndarray]:
    """The first row read, and the rows of the strips that hold rows ``y_from`` to ``y_to`` of an INDEX_SCHEMA page; strips raw or deflated."""
    height, width, tall = page["height"], page["width"], page["strip_rows"]
    y_to = height if y_to is None else min(y_to, height)
    first, last = y_from // tall, -(-y_to // tall)
    strips = []
    for place, n in list(zip(page["offsets"], page["counts"], strict=True))[first:last]:
        strips.append(source.get(place, n))
        if page["packed"] in (8, 32946):
            strips[-1] = zlib.decompress(strips[-1])
        elif page["packed"] != 1:
            raise ValueError(f"codec_unsupported: {COMPRESSIONS.get(page['packed'], page['packed'])}")
    a = np.frombuffer(b"".join(strips), np.dtype(page["dtype"]).newbyteorder(page["byte_order"]))
    return first * tall, a.reshape(min(last * tall, height) - first * tall, width)


def volume_planes(spark: SparkSession, path: str, z_from: int = 0, z_to: int | None = None, rows: tuple[int, int | None] = (0, None), columns: tuple[int, int | None] = (0, None), names: DataFrame | None = None) -> DataFrame:
    """PLANE_SCHEMA rows of the pages in the z range, cut to the ranges of rows and columns, one row each.

    Ranges are cut to the volume; a page that they miss gives no row.  Of a page only
    the strips that hold the rows are read.  Pages go to tasks by ranges of file and z, so
    that one large volume is read by many, each in a row; what is written first and
    shuffled is the index of the pages, never samples.
    """
    z_from, y_from, x_from = max(0, z_from), max(0, rows[0]), max(0, columns[0])
    y_to, x_to = rows[1], columns[1]

    def decode(batches):
        source, opened = None, None
        for batch in batches:
            for page in batch.to_pylist():
                out = {"name": page["name"], "z": page["z"], "error": page["error"], "bytes_read": page["bytes_read"]}
                if not out["error"]:
                    if y_from >= page["height"] or x_from >= page["width"] or (y_to is not None and y_to <= y_from) or (x_to is not None and x_to <= x_from):
                        continue
                    try:
                        if opened != page["path"]:
                            if source is not None:
                                source.file.close()
                            source, opened = ByteRanges(page["path"], page["length"]), page["path"]
                        before = source.bytes_read
                        at, a = samples(source, page, y_from, y_to)
                        a = a[y_from - at : None if y_to is None else y_to - at, x_from:x_to]
                        a = a.astype(a.dtype.newbyteorder("<"))
                        out |= {"y0": y_from, "x0": x_from, "height": a.shape[0], "width": a.shape[1], "dtype": a.dtype.name, "data": a.tobytes(), "bytes_read": page["bytes_read"] + source.bytes_read - before}
                    except Exception as e:  # noqa: BLE001
                        out["error"] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([out], PLANE_ARROW)
        if source is not None:
            source.file.close()

    index = written(page_index(files(spark, path, names), z_from, z_to), "pages")
    return index.repartitionByRange(_tasks(index), "path", "z").sortWithinPartitions("path", "z").mapInArrow(decode, PLANE_SCHEMA)


def _tasks(index: DataFrame) -> int:
    """Tasks for the pages of a written index, by their stored bytes."""
    stored = index.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n))).first()[0] or 0
    return max(index.sparkSession.sparkContext.defaultParallelism, -(-stored // TASK_BYTES))


def volume_box(spark: SparkSession, path: str, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """The planes' parts inside the box [low, high) in z, y, x, cut to each volume; see ``volume_planes``."""
    return volume_planes(spark, path, low[0], high[0], (low[1], high[1]), (low[2], high[2]))


def voxels(planes: DataFrame, keep_zero: bool = False) -> DataFrame:
    """(volume, z, y, x, value): the voxels of decoded planes, without zeros by default."""

    def spread(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], r["dtype"]).reshape(r["height"], r["width"])
                y, x = np.nonzero(np.ones_like(a) if keep_zero else a)
                n = len(y)
                yield pa.RecordBatch.from_arrays([pa.array([r["name"]] * n, pa.string()), pa.array(np.full(n, r["z"], np.int32)), pa.array((y + r["y0"]).astype(np.int32)), pa.array((x + r["x0"]).astype(np.int32)), pa.array(a[y, x].astype(float))], names=["volume", "z", "y", "x", "value"])

    return planes.where("error is null").select("name", "z", "y0", "x0", "height", "width", "dtype", "data").mapInArrow(spread, "volume string, z int, y int, x int, value double")


def tifxyz(spark: SparkSession, path: str) -> DataFrame:
    """Grid mesh (mesh, r, c, z, y, x, valid) of a folder with x.tif, y.tif and z.tif a surface.

    The folder's name is the mesh's; coordinates below zero or not finite are
    missing vertices.  A task reads one strip of rows of one coordinate.
    """
    from plumbline.operators.surfaces import missing_as_invalid

    named = files(spark, path).where(F.col("path").rlike(r"/[xyz]\.tif$"))
    parts = F.split("path", "/")
    schema = "mesh string, r int, c int, axis string, v double"
    index = written(page_index(named, 0, 1), "pages")
    broken = index.where("error is not null").select("path", "error").first()
    if broken:
        raise ValueError(f"{broken.path}: {broken.error}")
    strip = F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / F.col("strip_rows")))).alias("strip")
    each = index.select("*", F.element_at(parts, -2).alias("mesh"), F.substring(F.element_at(parts, -1), 1, 1).alias("axis"), strip)

    def spread(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with ByteRanges(row["path"], row["length"]) as source:
                    at, a = samples(source, row, row["strip"] * row["strip_rows"], (row["strip"] + 1) * row["strip_rows"])
                r, c = np.indices(a.shape, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([row["mesh"]] * a.size, pa.string()), pa.array((r + np.int32(at)).ravel()), pa.array(c.ravel()), pa.array([row["axis"]] * a.size, pa.string()), pa.array(a.ravel().astype(float))], names=["mesh", "r", "c", "axis", "v"])

    read = each.repartitionByRange(_tasks(index), "path", "strip").mapInArrow(spread, schema)
    wide = read.groupBy("mesh", "r", "c").agg(*[F.max(F.when(F.col("axis") == a, F.col("v"))).alias(a) for a in "zyx"])
    return missing_as_invalid(wide)
