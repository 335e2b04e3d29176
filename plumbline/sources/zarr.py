"""Zarr v2 arrays: metadata through ``from_json``, chunks as block rows.

Spark lists chunk files without their content; a box, or a draw of chunks, is a filter
on that listing, so that only the chunks asked for are read.
"""

from __future__ import annotations

import gzip
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.splits import numbered
from plumbline.sources.tiff import ByteRanges
from plumbline.storage import written

META_SCHEMA = "shape array<int>, chunks array<int>, dtype string, order string, compressor struct<id:string>, dimension_separator string"

BLOCK_SCHEMA = "array string, bz int, by int, bx int, shape array<int>, chunks array<int>, dtype string, data binary, status string"
_INTS = pa.list_(pa.int32())
BLOCK_ARROW = pa.schema([("array", pa.string()), *[(f"b{a}", pa.int32()) for a in "zyx"], ("shape", _INTS), ("chunks", _INTS), ("dtype", pa.string()), ("data", pa.binary()), ("status", pa.string())])


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark would open it."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toString()


def meta_texts(spark: SparkSession, arrays: list[str]) -> DataFrame:
    """(array, text): the ``.zarray`` of each array, or of array ``0`` of a group; null where neither can be read.

    Spark's file listing passes over names that begin with a dot, so tasks open these
    by their names.
    """

    def read(batches):
        for batch in batches:
            for given in batch.column(0).to_pylist():
                found = {"array": given, "text": None}
                for array in (given, f"{given}/0"):
                    try:
                        with ByteRanges(f"{array}/.zarray") as source:
                            found = {"array": array, "text": source.get(0, source.size).decode()}
                            break
                    except Exception:  # noqa: BLE001, S112  an array without metadata is a row
                        continue
                yield pa.RecordBatch.from_pylist([found], pa.schema([("array", pa.string()), ("text", pa.string())]))

    rows = [(qualified(spark, array),) for array in arrays]
    return spark.createDataFrame(rows, "array string").repartition(max(1, len(rows))).mapInArrow(read, "array string, text string")


def array_meta(texts: DataFrame) -> DataFrame:
    """(array, shape, chunks, dtype, codec, separator, error) from ``meta_texts``; C order only."""
    parsed = texts.select("array", F.from_json("text", META_SCHEMA).alias("m"))
    error = F.when(F.col("m.shape").isNull() | F.col("m.chunks").isNull(), "unreadable .zarray").when(F.col("m.order") != "C", "only C order is read")
    return parsed.select("array", "m.shape", "m.chunks", "m.dtype", F.col("m.compressor.id").alias("codec"), F.coalesce("m.dimension_separator", F.lit(".")).alias("separator"), error.alias("error"))


def chunk_files(spark: SparkSession, meta: DataFrame, array: str, low: tuple[int, int, int] | None = None, high: tuple[int, int, int] | None = None) -> DataFrame:
    """(array, bz, by, bx, shape, chunks, dtype, codec, path, length) of one array's stored chunks; with a box [low, high), of those that it touches."""
    pattern = r"/(\d+)[./](\d+)[./](\d+)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(array).where(F.col("path").rlike(pattern))
    full = qualified(spark, array)
    told = meta.where("error is null").where(F.col("array").isin(full, f"{full}/0")).first()
    keyed = files.select(*[F.regexp_extract("path", pattern, k + 1).cast("int").alias(f"b{a}") for k, a in enumerate("zyx")], "path", "length")
    joined = keyed.withColumn("array", F.lit(told.array if told else None).cast("string")).join(meta.where("error is null"), "array")
    if low is not None:
        for k, a in enumerate("zyx"):
            side = F.get("chunks", F.lit(k))
            joined = joined.where((F.col(f"b{a}") * side < high[k]) & ((F.col(f"b{a}") + 1) * side > low[k]))
    return joined.select("array", "bz", "by", "bx", "shape", "chunks", "dtype", "codec", "path", "length")


def blocks(spark: SparkSession, meta: DataFrame, array: str, low: tuple[int, int, int] | None = None, high: tuple[int, int, int] | None = None) -> DataFrame:
    """BLOCK_SCHEMA rows of one array's stored chunks, or of those that a box [low, high) touches."""
    return read_chunks(chunk_files(spark, meta, array, low, high))


def read_chunks(listed: DataFrame) -> DataFrame:
    """BLOCK_SCHEMA rows of ``chunk_files``.

    A chunk that cannot be read or decoded, or has the wrong length, is void, as one that
    is not there: its ``status`` says why and ``data`` is null.
    """

    def decode(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                path, size, codec = r.pop("path"), r.pop("length"), r.pop("codec")
                r["status"] = "ok"
                try:
                    with ByteRanges(path, size) as source:
                        raw = source.get(0, size)
                    if codec == "zlib":
                        raw = zlib.decompress(raw)
                    elif codec == "gzip":
                        raw = gzip.decompress(raw)
                    elif codec is not None:
                        r["status"] = f"codec_unsupported: {codec}"
                    if r["status"] == "ok" and len(raw) != int(np.prod(r["chunks"])) * np.dtype(r["dtype"]).itemsize:
                        r["status"] = "wrong length"
                except Exception as e:  # noqa: BLE001  an undecodable chunk is void
                    r["status"] = f"undecodable: {type(e).__name__}"
                r["data"] = raw if r["status"] == "ok" else None
                out.append(r)
            yield pa.RecordBatch.from_pylist(out, BLOCK_ARROW)

    return listed.mapInArrow(decode, BLOCK_SCHEMA)


def voxels(block_rows: DataFrame) -> DataFrame:
    """(volume, z, y, x, value): non-zero voxels of decoded blocks, inside the array's shape."""

    def spread(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], r["dtype"]).reshape(r["chunks"])
                at = np.argwhere(a) + np.array([r["bz"], r["by"], r["bx"]]) * np.array(r["chunks"])
                inside = (at < np.array(r["shape"])).all(1)
                z, y, x = (pa.array(c.astype(np.int32)) for c in at[inside].T)
                yield pa.RecordBatch.from_arrays([pa.array([r["array"]] * len(z), pa.string()), z, y, x, pa.array(a[a != 0][inside].astype(float))], names=["volume", "z", "y", "x", "value"])

    return block_rows.where("status = 'ok'").mapInArrow(spread, "volume string, z int, y int, x int, value double")


def box_blocks(block_rows: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int], side: tuple[int, int, int]) -> DataFrame:
    """Blocks that a box [low, high) touches: a range filter on the block numbers."""
    for a, lo, hi, s in zip("zyx", low, high, side, strict=True):
        block_rows = block_rows.where((F.col(f"b{a}") >= lo // s) & (F.col(f"b{a}") <= (hi - 1) // s))
    return block_rows


def layer_profiles(voxel_rows: DataFrame, key: list[str], layers: int, area: int, least: float = 0.5) -> DataFrame:
    """(key, coverage, range, at_zero, peak_offset) of surface-volume chunks, from their voxels.

    The footprint is every column with a value in some layer; a chunk counts if
    it covers half the area.  Each layer's mean is taken over the footprint.
    """
    footprint = voxel_rows.select(*key, "y", "x").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    sums = voxel_rows.groupBy(*key, "z").agg(F.sum("value").alias("s"))
    levels = sums.join(footprint, key).groupBy(*key).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("z", (F.col("s") / F.col("n")).alias("v")))).alias("m"))
    profile = F.transform(F.sequence(F.lit(0), F.lit(layers - 1)), lambda z: F.coalesce(F.try_element_at("m", z), F.lit(0.0)))
    p = levels.select(*key, (F.col("n") / area).alias("coverage"), profile.alias("p")).where(F.col("coverage") >= least)
    middle = layers // 2
    return p.select(*key, "coverage", (F.array_max("p") - F.array_min("p")).alias("range"), F.get("p", F.lit(middle)).alias("at_zero"), (F.array_position("p", F.array_max("p")) - 1 - middle).cast("double").alias("peak_offset"))


def drawn_profiles(spark: SparkSession, meta: DataFrame, array: str, n: int = 100, seed: int = 0, least: float = 0.5) -> DataFrame:
    """(mesh, by, bx, n, range, at_zero, peak_offset) of ``n`` chunks of a surface volume, drawn until enough are accepted.

    A sampling operator.  Chunks of the first layer of blocks, each as deep as the whole
    band, are tried in the order of their md5, without replacement; one whose surface
    covers less than ``least`` of its area, or that cannot be decoded, is passed over.
    Each pass reads twice what is missing and eight more; the draw ends early after four
    candidates for each row of blocks, or when none are left.  The result depends on
    the seed alone, and no more chunks are read than were tried.
    """
    listed = chunk_files(spark, meta, array).where("bz = 0")
    draw = F.md5(F.concat_ws("#", F.lit(str(seed)), "by", "bx"))
    order = written(numbered(listed.withColumn("__draw", draw), "__draw", "by", "bx"), "chunk-order")
    size = order.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("by").alias("rows"), F.first("chunks").alias("chunks")).first()
    end, at, kept, out = min(size.n, 4 * size["rows"]), 0, 0, None
    while out is None or (kept < n and at < end):
        until = min(end, at + 2 * (n - kept) + 8)
        tried = order.where((F.col("place") >= at) & (F.col("place") < until))
        layers, tall, wide = size.chunks or (1, 1, 1)
        v = voxels(read_chunks(tried.drop("__draw", "place").repartition(spark.sparkContext.defaultParallelism)))
        keyed = v.withColumns({"by": F.floor(F.col("y") / tall).cast("int"), "bx": F.floor(F.col("x") / wide).cast("int")})
        found = layer_profiles(keyed.where(F.col("value") > 0), ["by", "bx"], layers, tall * wide, least).join(tried.select("by", "bx", "place"), ["by", "bx"])
        found = written(found.select("place", F.lit(array.rstrip("/")).alias("mesh"), "by", "bx", F.round(F.col("coverage") * tall * wide).cast("long").alias("n"), "range", "at_zero", "peak_offset"), "drawn")
        kept, at = kept + found.count(), until
        out = found if out is None else out.unionByName(found)
    return out.orderBy("place").limit(n).drop("place")
