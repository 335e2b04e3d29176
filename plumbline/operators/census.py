"""Pairing of collections by name, and the census of what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stem(name: Column) -> Column:
    """File name without ``.tif`` or ``.tiff``, then without one channel suffix ``_0000`` to ``_0003``."""
    return F.regexp_replace(F.regexp_replace(name, r"\.tiff?$", ""), r"_000[0-3]$", "")


def is_remote(path: Column) -> Column:
    return path.rlike("^https?://")


def list_volumes(files: DataFrame, path: str = "path") -> DataFrame:
    """(name, path) of the ``.tif``, ``.tiff`` and ``.zarr`` entries of a file listing."""
    last = F.element_at(F.split(path, "/"), -1)
    return files.where(last.rlike(r"\.(tiff?|zarr)$")).select(F.regexp_replace(stem(last), r"\.zarr$", "").alias("name"), F.col(path).alias("path"))


def pair(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, image, label): full outer join of two (name, path) listings; a missing side is null."""
    return images.select("name", F.col("path").alias("image")).join(labels.select("name", F.col("path").alias("label")), "name", "full_outer")


def remote_pairs(names: DataFrame, image_base: str, label_base: str, suffix: str = "_0000") -> DataFrame:
    """(name, image, label) URLs of a list of names under two base URLs."""
    url = lambda base, tail: F.concat(F.lit(base.rstrip("/") + "/"), "name", F.lit(tail + ".tif"))
    return names.select("name", url(image_base, suffix).alias("image"), url(label_base, "").alias("label"))


def require(pairs: DataFrame, sides: str = "both") -> DataFrame:
    """Pairs that have both sides, or the image, or the label."""
    need = {"both": ("image", "label"), "image": ("image",), "label": ("label",)}[sides]
    for side in need:
        pairs = pairs.where(F.col(side).isNotNull())
    return pairs


def seeded_sample(rows: DataFrame, name: str, n: int, seed: int = 0) -> DataFrame:
    """A sampling operator: the n rows of least md5(name, seed), in name order."""
    return rows.orderBy(F.md5(F.concat_ws("#", F.col(name).cast("string"), F.lit(str(seed)))), name).limit(n).orderBy(name)


def first_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The first n pairs by name, for a trial run; all of them for n = 0."""
    return pairs.orderBy("name").limit(n) if n else pairs


def class_list(values: Column, most: int = 4) -> Column:
    """The non-zero class values of an array in order, ``most`` of them."""
    return F.slice(F.array_sort(F.filter(F.array_distinct(values), lambda v: v != 0)), 1, most)


def counted(rows: DataFrame, *by: str) -> DataFrame:
    """Value counts."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def mode_scheme(rows: DataFrame, scheme: str) -> DataFrame:
    """One row: the most frequent scheme (ties: the smaller) and its count."""
    return rows.where(F.col(scheme).isNotNull()).groupBy(scheme).agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(scheme).alias("s"))).alias("x")).select(F.col("x.s").alias(scheme), (-F.col("x.m")).alias("n"))


def off_scheme(rows: DataFrame, keys: list[str], scheme: str) -> DataFrame:
    """Rows whose scheme is not the most frequent one of their key (ties: the smaller scheme is the mode)."""
    counts = rows.where(F.col(scheme).isNotNull()).groupBy(*keys, scheme).agg(F.count(F.lit(1)).alias("n"))
    mode = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(scheme).alias("s"))).alias("x")).select(*keys, F.col("x.s").alias("mode"))
    return rows.join(mode, keys).where(F.col(scheme) != F.col("mode"))


def label_scheme(voxels: DataFrame, shape: DataFrame) -> DataFrame:
    """Per volume and class value: share of voxels and share of border touches.

    ``voxels`` (volume, z, y, x, value); ``shape`` (volume, sz, sy, sx).  A voxel
    on two faces counts twice, as each face is counted by itself.
    """
    faces = sum([(F.col(a) == 0).cast("int") + (F.col(a) == F.col(f"s{a}") - 1).cast("int") for a in ("y", "x")], (F.col("z") == 0).cast("int") + (F.col("z") == F.col("sz") - 1).cast("int"))
    each = voxels.join(shape, "volume").groupBy("volume", "value", "sz", "sy", "sx").agg(F.count(F.lit(1)).alias("n"), F.sum(faces).alias("touches"))
    return each.select("volume", "value", "n", (F.col("n") / (F.col("sz") * F.col("sy") * F.col("sx"))).alias("fraction"), (F.col("touches") / F.col("n")).alias("border_touch"))


def surface_class(classes: DataFrame, key: str = "volume") -> DataFrame:
    """Per volume the class of least median thickness among those that are no bulk.

    ``classes`` (key, value, fraction, thickness_median, saturated): a class of a
    share up to 1e-5, or half or more saturated, is skipped; ties go to the
    smaller class.  A volume without a usable class has none.
    """
    usable = classes.where("fraction > 1e-5 and saturated < 0.5 and thickness_median is not null and value <> 0")
    best = usable.groupBy(key).agg(F.min(F.struct("thickness_median", "value")).alias("m"))
    return classes.select(key).distinct().join(best, key, "left").select(key, F.col("m.value").alias("surface_class"), F.col("m.thickness_median").alias("thickness_median"))


def header_census(headers: DataFrame) -> dict[str, DataFrame]:
    """Counts by shape and compression, bytes by compression, and names that cannot be read or have no partner.

    ``headers`` (name, shape, plane_shape, compression, file_size, error,
    image_error, has_image, has_label).  Rows with a label header error do not
    count for shape and compression; a plane shape stands in for the full one.
    """
    good = headers.where("error is null")
    return {
        "by_shape": counted(good.select(F.coalesce("plane_shape", "shape").alias("shape")), "shape"),
        "by_compression": good.groupBy("compression").agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes")),
        "unreadable": headers.where("error is not null or image_error is not null").select("name"),
        "unpaired": headers.where("not has_image or not has_label").select("name"),
    }
