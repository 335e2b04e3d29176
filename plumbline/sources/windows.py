"""Boxes of a scan, whatever its format: Zarr arrays and TIFF stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import tiff, zarr


def volume_window(spark: SparkSession, path: str, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """(z, y, x, value): the voxels of one volume inside the box [low, high), cut to the volume; zeros may be left out.

    ``path``: a Zarr array, or a group with an array ``0``, whose name ends in ``.zarr``
    (or in the array's), else a TIFF file or folder.  Only what the box touches is read.
    """
    if ".zarr" in path:
        meta = zarr.array_meta(zarr.meta_texts(spark, [path]))
        told = meta.first()
        if told.error:
            raise ValueError(f"{path}: {told.error}")
        found = zarr.voxels(zarr.blocks(spark, meta, told.array, low, high))
        for a, lo, hi in zip("zyx", low, high, strict=True):
            found = found.where((F.col(a) >= lo) & (F.col(a) < hi))
        return found.drop("volume")
    return tiff.voxels(tiff.volume_box(spark, path, low, high)).drop("volume")
