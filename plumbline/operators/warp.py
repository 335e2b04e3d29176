"""Correction of a label's placement: a smooth field from cells, and the label drawn along it."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import voxels as vx
from plumbline.operators.voxels import AXES
from plumbline.storage import written

REACH = 4.0  #: standard deviations of a blur


def _edge_weights(place: str, to: str, size: int, sigma: float):
    """Weight of cell ``place`` in the blur at ``to``, where the grid's end cells go on beyond it."""
    reach = int(REACH * sigma + 0.5)
    kernel = [(k, math.exp(-0.5 * (k / sigma) ** 2)) for k in range(-reach, reach + 1)]
    inside = lambda k: F.greatest(F.lit(0), F.least(F.lit(size - 1), F.col(to) + k)) == F.col(place)
    return sum([F.when(inside(k), w).otherwise(0.0) for k, w in kernel[1:]], F.when(inside(kernel[0][0]), kernel[0][1]).otherwise(0.0))


def delta_cells(cells: DataFrame, summary: DataFrame, shape: tuple[int, int, int], cell: float, smooth: float = 0.5) -> DataFrame:
    """(volume, z, y, x, value): per cell the correction, its offset less the volume's own one.

    Resolved cells are blurred with ``smooth`` cells, by weights over measured cells
    alone; a volume with a single one is left as it is.  The blur fills cells that
    share a face with a measured one, and no others.
    """
    sizes = [math.ceil(s / cell) for s in shape]
    known = cells.where("status = 'ok'").join(summary.select("volume", "global_offset_raw"), "volume")
    known = written(known.select("volume", F.col("cz").alias("z"), F.col("cy").alias("y"), F.col("cx").alias("x"), (F.col("offset") - F.col("global_offset_raw")).alias("d")), "deltas")
    if smooth <= 0:
        return known.withColumnRenamed("d", "value")
    reach = int(REACH * smooth + 0.5)
    moves = F.explode(F.array(*[F.struct(*[F.lit(s).alias(f"d{a}") for a, s in zip(AXES, step, strict=True)]) for step in product(range(-reach, reach + 1), repeat=3)]))
    moved = known.select("volume", *AXES, "d", moves.alias("m")).select("volume", *AXES, "d", *[(F.col(a) + F.col(f"m.d{a}")).alias(f"t{a}") for a in AXES])
    for a, n in zip(AXES, sizes, strict=True):
        moved = moved.where((F.col(f"t{a}") >= 0) & (F.col(f"t{a}") < n))
    weight = F.lit(1.0)
    for a, n in zip(AXES, sizes, strict=True):
        weight = weight * _edge_weights(a, f"t{a}", n, smooth)
    blurred = moved.withColumn("w", weight).groupBy("volume", *[F.col(f"t{a}").alias(a) for a in AXES]).agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("soft"))
    near = vx.shifted(known, [(0, 0, 0), *vx.FACES], ["volume"]).distinct()
    many = known.groupBy("volume").agg(F.count(F.lit(1)).alias("n"))
    own = near.join(blurred, ["volume", *AXES]).join(many, "volume").join(known, ["volume", *AXES], "left")
    return own.select("volume", *AXES, F.when(F.col("n") > 1, F.col("soft")).otherwise(F.coalesce("d", F.lit(0.0))).alias("value"))


def field_at(points: DataFrame, deltas: DataFrame, shape: tuple[int, int, int], cell: float, point_id: str) -> DataFrame:
    """(volume, point_id, shift): the cells' corrections interpolated between the cells' middles; the end cells go on beyond theirs."""
    sizes = {a: math.ceil(s / cell) for a, s in zip(AXES, shape, strict=True)}
    placed = points.select("volume", point_id, *[((F.col(a) + 0.5) / float(cell) - 0.5).alias(a) for a in AXES])
    return vx.trilinear(placed, deltas, "volume", point_id, outside="clamp", shape=sizes).withColumnRenamed("sample", "shift")


def warped(label: DataFrame, normals: DataFrame, deltas: DataFrame, shape: tuple[int, int, int], cell: float, most: float = 4.0, threshold: float = 0.5) -> DataFrame:
    """(volume, z, y, x): the label drawn back along its normals, new(p) = old(p - shift(p) n(p)).

    A place outside the label takes the normal of its nearest label point, and only
    places within reach of the label can change.  A place is in the new label if the
    old one, interpolated, is at least ``threshold`` there.
    """
    band = label.select("volume", *[F.col(a).cast("int").alias(a) for a in AXES]).distinct()
    for _ in range(math.ceil(most) + 1):
        band = vx.shifted(band, [(0, 0, 0), *vx.ALL_AROUND], ["volume"]).distinct()
    for a, s in zip(AXES, shape, strict=True):
        band = band.where((F.col(a) >= 0) & (F.col(a) < s))
    band = written(band.withColumn("bid", F.concat_ws(",", *AXES)), "band")
    shifts = field_at(band, deltas, shape, cell, "bid")
    shift = F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), F.col("shift")))
    facing = vx.nearest_values(band, normals, "volume", "bid", "pid", [f"n{a}" for a in AXES])
    source = band.join(shifts, ["volume", "bid"]).join(facing, ["volume", "bid"]).select("volume", "bid", *[(F.col(a) - shift * F.col(f"n{a}")).alias(a) for a in AXES])
    drawn = vx.trilinear(written(source, "sources"), label.select("volume", *AXES, F.lit(1.0).alias("value")), "volume", "bid")
    return band.join(drawn.where(F.col("sample") >= threshold).select("volume", "bid"), ["volume", "bid"]).select("volume", *AXES)
