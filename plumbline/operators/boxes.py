"""Axis-aligned boxes: names, overlap fractions, gaps, and the overlap join.

A box is a row (name, volume, z0, y0, x0, z1, y1, x1) of half-open integer
bounds.  The overlap join is an equi-join on volume and grid cell with residual
comparisons, so that it never degrades to a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
PATCH_NAME = r"^([A-Za-z0-9.]+)_z(\d+)_y(\d+)_x(\d+)$"  #: fixed format: volume, then the origin


def parse_names(names: DataFrame, sizes: DataFrame | None = None, fallback: int | tuple[int, int, int] = 300) -> tuple[DataFrame, DataFrame]:
    """Boxes of the names that follow the pattern, and the names that do not.

    ``sizes`` (name, sz, sy, sx) gives real sizes; a name without one gets the
    fallback: one size for every axis, or three as z, y, x.
    """
    own = dict(zip(AXES, (fallback,) * 3 if isinstance(fallback, int) else fallback, strict=True))
    fits = F.col("name").rlike(PATCH_NAME)
    part = lambda k: F.regexp_extract("name", PATCH_NAME, k)
    parsed = names.where(fits).select("name", part(1).alias("volume"), *[part(k + 2).cast("long").alias(f"{a}0") for k, a in enumerate(AXES)])
    if sizes is None:
        sized = parsed.select("*", *[F.lit(own[a]).alias(f"s{a}") for a in AXES])
    else:
        sized = parsed.join(sizes, "name", "left").withColumns({f"s{a}": F.coalesce(f"s{a}", F.lit(own[a])) for a in AXES})
    boxes = sized.select("name", "volume", *[f"{a}0" for a in AXES], *[(F.col(f"{a}0") + F.col(f"s{a}")).alias(f"{a}1") for a in AXES])
    return boxes, names.where(~F.coalesce(fits, F.lit(False)))


def volume_of(prefix: str = "") -> Column:
    """Number of voxels in a box whose columns carry the prefix."""
    size = [F.col(f"{prefix}{a}1") - F.col(f"{prefix}{a}0") for a in AXES]
    return size[0] * size[1] * size[2]


def intersection(a: str, b: str) -> dict[str, Column]:
    """Bounds of the overlap of two prefixed boxes, in global coordinates."""
    out = {}
    for x in AXES:
        out[f"{x}0"] = F.greatest(f"{a}{x}0", f"{b}{x}0")
        out[f"{x}1"] = F.least(f"{a}{x}1", f"{b}{x}1")
    return out


def overlap_fraction(a: str, b: str) -> Column:
    """Shared voxels as a share of box ``a``; zero across volumes."""
    both = intersection(a, b)
    edges = [F.greatest(F.lit(0), both[f"{x}1"] - both[f"{x}0"]) for x in AXES]
    shared = edges[0] * edges[1] * edges[2]
    return F.when(F.col(f"{a}volume") == F.col(f"{b}volume"), shared / volume_of(a)).otherwise(0.0)


def gap(a: str, b: str) -> Column:
    """Largest gap along any axis (zero where the boxes touch); null across volumes."""
    each = [F.greatest(F.col(f"{a}{x}0") - F.col(f"{b}{x}1"), F.col(f"{b}{x}0") - F.col(f"{a}{x}1"), F.lit(0)) for x in AXES]
    return F.when(F.col(f"{a}volume") == F.col(f"{b}volume"), F.greatest(*each))


def overlap_pairs(boxes: DataFrame, buffer: int = 0, id_col: str = "id", cell: int | None = None) -> DataFrame:
    """(a, b, fraction) of every two boxes of a volume that overlap or lie within ``buffer``.

    ``a`` is the box that begins first along z (ties: the smaller id), and the
    fraction is its own.  With a buffer, a z gap equal to it does not count,
    while y and x gaps equal to it do.  ``cell``: edge of the grid that deals
    boxes out (by default the largest edge of any box plus the buffer); a box
    goes to each cell it touches, and a pair is kept in the cell that holds the
    lower corner of the two boxes' common region.  Both sides grow with the table,
    and Spark takes a side for as small as its file, so the join is told to shuffle.
    """
    if cell is None:
        edges = [F.max(F.col(f"{x}1") - F.col(f"{x}0")) for x in AXES]
        cell = max(1, int(boxes.agg(F.greatest(*edges, F.lit(1)).alias("m")).first()[0] or 1) + buffer)
    high = lambda x: F.col(f"{x}1") + buffer
    span = lambda x: F.sequence(F.floor(F.col(f"{x}0") / cell), F.floor((high(x) - (0 if buffer else 1)) / cell))
    celled = boxes
    for x in AXES:
        celled = celled.withColumn(f"c{x}", F.explode(span(x)))
    names = [id_col, *[f"{x}{e}" for e in (0, 1) for x in AXES]]
    left = celled.select("volume", *[f"c{x}" for x in AXES], *[F.col(c).alias(f"a_{c}") for c in names])
    right = celled.select("volume", *[f"c{x}" for x in AXES], *[F.col(c).alias(f"b_{c}") for c in names])
    first = (F.col("a_z0") < F.col("b_z0")) | ((F.col("a_z0") == F.col("b_z0")) & (F.col(f"a_{id_col}") < F.col(f"b_{id_col}")))
    near = F.col("b_z0") < F.col("a_z1") + buffer
    for x in ("y", "x"):
        if buffer:
            near = near & (F.col(f"a_{x}0") <= F.col(f"b_{x}1") + buffer) & (F.col(f"b_{x}0") <= F.col(f"a_{x}1") + buffer)
        else:
            near = near & (F.col(f"a_{x}0") < F.col(f"b_{x}1")) & (F.col(f"b_{x}0") < F.col(f"a_{x}1"))
    home = F.lit(True)
    for x in AXES:
        home = home & (F.col(f"c{x}") == F.floor(F.greatest(f"a_{x}0", f"b_{x}0") / cell))
    pairs = left.join(right.hint("merge"), ["volume", *[f"c{x}" for x in AXES]]).where(first & near & home)
    pairs = pairs.withColumn("a_volume", F.col("volume")).withColumn("b_volume", F.col("volume"))
    return pairs.select("volume", F.col(f"a_{id_col}").alias("a"), F.col(f"b_{id_col}").alias("b"), overlap_fraction("a_", "b_").alias("fraction"))


def overlap_graph(boxes: DataFrame, buffer: int = 0, id_col: str = "id", cell: int | None = None) -> DataFrame:
    """Both directions of every pair, each with the fraction of the box that begins first."""
    pairs = overlap_pairs(boxes, buffer, id_col, cell).select("a", "b", "fraction")
    return pairs.select("a", "b", "fraction").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "fraction"))


def overlap_summary(graph: DataFrame) -> DataFrame:
    """Pairs, boxes touched, and the median and largest of each touched box's largest fraction."""
    most = graph.groupBy("a").agg(F.max("fraction").alias("m"), F.count(F.lit(1)).alias("degree"))
    return most.agg(
        (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("n_pairs"), F.count(F.lit(1)).alias("n_touched"),
        F.coalesce(F.median("m"), F.lit(0.0)).alias("median_max"), F.coalesce(F.max("m"), F.lit(0.0)).alias("max_max"),
    )
