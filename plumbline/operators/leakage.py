"""Leakage of a split through boxes that share space.

``folds`` is (fold, role, id) with role ``train`` or ``val``, as declared: the
training set is what the table says, not the complement of the validation set.
``graph`` is (a, b, fraction) in both directions.  Folds and graph grow with the
table, so their joins are told to shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.boxes import AXES, intersection, volume_of


def declared_folds(assigned: DataFrame, k: int) -> DataFrame:
    """(fold, role, id) from (id, fold): a row is validation in its fold and training in the others."""
    each = assigned.select("id", "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("f"))
    return each.select(F.col("f").cast("int").alias("fold"), F.when(F.col("f") == F.col("fold"), "val").otherwise("train").alias("role"), "id")


def contaminated(folds: DataFrame, graph: DataFrame) -> DataFrame:
    """(fold, id, shared): validation rows and the largest fraction shared with a training row; null if none."""
    val = folds.where("role = 'val'").select("fold", "id")
    train = folds.where("role = 'train'").select("fold", F.col("id").alias("b"))
    touched = val.join(graph.withColumnRenamed("a", "id").hint("merge"), "id").join(train.hint("merge"), ["fold", "b"]).groupBy("fold", "id").agg(F.max("fraction").alias("shared"))
    return val.join(touched.hint("merge"), ["fold", "id"], "left")


def split_leakage(folds: DataFrame, graph: DataFrame) -> DataFrame:
    """One row: validation rows, how many touch training rows, mean and worst shared fraction."""
    return contaminated(folds, graph).agg(
        F.count(F.lit(1)).alias("n_val"),
        F.count("shared").alias("n_contaminated"),
        (100.0 * F.count("shared") / F.count(F.lit(1))).alias("contaminated_pct"),
        (100.0 * F.avg(F.coalesce("shared", F.lit(0.0)))).alias("mean_shared_pct"),
        F.coalesce(F.max("shared"), F.lit(0.0)).alias("worst_shared"),
    )


def with_buffer_zone(folds: DataFrame, graph: DataFrame) -> DataFrame:
    """``folds`` without the training rows that touch their fold's validation rows."""
    val = folds.where("role = 'val'").select("fold", F.col("id").alias("v"))
    touching = graph.select(F.col("a").alias("v"), F.col("b").alias("id")).join(val.hint("merge"), "v").select("fold", "id").distinct()
    train = folds.where("role = 'train'").join(touching.hint("merge"), ["fold", "id"], "left_anti")
    return train.select("fold", "role", "id").union(folds.where("role = 'val'").select("fold", "role", "id"))


def residual_leaks(folds: DataFrame, graph: DataFrame) -> DataFrame:
    """Validation rows that still touch a training row of their fold: none after ``with_buffer_zone``."""
    return contaminated(folds, graph).where("shared is not null").select("fold", "id")


def fold_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per fold: validation rows, training rows kept, and rows dropped into the buffer zone."""
    count = lambda role: F.sum((F.col("role") == role).cast("long"))
    all_rows = before.groupBy("fold").agg(count("val").alias("n_val"), count("train").alias("n_declared"))
    return all_rows.join(after.groupBy("fold").agg(count("train").alias("n_train")), "fold", "left").select("fold", "n_val", F.coalesce("n_train", F.lit(0)).alias("n_train"), (F.col("n_declared") - F.coalesce("n_train", F.lit(0))).alias("n_dropped"))


def seen_fraction(voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Share of labelled voxels of each validation patch inside the union of training boxes.

    ``voxels`` (id, z, y, x): labelled voxels of validation patches;
    ``boxes`` (id, z0, z1, y0, y1, x0, x1): a patch's overlaps with its training
    neighbours.  A semi-join, so a voxel in two boxes counts once.
    """
    v = voxels.alias("v")
    inside = [(F.col(f"v.{a}") >= F.col(f"w.{a}0")) & (F.col(f"v.{a}") < F.col(f"w.{a}1")) for a in ("z", "y", "x")]
    seen = v.join(boxes.alias("w"), (F.col("v.id") == F.col("w.id")) & inside[0] & inside[1] & inside[2], "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n_seen"))
    total = voxels.groupBy("id").agg(F.count(F.lit(1)).alias("n_labelled"))
    return total.join(seen, "id", "left").select("id", "n_labelled", F.coalesce("n_seen", F.lit(0)).alias("n_seen"), (F.coalesce("n_seen", F.lit(0)) / F.col("n_labelled")).alias("seen"))


def seen_summary(seen: DataFrame) -> DataFrame:
    """Mean, median, 90th percentile, maximum, voxel-weighted mean, and counts above 0 and a quarter."""
    s = F.col("seen")
    return seen.agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"), F.median(s).alias("median"), F.percentile(s, F.lit(0.9)).alias("p90"), F.max(s).alias("max"),
        (F.sum(s * F.col("n_labelled")) / F.sum("n_labelled")).alias("weighted_mean"), F.count_if(s > 0).alias("n_any"), (100.0 * F.count_if(s > 0) / F.count(F.lit(1))).alias("pct_any"), F.count_if(s > 0.25).alias("n_quarter"),
    )


def overlap_consistency(labels: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """IoU, Dice and disagreement of two patches' labels where they overlap.

    ``labels`` (id, z, y, x, on) in global coordinates.  Patches meet voxel by
    voxel, so two of them cost no more than what they share; ``pairs`` (a, b)
    keeps to those.  Two labels that are both empty agree fully.
    """
    at = ["z", "y", "x"]
    first = labels.select(F.col("id").alias("a"), *at, F.col("on").alias("on_a"))
    second = labels.select(F.col("id").alias("b"), *at, F.col("on").alias("on_b"))
    both = first.join(second, at).where("a < b")
    if pairs is not None:
        both = both.join(pairs.select("a", "b").distinct(), ["a", "b"], "left_semi")
    inter, union = F.count_if(F.col("on_a") & F.col("on_b")), F.count_if(F.col("on_a") | F.col("on_b"))
    sizes = F.count_if("on_a") + F.count_if("on_b")
    return both.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n_voxels"), F.when(union == 0, 1.0).otherwise(inter / union).alias("iou"), F.when(sizes == 0, 1.0).otherwise(2 * inter / sizes).alias("dice"),
        (F.count_if(F.col("on_a") != F.col("on_b")) / F.count(F.lit(1))).alias("disagreement"),
    )


def consistency_summary(pairs: DataFrame) -> DataFrame:
    """Mean, median and least IoU, and how many pairs lie under 0.9 and 0.5."""
    i = F.col("iou")
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(i).alias("mean"), F.median(i).alias("median"), F.min(i).alias("min"), F.count_if(i < 0.9).alias("n_below_90"), F.count_if(i < 0.5).alias("n_below_50"))


def worst(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The n pairs of least IoU: a top-k report."""
    return pairs.orderBy("iou", "a", "b").limit(n)


def shared_boxes(pairs: DataFrame, boxes: DataFrame) -> DataFrame:
    """(pairs, z0, z1, y0, y1, x0, x1): what the boxes (id, z0, ..., x1) of ``a`` and ``b`` have in common; pairs within a buffer alone have nothing."""
    bounds = [f"{x}{e}" for x in AXES for e in (0, 1)]
    for side in "ab":
        pairs = pairs.join(boxes.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in bounds]), side)
    both = pairs.withColumns(intersection("a_", "b_")).drop(*[f"{s}_{c}" for s in "ab" for c in bounds])
    return both.where("z0 < z1 and y0 < y1 and x0 < x1")


def training_boxes(folds: DataFrame, graph: DataFrame, boxes: DataFrame) -> DataFrame:
    """(id, b, bounds): what each validation patch shares with each training patch of its own fold."""
    val = folds.where("role = 'val'").select("fold", F.col("id").alias("a"))
    train = folds.where("role = 'train'").select("fold", F.col("id").alias("b"))
    met = graph.select("a", "b").join(val, "a").join(train, ["fold", "b"]).select("a", "b").distinct()
    return shared_boxes(met, boxes).withColumnRenamed("a", "id")


def pair_consistency(voxels: DataFrame, pairs: DataFrame) -> DataFrame:
    """IoU, Dice and disagreement of two patches' labels in the box they share.

    ``voxels`` (id, z, y, x): labelled voxels in global coordinates; ``pairs`` (a, b,
    bounds) as ``shared_boxes`` gives them.  Voxels without a label are never rows: what
    is shuffled is the labelled voxels inside the pairs' boxes.  Two labels that are
    both empty agree fully.
    """
    bounds = [f"{x}{e}" for x in AXES for e in (0, 1)]
    sides = F.explode(F.array(F.struct(F.lit(1).alias("s"), F.col("a").alias("id")), F.struct(F.lit(2).alias("s"), F.col("b").alias("id")))).alias("side")
    asked = pairs.select("a", "b", *bounds, sides).select("a", "b", *bounds, "side.s", F.col("side.id").alias("id"))
    inside = [(F.col(f"v.{x}") >= F.col(f"w.{x}0")) & (F.col(f"v.{x}") < F.col(f"w.{x}1")) for x in AXES]
    met = voxels.select("id", *AXES).alias("v").join(asked.alias("w"), (F.col("v.id") == F.col("w.id")) & inside[0] & inside[1] & inside[2])
    each = met.groupBy("w.a", "w.b", *[f"v.{x}" for x in AXES]).agg(F.bit_or("w.s").alias("on"))
    counts = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_union"), F.count_if(F.col("on") == 3).alias("n_both"))
    told = pairs.join(counts, ["a", "b"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_union", "n_both")}).withColumn("n_voxels", volume_of())
    union, both = F.col("n_union"), F.col("n_both")
    return told.select(
        "a", "b", "n_voxels", F.when(union == 0, 1.0).otherwise(both / union).alias("iou"), F.when(union == 0, 1.0).otherwise(2 * both / (union + both)).alias("dice"),
        (union - both).alias("n_disagreeing"), ((union - both) / F.col("n_voxels")).alias("disagreement"),
    )


def drawn_pairs(graph: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A sampling operator: ``n`` of the graph's pairs (a < b), those of least md5."""
    draw = F.md5(F.concat_ws("#", F.lit(str(seed)), F.col("a").cast("string"), F.col("b").cast("string")))
    return graph.where("a < b").select("a", "b").distinct().orderBy(draw, "a", "b").limit(n)
