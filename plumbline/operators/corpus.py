"""Corpus-level reports: matched results, controls, decision rules, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.splits import numbered
from plumbline.storage import written

CHUNK = 64  #: places of bounds and sizes in which an item and a holder meet as rows


def truthy(c: Column | str) -> Column:
    """``true`` in any case, as text."""
    return F.lower(F.col(c) if isinstance(c, str) else c) == "true"


def number(c: Column | str) -> Column:
    """The text as a number, or null."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def winding(name: Column) -> Column:
    """Winding index in a name: the middle of ``w<a>-<b>``, else ``w<n>``; null without one."""
    part = lambda p, k: F.nullif(F.regexp_extract(name, p, k), F.lit("")).cast("double")
    return F.coalesce((part(r"w(\d+)-(\d+)", 1) + part(r"w(\d+)-(\d+)", 2)) / 2, part(r"w(\d+)", 1))


def series_day(name: Column) -> Column:
    """The eight digits of the date before ``-w``."""
    return F.nullif(F.regexp_extract(name, r"(\d{8})\d*-w", 1), F.lit(""))


def segment(path: Column) -> Column:
    """What follows ``/segments/`` in a path, up to the next slash."""
    return F.split_part(F.split_part(path, F.lit("/segments/"), F.lit(2)), F.lit("/"), F.lit(1))


def scroll(name: Column) -> Column:
    """What stands before ``__`` in a name."""
    return F.split_part(name, F.lit("__"), F.lit(1))


def last_per_name(rows: DataFrame, name: str = "name", order: str = "path") -> DataFrame:
    """The row of the greatest path for each name."""
    turn = F.row_number().over(Window.partitionBy(name).orderBy(F.desc(order)))
    return rows.withColumn("__turn", turn).where("__turn = 1").drop("__turn")


def paired(real: DataFrame, plant: DataFrame, value: str = "max_z") -> DataFrame:
    """Inner join of real and planted results on name, with the gates of each side.

    The real row must be adequate and not degenerate, the planted one only not
    degenerate; the ratio needs a real value above zero.
    """
    a = real.where("adequate and not degenerate").select("name", F.col(value).alias("real_value"))
    b = plant.where("not degenerate").select("name", F.col(value).alias("plant_value"))
    return a.join(b, "name").where("real_value is not null and plant_value is not null").withColumn("ratio", F.when(F.col("real_value") > 0, F.col("plant_value") / F.col("real_value")))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """n, how often the plant is higher, the ratios, both ranges, and whether the two can be told apart."""
    r, p = F.col("real_value"), F.col("plant_value")
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(p > r).alias("n_plant_higher"), F.median("ratio").alias("ratio_median"), F.min("ratio").alias("ratio_min"), F.max("ratio").alias("ratio_max"),
        F.median(r).alias("real_median"), F.max(r).alias("real_max"), F.median(p).alias("plant_median"), F.min(p).alias("plant_min"), (F.min(p) > F.max(r)).alias("separable"),
    )


def scroll_table(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per scroll: rows, errors, adequate, degenerate, usable, flagged, and the median score of usable rows."""
    usable = F.col("adequate") & ~F.col("degenerate")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.count_if("adequate").alias("n_adequate"), F.count_if("degenerate").alias("n_degenerate"),
        F.count_if(usable).alias("n_usable"), F.count_if(usable & (F.col("n_seams") > 0)).alias("n_flagged"), F.median(F.when(usable, F.col("max_z"))).alias("median_max_z"),
    )


def joined_by_name_or_prefix(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """Left join on the exact name, else on the part before ``__`` (the first name of that prefix)."""
    by_name = right.select(F.col(name).alias("__n"), F.struct(*right.columns).alias("exact"))
    first = right.groupBy(scroll(F.col(name)).alias("__p")).agg(F.min_by(F.struct(*right.columns), name).alias("near"))
    joined = left.join(by_name, left[name] == F.col("__n"), "left").join(first, scroll(left[name]) == F.col("__p"), "left")
    return joined.select(left["*"], F.coalesce("exact", "near").alias("match"), F.col("exact").isNotNull().alias("is_exact"))


def choose_containing(items: DataFrame, holders: DataFrame, keys: list[str], size: str, bounds: tuple[str, str], order: list[str]) -> DataFrame:
    """Each item with the first holder (by ``order``) of its key whose bounds contain its size; null if none.

    Bounds and sizes are numbered together by key and value, so that a holder is a
    run of places.  Places are dealt to chunks of ``CHUNK``: an item meets the holders that
    begin or end in its chunk, and of those that cover the chunk whole only the first, kept
    for runs of chunks whose length is a power of two.  No item meets all its holders.
    """
    low, high = bounds
    has_keys = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys], F.lit(True))
    own = written(items.distinct().withColumn("__id", F.monotonically_increasing_id()), "items")
    pick = F.struct(*[F.col(o) for o in order]).alias("__pick")
    held = holders.where((F.col(high) - F.col(low) >= 0) & has_keys).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(low).alias("__low"), F.col(high).alias("__high"), pick)
    held = written(numbered(held, "__pick", "__low", "__high", *[f"__k{i}" for i in range(len(keys))]).withColumnRenamed("place", "__id"), "holders")  # the least id is the first holder
    by = [f"__k{i}" for i in range(len(keys))]
    sides = [held.select(*by, F.col(c).alias("__at"), F.lit(k).alias("__kind"), "__id") for k, c in ((0, "__low"), (2, "__high"))]
    sized = own.where(F.col(size).isNotNull() & has_keys).select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], F.col(size).alias("__at"), F.lit(1).alias("__kind"), "__id")
    placed = numbered(sides[0].unionByName(sized).unionByName(sides[1]), *by, "__at", "__kind", "__id").select("__kind", "__id", F.col("place").alias("__p"))
    placed = written(placed.withColumn("__chunk", F.floor(F.col("__p") / CHUNK)), "places")
    points = placed.where("__kind = 1").drop("__kind")
    side = lambda k, n: placed.where(f"__kind = {k}").select(F.col("__id").alias("__h"), F.col("__p").alias(f"__{n}"), F.col("__chunk").alias(f"__c{n}"))
    runs = written(side(0, "l").join(side(2, "r").hint("merge"), "__h"), "runs")
    ends = runs.select("__h", "__l", "__r", F.explode(F.array_distinct(F.array("__cl", "__cr"))).alias("__chunk"))
    inside = points.join(ends.hint("merge"), "__chunk").where("__l < __p and __p < __r").groupBy("__id").agg(F.min("__h").alias("__inner"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(int(placed.agg(F.max("__chunk")).first()[0] or 0).bit_length()))).alias("__level")
    first, until = F.expr("shiftright(__cl + shiftleft(1L, __level), __level)"), F.expr("shiftright(__cr, __level)")  # whole runs of that length: from first up to until
    each = runs.where("__cl + 1 < __cr").select("__h", "__cl", "__cr", levels).select("__h", "__level", first.alias("__a"), until.alias("__b")).where("__a < __b")
    left = F.when(F.col("__a") % 2 == 1, F.col("__a"))
    right = F.when((F.col("__b") % 2 == 1) & (F.col("__a") + F.col("__a") % 2 < F.col("__b")), F.col("__b") - 1)
    nodes = each.select("__h", "__level", F.explode(F.array_compact(F.array(left, right))).alias("__node")).groupBy("__level", "__node").agg(F.min("__h").alias("__outer"))
    asked = points.select("__chunk").distinct().select("__chunk", levels).withColumn("__node", F.expr("shiftright(__chunk, __level)"))
    cover = asked.join(nodes.hint("merge"), ["__level", "__node"]).groupBy("__chunk").agg(F.min("__outer").alias("__outer"))
    best = points.join(cover.hint("merge"), "__chunk", "left").join(inside.hint("merge"), "__id", "left").select("__id", F.least("__inner", "__outer").alias("__h"))
    chosen = best.join(held.select(F.col("__id").alias("__h"), F.col("__pick").alias("holder")).hint("merge"), "__h").select("__id", "holder")
    return own.join(chosen.hint("merge"), "__id", "left").select(*items.columns, "holder")


def decision(rows: DataFrame, keys: list[str], positive: Column, chosen: Column, least: int = 10, precision: float = 0.8, lift: float = 2.0) -> DataFrame:
    """Pass or fail of a screening rule: enough chosen rows, precise enough, and above the base rate."""
    n, hits = F.count_if(chosen), F.count_if(chosen & positive)
    each = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), n.alias("n_chosen"), F.when(n > 0, hits / n).alias("precision"), (F.count_if(positive) / F.count(F.lit(1))).alias("base_rate"))
    good = (F.col("n_chosen") >= least) & (F.col("precision") >= precision) & (F.col("precision") >= lift * F.col("base_rate"))
    return each.withColumn("verdict", F.when(F.coalesce(good, F.lit(False)), "PASS").otherwise("FAIL"))


def verdict(value: Column, baseline: Column) -> Column:
    """Sheet verdict of a range against the baseline's median (at least 1e-6)."""
    share = value / F.greatest(baseline, F.lit(1e-6))
    return F.when(value.isNull() | baseline.isNull(), F.lit(None)).when(share >= 0.5, "ON SHEET").when(share >= 0.3, "marginal").otherwise("OFF SHEET")


def eligible_series(rows: DataFrame, keys: list[str], place: str, least: int = 5) -> DataFrame:
    """Series with ``least`` rows or more, and the span of their places."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("n") >= least)


def label_shares(rows: DataFrame, keys: list[str], answer: str, least: float = 0.2) -> DataFrame:
    """Per key: text, no-text and unsure answers, the share of text among the sure ones, and whether it qualifies."""
    text, none = F.count_if(F.col(answer) == "text"), F.count_if(F.col(answer) == "no-text")
    share = text / F.nullif(text + none, F.lit(0))
    return rows.groupBy(*keys).agg(text.alias("n_text"), none.alias("n_no_text"), F.count_if(F.col(answer) == "unsure").alias("n_unsure"), share.alias("text_share"), F.coalesce(share >= least, F.lit(False)).alias("qualifies"))


def block_stats(rows: DataFrame, keys: list[str], values: str, flat: float) -> DataFrame:
    """(keys, n, mean, median, flat_share) of the numbers in an array column; ``flat``: those under it."""
    each = rows.select(*keys, F.explode(values).alias("v"))
    return each.groupBy(*keys).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.avg((F.col("v") < flat).cast("double")).alias("flat_share"))


def verdict_groups(rows: DataFrame, verdict: str, value: str, flat: str) -> DataFrame:
    """Per verdict: n, mean and median of the value, and the mean flat share."""
    return rows.groupBy(verdict).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.avg(flat).alias("flat_share"))


def keyed_labels(labels: DataFrame, key: DataFrame, predictors: DataFrame, code: str = "code", base: str = "base") -> DataFrame:
    """Labels under a blind code, their base names from the key, and the base's predictors: inner joins."""
    return labels.join(key, code).join(predictors, base)


def metric_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, n_measurable, n_attempted, median, mean, least, most) of each metric over the rows that have it."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("e")).select("e.*")
    v = F.when(~F.isnan("v"), F.col("v"))
    return each.groupBy("metric").agg(F.count(v).alias("n_measurable"), F.count(F.lit(1)).alias("n_attempted"), F.median(v).alias("median"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))


def top(rows: DataFrame, by: str, n: int = 40, ties: tuple[str, ...] = (), by_size: bool = False) -> DataFrame:
    """The n rows of the largest value (``by_size``: of the largest absolute value): a top-k report; nulls come last."""
    order = F.abs(F.col(by)) if by_size else F.col(by)
    return rows.orderBy(order.desc_nulls_last(), *ties).limit(n)


def neighbourhood(rows: DataFrame, keys: list[str], place: str, low: float, high: float, value: str) -> DataFrame:
    """Per key: n, least and median value of the rows whose place lies in [low, high]."""
    return rows.where((F.col(place) >= low) & (F.col(place) <= high)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.median(value).alias("median"))
