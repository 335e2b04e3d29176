"""Ranks, robust scores, two-sample tests, bootstraps and group choices."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plumbline.storage import written

MAD_SCALE = 1.4826
LEAST_MAD = 1e-6
LEAST_LINES = 4


def nan_to_null(c: Column | str) -> Column:
    """NaN (missing number) as null, so that aggregates skip it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def line_scores(values: DataFrame, keys: list[str], line: str, value: str) -> DataFrame:
    """Robust z of each line's mean within its group: (mean - median) / (1.4826 MAD).

    A group of fewer than four finite lines, or with a MAD under 1e-6, has
    scores of zero, as has a line without a finite value; deviations never stand
    in for a MAD that is too small.  Means first: one row a line is left, and
    medians over lines are joined back, not windowed over rows.
    """
    means = values.groupBy(*keys, line).agg(F.avg(nan_to_null(value)).alias("line_mean"))
    middle = means.groupBy(*keys).agg(F.count("line_mean").alias("n_lines"), F.median("line_mean").alias("middle"))
    with_middle = means.join(middle, keys)
    mad = with_middle.groupBy(*keys).agg(F.median(F.abs(F.col("line_mean") - F.col("middle"))).alias("mad"))
    usable = (F.col("n_lines") >= LEAST_LINES) & (F.col("mad") >= LEAST_MAD) & F.col("line_mean").isNotNull()
    z = F.when(usable, (F.col("line_mean") - F.col("middle")) / (MAD_SCALE * F.col("mad"))).otherwise(0.0)
    return with_middle.join(mad, keys).select(*keys, line, "line_mean", z.alias("z"))


def running_totals(rows: DataFrame, keys: list[str], order: str, amount: str) -> DataFrame:
    """``rows`` with ``upto``: the sum of ``amount`` over the rows of the key up to and with this one, one row an order.

    Ranges of (keys, order) are summed on their own and begin at what the key's
    earlier ranges hold, so a key of any size, or a constant one, is no single task.
    """
    ranged = written(rows.repartitionByRange(*keys, order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of the key
    bases = ranged.groupBy("__part", *keys).agg(F.sum(amount).alias("__sum")).withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    own = F.sum(amount).over(Window.partitionBy("__part", *keys).orderBy(order))
    return ranged.withColumn("__own", own).join(bases, ["__part", *keys]).select(*rows.columns, (F.col("__own") + F.col("__base")).alias("upto"))


def midrank_percentile(rows: DataFrame, keys: list[str], value: str, alias: str = "midrank") -> DataFrame:
    """P(x < v) + P(x = v) / 2 within the group: not ``percent_rank``.

    Counts of distinct values are ranked, so ties and repeated rows cost nothing.
    """
    counts = running_totals(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties")), keys, value, "ties")
    sizes = counts.groupBy(*keys).agg(F.sum("ties").alias("__n"))
    share = (F.col("upto") - F.col("ties") / 2) / F.col("__n")
    return rows.join(counts.join(sizes, keys).select(*keys, value, share.alias(alias)), [*keys, value])


def _rank_sums(rows: DataFrame, keys: list[str], group: Column, value: str) -> DataFrame:
    """Per key: sizes n1 (group true) and n2, the rank sum of the first, and sum of t^3 - t over ties."""
    counts = rows.select(*keys, F.col(value).alias("v"), group.alias("g")).where("v is not null and g is not null").groupBy(*keys, "v").agg(F.count_if("g").alias("a"), F.count(F.lit(1)).alias("t"))
    ranked = running_totals(counts, keys, "v", "t").withColumn("rank", F.col("upto") - (F.col("t") - 1) / 2)
    t = F.col("t").cast("double")
    return ranked.groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum(F.col("t") - F.col("a")).alias("n2"), F.sum(F.col("rank") * F.col("a")).alias("r1"), F.sum(t * t * t - t).alias("ties"))


def _normal_cdf(z: Column) -> Column:
    """The normal distribution function, to 1e-7 (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + F.lit(0.2316419) * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


EXACT_SIZE = 8  #: a smaller sample up to which p is exact where no values are tied


def lower_tail(n1: int, n2: int, u: int) -> float:
    """P(U <= u) for samples without ties, by counting: the places of the smaller sample are a partition in a box.

    The counts are the coefficients of prod (1 - q^(n + i)) / (1 - q^i), in whole numbers.
    """
    m, n = sorted((int(n1), int(n2)))
    u = int(u)
    if u < 0:
        return 0.0
    if 2 * u >= m * n:  # the other tail is shorter
        return 1.0 - lower_tail(m, n, m * n - u - 1) if u < m * n else 1.0
    counts = np.zeros(u + 1, object)
    counts[0] = 1
    for i in range(1, m + 1):  # divided by 1 - q^i: running sums in steps of i
        for r in range(min(i, u + 1)):
            counts[r::i] = np.cumsum(counts[r::i])
    for i in range(1, m + 1):
        if n + i <= u:
            counts[n + i :] = counts[n + i :] - counts[: u + 1 - n - i]
    return float(Fraction(int(counts.sum()), math.comb(m + n, m)))


@F.pandas_udf(DoubleType())
def _exact_p(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else lower_tail(a, b, c) for a, b, c in zip(n1, n2, u, strict=True)], dtype=float)


def mann_whitney_less(rows: DataFrame, keys: list[str], group: Column, value: str) -> DataFrame:
    """Keys, n1, n2, U of the first sample, the one-sided p that it lies lower, and whether p is exact.

    Average ranks over ties.  p is exact where the smaller sample has up to
    ``EXACT_SIZE`` rows and no two values are equal, else by the normal approximation
    with tie and continuity correction.
    """
    s = _rank_sums(rows, keys, group, value)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    s = s.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    sd = F.when(n > 1, F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))))
    exact = (F.col("ties") == 0) & (F.least("n1", "n2") <= EXACT_SIZE) & (F.least("n1", "n2") > 0)
    s = s.withColumns({"zscore": F.when(sd > 0, (F.col("u") - n1 * n2 / 2 + 0.5) / sd), "exact": exact})
    counted = _exact_p(*[F.when(exact, F.col(c)) for c in ("n1", "n2", "u")])
    return s.select(*keys, "n1", "n2", "u", "zscore", F.coalesce(counted, _normal_cdf(F.col("zscore")), F.lit(1.0)).alias("p"), "exact")


def auc(rows: DataFrame, keys: list[str], positive: Column, value: str) -> DataFrame:
    """Keys, n_pos, n_neg, and P(pos < neg) + P(pos = neg) / 2; null where a class is empty."""
    s = _rank_sums(rows, keys, positive, value)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    return s.select(*keys, F.col("n1").alias("n_pos"), F.col("n2").alias("n_neg"), F.when((n1 > 0) & (n2 > 0), 1 - u / (n1 * n2)).alias("auc"))


def even_bins(rows: DataFrame, keys: list[str], order: list[str], bins: int = 4) -> DataFrame:
    """``rows`` with ``bin``: n div bins rows in each, the remainder in the last (not ``ntile``).

    The window is per key; without keys, ranges are numbered in parallel from
    per-range counts.
    """
    if keys:
        w = Window.partitionBy(*keys)
        place = F.row_number().over(w.orderBy(*order)) - 1
        return rows.withColumn("bin", F.least(F.floor(place / F.greatest(F.floor(F.count(F.lit(1)).over(w) / bins), F.lit(1))), F.lit(bins - 1)).cast("int"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__own", F.monotonically_increasing_id())
    ranged = written(ranged, "bins")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__own").alias("__least"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", "__least", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__base"))
    each = max(1, ranged.count() // bins)
    place = F.col("__base") + F.col("__own") - F.col("__least")
    return ranged.join(F.broadcast(sizes), "__part").withColumn("bin", F.least(F.floor(place / each), F.lit(bins - 1)).cast("int")).drop("__part", "__own", "__least", "__base")


def choose_in_band(rows: DataFrame, keys: list[str], value: str, name: str, low: float, high: float, target: float) -> DataFrame:
    """One row a key: in the band, the one closest to the target; else the one of least value; ties by name."""
    v = F.col(value)
    inside = (v >= low) & (v <= high)
    order = F.struct((~inside).cast("int").alias("out"), F.when(inside, F.abs(v - target)).otherwise(v).alias("far"), F.col(name).alias("name"))
    return rows.where(v.isNotNull()).groupBy(*keys).agg(F.min(F.struct(order.alias("o"), v.alias("v"))).alias("m")).select(*keys, F.col("m.o.name").alias(name), F.col("m.v").alias(value), (F.col("m.o.out") == 0).alias("in_band"))


def terminal_rank(rows: DataFrame, keys: list[str], place: str, value: str, least: int = 4) -> DataFrame:
    """Per series of ``least`` rows: the last row's rank by value, ascending, and the chance 1 / n of the worst."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(value, place))).withColumn("turn", F.row_number().over(w.orderBy(F.desc(place))))
    last = ranked.where(F.col("n") >= least).groupBy(*keys).agg(
        F.first("n").alias("n"), F.max(F.when(F.col("turn") == 1, F.col(place))).alias("last_place"), F.max(F.when(F.col("turn") == 1, F.col(value))).alias("last_value"),
        F.max(F.when(F.col("turn") == 1, F.col("rank"))).alias("last_rank"), F.median(F.when(F.col("turn") > 1, F.col(value))).alias("rest_median"),
    )
    return last.withColumn("is_worst", F.col("last_rank") == 1).withColumn("chance", F.lit(1.0) / F.col("n"))


def combined_chance(terminals: DataFrame) -> DataFrame:
    """One row: series, how many ended worst, and the product of 1 / n if all did."""
    return terminals.agg(F.count(F.lit(1)).alias("n_series"), F.count_if("is_worst").alias("n_worst"), F.when(F.count_if(~F.col("is_worst")) == 0, F.exp(F.sum(F.log("chance")))).alias("combined_p"))


def _resampled(rows: DataFrame, first: int, resamples: int) -> DataFrame:
    """``rows`` (with ``__id``) once a resample ``__b`` that they are in, with their weight ``__w``; in resample -1 each row is once."""
    u = F.pmod(F.xxhash64("__id", "__b"), F.lit(1 << 30)) / float(1 << 30)
    # inverse of the Poisson(1) distribution function, to 8
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        steps.append(total)
        term /= k + 1
    weight = sum([(u >= s).cast("int") for s in steps[1:]], (u >= steps[0]).cast("int"))
    each = rows.withColumn("__b", F.explode(F.sequence(F.lit(first), F.lit(resamples - 1))))
    return each.withColumn("__w", F.when(F.col("__b") < 0, 1).otherwise(weight)).where("__w > 0")


RANGE_ROWS = 8192  #: rows of a range of values, on average
MOST_RANGES = 1000


def _resampled_medians(values: DataFrame, keys: list[str], resamples: int) -> DataFrame:
    """(keys, __b, __s): the median of ``__v`` in each resample; resample -1 is the rows as they are.

    Weights are summed over ranges of values first; only the ranges that hold the
    middle of a resample are counted value by value.
    """
    ranges = min(MOST_RANGES, 1 + values.count() // RANGE_ROWS)
    ranged = written(values.repartitionByRange(ranges, *keys, "__v").withColumn("__part", F.spark_partition_id()), "ranges")
    sums = _resampled(ranged, -1, resamples).groupBy(*keys, "__b", "__part").agg(F.sum("__w").alias("__own"))
    each = Window.partitionBy(*keys, "__b")  # a row for each range of the key
    upto, total = F.sum("__own").over(each.orderBy("__part")), F.sum("__own").over(each)
    placed = sums.select(*keys, "__b", "__part", (upto - F.col("__own")).alias("__before"), upto.alias("__upto"), F.floor((total + 1) / 2).alias("__low"), (F.floor(total / 2) + 1).alias("__high"))
    middles = written(placed.where("(__low > __before and __low <= __upto) or (__high > __before and __high <= __upto)"), "middles")
    near = ranged.join(middles.select(*keys, "__part").distinct().hint("merge"), [*keys, "__part"], "left_semi")
    of = [*keys, "__b", "__part"]
    met = _resampled(near, -1, resamples).join(middles.hint("merge"), of).groupBy(*of, "__v", "__before", "__low", "__high").agg(F.sum("__w").alias("__w"))
    reached = met.withColumn("__upto", F.col("__before") + F.sum("__w").over(Window.partitionBy(*of).orderBy("__v")))
    low, high = (F.min(F.when(F.col("__upto") >= F.col(c), F.col("__v"))) for c in ("__low", "__high"))
    return reached.groupBy(*keys, "__b").agg(low.alias("__l"), high.alias("__h")).select(*keys, "__b", F.when(F.col("__l") == F.col("__h"), F.col("__l")).otherwise(0.5 * F.col("__l") + 0.5 * F.col("__h")).alias("__s"))


def bootstrap(rows: DataFrame, keys: list[str], row_id: str, value: str, resamples: int = 200, statistic: str = "avg", least: int = 3) -> DataFrame:
    """Keys, n, estimate, low and high: 2.5 and 97.5 percentiles over resamples.

    Poisson bootstrap: a row's weight in a resample comes from a hash of its id
    and the resample, so weights are the same wherever the row is, no resample
    needs the group in one place, and each resample is a weighted sum (``avg``) or
    a weighted ``median``, found by ranges of values, so no task holds the values of
    a resample.  Groups under ``least`` rows give nulls.
    """
    if statistic not in ("avg", "median"):
        raise ValueError("avg or median is resampled")
    if not keys:
        return bootstrap(rows.withColumn("__all", F.lit(0)), ["__all"], row_id, value, resamples, statistic, least).drop("__all")
    values = rows.where(F.col(value).isNotNull()).select(*keys, F.col(row_id).alias("__id"), F.col(value).cast("double").alias("__v"))
    if statistic == "avg":
        sums = _resampled(values, 0, resamples).groupBy(*keys, "__b").agg((F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias("__s"))
        plain = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("estimate"))
    else:
        medians = written(_resampled_medians(values, keys, resamples), "medians")
        sums = medians.where("__b >= 0")
        plain = rows.groupBy(*keys).agg(F.count(value).alias("n")).join(medians.where("__b < 0").select(*keys, F.col("__s").alias("estimate")), keys)
    spread = sums.groupBy(*keys).agg(F.percentile("__s", F.lit(0.025)).alias("low"), F.percentile("__s", F.lit(0.975)).alias("high"))
    joined = plain.join(spread, keys)
    enough = F.col("n") >= least
    return joined.select(*keys, "n", F.when(enough, F.col("estimate")).alias("estimate"), F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"), F.when(enough, (F.col("low") > 0) | (F.col("high") < 0)).alias("excludes_zero"))


def paired_bootstrap(rows: DataFrame, keys: list[str], row_id: str, first: str, second: str, resamples: int = 2000) -> DataFrame:
    """``bootstrap`` of the mean of ``second`` - ``first``; rows without both are left out."""
    both = rows.withColumn("__gain", nan_to_null(F.col(second).cast("double")) - nan_to_null(F.col(first).cast("double"))).where("__gain is not null")
    return bootstrap(both, keys, row_id, "__gain", resamples)


def spread_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, median, p10, p90, IQR as a share of the median (1e-9 at least), min and max of a value per key."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    s = rows.groupBy(*keys).agg(F.count(value).alias("n"), q.alias("q"), F.min(value).alias("least"), F.max(value).alias("most"))
    return s.select(*keys, "n", F.col("q")[2].alias("median"), F.col("q")[0].alias("p10"), F.col("q")[4].alias("p90"), ((F.col("q")[3] - F.col("q")[1]) / F.greatest(F.col("q")[2], F.lit(1e-9))).alias("iqr_share"), "least", "most")


def robustness_grid(rows: DataFrame, settings: list[int], place: str, group: Column, value: str) -> DataFrame:
    """The one-sided test for each block size: blocks of ``setting`` neighbours are averaged first.

    Settings are rows, so all tests are one grouping.
    """
    each = rows.select(place, group.alias("g"), F.col(value).alias("v"), F.explode(F.array(*[F.lit(s) for s in settings])).alias("setting"))
    blocks = each.groupBy("setting", "g", F.floor(F.col(place) / F.col("setting")).alias("block")).agg(F.avg("v").alias("v"))
    return mann_whitney_less(blocks, ["setting"], F.col("g"), "v")
