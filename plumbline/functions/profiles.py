"""One-dimensional profile functions over array columns, as higher-order functions.

A profile is an array of values at offsets -R, -R + step, ..., R.  Everything
stays in the JVM; a profile is some tens to hundreds of numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def offsets(radius: float | Column, step: float) -> Column:
    """-R, -R + step, ... up to R (and a half step more, against rounding); R may be a column."""
    r = F.lit(float(radius)) if isinstance(radius, (int, float)) else radius
    last = F.ceil((2 * r + step / 2) / step).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: -r + i * float(step))


def walk(point: Column, normal: Column, along: Column) -> Column:
    """Points point + offset * normal (structs of z, y, x) at each offset."""
    return F.transform(along, lambda o: F.struct(*[(point[a] + normal[a] * o).alias(a) for a in ("z", "y", "x")]))


def walk_inside(point: Column, normal: Column, radius: float | Column, shape: tuple[int, int, int]) -> Column:
    """Whether the whole walk lies in [0, shape - 1]: it is a segment, so its ends decide."""
    out = F.lit(True)
    for a, size in zip(("z", "y", "x"), shape, strict=True):
        for sign in (-1.0, 1.0):
            end = point[a] + normal[a] * (radius * sign)
            out = out & (end >= 0) & (end <= size - 1)
    return out


def smoothed(profile: Column, sigma: float, truncate: float = 4.0) -> Column:
    """Gaussian smoothing; sigma in samples, edges mirrored (the edge sample repeated)."""
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    kernel = F.array(*[F.lit(w / sum(raw)) for w in raw])
    n = F.size(profile)

    def at(i: Column) -> Column:
        place = F.pmod(i, 2 * n)
        return F.get(profile, F.when(place < n, place).otherwise(2 * n - 1 - place))

    steps = F.sequence(F.lit(0), F.lit(2 * reach))
    return F.transform(profile, lambda _, i: F.aggregate(steps, F.lit(0.0), lambda total, k: total + F.get(kernel, k) * at(i + k - reach)))


def value_range(profile: Column) -> Column:
    return F.array_max(profile) - F.array_min(profile)


def argmax(profile: Column) -> Column:
    """First place (from 0) of the largest value."""
    return F.array_position(profile, F.array_max(profile)) - 1


def at_middle(profile: Column) -> Column:
    return F.get(profile, F.floor(F.size(profile) / 2).cast("int"))


def refined(profile: Column, i: Column) -> Column:
    """Place of the parabola's top through i and its neighbours; the shift is at most one sample."""
    y0, y1, y2 = (F.get(profile, (i + k).cast("int")) for k in (-1, 0, 1))
    bend = y0 - 2.0 * y1 + y2
    shift = F.when(F.abs(bend) > 1e-9, 0.5 * (y0 - y2) / bend).otherwise(0.0)
    inner = (i > 0) & (i < F.size(profile) - 1)
    return F.when(inner, i + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), shift))).otherwise(i.cast("double"))


def subvoxel_peak(profile: Column) -> Column:
    """The largest sample's place, pulled inside by one sample, refined by a parabola."""
    return refined(profile, F.greatest(F.lit(1), F.least(argmax(profile), F.size(profile) - 2)))


def _inner(profile: Column, margin: int) -> Column:
    return F.when(F.size(profile) > 2 * margin, F.sequence(F.lit(margin), F.size(profile) - 1 - margin)).otherwise(F.array().cast("array<int>"))


def nearest(places: Column, along: Column) -> Column:
    """Of the places, the one whose offset is nearest to zero; ties go to the first."""
    return F.array_min(F.transform(places, lambda i: F.struct(F.abs(F.get(along, i)).alias("far"), i.alias("i"))))["i"]


def ridges(curve: Column, floor: float = 0.6) -> Column:
    """Places of ridges (plateaus count) that rise ``floor`` of the way from least to largest."""
    level = F.array_min(curve) + floor * value_range(curve)
    return F.filter(_inner(curve, 1), lambda i: (F.get(curve, i) >= F.get(curve, i - 1)) & (F.get(curve, i) >= F.get(curve, i + 1)) & (F.get(curve, i) >= level))


def peak_offset(curve: Column, along: Column, floor: float = 0.6) -> Column:
    """Offset of the ridge nearest to the label on a smoothed curve; the largest sample if there is no ridge."""
    found = ridges(curve, floor)
    i = F.coalesce(nearest(found, along), argmax(curve).cast("int"))
    return F.get(along, F.lit(0)) + refined(curve, i) * (F.get(along, F.lit(1)) - F.get(along, F.lit(0)))


def strict_peaks(curve: Column, margin: int = 2) -> Column:
    return F.filter(_inner(curve, margin), lambda i: (F.get(curve, i) > F.get(curve, i - 1)) & (F.get(curve, i) > F.get(curve, i + 1)))


def neighbour_ridges(curve: Column, along: Column, guard: float = 2.0) -> Column:
    """struct(centre, positive, negative, spacing, radius) of a smoothed mean profile.

    The dominant ridge is the one nearest to the label among those at least
    three quarters as strong as the strongest.  Without a neighbour beyond the
    guard the spacing is null and the radius 6.
    """
    peaks = strict_peaks(curve)
    strongest = F.array_max(F.transform(peaks, lambda i: F.get(curve, i)))
    low = F.array_min(curve)
    strong = F.filter(peaks, lambda i: F.get(curve, i) >= low + 0.75 * (strongest - low))
    centre = F.get(along, nearest(strong, along))
    places = F.transform(peaks, lambda i: F.get(along, i) - centre)
    positive, negative = F.array_min(F.filter(places, lambda x: x > guard)), F.array_max(F.filter(places, lambda x: x < -guard))
    spacing = F.least(F.abs(positive), F.abs(negative))
    radius = F.when(spacing.isNull(), 6.0).otherwise(F.greatest(F.lit(3.0), F.least(F.lit(16.0), F.abs(centre) + 0.45 * spacing)))
    return F.struct(centre.alias("centre"), positive.alias("positive"), negative.alias("negative"), spacing.alias("spacing"), radius.alias("radius"))


def winding_spacing(curve: Column, along: Column, guard: float = 2.0) -> Column:
    """Distance from the peak nearest to zero to its nearest neighbour beyond the guard; NaN without one."""
    peaks = strict_peaks(curve)
    centre = F.get(along, nearest(peaks, along))
    far = F.array_min(F.filter(F.transform(peaks, lambda i: F.abs(F.get(along, i) - centre)), lambda d: d > guard))
    return F.coalesce(far, F.lit(float("nan")))


def edge_dip(samples: Column) -> Column:
    """Lower end minus the lowest inner sample of values along an edge; null where an end is missing."""
    n = F.size(samples)
    first, last = F.get(samples, F.lit(0)), F.get(samples, n - 1)
    dip = F.least(first, last) - F.array_min(F.slice(samples, F.lit(2), F.greatest(n - 2, F.lit(0))))
    return F.when(first.isNotNull() & last.isNotNull(), dip)


def polarity(profile: Column, mode: str = "bright") -> Column:
    """The profile turned so that the surface is bright; ``auto`` compares centre and edges."""
    if mode == "bright":
        return profile
    turned = F.transform(profile, lambda v: -v)
    if mode == "dark":
        return turned
    n = F.size(profile)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v) / F.greatest(F.size(a), F.lit(1))
    middle = F.floor(n / 2).cast("int")
    centre = mean(F.slice(profile, F.greatest(middle, F.lit(1)), F.lit(3)))
    edges = mean(F.concat(F.slice(profile, F.lit(1), F.lit(2)), F.slice(profile, F.greatest(n - 1, F.lit(1)), F.lit(2))))
    return F.when(centre >= edges, profile).otherwise(turned)


def orientation_quality(profile: Column, along: Column) -> Column:
    """|pos - neg| / (|pos| + |neg|) of the mean sides above the profile's least value."""
    base = F.array_min(profile)
    pairs = F.zip_with(profile, along, lambda v, o: F.struct(v.alias("v"), o.alias("o")))
    side = lambda keep: F.filter(pairs, keep)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, p: t + p["v"] - base) / F.greatest(F.size(a), F.lit(1))
    pos, neg = mean(side(lambda p: p["o"] > 0)), mean(side(lambda p: p["o"] < 0))
    return F.coalesce(F.abs(pos - neg) / F.nullif(F.abs(pos) + F.abs(neg), F.lit(0.0)), F.lit(0.0))


def interpolated(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear value at x of the curve through ascending ``xs`` and ``ys``; the ends' values beyond them."""
    below = F.size(F.filter(xs, lambda v: v <= x))
    x0, x1, y0, y1 = (F.get(a, i) for a, i in ((xs, below - 1), (xs, below), (ys, below - 1), (ys, below)))
    return F.when(below == 0, F.get(ys, F.lit(0))).when(below == F.size(xs), F.get(ys, below - 1)).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
