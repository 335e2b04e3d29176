"""Normals with one side: signs along a minimum spanning forest of near points.

Local planes give an axis, not a direction.  Points are tied to their nearest ones,
sets that no such tie joins by one bridge each, and signs run along the lightest
edges, where neighbouring normals agree most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.graph import connected_components
from plumbline.operators.voxels import AXES, knn_edges, search_edges
from plumbline.storage import written


def _jumped(parents: DataFrame) -> DataFrame:
    """(c, p, f) with ``p`` the root of ``c`` and ``f`` whether the flips on the way are odd; pointers jump twice as far each round."""
    while True:
        onward = parents.select(F.col("c").alias("p"), F.col("p").alias("q"), F.col("f").alias("g"))
        if parents.where("p <> c").select("p").distinct().join(onward.where("q <> p"), "p", "left_semi").isEmpty():
            return parents
        parents = written(parents.join(onward, "p").select("c", F.col("q").alias("p"), (F.col("f") != F.col("g")).alias("f")), "forest")


FOREST_EDGES = 1 << 21  #: edges that a task looks at together


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of the spanning forest's edges between nodes 0 to n - 1, for edges in the order of their weights."""
    label, live, kept = np.arange(n), np.arange(len(a)), []
    while True:
        la, lb = label[a[live]], label[b[live]]
        live, la, lb = (x[la != lb] for x in (live, la, lb))
        if not len(live):
            return np.unique(np.concatenate(kept)) if kept else live
        best = np.full((2, n), len(a))
        best[0, la[::-1]], best[1, lb[::-1]] = live[::-1], live[::-1]  # of a node's edges the first is written last
        best = best.min(0)
        own = np.flatnonzero(best < len(a))
        ends = label[a[best[own]]], label[b[best[own]]]
        up = np.arange(n)
        up[own] = np.where(ends[0] == own, ends[1], ends[0])
        both = own[(up[up[own]] == own) & (own < up[own])]
        up[both] = both
        while (up[up] != up).any():
            up = up[up]
        kept.append(best[own])
        label = up[label]


def _thinned(pairs: DataFrame) -> DataFrame:
    """``pairs`` (ea, eb, w, f) without edges that are the heaviest of a cycle among ``FOREST_EDGES`` of them.

    No such edge is in the minimum spanning forest of all.  Edges are dealt by ranges of
    the end that has more nodes, so that a task has all edges of most of these and sees
    few nodes for its edges.  ``pairs`` are computed three times: for the numbers of
    nodes, for the ranges and for the edges.
    """

    def thin(rows: pa.Table) -> list[pa.RecordBatch]:
        ends = [rows[c].to_numpy() for c in ("ea", "eb")]
        w, f = rows["w"].combine_chunks(), rows["f"].combine_chunks()
        flips = np.where(f.is_valid().to_numpy(zero_copy_only=False), f.fill_null(False).to_numpy(zero_copy_only=False), -1)
        heavy, known = w.fill_null(0).to_numpy(zero_copy_only=False), w.is_valid().to_numpy(zero_copy_only=False)
        order = np.lexsort((heavy, known))  # nulls first, NaN last, as in Spark
        same = (heavy[order[1:]] == heavy[order[:-1]]) | ((heavy[order[1:]] != heavy[order[1:]]) & (heavy[order[:-1]] != heavy[order[:-1]]))
        if (same & (known[order[1:]] == known[order[:-1]])).any():  # equal weights go by their ends
            order = np.lexsort((flips, ends[1], ends[0], heavy, known))
        codes, nodes = pd.factorize(np.concatenate(ends))
        codes = codes.reshape(2, -1)[:, order]
        return rows.take(pa.array(order[_forest(codes[0], codes[1], len(nodes))])).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= FOREST_EDGES:
                yield from thin(pa.Table.from_batches(held))
                held = []
        if held:
            yield from thin(pa.Table.from_batches(held))

    low, high = pairs.agg(F.approx_count_distinct("ea"), F.approx_count_distinct("eb")).first()
    by = ["ea", "eb"] if low > high else ["eb", "ea"]
    return pairs.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, pairs.schema)


def spanning_signs(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "weight", flip: str = "flip", rounds: int = 64) -> DataFrame:
    """(node, component, sign) of every node on an edge.

    ``flip``: whether the signs of an edge's ends differ.  Signs are those along the
    minimum spanning forest, found by rounds: each component takes its least edge,
    components joined that way become one (a sign bit goes with each), and of the
    edges between two components the least stays.  Edges of equal weight go by their
    ends.  Where nodes are whole numbers, tasks drop edges that close a cycle among
    their own first.  A component is named by its least node, whose sign is 1.
    """
    ends = F.least(a, b).alias("ea"), F.greatest(a, b).alias("eb")
    own = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = own.select(*ends, F.col(weight).alias("w"), F.col(flip).alias("f"))
    kinds = {c: type(pairs.schema[c].dataType) for c in pairs.columns}
    if kinds["ea"] in (T.IntegerType, T.LongType) and kinds["w"] in (T.IntegerType, T.LongType, T.FloatType, T.DoubleType):
        pairs = _thinned(pairs)
    least = pairs.groupBy("ea", "eb").agg(F.min(F.struct("w", "f")).alias("m"))
    links = written(least.select(F.col("ea").alias("ca"), F.col("eb").alias("cb"), F.struct("m.w", "ea", "eb", "m.f").alias("e")), "links")
    nodes = links.select(F.explode(F.array("ca", "cb")).alias("node")).distinct().select("node", F.col("node").alias("c"), F.lit(False).alias("turned"))
    nodes = written(nodes, "nodes")
    for _ in range(rounds):
        if links.isEmpty():
            break
        sides = links.select(F.col("ca").alias("c"), F.struct("e", F.col("cb").alias("to")).alias("m")).union(links.select(F.col("cb"), F.struct("e", F.col("ca").alias("to"))))
        chosen = written(sides.groupBy("c").agg(F.min("m").alias("m")).select("c", F.col("m.to").alias("p"), F.col("m.e.f").alias("f")), "chosen")
        back = chosen.select(F.col("c").alias("p"), F.col("p").alias("q"))
        root = (F.col("q") == F.col("c")) & (F.col("c") < F.col("p"))  # of two that chose each other, the lesser
        parents = chosen.join(back, "p").select("c", F.when(root, F.col("c")).otherwise(F.col("p")).alias("p"), F.when(root, F.lit(False)).otherwise(F.col("f")).alias("f"))
        tops = _jumped(written(parents, "forest"))
        side = lambda x: tops.select(F.col("c").alias(f"c{x}"), F.col("p").alias(f"p{x}"), F.col("f").alias(f"f{x}"))  # noqa: B023, E731
        nodes = written(nodes.join(tops, "c", "left").select("node", F.coalesce("p", "c").alias("c"), (F.col("turned") != F.coalesce("f", F.lit(False))).alias("turned")), "nodes")
        odd = (F.col("e.f") != F.col("fa")) != F.col("fb")
        moved = links.join(side("a"), "ca").join(side("b"), "cb").where("pa <> pb").select(F.least("pa", "pb").alias("ca"), F.greatest("pa", "pb").alias("cb"), F.struct("e.w", "e.ea", "e.eb", odd.alias("f")).alias("e"))
        links = written(moved.groupBy("ca", "cb").agg(F.min("e").alias("e")), "links")
    else:
        raise RuntimeError(f"the forest did not settle in {rounds} rounds")
    heads = nodes.groupBy("c").agg(F.min("node").alias("component"), F.min_by("turned", "node").alias("first"))
    return nodes.join(heads, "c").select("node", "component", F.when(F.col("turned") == F.col("first"), 1.0).otherwise(-1.0).alias("sign"))


def _boxes(cells: DataFrame, level: int, by: list[str], key: str) -> DataFrame:
    """Bounding boxes of the points in cells of a level, and the least and largest group in each."""
    sides = [f(f"{p}{a}").alias(f"{p}{a}") for a in AXES for f, p in ((F.min, "l"), (F.max, "h"))]
    return cells.groupBy(key, *by, *[F.shiftright(f"c{a}", level).alias(f"c{a}") for a in AXES]).agg(*sides, F.min("g0").alias("g0"), F.max("g1").alias("g1"))


def nearest_foreign(points: DataFrame, key: str, group: str, point_id: str) -> DataFrame:
    """(key, group, a, b, distance): each group's point that is nearest to one of another group of the key, and that one.

    Cells are refined from one that holds the whole key: pairs of a group's cell and
    a cell with foreign points go on while the least distance of their boxes is
    within the group's bound, the smallest of the pairs' largest distances.  The
    bound starts from the finest cells that a group shares with others: where points
    are mixed it is near the answer, so few pairs but a cell's own go on.  A cell
    counts once, however many groups are in it, so neither the number of groups nor
    their sizes bounds the search.  Ties go to the smaller ids; a key of one group
    has no row.
    """
    p = points.select(key, F.col(group).alias("g"), F.col(point_id).alias("id"), *[F.col(a).cast("double").alias(a) for a in AXES])
    origin = search_edges(p, key, 3).join(p.groupBy(key).agg(*[F.min(a).alias(f"o{a}") for a in AXES]), key)
    placed = p.join(origin, key).select(key, "g", "id", *AXES, *[F.floor((F.col(a) - F.col(f"o{a}")) / F.col("__edge")).cast("long").alias(f"c{a}") for a in AXES])
    placed = written(placed, "foreign-points")
    fine = placed.groupBy(key, "g", *[f"c{a}" for a in AXES]).agg(*[f(a).alias(f"{n}{a}") for a in AXES for f, n in ((F.min, "l"), (F.max, "h"))])
    fine = written(fine.withColumns({"g0": F.col("g"), "g1": F.col("g")}), "foreign-cells")
    top = int(placed.agg(F.max(F.greatest(*[f"c{a}" for a in AXES]))).first()[0] or 0).bit_length()
    foreign = (F.col("g0") != F.col("g")) | (F.col("g1") != F.col("g"))
    length = lambda v: F.sqrt(reduce(lambda s, x: s + x, [x * x for x in v]))
    across = length([F.greatest(F.col(f"hb{a}") - F.col(f"la{a}"), F.col(f"ha{a}") - F.col(f"lb{a}")) for a in AXES])
    apart = length([F.greatest(F.col(f"lb{a}") - F.col(f"ha{a}"), F.col(f"la{a}") - F.col(f"hb{a}"), F.lit(0.0)) for a in AXES])
    own = fine.select(key, "g", *[f"c{a}" for a in AXES], *[F.col(f"{s}{a}").alias(f"{s}a{a}") for a in AXES for s in "lh"])
    shared = _boxes(fine, 0, [], key).select(key, "g0", "g1", *[f"c{a}" for a in AXES], *[F.col(f"{s}{a}").alias(f"{s}b{a}") for a in AXES for s in "lh"])
    start = own.join(shared.hint("merge"), [key, *[f"c{a}" for a in AXES]]).where(foreign).groupBy(key, "g").agg(F.min(across).alias("start"))
    start = written(start, "foreign-start")
    pairs = None
    for level in range(top, -1, -1):
        own = _boxes(fine, level, ["g"], key).drop("g0", "g1")
        own = own.select(key, "g", *[F.col(f"{s}{a}").alias(f"{s}a{a}") for a in AXES for s in "clh"])
        any_ = _boxes(fine, level, [], key).select(key, "g0", "g1", *[F.col(f"{s}{a}").alias(f"{s}b{a}") for a in AXES for s in "clh"])
        if pairs is None:
            met = own.join(any_, key)
        else:
            up = lambda s: [F.shiftright(f"c{s}{a}", 1).alias(f"p{s}{a}") for a in AXES]
            met = pairs.join(own.select("*", *up("a")).hint("merge"), [key, "g", *[f"pa{a}" for a in AXES]]).join(any_.select("*", *up("b")).hint("merge"), [key, *[f"pb{a}" for a in AXES]])
        cells = [F.col(f"c{s}{a}").alias(f"p{s}{a}") for s in "ab" for a in AXES]
        told = met.where(foreign).select(key, "g", *cells, apart.alias("low"), across.alias("high")).join(start, [key, "g"], "left")
        told = written(told.where(F.col("start").isNull() | (F.col("low") <= F.col("start") * (1 + 1e-9))), "foreign-pairs")
        bound = told.groupBy(key, "g").agg(F.least(F.min("high"), F.min("start")).alias("bound"))
        pairs = told.join(bound, [key, "g"]).where(F.col("low") <= F.col("bound") * (1 + 1e-9)).drop("low", "high", "start", "bound")
    first = placed.select(key, "g", F.col("id").alias("a"), *[F.col(a).alias(f"a{a}") for a in AXES], *[F.col(f"c{a}").alias(f"pa{a}") for a in AXES])
    second = placed.select(key, F.col("g").alias("other"), F.col("id").alias("b"), *[F.col(a).alias(f"b{a}") for a in AXES], *[F.col(f"c{a}").alias(f"pb{a}") for a in AXES])
    both = pairs.join(first.hint("merge"), [key, "g", *[f"pa{a}" for a in AXES]]).join(second.hint("merge"), [key, *[f"pb{a}" for a in AXES]]).where(F.col("other") != F.col("g"))
    distance = length([F.col(f"a{a}") - F.col(f"b{a}") for a in AXES])
    best = both.groupBy(key, "g").agg(F.min(F.struct(distance.alias("distance"), "a", "b")).alias("m"))
    return best.select(key, F.col("g").alias(group), "m.a", "m.b", "m.distance")


def consistent_normals(points: DataFrame, key: str, point_id: str, k: int = 10) -> DataFrame:
    """``points`` (key, point_id, z, y, x, nz, ny, nx) with normals that agree along the surface, and their ``component``.

    Each point is tied to its ``k`` nearest ones; each set that results, to its
    nearest point outside.  An edge weighs less the more parallel its normals are.
    What is left to choose is one sign for each component.
    """
    own = written(points.withColumn("__id", F.struct(key, point_id)), "normals")
    near = knn_edges(own, key, point_id, k).select(F.struct(F.col(key), F.col("a").alias(point_id)).alias("a"), F.struct(F.col(key), F.col("b").alias(point_id)).alias("b"))
    near = written(near, "near")
    sets = connected_components(near).select(F.col("node").alias("__id"), F.col("component").alias("__set"))
    grouped = written(own.join(sets, "__id", "left").withColumn("__set", F.coalesce("__set", "__id")), "sets")
    several = grouped.groupBy(key).agg(F.min("__set").alias("l"), F.max("__set").alias("h")).where("l <> h").select(key)
    ties = near
    if not several.isEmpty():
        ties = near.union(nearest_foreign(grouped.join(several, key, "left_semi"), key, "__set", "__id").select("a", "b"))
    side = lambda s: own.select(F.col("__id").alias(s), *[F.col(f"n{a}").alias(f"{s}{a}") for a in AXES])
    dot = reduce(lambda s, t: s + t, [F.col(f"a{a}") * F.col(f"b{a}") for a in AXES])
    weighed = ties.join(side("a"), "a").join(side("b"), "b").select("a", "b", (1.0 - F.abs(dot) + 1e-6).alias("weight"), (dot < 0).alias("flip"))
    signs = spanning_signs(weighed)
    out = own.join(signs.withColumnRenamed("node", "__id"), "__id", "left")
    sign = F.coalesce("sign", F.lit(1.0))
    return out.withColumns({f"n{a}": F.col(f"n{a}") * sign for a in AXES}).withColumn("component", F.coalesce("component", "__id")[point_id]).drop("__id", "sign")
