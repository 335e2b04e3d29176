"""Cross-validation splits: the seeded reference split, random trials, blocked folds."""

from __future__ import annotations

import json
import random

try:
    from _md5 import md5  # the interpreter's own: OpenSSL's takes three times as long for a short text
except ImportError:
    from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.boxes import AXES
from plumbline.operators.graph import connected_components
from plumbline.operators.leakage import contaminated, declared_folds
from plumbline.storage import written

MOST_NAMES = 5_000_000  #: a permutation is one array of the driver; more rows are refused


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``place``, from 0 in the given order: ranges are numbered from their counts, so no task holds all rows."""
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__own", F.monotonically_increasing_id()), "numbered")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__own").alias("__least"))
    base = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    joined = ranged.join(F.broadcast(sizes.select("__part", "__least", base.alias("__base"))), "__part")
    return joined.select(*rows.columns, (F.col("__base") + F.col("__own") - F.col("__least")).alias("place"))


def _numbered(names: DataFrame) -> tuple[DataFrame, int]:
    """(name, i): places in name order."""
    placed = numbered(names.select("name").distinct(), "name").select("name", F.col("place").cast("int").alias("i"))
    return placed, placed.count()


def seeded_split(names: DataFrame, k: int = 5, seed: int = 12345) -> DataFrame:
    """(name, fold) of the shuffled k-fold split with that seed over the sorted names.

    The permutation is MT19937's, so it must be drawn in one place: it is one
    integer array of the driver, and ``MOST_NAMES`` bounds it.  The first n mod k
    folds hold one row more.
    """
    placed, n = _numbered(names)
    if n > MOST_NAMES:
        raise ValueError(f"{n} names; a seeded split is drawn for {MOST_NAMES} at most")
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    sizes = [n // k + (f < n % k) for f in range(k)]
    fold = np.empty(n, np.int32)
    fold[order] = np.repeat(np.arange(k, dtype=np.int32), sizes)
    table = names.sparkSession.createDataFrame([(int(i), int(f)) for i, f in enumerate(fold)] or [(-1, 0)], "i int, fold int")
    return placed.join(table, "i").select("name", "fold")


def random_trials(spark: SparkSession, n: int, graph: DataFrame, k: int = 5, trials: int = 200, seed: int = 0) -> DataFrame:
    """One row: mean and deviation over ``trials`` of the contaminated share, and the mean shared share.

    Each trial shuffles the order that the trial before it left.  ``graph`` is
    (a, b, fraction) over ids 0 to n - 1, both directions.
    """
    if n * trials > MOST_NAMES:
        raise ValueError(f"{n} x {trials} places; {MOST_NAMES} at most")
    order, draw, rows = list(range(n)), random.Random(seed), []
    for trial in range(trials):
        draw.shuffle(order)
        rows += [(trial, i, place % k) for place, i in enumerate(order)]
    placed = spark.createDataFrame(rows, "trial int, id long, fold int")
    other = placed.select("trial", F.col("id").alias("b"), F.col("fold").alias("other"))
    touched = placed.join(graph.withColumnRenamed("a", "id"), "id").join(other, ["trial", "b"]).where("fold <> other").groupBy("trial", "id").agg(F.max("fraction").alias("shared"))
    each = touched.groupBy("trial").agg((100.0 * F.count(F.lit(1)) / n).alias("contaminated"), (100.0 * F.sum("shared") / n).alias("shared"))
    all_trials = spark.range(trials).select(F.col("id").cast("int").alias("trial")).join(each, "trial", "left").fillna(0.0)
    return all_trials.agg(
        F.lit(k).alias("k"), F.lit(trials).alias("trials"), F.avg("contaminated").alias("contaminated_pct_mean"),
        F.coalesce(F.stddev_samp("contaminated"), F.lit(0.0)).alias("contaminated_pct_sd"), F.avg("shared").alias("mean_max_shared_pct"),
    )


def _dealt(ids: DataFrame, graph: DataFrame, n: int, k: int, trials: int, seed: int, width: int, chunk: int, span: int) -> tuple[DataFrame, bool]:
    """(chunk, id, folds) of the ids on an edge, a byte a trial, and whether ``width`` bytes of each md5 told all ids apart.

    Chunks of ids hash theirs for all trials and send the md5s, packed, to ranges of a
    trial's order; a range ranks its own and sends the places back to the chunks.  An
    id off the graph is counted there, but nothing comes back for it.
    """
    bits = max(0, (n - 1) // span).bit_length()
    touched = graph.select(F.col("a").alias("id")).union(graph.select("b")).distinct().withColumn("own", F.lit(True))
    flagged = ids.select("id").join(touched.hint("merge"), "id", "left")
    text = F.coalesce(F.concat(F.lit("#"), F.col("id").cast("string")), F.lit(""))
    held = F.struct(text.alias("text"), F.coalesce("own", F.lit(False)).alias("own"), "id")
    dealt = flagged.select(F.pmod(F.xxhash64("id"), F.lit(-(-n // chunk))).alias("chunk"), held.alias("row"))
    chunks = written(dealt.groupBy("chunk").agg(F.collect_list("row").alias("rows")), "chunks")

    def sent(batches):
        for batch in batches:
            for number, rows in zip(batch["chunk"].to_pylist(), batch["rows"], strict=True):
                texts = [t.encode() for t in rows.values.field("text").to_pylist()]
                own = rows.values.field("own").to_numpy(zero_copy_only=False)
                for trial in range(trials):
                    head = f"{seed}#{trial}".encode()
                    drawn = np.frombuffer(b"".join([md5(head + t).digest()[:width] for t in texts]), np.uint8).reshape(-1, width)
                    part = drawn[:, :4].copy().view(">u4").ravel().astype(np.int64) >> (32 - bits)
                    order = np.argsort(part, kind="stable")
                    out = []
                    for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                        mine = at[own[at]]
                        out.append({"trial": trial, "part": int(part[at[0]]), "chunk": number, "at": mine.astype("<u4").tobytes(), "drawn": drawn[mine].tobytes() + drawn[at[~own[at]]].tobytes()})
                    yield pa.RecordBatch.from_pylist(out, pieces)

    def ranked(key, group):
        sizes = np.array([len(d.as_py()) // width for d in group["drawn"]])
        drawn = np.frombuffer(b"".join(group["drawn"].to_pylist()), np.uint8).reshape(-1, width)
        words = [np.ascontiguousarray(drawn[:, i : i + 8]).view(">u8").ravel().astype(np.uint64) for i in range(0, width, 8)]
        order = np.argsort(words[0], kind="stable") if width == 8 else np.lexsort(words[::-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tied = width < 16 and bool((words[0][order[1:]] == words[0][order[:-1]]).any())
        starts, many = np.cumsum(sizes) - sizes, [len(a.as_py()) // 4 for a in group["at"]]
        back = [(place[s : s + m] % k).astype(np.uint8).tobytes() for s, m in zip(starts, many, strict=True)]
        told = {"trial": group["trial"], "part": group["part"], "chunk": group["chunk"], "at": group["at"], "place": pa.array(back, pa.binary()), "n": pa.array([len(order)] * len(back), pa.int64()), "tied": pa.array([tied] * len(back))}
        return pa.table(told)

    def gathered(key, rows, back):
        rows = rows["rows"].combine_chunks()
        rows = (rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows).flatten()
        folds = np.zeros((len(rows), trials), np.uint8)
        for trial, base, at, place in zip(back["trial"].to_pylist(), back["base"].to_pylist(), back["at"].to_pylist(), back["place"].to_pylist(), strict=True):
            folds[np.frombuffer(at, "<u4"), trial] = (np.frombuffer(place, np.uint8).astype(np.int64) + base) % k
        own = np.flatnonzero(rows.field("own").to_numpy(zero_copy_only=False))
        mine = rows.field("id").take(pa.array(own))
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(own), pa.int64()), "id": mine, "folds": pa.array([folds[i].tobytes() for i in own], pa.binary())})

    kept = "trial int, part long, chunk long, at binary"
    pieces = pa.schema([("trial", pa.int32()), ("part", pa.int64()), ("chunk", pa.int64()), ("at", pa.binary()), ("drawn", pa.binary())])
    back = chunks.repartition(min(4096, -(-n // chunk))).mapInArrow(sent, f"{kept}, drawn binary").groupBy("trial", "part").applyInArrow(ranked, f"{kept}, place binary, n long, tied boolean")
    back = written(back, "ranks")
    sizes = back.groupBy("trial", "part").agg(F.first("n").alias("n"))
    before = Window.partitionBy("trial").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of the trial
    base = sizes.select("trial", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) % k).alias("base"))
    placed = back.join(base.hint("merge"), ["trial", "part"]).select("chunk", "trial", "base", "at", "place")
    kind = ids.schema["id"].dataType.simpleString()
    folds = chunks.groupBy("chunk").cogroup(placed.groupBy("chunk")).applyInArrow(gathered, f"chunk long, id {kind}, folds binary")
    return written(folds, "folds"), not back.where("tied").isEmpty()


def hashed_trials(ids: DataFrame, graph: DataFrame, k: int = 5, trials: int = 200, seed: int = 0, width: int = 8, chunk: int = 32768, span: int = 262144) -> DataFrame:
    """The statistics of ``random_trials`` for any number of ids: each trial deals the ids in the order of their md5.

    ``ids`` (id); ``graph`` (a, b, fraction), both directions.  The folds of a
    trial are even, as those of a shuffle; nothing but the result reaches the driver.
    An id's draws stay packed: no id and trial is a row.  ``width``: bytes of an md5 that
    are sent first (8 or 16), all 16 where two ids share those; ``chunk``: most ids hashed
    together; ``span``: most ids of a trial ranked together, both on average.
    """
    if not 1 <= k <= 256 or width not in (8, 16):
        raise ValueError("1 to 256 folds, 8 or 16 bytes of md5")
    n = max(1, ids.count())
    graph = written(graph.select("a", "b", "fraction"), "graph")
    deal = lambda w: _dealt(ids, graph, n, k, trials, seed, w, min(chunk, max(1024, n // 64)), span)
    folds, tied = deal(width)
    if tied:
        folds, _ = deal(16)
    other = folds.select(F.col("id").alias("b"), F.col("folds").alias("other"))
    met = graph.join(other.hint("merge"), "b").join(folds.withColumnRenamed("id", "a").hint("merge"), "a").select("chunk", "a", "fraction", "folds", "other")

    def counted(key, edges):
        edges = edges.sort_by("a")
        sides = [np.frombuffer(b"".join(edges[c].to_pylist()), np.uint8).reshape(-1, trials) for c in ("folds", "other")]
        share = np.array(edges["fraction"].to_pylist(), float)[:, None]
        names = edges["a"].combine_chunks()
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
        first = np.flatnonzero(np.r_[True, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)])
        apart = sides[0] != sides[1]
        hit = np.logical_or.reduceat(apart, first)
        most = np.maximum.reduceat(np.where(apart & ~np.isnan(share), share, -np.inf), first)
        return pa.table({"trial": pa.array(range(trials), pa.int32()), "hit": pa.array(hit.sum(0), pa.int64()), "most": pa.array(np.where(most > -np.inf, most, 0.0).sum(0), pa.float64())})

    each = met.groupBy("chunk").applyInArrow(counted, "trial int, hit long, most double")
    per_trial = each.groupBy("trial").agg((100.0 * F.sum("hit") / n).alias("contaminated"), (100.0 * F.sum("most") / n).alias("shared"))
    all_trials = ids.sparkSession.range(trials).select(F.col("id").cast("int").alias("trial")).join(per_trial, "trial", "left").fillna(0.0)
    return all_trials.agg(
        F.lit(k).alias("k"), F.lit(trials).alias("trials"), F.avg("contaminated").alias("contaminated_pct_mean"),
        F.coalesce(F.stddev_samp("contaminated"), F.lit(0.0)).alias("contaminated_pct_sd"), F.avg("shared").alias("mean_max_shared_pct"),
    )


def block_of(size: dict[str, Column | int]) -> list[Column]:
    """Block numbers of a box's centre (integer half size), for blocks of the given edges."""
    return [F.floor((F.col(f"{a}0") + F.floor((F.col(f"{a}1") - F.col(f"{a}0")) / 2)) / size[a]).alias(f"b{a}") for a in AXES]


def blocks(boxes: DataFrame, factor: int = 4) -> DataFrame:
    """(id, volume, bz, by, bx): blocks of ``factor`` times the largest edge along each axis."""
    largest = boxes.agg(*[F.max(F.col(f"{a}1") - F.col(f"{a}0")) for a in AXES]).first()
    size = {a: max(1, int(s or 1) * factor) for a, s in zip(AXES, largest, strict=True)}
    return boxes.select("id", "volume", *block_of(size))


def deal_plan(histogram: dict[int, int], k: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first rank, number, folds in turn): each group to the fold that is smallest so far, larger groups first.

    Once the folds lie within one group of each other, equal groups go round them
    in a fixed order; so a run of any number of equal groups is one entry.
    """
    filled, plan = [0] * k, []
    for size in sorted(histogram, reverse=True):
        rank, count = 0, histogram[size]
        while rank < count:
            if max(filled) - min(filled) < size:  # a fold that gets one comes behind all others
                turn = sorted(range(k), key=lambda f: (filled[f], f))
                plan.append((size, rank, count - rank, turn))
                rounds, rest = divmod(count - rank, k)
                for place, f in enumerate(turn):
                    filled[f] += size * (rounds + (place < rest))
                break
            fold = min(range(k), key=lambda f: (filled[f], f))
            plan.append((size, rank, 1, [fold]))
            filled[fold] += size
            rank += 1
    return plan


def deal_groups(groups: DataFrame, k: int = 5) -> DataFrame:
    """(group, fold): groups (group, n) by size, each to the fold that is smallest so far.

    Groups of equal size go in the order of their names' md5.  The plan needs the
    number of groups of each size (for N rows at most sqrt(2 N) sizes); groups take
    their folds by their rank within their size, so none passes the driver.
    """
    spark = groups.sparkSession
    sizes = {int(r["n"]): int(r["count"]) for r in groups.groupBy("n").count().collect()}
    bases, at = [], 0
    for size in sorted(sizes, reverse=True):
        bases.append((size, at))
        at += sizes[size]
    base = spark.createDataFrame(bases or [(0, 0)], "n long, base long")
    plan = spark.createDataFrame(deal_plan(sizes, k) or [(0, 0, 0, [0])], "n long, first long, many long, turn array<int>")
    ranked = numbered(groups.select((-F.col("n")).alias("order"), F.md5("group").alias("hash"), "group", "n"), "order", "hash", "group")
    within = ranked.join(base, "n").select("group", "n", (F.col("place") - F.col("base")).alias("rank"))
    met = within.join(plan, "n").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("many")))
    return met.select("group", F.get("turn", F.pmod(F.col("rank") - F.col("first"), F.size("turn")).cast("int")).alias("fold"))


def blocked_kfold(boxes: DataFrame, graph: DataFrame, k: int = 5, mode: str = "block", factor: int = 4) -> DataFrame:
    """(id, fold): whole blocks (``block``) or whole components of the graph (``component``) per fold."""
    if mode == "block":
        keyed = blocks(boxes, factor).select("id", F.concat_ws("/", "volume", *[f"b{a}" for a in AXES]).alias("group"))
    elif mode == "component":
        named = connected_components(graph)
        keyed = boxes.join(named.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("id", F.coalesce("component", "id").cast("string").alias("group"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    folds = deal_groups(keyed.groupBy("group").agg(F.count(F.lit(1)).alias("n")), k)
    return keyed.join(folds.hint("merge"), "group").select("id", "fold")


def splits_json(folds: DataFrame) -> DataFrame:
    """(fold, split): each fold's names as ``{"train": [...], "val": [...]}`` text, names sorted."""
    lists = folds.groupBy("fold").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "train", F.col("name")))).alias("train"), F.sort_array(F.collect_list(F.when(F.col("role") == "val", F.col("name")))).alias("val")
    )
    return lists.select("fold", F.to_json(F.struct("train", "val")).alias("split")).orderBy("fold")


def write_splits(folds: DataFrame, path: str) -> None:
    """One JSON file with a list of folds; the lists of names are the file, so they pass here whole."""
    with open(path, "w") as out:
        json.dump([json.loads(r["split"]) for r in splits_json(folds).collect()], out, indent=1)


__all__ = ["blocked_kfold", "blocks", "contaminated", "deal_groups", "deal_plan", "declared_folds", "hashed_trials", "numbered", "random_trials", "seeded_split", "splits_json", "write_splits"]
