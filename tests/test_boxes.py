"""Overlap join, leakage and splits against brute force."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline.operators import boxes, graph, leakage, splits


def _random_boxes(n=60, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        z, y, x = (r.randrange(0, 200) for _ in range(3))
        rows.append((i, "v" + str(i % 2), z, y, x, z + r.choice((30, 60)), y + 40, x + r.choice((30, 50))))
    return rows


SCHEMA = "id long, volume string, z0 long, y0 long, x0 long, z1 long, y1 long, x1 long"


def _brute(rows, buffer):
    out = {}
    for a in rows:
        for b in rows:
            if a[1] != b[1] or (a[2], a[0]) >= (b[2], b[0]):
                continue
            side = all((a[k] <= b[k + 3] + buffer and b[k] <= a[k + 3] + buffer) if buffer else (a[k] < b[k + 3] and b[k] < a[k + 3]) for k in (3, 4))
            if b[2] < a[5] + buffer and side:
                shared = own = 1
                for k in (2, 3, 4):
                    shared *= max(0, min(a[k + 3], b[k + 3]) - max(a[k], b[k]))
                    own *= a[k + 3] - a[k]
                out[a[0], b[0]] = shared / own
    return out


@pytest.mark.parametrize("buffer", [0, 10])
@pytest.mark.parametrize("cell", [None, 17])
def test_overlap_pairs(spark, buffer, cell):
    rows = _random_boxes()
    got = {(r.a, r.b): r.fraction for r in boxes.overlap_pairs(spark.createDataFrame(rows, SCHEMA), buffer, cell=cell).collect()}
    assert got == pytest.approx(_brute(rows, buffer))


def test_overlap_join_has_no_nested_loop(spark):
    plan = boxes.overlap_pairs(spark.createDataFrame(_random_boxes(), SCHEMA), cell=50)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_parse_names(spark):
    names = spark.createDataFrame([("s1_z0_y10_x20",), ("bad name",), ("a.b_z1_y2_x3",)], "name string")
    sizes = spark.createDataFrame([("s1_z0_y10_x20", 10, 20, 30)], "name string, sz int, sy int, sx int")
    good, bad = boxes.parse_names(names, sizes, 300)
    got = {r.name: (r.volume, r.z1, r.y1, r.x1) for r in good.collect()}
    assert got == {"s1_z0_y10_x20": ("s1", 10, 30, 50), "a.b_z1_y2_x3": ("a.b", 301, 302, 303)}
    assert [r.name for r in bad.collect()] == ["bad name"]


@pytest.mark.parametrize("mode", ["block", "component"])
def test_blocked_kfold_does_not_leak(spark, mode):
    rows = [(i, "v", i // 16 * 150, i // 4 % 4 * 150, i % 4 * 150, i // 16 * 150 + 300, i // 4 % 4 * 150 + 300, i % 4 * 150 + 300) for i in range(64)]
    b = spark.createDataFrame(rows, SCHEMA)
    g = boxes.overlap_graph(b)
    usual = leakage.declared_folds(splits.seeded_split(b.selectExpr("cast(id as string) name")).selectExpr("cast(name as long) id", "fold"), 5)
    assert leakage.split_leakage(usual, g).first().n_contaminated > 0
    folds = leakage.declared_folds(splits.blocked_kfold(b, g, 5, mode, factor=1), 5)
    safe = leakage.with_buffer_zone(folds, g)
    assert leakage.residual_leaks(safe, g).count() == 0
    assert safe.where("role = 'val'").select("id").distinct().count() == 64


def test_training_rows_are_those_declared(spark):
    folds = spark.createDataFrame([(0, "val", 1), (0, "train", 2)], "fold int, role string, id long")
    g = spark.createDataFrame([(1, 3, 0.5), (3, 1, 0.5)], "a long, b long, fraction double")
    assert leakage.split_leakage(folds, g).first().n_contaminated == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)]
    name = {}

    def find(i):
        name.setdefault(i, i)
        while name[i] != i:
            i = name[i]
        return i

    for a, b in edges:
        p, q = find(a), find(b)
        name[max(p, q)] = min(p, q)
    got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {i for a, b in edges if a != b for i in (a, b)}
    assert got == {i: find(i) for i in touched}


def test_random_trials_shuffle_what_the_last_left(spark):
    g = spark.createDataFrame([(a, b, 0.5) for a in range(10) for b in range(10) if abs(a - b) == 1], "a long, b long, fraction double")
    order, draw, shares = list(range(10)), random.Random(0), []
    for _ in range(4):
        draw.shuffle(order)
        fold = {i: p % 5 for p, i in enumerate(order)}
        shares.append(10.0 * sum(any(fold[i] != fold[j] for j in (i - 1, i + 1) if 0 <= j < 10) for i in range(10)))
    got = splits.random_trials(spark, 10, g, 5, 4)
    assert got.first().contaminated_pct_mean == pytest.approx(sum(shares) / 4)


@pytest.mark.parametrize("k", [2, 5])
def test_groups_go_to_the_smallest_fold(spark, k):
    import hashlib

    r = random.Random(k)
    sizes = {f"g{i}": r.choice((1, 1, 1, 2, 3, 3, 8, 40)) for i in range(90)} | {"huge": 200}
    filled, want = [0] * k, {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], hashlib.md5(x[0].encode()).hexdigest(), x[0])):
        want[name] = min(range(k), key=lambda f: (filled[f], f))
        filled[want[name]] += n
    got = splits.deal_groups(spark.createDataFrame(list(sizes.items()), "group string, n long"), k).collect()
    assert {x.group: x.fold for x in got} == want and len(got) == len(want)


def test_hashed_trials(spark):
    import hashlib

    n, k = 23, 5
    edges = [(a, b, 0.1 * (a % 7 + 1)) for a in range(n) for b in range(n) if abs(a - b) in (1, 4)]
    shares, fractions = [], []
    for trial in range(6):
        order = sorted(range(n), key=lambda i: (hashlib.md5(f"3#{trial}#{i}".encode()).hexdigest(), i))
        fold = {i: p % k for p, i in enumerate(order)}
        hit = {}
        for a, b, f in edges:
            if fold[a] != fold[b]:
                hit[a] = max(hit.get(a, 0), f)
        shares.append(100 * len(hit) / n)
        fractions.append(100 * sum(hit.values()) / n)
    ids = spark.createDataFrame([(i,) for i in range(n)], "id long")
    got = splits.hashed_trials(ids, spark.createDataFrame(edges, "a long, b long, fraction double"), k, 6, 3).first()
    assert got.contaminated_pct_mean == pytest.approx(sum(shares) / 6) and got.mean_max_shared_pct == pytest.approx(sum(fractions) / 6)


@pytest.mark.parametrize("twice", [[], [4, 30]])
def test_no_id_and_trial_of_hashed_trials_is_a_row(spark, monkeypatch, twice):
    """Ids that occur twice share the whole md5, so that they are told apart by none of its bytes."""
    import hashlib

    n, k, trials = 1200, 3, 12
    rows = [*range(n), *twice]
    edges = [(a, b, 0.1 * (a % 7 + 1)) for a in range(0, n, 2) for b in (a - 2, a + 2) if 0 <= b < n]
    shares, fractions = [], []
    for trial in range(trials):
        folds = {}
        for p, i in enumerate(sorted(rows, key=lambda i: (hashlib.md5(f"0#{trial}#p{i}".encode()).hexdigest(), i))):
            folds.setdefault(i, []).append(p % k)
        hit = {}
        for a, b, f in edges:
            if any(x != y for x in folds[a] for y in folds[b]):
                hit[a] = max(hit.get(a, 0), f)
        shares.append(100 * len(hit) / len(rows))
        fractions.append(100 * sum(hit.values()) / len(rows))
    count, write = [], splits.written
    monkeypatch.setattr(splits, "written", lambda df, tag: count.append(df.count()) or write(df, tag))
    ids = spark.createDataFrame([(f"p{i}",) for i in rows], "id string")
    found = splits.hashed_trials(ids, spark.createDataFrame([(f"p{a}", f"p{b}", f) for a, b, f in edges], "a string, b string, fraction double"), k, trials, span=300).first()
    assert found.contaminated_pct_mean == pytest.approx(sum(shares) / trials) and found.mean_max_shared_pct == pytest.approx(sum(fractions) / trials)
    assert found.contaminated_pct_sd == pytest.approx(statistics.stdev(shares))
    assert max(count) < 2 * n  # ids and trials were rows: 14400 of them


def test_places_follow_the_order(spark):
    rows = [(i * 37 % 101, i % 3) for i in range(101)]
    got = splits.numbered(spark.createDataFrame(rows, "a long, n long"), "n", "a").collect()
    assert [(r.a, r.n) for r in sorted(got, key=lambda r: r.place)] == sorted(rows, key=lambda r: (r[1], r[0])) and sorted(r.place for r in got) == list(range(101))


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from plumbline.storage import shared_dir

    bare = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda k: None), getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=bare))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_growing_sides_are_not_broadcast(spark):
    """Ranges of many rows have tiny files or none: their estimated size says nothing of their rows."""
    from plumbline.operators import boxes as bx
    from plumbline.operators import graph, leakage

    k = F.col("id")
    boxes = spark.range(40).select("id", F.lit("v").alias("volume"), *[(k * 5).alias(f"{a}0") for a in "zyx"], *[(k * 5 + 8).alias(f"{a}1") for a in "zyx"])
    pairs = bx.overlap_pairs(boxes)
    assert "Broadcast" not in _plan(pairs) and pairs.count() == 39
    folds, both = leakage.declared_folds(boxes.select("id", (k % 5).alias("fold")), 5), bx.overlap_graph(boxes)
    kept = leakage.with_buffer_zone(folds, both)
    for found in (leakage.contaminated(folds, both), kept, leakage.residual_leaks(kept, both)):
        assert "Broadcast" not in _plan(found)
    assert leakage.residual_leaks(kept, both).count() == 0
    assert {r["component"] for r in graph.connected_components(pairs).collect()} == {0}


def test_containing_holders_meet_items_in_bounded_numbers(spark):
    """Wide holders that all contain all items: pairs are not rows, and the first holder is that of all pairs."""
    from plumbline.operators import corpus

    r = random.Random(5)
    held = [(r.choice((0, 0, 0, 1, None)), lo, lo + r.choice((0.0, 1.0, 40.0, 900.0)), i) for i in range(900) for lo in (float(r.randrange(-500, 500)),)] + [(0, 5.0, 1.0, -1)]
    items = [(i, r.choice((0, 0, 0, 1, 2, None)), r.choice((None, *[float(r.randrange(-550, 1450))] * 20))) for i in range(900)]
    holders, sized = spark.createDataFrame(held, "k int, low double, high double, h int"), spark.createDataFrame(items, "i int, k int, size double")
    got = {r["i"]: r["holder"] and tuple(r["holder"]) for r in corpus.choose_containing(sized, holders, ["k"], "size", ("low", "high"), ["low", "h"]).collect()}
    want = {i: min(((lo, h) for hk, lo, hi, h in held if s is not None and hk is not None and hk == k and lo <= s <= hi), default=None) for i, k, s in items}
    assert got == want
    wide = spark.range(3000).select(F.lit(0).alias("k"), (-F.col("id") - 1.0).alias("low"), (F.col("id") + 3000.0).alias("high"), "id")
    many = spark.range(3000).select(F.col("id").alias("i"), F.lit(0).alias("k"), (F.col("id") + 0.0).alias("size"))
    found = corpus.choose_containing(many, wide, ["k"], "size", ("low", "high"), ["low"])
    assert {r["holder"]["low"] for r in found.collect()} == {-3000.0}
    assert _most_rows(spark) < 500_000  # of 9 million pairs


def test_foreign_search_of_mixed_points_keeps_few_pairs(spark, tmp_path, monkeypatch):
    """Pairs of cells stay about as many as the cells where groups are mixed, and the pair found is the nearest."""
    from plumbline.operators import orientation

    kept, write = [], orientation.written

    def counted(df, tag):
        out = write(df, tag)
        if tag == "foreign-pairs":
            kept.append(out.count())
        return out

    monkeypatch.setattr(orientation, "written", counted)
    r = random.Random(3)
    points = [(i, "k", i % 5, r.random() * 100, r.random() * 100, r.random() * 100) for i in range(1500)]
    got = {row["g"]: (row["a"], row["b"]) for row in orientation.nearest_foreign(spark.createDataFrame(points, "id int, k string, g int, z double, y double, x double"), "k", "g", "id").collect()}
    far = lambda p, q: sum((s - t) ** 2 for s, t in zip(p[3:], q[3:], strict=True))
    assert got == {g: min((far(p, q), p[0], q[0]) for p in points if p[2] == g for q in points if q[2] != g)[1:] for g in range(5)}
    assert max(kept) < 4 * len(points)


def _most_rows(spark):
    """The most rows that an operator of any query so far has given out."""
    store = spark._jsparkSession.sharedState().statusStore()
    java = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    most = 0
    for run in list(java(store.executionsList()))[-12:]:
        values = store.executionMetrics(run.executionId())
        for node in java(store.planGraph(run.executionId()).allNodes()):
            for metric in java(node.metrics()):
                value = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return most


def test_neighbour_search_visits_only_cells_within_the_edge(spark):
    """The least numbers are those of brute force, and a query is dealt to fewer than the 27 cells around it."""
    from plumbline.operators import voxels

    r = random.Random(8)
    points = [(i, "k", r.random() * 50, r.random() * 50, r.random() * 50) for i in range(3000)]
    table = spark.createDataFrame(points, "id int, k string, z double, y double, x double")
    got = {}
    for row in voxels.nearest_neighbours(table, "k", "id", 3).collect():
        got.setdefault(row["id"], []).append((row["turn"], row["neighbour"]))
    far = lambda p, q: sum((s - t) ** 2 for s, t in zip(p[2:], q[2:], strict=True))
    for p in points[::60]:
        near = sorted((far(p, q), q[0]) for q in points)[:3]
        assert [n for _, n in sorted(got[p[0]])] == [n for _, n in near]
    placed = table.select("k", F.col("id").alias("q"), *[F.col(a).alias(f"q{a}") for a in "zyx"], *[F.floor(F.col(a) / 5).alias(a) for a in "zyx"], F.lit(5.0).alias("__edge"), F.lit(90.0).alias("__reach"))
    assert voxels._cells_within(placed, ["k", "q"]).count() < 22 * len(points)
