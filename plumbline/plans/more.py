"""More registered queries: surfaces, corpus joins, top-k reports, series tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import profiles as pf
from plumbline.operators import census, corpus, leakage, ranks, surfaces, voxels
from plumbline.operators import boxes as bx
from plumbline.plans.proxies import BOXES_SQL, VOXELS_SQL, line_voxels, part_boxes, table
from plumbline.plans.registry import _GRID_SQL, _PROFILE_SQL, _grid, components_sql, normal_p_sql, profiles, query, rounded
from plumbline.sources import reports, zarr
from plumbline.streaming import resume

_CONSISTENCY_SQL = """l AS (SELECT l_suppkey % 8 AS id, l_orderkey % 60 AS z, l_partkey % 20 AS y, l_linenumber AS x, bool_or(l_quantity > 25) AS o FROM lineitem GROUP BY ALL),
c AS (SELECT a.id AS a, b.id AS b, CASE WHEN count(*) FILTER (a.o OR b.o) = 0 THEN 1 ELSE count(*) FILTER (a.o AND b.o) / count(*) FILTER (a.o OR b.o)::DOUBLE END AS iou FROM l a JOIN l b ON a.z = b.z AND a.y = b.y AND a.x = b.x AND a.id < b.id GROUP BY ALL)"""


def _consistency(spark, sf_dir):
    lab = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("id"), (F.col("l_orderkey") % 60).alias("z"), (F.col("l_partkey") % 20).alias("y"), F.col("l_linenumber").alias("x")).agg(F.bool_or(F.col("l_quantity") > 25).alias("on"))
    return leakage.overlap_consistency(lab)


@query(f"""WITH {_CONSISTENCY_SQL} SELECT count(*) AS n_pairs, round(avg(iou), 6) AS mean, round(median(iou), 6) AS median, round(min(iou), 6) AS min, count(*) FILTER (iou < 0.9) AS n_below_90, count(*) FILTER (iou < 0.5) AS n_below_50 FROM c""")
def consistency_summary(spark, sf_dir):
    return rounded(leakage.consistency_summary(_consistency(spark, sf_dir)), "mean", "median", "min")


@query(f"WITH {_CONSISTENCY_SQL} SELECT a, b, round(iou, 6) AS iou FROM c ORDER BY c.iou, a, b LIMIT 10")
def worst_overlaps(spark, sf_dir):
    """A top-k report."""
    return rounded(leakage.worst(_consistency(spark, sf_dir)).select("a", "b", "iou"), "iou")


@query(f"""WITH {_GRID_SQL}, n AS (SELECT *, lag(z) OVER r AS zb, lead(z) OVER r AS zf, lag(y) OVER r AS yb, lead(y) OVER r AS yf, lag(z) OVER c AS zcb, lead(z) OVER c AS zcf, lag(x) OVER c AS xcb, lead(x) OVER c AS xcf FROM g
  WINDOW r AS (PARTITION BY mesh, c ORDER BY r), c AS (PARTITION BY mesh, r ORDER BY c)),
d AS (SELECT mesh, r, c, CASE WHEN zb IS NOT NULL AND zf IS NOT NULL THEN (zf - zb) / 2 WHEN zf IS NOT NULL THEN zf - z ELSE z - zb END AS rz, CASE WHEN yb IS NOT NULL AND yf IS NOT NULL THEN (yf - yb) / 2 WHEN yf IS NOT NULL THEN yf - y ELSE y - yb END AS ry,
  CASE WHEN zcb IS NOT NULL AND zcf IS NOT NULL THEN (zcf - zcb) / 2 WHEN zcf IS NOT NULL THEN zcf - z ELSE z - zcb END AS cz, CASE WHEN xcb IS NOT NULL AND xcf IS NOT NULL THEN (xcf - xcb) / 2 WHEN xcf IS NOT NULL THEN xcf - x ELSE x - xcb END AS cx FROM n)
SELECT mesh, r, c, round(ry * cx / sqrt((ry * cx) ** 2 + (rz * cx) ** 2 + (ry * cz) ** 2), 6) AS nz FROM d""")
def quad_normals(spark, sf_dir):
    """Columns and rows of the grid move along one axis each, so two of the slopes are zero."""
    return rounded(surfaces.normals(_grid(spark, sf_dir)).select("mesh", "r", "c", "nz"), "nz")


@query(f"""WITH {_GRID_SQL}, s AS (SELECT mesh, max(c) + 1 AS cols FROM g GROUP BY mesh) SELECT g.mesh, g.r, g.c, round(CASE WHEN g.c >= cols // 2 THEN z + 7.5 ELSE z END, 6) AS z FROM g JOIN s USING (mesh)""")
def planted_displacement(spark, sf_dir):
    flat = _grid(spark, sf_dir).withColumns({"nz": F.lit(1.0), "ny": F.lit(0.0), "nx": F.lit(0.0)})
    return rounded(surfaces.displaced(flat, 7.5).select("mesh", "r", "c", "z"), "z")


@query(f"WITH {_GRID_SQL} SELECT mesh, CAST(r // 2 AS INTEGER) AS r, CAST(c // 2 AS INTEGER) AS c, z FROM g WHERE r % 2 = 0 AND c % 2 = 0")
def decimated_grid(spark, sf_dir):
    return surfaces.decimated(_grid(spark, sf_dir), 2).select("mesh", "r", "c", "z")


@query(f"""WITH {_GRID_SQL} SELECT mesh, CAST(greatest(floor(min(z)) - 8, 0) AS BIGINT) AS z0, CAST(ceil(max(z)) + 9 AS BIGINT) AS z1, CAST(greatest(floor(min(y)) - 8, 0) AS BIGINT) AS y0, CAST(ceil(max(y)) + 9 AS BIGINT) AS y1,
  CAST(greatest(floor(min(x)) - 8, 0) AS BIGINT) AS x0, CAST(ceil(max(x)) + 9 AS BIGINT) AS x1 FROM g GROUP BY mesh""")
def surface_bounds(spark, sf_dir):
    return surfaces.bounds(_grid(spark, sf_dir), "mesh", 8)


@query(f"""WITH {_GRID_SQL}, {VOXELS_SQL}, o AS (SELECT z, y, x, max(value) AS v FROM voxels GROUP BY ALL), p AS (SELECT mesh, r, c, z % 24 AS z, y % 24 AS y, x % 24 AS x FROM g),
k AS (SELECT mesh, r, c, floor(z) + dz AS z, floor(y) + dy AS y, floor(x) + dx AS x, (CASE dz WHEN 1 THEN z - floor(z) ELSE 1 - z + floor(z) END) * (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) AS w FROM p, range(0, 2) a(dz), range(0, 2) b(dy), range(0, 2) e(dx)),
s AS (SELECT k.mesh, k.r, k.c, sum(w * coalesce(o.v, 0)) AS s FROM k LEFT JOIN o ON o.z = k.z AND o.y = k.y AND o.x = k.x GROUP BY ALL), m AS (SELECT mesh, median(s) AS level FROM s GROUP BY mesh)
SELECT s.mesh, round(max(level), 6) AS level, round(1.4826 * median(abs(s.s - level)), 6) AS spread FROM s JOIN m ON m.mesh = s.mesh GROUP BY s.mesh""")
def surface_intensity(spark, sf_dir):
    """Median and spread of the line items' volume at the orders' vertices."""
    grid = _grid(spark, sf_dir).withColumns({a: F.col(a) % 24 for a in "zyx"})
    return rounded(surfaces.surface_intensity(grid, line_voxels(spark, sf_dir).groupBy("z", "y", "x").agg(F.max("value").alias("value"))), "level", "spread")


@query("""WITH v AS (SELECT p_partkey % 500 AS v, CAST(max(p_size) AS DOUBLE) AS z, max(p_retailprice) AS y, p_partkey % 500 * 1.0 AS x FROM part GROUP BY p_partkey % 500), f AS (SELECT l_orderkey % 500 AS a, l_partkey % 500 AS b, l_suppkey % 500 AS c FROM lineitem),
n AS (SELECT [f.a, f.b, f.c] AS corners, (b.y - a.y) * (c.x - a.x) - (b.x - a.x) * (c.y - a.y) AS nz, (b.x - a.x) * (c.z - a.z) - (b.z - a.z) * (c.x - a.x) AS ny, (b.z - a.z) * (c.y - a.y) - (b.y - a.y) * (c.z - a.z) AS nx FROM f JOIN v a ON a.v = f.a JOIN v b ON b.v = f.b JOIN v c ON c.v = f.c),
t AS (SELECT v, sum(nz) AS nz, sum(ny) AS ny, sum(nx) AS nx FROM (SELECT unnest(corners) AS v, nz, ny, nx FROM n) GROUP BY v)
SELECT v, round(nz / sqrt(nz * nz + ny * ny + nx * nx), 6) + 0.0 AS nz, round(ny / sqrt(nz * nz + ny * ny + nx * nx), 6) + 0.0 AS ny, round(nx / sqrt(nz * nz + ny * ny + nx * nx), 6) + 0.0 AS nx FROM t""")
def triangle_vertex_normals(spark, sf_dir):
    """Area-weighted normals of triangles between parts."""
    v = table(spark, sf_dir, "part").select((F.col("p_partkey") % 500).alias("v"), "p_size", "p_retailprice").groupBy("v").agg(F.max("p_size").cast("double").alias("z"), F.max("p_retailprice").alias("y")).select(F.lit(0).alias("mesh"), "v", "z", "y", (F.col("v") * 1.0).alias("x"))
    f = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("mesh"), (F.col("l_orderkey") % 500).alias("a"), (F.col("l_partkey") % 500).alias("b"), (F.col("l_suppkey") % 500).alias("c"))
    return rounded(surfaces.triangle_normals(v, f).drop("mesh"), "nz", "ny", "nx")


@query(f"""WITH {_PROFILE_SQL}, t AS (SELECT label, vec_id % 4 AS tile, i, avg(v) AS v, count(*) AS n FROM x GROUP BY ALL)
SELECT label, CAST(tile AS INTEGER) AS tile, max(n) AS n, round(max(v) - min(v), 6) AS range, round(max(v) FILTER (i = 32), 6) AS at_zero FROM t GROUP BY ALL HAVING max(n) >= 8 AND max(v) > 0""")
def block_profiles(spark, sf_dir):
    means = surfaces.mean_profiles(profiles(spark, sf_dir).withColumn("tile", (F.col("vec_id") % 4).cast("int")), ["label", "tile"], "profile", 8)
    p = F.col("profile")
    return rounded(means.where(F.array_max(p) > 0).select("label", "tile", "n", pf.value_range(p).alias("range"), pf.at_middle(p).alias("at_zero")), "range", "at_zero")


@query("""WITH p AS (SELECT l_partkey % 12 AS chunk, l_orderkey % 9 AS z, l_suppkey % 16 AS y, l_linenumber AS x, max(l_quantity) AS v FROM lineitem GROUP BY ALL), f AS (SELECT chunk, count(DISTINCT (y, x)) AS n FROM p GROUP BY chunk),
m AS (SELECT chunk, z, sum(v) / max(f.n) AS v, max(f.n) AS n FROM p JOIN f USING (chunk) GROUP BY ALL)
SELECT chunk, round(max(n) / 112.0, 6) AS coverage, round(max(v) - min(v), 6) AS range, round(max(v) FILTER (z = 4), 6) AS at_zero, CAST(arg_max(z, v) - 4 AS DOUBLE) AS peak_offset FROM m GROUP BY chunk HAVING max(n) / 112.0 >= 0.5""")
def layer_profiles(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    v = i.groupBy((F.col("l_partkey") % 12).alias("chunk"), (F.col("l_orderkey") % 9).cast("int").alias("z"), (F.col("l_suppkey") % 16).alias("y"), F.col("l_linenumber").alias("x")).agg(F.max("l_quantity").alias("value"))
    return rounded(zarr.layer_profiles(v, ["chunk"], 9, 112), "coverage", "range", "at_zero")


@query("""WITH a AS (SELECT concat('S', CAST(c_nationkey AS VARCHAR), '__', CAST(c_custkey AS VARCHAR)) AS name, c_acctbal FROM customer), b AS (SELECT concat('S', CAST(s_nationkey AS VARCHAR), '__', CAST(s_suppkey * 2 AS VARCHAR)) AS name, s_acctbal FROM supplier)
SELECT a.name, coalesce(e.s_acctbal, p.s_acctbal) AS matched, e.name IS NOT NULL AS is_exact FROM a LEFT JOIN b e ON a.name = e.name
LEFT JOIN (SELECT split_part(name, '__', 1) AS prefix, arg_min(s_acctbal, name) AS s_acctbal FROM b GROUP BY ALL) p ON split_part(a.name, '__', 1) = p.prefix""")
def exact_or_prefix_join(spark, sf_dir):
    name = lambda n, k: F.concat(F.lit("S"), F.col(n).cast("string"), F.lit("__"), k.cast("string"))
    left = table(spark, sf_dir, "customer").select(name("c_nationkey", F.col("c_custkey")).alias("name"), "c_acctbal")
    right = table(spark, sf_dir, "supplier").select(name("s_nationkey", F.col("s_suppkey") * 2).alias("name"), "s_acctbal")
    return corpus.joined_by_name_or_prefix(left, right).select("name", F.col("match.s_acctbal").alias("matched"), "is_exact")


@query("""WITH t AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, arg_min(c_custkey, (c_acctbal, c_custkey)) = max(c_custkey) AS worst FROM customer GROUP BY ALL HAVING count(*) >= 4)
SELECT count(*) AS n_series, count(*) FILTER (worst) AS n_worst, CASE WHEN count(*) FILTER (NOT worst) = 0 THEN round(exp(sum(ln(1.0 / n))), 9) END AS combined_p FROM t""")
def combined_terminal_chance(spark, sf_dir):
    return rounded(ranks.combined_chance(ranks.terminal_rank(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", "c_acctbal")), "combined_p", digits=9)


@query("""SELECT l_shipdate, l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 40""")
def flagged_top(spark, sf_dir):
    """A top-k report: the forty highest scores."""
    return table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(40)


@query("""SELECT n_name AS "nation.name", r_name AS "nation.region", to_json([n_nationkey, n_regionkey]) AS keys FROM nation JOIN region ON n_regionkey = r_regionkey""")
def flattened_records(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return reports.flattened(rows.select(F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("region")).alias("nation"), F.array("n_nationkey", "n_regionkey").alias("keys")))


@query("""SELECT p_partkey AS name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A' AND l_quantity >= 40)""")
def unmeasured_work(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name"), F.when(~((F.col("l_returnflag") == "A") & (F.col("l_quantity") >= 40)), "failed").alias("error"))
    return resume.unmeasured(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name")), done)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def event_rates(spark, sf_dir):
    return rounded(resume.event_rates(table(spark, sf_dir, "events")), "mean")


def _blur_sql(sigma: float) -> str:
    """``soft``: the voxels' values after a blur along each axis, with weights renormalised where there is no voxel."""
    reach, steps, source = int(4 * sigma + 0.5), [], "voxels"
    for k, axis in enumerate("zyx"):
        meets = " AND ".join(f"b.{o} = a.{o}" + (" + k" if o == axis else "") for o in "zyx")
        steps.append(f"blur{k} AS (SELECT a.volume, a.z, a.y, a.x, sum(b.value * w) / sum(w) AS value FROM voxels a, kernel, {source} b WHERE b.volume = a.volume AND {meets} GROUP BY ALL)")
        source = f"blur{k}"
    return f"kernel AS (SELECT k, exp(-0.5 * (k / {sigma}) ** 2) AS w FROM range({-reach}, {reach + 1}) t(k)), {', '.join(steps)}, soft AS (SELECT volume, z, y, x, v.value, b.value AS soft FROM voxels v JOIN {source} b USING (volume, z, y, x))"


@query(f"""WITH {VOXELS_SQL}, {_blur_sql(1.0)}, m AS (SELECT volume, median(value - soft) AS m FROM soft GROUP BY volume)
SELECT volume, round(greatest(1.4826 * median(abs(value - soft - m)), 1e-6), 6) AS noise_sigma FROM soft JOIN m USING (volume) GROUP BY volume""")
def voxel_noise(spark, sf_dir):
    """Noise of each volume after a Gaussian blur; the voxels have no zeros."""
    return rounded(voxels.noise_sigma(line_voxels(spark, sf_dir), "volume"), "noise_sigma")


@query(f"""WITH RECURSIVE {components_sql(45)}, c AS (SELECT volume, root, count(*) AS n, covar_pop(z, z) AS zz, covar_pop(z, y) AS zy, covar_pop(z, x) AS zx, covar_pop(y, y) AS yy, covar_pop(y, x) AS yx, covar_pop(x, x) AS xx FROM sets GROUP BY ALL HAVING count(*) >= 8), m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY volume ORDER BY n DESC, root) <= 16),
q AS (SELECT *, (zz + yy + xx) / 3 AS q, sqrt(((zz - (zz + yy + xx) / 3) ** 2 + (yy - (zz + yy + xx) / 3) ** 2 + (xx - (zz + yy + xx) / 3) ** 2 + 2 * (zy * zy + zx * zx + yx * yx)) / 6) AS p FROM m),
d AS (SELECT *, ((zz - q) * ((yy - q) * (xx - q) - yx * yx) - zy * (zy * (xx - q) - yx * zx) + zx * (zy * yx - (yy - q) * zx)) / (2 * p ** 3) AS r FROM q),
e AS (SELECT volume, greatest(q + 2 * p * cos(acos(greatest(-1, least(1, r))) / 3 + 2.0943951023931953), 0) / (3 * q) AS planarity FROM d)
SELECT volume, count(planarity) AS n_measured, round(median(planarity), 6) AS median_planarity, round(max(planarity), 6) AS worst_planarity FROM e GROUP BY volume""")
def voxel_planarity(spark, sf_dir):
    """Flatness of the sixteen largest connected sets of eight voxels or more in each volume (a top-k report): median and worst."""
    flat = voxels.planarity(voxels.components(line_voxels(spark, sf_dir).where("value >= 45"), "volume"), "volume", least=8)
    return rounded(voxels.planarity_summary(flat, "volume"), "median_planarity", "worst_planarity")


@query("""WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT vec_id, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(avg((v < -0.1)::INT), 6) AS flat_share FROM e GROUP BY vec_id""")
def block_stats(spark, sf_dir):
    return rounded(corpus.block_stats(profiles(spark, sf_dir), ["vec_id"], "profile", -0.1), "mean", "median", "flat_share")


@query("""SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, round(avg(c_nationkey), 6) AS flat_share FROM customer GROUP BY ALL""")
def verdict_groups(spark, sf_dir):
    return rounded(rounded(corpus.verdict_groups(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "c_nationkey"), "mean", "median", digits=4), "flat_share")


@query("""WITH a AS (SELECT c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'unsure' WHEN c_acctbal > 7000 THEN 'text' ELSE 'no-text' END AS answer FROM customer)
SELECT c_nationkey, count(*) FILTER (answer = 'text') AS n_text, count(*) FILTER (answer = 'no-text') AS n_no_text, count(*) FILTER (answer = 'unsure') AS n_unsure,
  round(count(*) FILTER (answer = 'text') / nullif(count(*) FILTER (answer <> 'unsure'), 0)::DOUBLE, 6) AS text_share, coalesce(count(*) FILTER (answer = 'text') / nullif(count(*) FILTER (answer <> 'unsure'), 0)::DOUBLE >= 0.2, false) AS qualifies FROM a GROUP BY ALL""")
def label_shares(spark, sf_dir):
    answer = F.when(F.col("c_custkey") % 5 == 0, "unsure").when(F.col("c_acctbal") > 7000, "text").otherwise("no-text")
    return rounded(corpus.label_shares(table(spark, sf_dir, "customer").withColumn("answer", answer), ["c_nationkey"], "answer"), "text_share")


@query("""SELECT o_orderkey, l_linenumber, concat_ws('__z', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR)) AS key, l_extendedprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""")
def composed_key_join(spark, sf_dir):
    """Scores joined to their index on a key made of two columns."""
    index = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("__z", "o_custkey", "o_orderkey").alias("key"))
    owner = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    scores = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("__z", "o_custkey", "l_orderkey").alias("key"), "l_linenumber", "l_extendedprice")
    return index.join(scores, "key").select("o_orderkey", "l_linenumber", "key", "l_extendedprice")


def _mann_whitney_sql(rows: str, key: str) -> str:
    """The rank-sum test in SQL over ``rows`` (key, g, v)."""
    return f"""{rows}, r AS (SELECT {key}, g, rank() OVER (PARTITION BY {key} ORDER BY v) + (count(*) OVER (PARTITION BY {key}, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {key}, v) AS t FROM b),
s AS (SELECT {key}, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, sum(rk) FILTER (g) AS r1, sum(CAST(t * t - 1 AS DOUBLE)) AS ties FROM r GROUP BY ALL)
SELECT {key}, n1, n2, round(r1 - n1 * (n1 + 1) / 2.0, 3) AS u, round(z, 5) AS zscore, CASE WHEN ties > 0 OR least(n1, n2) > 8 THEN round({normal_p_sql("z")}, 5) END AS p_normal
FROM (SELECT *, (r1 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0 + 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z FROM s)"""


@query(_mann_whitney_sql("""WITH b AS (SELECT setting, c_mktsegment = 'BUILDING' AS g, c_custkey // setting AS block, avg(c_acctbal) AS v FROM customer, (SELECT CAST(unnest([8, 12, 16]) AS INTEGER) AS setting) GROUP BY ALL)""", "setting"))
def robustness_grid(spark, sf_dir):
    found = ranks.robustness_grid(table(spark, sf_dir, "customer"), [8, 12, 16], "c_custkey", F.col("c_mktsegment") == "BUILDING", "c_acctbal")
    return found.select("setting", "n1", "n2", F.round("u", 3).alias("u"), F.round("zscore", 5).alias("zscore"), F.when(~F.col("exact"), F.round("p", 5)).alias("p_normal"))


@query(_mann_whitney_sql("WITH b AS (SELECT 'pooled' AS series, c_nationkey < 10 AS g, c_acctbal AS v FROM customer)", "series"))
def pooled_mann_whitney(spark, sf_dir):
    """Both series' blocks as one sample each: no key but a constant."""
    found = ranks.mann_whitney_less(table(spark, sf_dir, "customer").withColumn("series", F.lit("pooled")), ["series"], F.col("c_nationkey") < 10, "c_acctbal")
    return found.select("series", "n1", "n2", F.round("u", 3).alias("u"), F.round("zscore", 5).alias("zscore"), F.when(~F.col("exact"), F.round("p", 5)).alias("p_normal"))


@query(f"""WITH {VOXELS_SQL}, {_blur_sql(2.0)}
SELECT volume, round(avg(abs(value - soft)) / nullif(quantile_cont(value, 0.99) - quantile_cont(value, 0.01), 0), 6) AS contrast, round(median(value), 6) AS median FROM soft GROUP BY volume""")
def voxel_contrast(spark, sf_dir):
    """Local contrast of each volume against a blur of two voxels."""
    return rounded(voxels.local_contrast(line_voxels(spark, sf_dir), "volume"), "contrast", "median")


@query("""WITH p AS (SELECT vec_id, vec_id % 2 AS mesh, CAST(vec_id // 32 // 8 AS INTEGER) AS tr, CAST(vec_id % 32 // 8 AS INTEGER) AS tc, embedding FROM embeddings), x AS (SELECT mesh, tr, tc, i - 1 AS i, avg(CAST(embedding[i] AS DOUBLE)) AS v, count(*) AS n FROM p, range(1, 65) t(i) GROUP BY ALL)
SELECT mesh, tr, tc, max(n) AS n, round(max(v) - min(v), 6) AS range, round(max(v) FILTER (i = 32), 6) AS at_zero, CAST(arg_max(i, v) - 32 AS DOUBLE) AS peak_offset FROM x GROUP BY ALL HAVING max(n) >= 32 AND max(v) > 0""")
def onsheet_blocks(spark, sf_dir):
    """Mean profiles of tiles of 8 x 8 cells, at least half of them filled: the embeddings as the cells of two surfaces."""
    v = F.col("vec_id")
    cells = profiles(spark, sf_dir).select((v % 2).alias("mesh"), F.floor(v / 32).alias("r"), (v % 32).alias("c"), "profile")
    return rounded(surfaces.block_profiles(cells, "mesh", 8, 32.0, 1.0), "range", "at_zero")


@query("""WITH p AS (SELECT c_custkey AS pid, c_nationkey AS s, c_custkey % 97 * 1.0 AS z, c_custkey % 89 * 1.0 AS y, c_acctbal / 100 AS x FROM customer), e AS (SELECT s_suppkey AS sid, s_nationkey AS s, s_suppkey % 97 * 1.0 AS z, s_suppkey % 89 * 1.0 AS y, s_acctbal / 100 AS x FROM supplier)
SELECT pid, arg_min(sid, (sqrt((p.z - e.z) ** 2 + (p.y - e.y) ** 2 + (p.x - e.x) ** 2), sid)) AS sid FROM p JOIN e ON e.s = p.s GROUP BY pid""")
def nearest_seed(spark, sf_dir):
    """Each customer's nearest supplier of its nation."""
    at = lambda k, b: [(F.col(k) % 97).cast("double").alias("z"), (F.col(k) % 89).cast("double").alias("y"), (F.col(b) / 100).alias("x")]
    points = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("s"), F.col("c_custkey").alias("pid"), *at("c_custkey", "c_acctbal"))
    seeds = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("s"), F.col("s_suppkey").alias("sid"), *at("s_suppkey", "s_acctbal"))
    return voxels.nearest_points(points, seeds, "s", "pid", "sid", 1).select("pid", F.col("neighbour").alias("sid"))


@query(f"""WITH {BOXES_SQL} SELECT a.id AS a, b.id AS b, greatest(a.z0 - b.z1, b.z0 - a.z1, a.y0 - b.y1, b.y0 - a.y1, a.x0 - b.x1, b.x0 - a.x1, 0) AS gap FROM boxes a JOIN boxes b ON a.volume = b.volume AND (a.z0 < b.z0 OR (a.z0 = b.z0 AND a.id < b.id))
  AND b.z0 < a.z1 + 30 AND a.y0 <= b.y1 + 30 AND b.y0 <= a.y1 + 30 AND a.x0 <= b.x1 + 30 AND b.x0 <= a.x1 + 30""")
def box_gaps(spark, sf_dir):
    """The gap of every two boxes that lie within 30 of each other."""
    boxes = part_boxes(spark, sf_dir)
    side = lambda p: boxes.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in boxes.columns if c != "id"])
    pairs = bx.overlap_pairs(boxes, 30).select("a", "b")
    return pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", bx.gap("a_", "b_").alias("gap"))


@query("""SELECT metric, count(v) AS n_measurable, count(*) AS n_attempted, round(median(v), 4) AS median, round(avg(v), 4) AS mean, min(v) AS least, max(v) AS most FROM (
  SELECT 'acctbal' AS metric, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer UNION ALL SELECT 'nation', CAST(c_nationkey AS DOUBLE) FROM customer) GROUP BY metric""")
def metric_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("acctbal"), F.col("c_nationkey").alias("nation"))
    return rounded(corpus.metric_summary(rows, ["acctbal", "nation"]), "median", "mean", digits=4)


@query("""SELECT c_custkey, c_acctbal - 4500 AS off FROM customer ORDER BY abs(c_acctbal - 4500) DESC, c_custkey LIMIT 40""")
def worst_by_size(spark, sf_dir):
    """A top-k report: the forty rows farthest from the middle, on either side."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") - 4500).alias("off"))
    return corpus.top(rows, "off", 40, ("c_custkey",), by_size=True)


@query("""SELECT c_nationkey, count(*) AS n, min(c_acctbal) AS least, round(median(c_acctbal), 4) AS median FROM customer WHERE c_custkey % 200 BETWEEN 105 AND 155 GROUP BY ALL""")
def neighbourhood_band(spark, sf_dir):
    """The rows whose winding lies in the band around a suspect one."""
    rows = table(spark, sf_dir, "customer").withColumn("winding", F.col("c_custkey") % 200)
    return rounded(corpus.neighbourhood(rows, ["c_nationkey"], "winding", 105, 155, "c_acctbal"), "median", digits=4)


@query("""SELECT c_custkey, n_name, c_acctbal, round(avg(o_totalprice), 4) AS spend FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def keyed_labels(spark, sf_dir):
    """Labels under a code, the key of codes, and predictors by name."""
    labels = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("code"), F.col("c_custkey").alias("base"), "c_acctbal")
    key = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), "n_name")
    spend = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("base")).agg(F.round(F.avg("o_totalprice"), 4).alias("spend"))
    return corpus.keyed_labels(labels, key, spend).select(F.col("base").alias("c_custkey"), "n_name", "c_acctbal", "spend")


@query(f"""WITH {_PROFILE_SQL}, q AS (SELECT vec_id, 0.37 + (vec_id % 63) AS place FROM embeddings)
SELECT q.vec_id, round(max(v) FILTER (i = floor(place)) + (max(v) FILTER (i = floor(place) + 1) - max(v) FILTER (i = floor(place))) * (max(place) - floor(max(place))), 6) AS v FROM q JOIN x ON x.vec_id = q.vec_id GROUP BY q.vec_id""")
def interpolated_profiles(spark, sf_dir):
    """Profiles read between their samples."""
    rows = profiles(spark, sf_dir).withColumn("along", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("double")))
    return rounded(rows.select("vec_id", pf.interpolated(0.37 + F.col("vec_id") % 63, F.col("along"), F.col("profile")).alias("v")), "v")


@query(f"""WITH {_GRID_SQL}, d AS (SELECT mesh, greatest(max(r) + 1 - 20, 0) AS lr, greatest(max(c) + 1 - 20, 0) AS lc FROM g GROUP BY mesh), t AS (SELECT mesh, lr, lc, CAST(greatest(lr // 6, 1) AS INTEGER) AS sr, CAST(greatest(lc // 6, 1) AS INTEGER) AS sc FROM d),
w AS (SELECT mesh, r0, c0, sr, sc FROM t, LATERAL (SELECT unnest(range(0, lr + 1, sr)) AS r0), LATERAL (SELECT unnest(range(0, lc + 1, sc)) AS c0)),
n AS (SELECT w.mesh, r0, c0, count(*) AS n FROM w JOIN g ON g.mesh = w.mesh AND g.r >= r0 AND g.r < r0 + 20 AND g.c >= c0 AND g.c < c0 + 20 GROUP BY ALL)
SELECT mesh, CAST(r0 AS INTEGER) AS r, CAST(c0 AS INTEGER) AS c, n FROM n QUALIFY row_number() OVER (PARTITION BY mesh ORDER BY n DESC, r0, c0) = 1""")
def strided_window(spark, sf_dir):
    return surfaces.strided_window(_grid(spark, sf_dir), 20).select("mesh", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "n")


@query(f"""WITH {_GRID_SQL}, t AS (SELECT DISTINCT mesh, r // 8 AS tr, c // 8 AS tc FROM g)
SELECT mesh, CAST(tr AS INTEGER) AS tr, CAST(tc AS INTEGER) AS tc FROM t QUALIFY row_number() OVER (PARTITION BY mesh ORDER BY md5(concat_ws('#', '7', mesh, CAST(tr AS VARCHAR), CAST(tc AS VARCHAR))), tr, tc) <= 5""")
def chosen_tiles(spark, sf_dir):
    """A sampling operator: five tiles of each surface."""
    tiles = _grid(spark, sf_dir).select("mesh", F.floor(F.col("r") / 8).cast("int").alias("tr"), F.floor(F.col("c") / 8).cast("int").alias("tc")).distinct()
    return surfaces.chosen_tiles(tiles, "mesh", 5, 7)


@query(f"""WITH {_GRID_SQL}, s AS (SELECT *, coalesce(sqrt((z - lag(z) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (x - lag(x) OVER w) ** 2), 0) AS step FROM g WINDOW w AS (PARTITION BY mesh, r ORDER BY c))
SELECT mesh, r, c, round(sum(step) OVER (PARTITION BY mesh, r ORDER BY c ROWS UNBOUNDED PRECEDING), 4) AS arc FROM s""")
def row_arc_lengths(spark, sf_dir):
    return rounded(surfaces.arc_lengths(_grid(spark, sf_dir), ["mesh", "r"], "c").select("mesh", "r", "c", "arc"), "arc", digits=4)


@query("""SELECT source, list_slice(list_sort(list_distinct(list(n_chars % 7) FILTER (n_chars % 7 <> 0))), 1, 4) AS classes FROM documents GROUP BY source""")
def class_lists(spark, sf_dir):
    """The first four non-zero classes of each source."""
    values = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set(F.col("n_chars") % 7).alias("v"))
    return values.select("source", census.class_list(F.col("v")).alias("classes"))


@query()
def bootstrap_medians(spark, sf_dir):
    """Intervals of medians from hashed Poisson resamples: no SQL twin, as the hash is Spark's."""
    return ranks.bootstrap(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey", "c_acctbal", 200, "median")
