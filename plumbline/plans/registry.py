"""Registered queries and their oracle SQL.

Each query applies operators to the whole of the given tables, through the
shapes in ``proxies``.  Floating results are rounded on both sides, as sums run
in another order in every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import profiles as pf
from plumbline.operators import boxes as bx
from plumbline.operators import census, corpus, graph, leakage, ranks, splits, surfaces, voxels
from plumbline.plans.proxies import BOXES_SQL, FOLDS_SQL, VOXELS_SQL, event_grid, hashed_fold, line_voxels, pairs_sql, part_boxes, profiles, table
from plumbline.storage import written

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle where SQL has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.declared_folds(part_boxes(spark, sf_dir).select("id", hashed_fold("id").alias("fold")), 5)


# Boxes, overlap graph, leakage


@query(f"WITH {BOXES_SQL}, {pairs_sql()} SELECT a, b, round(fraction, 6) AS fraction FROM pairs")
def box_overlap_join(spark, sf_dir):
    return rounded(bx.overlap_pairs(part_boxes(spark, sf_dir)).select("a", "b", "fraction"), "fraction")


@query(f"WITH {BOXES_SQL}, {pairs_sql(30)} SELECT a, b, round(fraction, 6) AS fraction FROM graph")
def box_overlap_graph_buffered(spark, sf_dir):
    return rounded(bx.overlap_graph(part_boxes(spark, sf_dir), 30), "fraction")


@query(f"""WITH {BOXES_SQL}, {pairs_sql()}, deg AS (SELECT a, max(fraction) AS m, count(*) AS d FROM graph GROUP BY a)
SELECT CAST(sum(d) / 2 AS BIGINT) AS n_pairs, count(*) AS n_touched, round(median(m), 6) AS median_max, round(max(m), 6) AS max_max FROM deg""")
def overlap_summary(spark, sf_dir):
    return rounded(bx.overlap_summary(bx.overlap_graph(part_boxes(spark, sf_dir))), "median_max", "max_max")


@query(f"""WITH {BOXES_SQL}, {pairs_sql()}, {FOLDS_SQL}, hit AS (
  SELECT v.fold, v.id, max(g.fraction) AS shared FROM folds v LEFT JOIN (graph g JOIN folds t ON t.id = g.b AND t.role = 'train') ON g.a = v.id AND t.fold = v.fold
  WHERE v.role = 'val' GROUP BY ALL)
SELECT count(*) AS n_val, count(shared) AS n_contaminated, round(100.0 * count(shared) / count(*), 6) AS contaminated_pct,
       round(100.0 * avg(coalesce(shared, 0)), 6) AS mean_shared_pct, round(max(shared), 6) AS worst_shared FROM hit""")
def split_leakage(spark, sf_dir):
    found = leakage.split_leakage(_folds(spark, sf_dir), bx.overlap_graph(part_boxes(spark, sf_dir)))
    return rounded(found, "contaminated_pct", "mean_shared_pct", "worst_shared")


@query(f"""WITH {BOXES_SQL}, {pairs_sql()}, {FOLDS_SQL}
SELECT fold, role, id FROM folds f WHERE role = 'val' OR NOT EXISTS (
  SELECT 1 FROM graph g JOIN folds v ON v.id = g.a AND v.role = 'val' WHERE g.b = f.id AND v.fold = f.fold)""")
def buffer_zone(spark, sf_dir):
    return leakage.with_buffer_zone(_folds(spark, sf_dir), bx.overlap_graph(part_boxes(spark, sf_dir)))


@query(f"""WITH {BOXES_SQL}, {pairs_sql()}, {FOLDS_SQL}, kept AS (
  SELECT fold, role, id FROM folds f WHERE role = 'train' AND NOT EXISTS (
  SELECT 1 FROM graph g JOIN folds v ON v.id = g.a AND v.role = 'val' WHERE g.b = f.id AND v.fold = f.fold))
SELECT f.fold, count(*) FILTER (role = 'val') AS n_val, (SELECT count(*) FROM kept k WHERE k.fold = f.fold) AS n_train,
       count(*) FILTER (role = 'train') - (SELECT count(*) FROM kept k WHERE k.fold = f.fold) AS n_dropped FROM folds f GROUP BY f.fold""")
def fold_stats(spark, sf_dir):
    folds = _folds(spark, sf_dir)
    return leakage.fold_stats(folds, leakage.with_buffer_zone(folds, bx.overlap_graph(part_boxes(spark, sf_dir))))


@query(f"""WITH {BOXES_SQL}, {pairs_sql()}, {FOLDS_SQL}, kept AS (
  SELECT fold, role, id FROM folds f WHERE role = 'val' OR NOT EXISTS (
  SELECT 1 FROM graph g JOIN folds v ON v.id = g.a AND v.role = 'val' WHERE g.b = f.id AND v.fold = f.fold))
SELECT DISTINCT v.fold, v.id FROM kept v JOIN graph g ON g.a = v.id JOIN kept t ON t.id = g.b AND t.fold = v.fold AND t.role = 'train' WHERE v.role = 'val'""")
def residual_leaks(spark, sf_dir):
    g = bx.overlap_graph(part_boxes(spark, sf_dir))
    return leakage.residual_leaks(leakage.with_buffer_zone(_folds(spark, sf_dir), g), g)


@query(f"""WITH RECURSIVE {BOXES_SQL}, {pairs_sql()}, reach AS (SELECT a AS node, a AS root FROM graph UNION SELECT g.b, r.root FROM reach r JOIN graph g ON g.a = r.node)
SELECT node, min(root) AS component FROM reach GROUP BY node""")
def overlap_components(spark, sf_dir):
    return graph.connected_components(bx.overlap_pairs(part_boxes(spark, sf_dir)))


@query(f"""WITH {BOXES_SQL}, e AS (SELECT max(z1 - z0) * 4 AS z, max(y1 - y0) * 4 AS y, max(x1 - x0) * 4 AS x FROM boxes)
SELECT id, volume, (z0 + (z1 - z0) // 2) // e.z AS bz, (y0 + (y1 - y0) // 2) // e.y AS by, (x0 + (x1 - x0) // 2) // e.x AS bx FROM boxes, e""")
def spatial_blocks(spark, sf_dir):
    return splits.blocks(part_boxes(spark, sf_dir))


@query()
def blocked_kfold(spark, sf_dir):
    """Greedy dealing of blocks to folds; no SQL for the greedy step."""
    b = part_boxes(spark, sf_dir)
    return splits.blocked_kfold(b, bx.overlap_graph(b))


@query()
def component_kfold(spark, sf_dir):
    b = part_boxes(spark, sf_dir)
    return splits.blocked_kfold(b, bx.overlap_graph(b), mode="component")


@query()
def seeded_reference_split(spark, sf_dir):
    """The shuffled 5-fold split of seed 12345 over the customers' names (MT19937)."""
    return splits.seeded_split(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")))


@query(f"""WITH {BOXES_SQL}, {pairs_sql()}, d AS (SELECT trial, id, CAST((row_number() OVER (PARTITION BY trial ORDER BY md5('0#' || trial || '#' || id), id) - 1) % 5 AS INTEGER) AS fold, count(*) OVER (PARTITION BY trial) AS n FROM boxes, range(0, 200) t(trial)),
t AS (SELECT v.trial, v.id, v.n, max(g.fraction) AS shared FROM d v JOIN graph g ON g.a = v.id JOIN d o ON o.trial = v.trial AND o.id = g.b AND o.fold <> v.fold GROUP BY ALL),
e AS (SELECT trial, 100.0 * count(*) / max(n) AS c, 100.0 * sum(shared) / max(n) AS s FROM t GROUP BY trial), a AS (SELECT coalesce(c, 0) AS c, coalesce(s, 0) AS s FROM range(0, 200) r(trial) LEFT JOIN e USING (trial))
SELECT 5 AS k, 200 AS trials, round(avg(c), 6) AS contaminated_pct_mean, round(stddev_samp(c), 6) AS contaminated_pct_sd, round(avg(s), 6) AS mean_max_shared_pct FROM a""")
def random_split_baseline(spark, sf_dir):
    """Contamination over 200 random 5-fold splits of the boxes, each dealt in the order of the ids' md5."""
    b = part_boxes(spark, sf_dir)
    return rounded(splits.hashed_trials(b.select("id"), bx.overlap_graph(b)), "contaminated_pct_mean", "contaminated_pct_sd", "mean_max_shared_pct")


@query(f"""WITH {BOXES_SQL}, {FOLDS_SQL}
SELECT fold, to_json({{'train': list(CAST(id AS VARCHAR) ORDER BY CAST(id AS VARCHAR)) FILTER (role = 'train'), 'val': list(CAST(id AS VARCHAR) ORDER BY CAST(id AS VARCHAR)) FILTER (role = 'val')}}) AS split
FROM folds GROUP BY fold""")
def splits_json(spark, sf_dir):
    return splits.splits_json(_folds(spark, sf_dir).select("fold", "role", F.col("id").cast("string").alias("name"))).withColumn("split", F.col("split"))


# Names, pairing, census


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_matches(url, '^https?://') AS remote,
       nullif(regexp_extract(url, '/([a-z]{2})/', 1), '') AS lang, try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS DOUBLE) AS number FROM pages""")
def name_parsing(spark, sf_dir):
    part = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), census.is_remote(F.col("url")).alias("remote"), part("/([a-z]{2})/").alias("lang"), corpus.number(part("/([0-9]+)")).alias("number")
    )


@query("""WITH n AS (SELECT o_orderkey, concat('19980103', CAST(o_orderkey % 100 AS VARCHAR), '-w', lpad(CAST(o_custkey % 90 AS VARCHAR), 3, '0'),
                            CASE WHEN o_orderkey % 2 = 0 THEN concat('-', lpad(CAST(o_custkey % 90 + 4 AS VARCHAR), 3, '0')) ELSE '' END) AS name FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (CAST(regexp_extract(name, 'w([0-9]+)-([0-9]+)', 1) AS DOUBLE) + CAST(regexp_extract(name, 'w([0-9]+)-([0-9]+)', 2) AS DOUBLE)) / 2
       ELSE CAST(regexp_extract(name, 'w([0-9]+)', 1) AS DOUBLE) END AS winding, substr(name, 1, 8) AS day FROM n""")
def winding_names(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey") % 90
    pad = lambda c: F.lpad(c.cast("string"), 3, "0")
    name = F.concat(F.lit("19980103"), (key % 100).cast("string"), F.lit("-w"), pad(cust), F.when(key % 2 == 0, F.concat(F.lit("-"), pad(cust + 4))).otherwise(""))
    named = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))
    return named.select("o_orderkey", corpus.winding(F.col("name")).alias("winding"), corpus.series_day(F.col("name")).alias("day"))


@query("""WITH n AS (SELECT p_partkey, concat(replace(p_brand, '#', ''), CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('_z', CAST(p_partkey % 20 * 50 AS VARCHAR), '_y', CAST(p_size AS VARCHAR), '_x0') END) AS name FROM part)
SELECT name, regexp_extract(name, '^([A-Za-z0-9.]+)_z', 1) AS volume, CAST(regexp_extract(name, '_z([0-9]+)', 1) AS BIGINT) AS z0, CAST(regexp_extract(name, '_y([0-9]+)', 1) AS BIGINT) AS y0, 0::BIGINT AS x0,
       CAST(regexp_extract(name, '_z([0-9]+)', 1) AS BIGINT) + 300 AS z1, CAST(regexp_extract(name, '_y([0-9]+)', 1) AS BIGINT) + 300 AS y1, 300::BIGINT AS x1 FROM n WHERE name LIKE '%\\_z%' ESCAPE '\\'""")
def patch_names(spark, sf_dir):
    key = F.col("p_partkey")
    tail = F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("_z"), (key % 20 * 50).cast("string"), F.lit("_y"), F.col("p_size").cast("string"), F.lit("_x0")))
    return bx.parse_names(table(spark, sf_dir, "part").select(F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), tail).alias("name")))[0]


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS name, d.doc_id AS image, l.doc_id AS label FROM (SELECT doc_id FROM documents WHERE lang <> 'es') d
FULL OUTER JOIN (SELECT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def full_outer_pairing(spark, sf_dir):
    side = lambda df: df.select(F.col("doc_id").alias("name"), F.col("doc_id").alias("path"))
    return census.pair(side(table(spark, sf_dir, "documents").where("lang <> 'es'")), side(table(spark, sf_dir, "labels")))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), m AS (SELECT source, lang FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1)
SELECT d.doc_id, d.source, d.lang, m.lang AS mode FROM documents d JOIN m USING (source) WHERE d.lang <> m.lang""")
def off_scheme_rows(spark, sf_dir):
    return census.off_scheme(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source"], "lang")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def census_counts(spark, sf_dir):
    return census.counted(table(spark, sf_dir, "documents"), "lang", "source")


@query(f"""WITH {VOXELS_SQL} SELECT volume, CAST(value % 3 AS INTEGER) AS value, count(*) AS n, round(count(*) / (24.0 * 24 * 24), 6) AS fraction,
  round(sum((z = 0)::INT + (z = 23)::INT + (y = 0)::INT + (y = 23)::INT + (x = 0)::INT + (x = 23)::INT) / count(*)::DOUBLE, 6) AS border_touch FROM voxels GROUP BY ALL""")
def label_scheme(spark, sf_dir):
    v = line_voxels(spark, sf_dir).withColumn("value", (F.col("value") % 3).cast("int"))
    shape = v.select("volume").distinct().select("volume", *[F.lit(24).alias(f"s{a}") for a in "zyx"])
    return rounded(census.label_scheme(v, shape), "fraction", "border_touch")


@query("SELECT c_name FROM (SELECT c_name FROM customer ORDER BY md5(c_name || '#7'), c_name LIMIT 20) ORDER BY c_name")
def seeded_sample(spark, sf_dir):
    """A sampling operator: twenty names of least md5."""
    return census.seeded_sample(table(spark, sf_dir, "customer").select("c_name"), "c_name", 20, 7)


@query("""WITH f AS (SELECT l_orderkey % 500 AS a, l_partkey % 500 AS b, l_suppkey % 500 AS c FROM lineitem), e AS (
  SELECT least(a, b) AS u, greatest(a, b) AS v FROM f UNION SELECT least(b, c), greatest(b, c) FROM f UNION SELECT least(c, a), greatest(c, a) FROM f)
SELECT u, v FROM e WHERE u <> v""")
def unique_face_edges(spark, sf_dir):
    face = [(F.col(c) % 500).alias(n) for c, n in (("l_orderkey", "a"), ("l_partkey", "b"), ("l_suppkey", "c"))]
    return surfaces.unique_edges(table(spark, sf_dir, "lineitem").select(*face))


# Ranks, scores, tests


@query("""WITH m AS (SELECT event_type AS mesh, user_id AS line, avg(value) AS line_mean FROM events GROUP BY ALL), q AS (SELECT *, count(line_mean) OVER w AS n, median(line_mean) OVER w AS mid FROM m WINDOW w AS (PARTITION BY mesh)),
d AS (SELECT *, median(abs(line_mean - mid)) OVER (PARTITION BY mesh) AS mad FROM q)
SELECT mesh, line, round(line_mean, 6) AS line_mean, round(CASE WHEN n >= 4 AND mad >= 1e-6 THEN (line_mean - mid) / (1.4826 * mad) ELSE 0 END, 5) AS z FROM d""")
def robust_line_scores(spark, sf_dir):
    found = ranks.line_scores(event_grid(spark, sf_dir), ["mesh"], "line", "dip")
    return found.select("mesh", "line", F.round("line_mean", 6).alias("line_mean"), F.round("z", 5).alias("z"))


@query("""SELECT c_custkey, round((count(*) FILTER (TRUE) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  - 0.5 * count(*) OVER (PARTITION BY c_nationkey, c_acctbal)) / count(*) OVER (PARTITION BY c_nationkey), 6) AS midrank FROM customer""")
def midrank(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return ranks.midrank_percentile(rows, ["c_nationkey"], "c_acctbal").select("c_custkey", F.round("midrank", 6).alias("midrank"))


_RANKS_SQL = """r AS (SELECT c_nationkey, c_mktsegment = 'BUILDING' AS g, c_acctbal AS v, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0 AS rk,
  count(*) OVER (PARTITION BY c_nationkey, c_acctbal) AS t FROM customer),
s AS (SELECT c_nationkey, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, coalesce(sum(rk) FILTER (g), 0) AS r1, sum(CAST(t * t - 1 AS DOUBLE)) AS ties FROM r GROUP BY ALL)"""


def normal_p_sql(z: str) -> str:
    """The normal distribution function, to 1e-7, as SQL."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    upper = f"(exp(-{z} * {z} / 2) * 0.3989422804014327 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"CASE WHEN {z} >= 0 THEN 1 - {upper} ELSE {upper} END"


@query(f"""WITH {_RANKS_SQL}, u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS sd FROM s)
SELECT c_nationkey, n1, n2, round(u, 4) AS u, round(z, 5) AS zscore, CASE WHEN NOT exact THEN round(coalesce({normal_p_sql("z")}, 1), 5) END AS p_normal, exact
FROM (SELECT *, CASE WHEN sd > 0 THEN (u - n1 * n2 / 2.0 + 0.5) / sd END AS z, ties = 0 AND least(n1, n2) BETWEEN 1 AND 8 AS exact FROM u)""")
def mann_whitney(spark, sf_dir):
    found = ranks.mann_whitney_less(table(spark, sf_dir, "customer"), ["c_nationkey"], F.col("c_mktsegment") == "BUILDING", "c_acctbal")
    return found.select("c_nationkey", "n1", "n2", F.round("u", 4).alias("u"), F.round("zscore", 5).alias("zscore"), F.when(~F.col("exact"), F.round("p", 5)).alias("p_normal"), "exact")


@query(f"""WITH {_RANKS_SQL} SELECT c_nationkey, n1 AS n_pos, n2 AS n_neg, round(CASE WHEN n1 > 0 AND n2 > 0 THEN 1 - (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) END, 6) AS auc FROM s""")
def auc(spark, sf_dir):
    return rounded(ranks.auc(table(spark, sf_dir, "customer"), ["c_nationkey"], F.col("c_mktsegment") == "BUILDING", "c_acctbal"), "auc")


@query("""WITH b AS (SELECT o_totalprice AS v, least((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // (count(*) OVER () // 4), 3) AS bin FROM orders)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(median(v), 4) AS median FROM b GROUP BY bin""")
def difficulty_bins(spark, sf_dir):
    binned = ranks.even_bins(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [], ["o_totalprice", "o_orderkey"])
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("o_totalprice"), 4).alias("median"))


@query("""SELECT s_nationkey, s_name, s_acctbal, s_acctbal BETWEEN 1000 AND 5000 AS in_band FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey
  ORDER BY (s_acctbal BETWEEN 1000 AND 5000) DESC, CASE WHEN s_acctbal BETWEEN 1000 AND 5000 THEN abs(s_acctbal - 2400) ELSE s_acctbal END, s_name) = 1""")
def choose_in_band(spark, sf_dir):
    return ranks.choose_in_band(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", "s_name", 1000, 5000, 2400)


@query("""WITH r AS (SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey) AS rk,
  row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey DESC) AS t FROM customer WINDOW p AS (PARTITION BY c_nationkey, c_mktsegment))
SELECT c_nationkey, c_mktsegment, n, max(c_custkey) FILTER (t = 1) AS last_place, max(c_acctbal) FILTER (t = 1) AS last_value, CAST(max(rk) FILTER (t = 1) AS INTEGER) AS last_rank,
  round(median(c_acctbal) FILTER (t > 1), 4) AS rest_median, max(rk) FILTER (t = 1) = 1 AS is_worst, round(1.0 / n, 6) AS chance FROM r WHERE n >= 4 GROUP BY c_nationkey, c_mktsegment, n""")
def terminal_ranks(spark, sf_dir):
    found = ranks.terminal_rank(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", "c_acctbal")
    return found.withColumn("rest_median", F.round("rest_median", 4)).withColumn("chance", F.round("chance", 6))


@query("""SELECT c_mktsegment, count(c_acctbal) AS n, round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(quantile_cont(c_acctbal, 0.1), 4) AS p10, round(quantile_cont(c_acctbal, 0.9), 4) AS p90,
  round((quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)) / greatest(quantile_cont(c_acctbal, 0.5), 1e-9), 6) AS iqr_share, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer GROUP BY ALL""")
def spread_summary(spark, sf_dir):
    return rounded(rounded(ranks.spread_summary(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal"), "median", "p10", "p90", digits=4), "iqr_share")


@query()
def bootstrap_means(spark, sf_dir):
    """Intervals from hashed Poisson resamples: no SQL twin, as the hash is Spark's."""
    return ranks.bootstrap(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey", "c_acctbal", 200)


# Corpus reports

_PAIR_SQL = """u AS (SELECT user_id AS name, event_type, max(value) AS max_z, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT a.name, a.max_z AS real_value, b.max_z AS plant_value, CASE WHEN a.max_z > 0 THEN b.max_z / a.max_z END AS ratio FROM u a JOIN u b ON a.name = b.name
  WHERE a.event_type = 'click' AND b.event_type = 'view' AND a.n >= 2 AND a.max_z >= 1 AND b.max_z >= 1)"""


def _event_results(spark, sf_dir, kind):
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("name")).agg(F.max("value").alias("max_z"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("adequate", F.col("n") >= 2).withColumn("degenerate", F.col("max_z") < 1)


@query(f"WITH {_PAIR_SQL} SELECT name, real_value, plant_value, round(ratio, 6) AS ratio FROM p")
def paired_control(spark, sf_dir):
    return rounded(corpus.paired(_event_results(spark, sf_dir, "click"), _event_results(spark, sf_dir, "view")), "ratio")


@query(f"""WITH {_PAIR_SQL} SELECT count(*) AS n, count(*) FILTER (plant_value > real_value) AS n_plant_higher, round(median(ratio), 6) AS ratio_median, round(min(ratio), 6) AS ratio_min, round(max(ratio), 6) AS ratio_max,
  round(median(real_value), 6) AS real_median, max(real_value) AS real_max, round(median(plant_value), 6) AS plant_median, min(plant_value) AS plant_min, min(plant_value) > max(real_value) AS separable FROM p""")
def paired_summary(spark, sf_dir):
    pairs = corpus.paired(_event_results(spark, sf_dir, "click"), _event_results(spark, sf_dir, "view"))
    return rounded(corpus.paired_summary(pairs), "ratio_median", "ratio_min", "ratio_max", "real_median", "plant_median")


@query("""WITH r AS (SELECT c_nationkey, CASE WHEN c_custkey % 17 = 0 THEN 'failed' END AS error, c_acctbal >= 2000 AS adequate, c_acctbal < 0 AS degenerate, CAST(floor(c_acctbal / 4000) AS BIGINT) AS n_seams, c_acctbal AS max_z FROM customer)
SELECT c_nationkey, count(*) AS n, count(error) AS n_errors, count(*) FILTER (adequate) AS n_adequate, count(*) FILTER (degenerate) AS n_degenerate, count(*) FILTER (adequate AND NOT degenerate) AS n_usable,
  count(*) FILTER (adequate AND NOT degenerate AND n_seams > 0) AS n_flagged, round(median(max_z) FILTER (adequate AND NOT degenerate), 4) AS median_max_z FROM r GROUP BY ALL""")
def scroll_table(spark, sf_dir):
    b = F.col("c_acctbal")
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 17 == 0, "failed").alias("error"), (b >= 2000).alias("adequate"), (b < 0).alias("degenerate"), F.floor(b / 4000).alias("n_seams"), b.alias("max_z"))
    return rounded(corpus.scroll_table(rows, ["c_nationkey"]), "median_max_z", digits=4)


@query("""WITH h AS (SELECT CAST(p_size AS BIGINT) AS size_key, p_retailprice AS low, p_retailprice + 200 AS high, p_partkey FROM part),
i AS (SELECT o_orderkey, CAST(o_orderkey % 50 + 1 AS BIGINT) AS size_key, o_totalprice / 200 AS extent FROM orders),
j AS (SELECT i.o_orderkey, h.low, h.p_partkey, row_number() OVER (PARTITION BY i.o_orderkey ORDER BY h.low, h.p_partkey) AS t FROM i LEFT JOIN h ON i.size_key = h.size_key AND i.extent >= h.low AND i.extent <= h.high)
SELECT o_orderkey, low, p_partkey FROM j WHERE t = 1""")
def containment_choice(spark, sf_dir):
    holders = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("size_key"), F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + 200).alias("high"), "p_partkey")
    items = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 50 + 1).alias("size_key"), (F.col("o_totalprice") / 200).alias("extent"))
    return corpus.choose_containing(items, holders, ["size_key"], "extent", ("low", "high"), ["low", "p_partkey"]).select("o_orderkey", "holder.low", "holder.p_partkey")


@query("""SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal < 1000) AS n_chosen, round(count(*) FILTER (c_acctbal < 1000 AND c_nationkey % 5 < 3) / nullif(count(*) FILTER (c_acctbal < 1000), 0)::DOUBLE, 6) AS precision,
  round(count(*) FILTER (c_nationkey % 5 < 3) / count(*)::DOUBLE, 6) AS base_rate, CASE WHEN count(*) FILTER (c_acctbal < 1000) >= 10 AND count(*) FILTER (c_acctbal < 1000 AND c_nationkey % 5 < 3) / count(*) FILTER (c_acctbal < 1000)::DOUBLE >= 0.8
  AND count(*) FILTER (c_acctbal < 1000 AND c_nationkey % 5 < 3) / count(*) FILTER (c_acctbal < 1000)::DOUBLE >= 2 * count(*) FILTER (c_nationkey % 5 < 3) / count(*)::DOUBLE THEN 'PASS' ELSE 'FAIL' END AS verdict FROM customer GROUP BY ALL""")
def decision_rule(spark, sf_dir):
    return rounded(corpus.decision(table(spark, sf_dir, "customer"), ["c_mktsegment"], F.col("c_nationkey") % 5 < 3, F.col("c_acctbal") < 1000), "precision", "base_rate")


@query("""SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY ALL HAVING count(*) >= 5""")
def eligible_series(spark, sf_dir):
    return corpus.eligible_series(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_extendedprice DESC) = 1""")
def last_result_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", F.struct("l_shipdate", "l_linenumber", "l_extendedprice").alias("path"))
    return corpus.last_per_name(rows, "l_orderkey").drop("path")


@query("""SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def json_metadata(spark, sf_dir):
    found = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    return found.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


# Profiles

_PROFILE_SQL = """x AS (SELECT vec_id, label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)), c AS (SELECT label, i, avg(v) AS v FROM x GROUP BY ALL)"""


@query(f"WITH {_PROFILE_SQL} SELECT label, CAST(i AS INTEGER) AS i, round(v, 6) AS v FROM c")
def mean_profiles(spark, sf_dir):
    found = surfaces.mean_profiles(profiles(spark, sf_dir), ["label"], "profile")
    return found.select("label", F.posexplode("profile").alias("i", "v")).withColumn("v", F.round("v", 6))


@query(f"""WITH {_PROFILE_SQL} SELECT vec_id, round(max(v) - min(v), 6) AS range, round(max(v) FILTER (i = 32), 6) AS at_zero, CAST(arg_max(i, v) AS DOUBLE) - 32 AS peak_offset FROM x GROUP BY vec_id""")
def profile_summary(spark, sf_dir):
    p = F.col("profile")
    return profiles(spark, sf_dir).select("vec_id", F.round(pf.value_range(p), 6).alias("range"), F.round(pf.at_middle(p), 6).alias("at_zero"), (pf.argmax(p) - 32.0).alias("peak_offset"))


@query(f"""WITH {_PROFILE_SQL}, k AS (SELECT k, exp(-0.5 * (k / 2.0) ** 2) AS w FROM range(-8, 9) t(k)),
s AS (SELECT x.vec_id, x.i, sum(y.v * k.w) / (SELECT sum(w) FROM k) AS v FROM x, k JOIN x y ON y.vec_id = x.vec_id AND y.i = CASE WHEN x.i + k < 0 THEN -1 - (x.i + k) WHEN x.i + k > 63 THEN 127 - (x.i + k) ELSE x.i + k END GROUP BY ALL)
SELECT vec_id, CAST(i AS INTEGER) AS i, round(v, 6) AS v FROM s""")
def smoothed_profiles(spark, sf_dir):
    found = profiles(spark, sf_dir).select("vec_id", F.posexplode(pf.smoothed(F.col("profile"), 2.0)).alias("i", "v"))
    return found.withColumn("v", F.round("v", 6))


_PEAKS_SQL = f"""{_PROFILE_SQL}, k AS (SELECT k, exp(-0.5 * (k / 1.5) ** 2) AS w FROM range(-6, 7) t(k)),
s AS (SELECT x.vec_id, x.i, sum(y.v * k.w) / (SELECT sum(w) FROM k) AS v FROM x, k JOIN x y ON y.vec_id = x.vec_id AND y.i = CASE WHEN x.i + k < 0 THEN -1 - (x.i + k) WHEN x.i + k > 63 THEN 127 - (x.i + k) ELSE x.i + k END GROUP BY ALL),
n AS (SELECT vec_id, i, v, CAST(i - 31.5 AS DOUBLE) AS o, lag(v) OVER w AS b, lead(v) OVER w AS f, min(v) OVER e AS lo, max(v) OVER e AS hi FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY i), e AS (PARTITION BY vec_id)),
t AS (SELECT *, CASE WHEN i = 0 OR i = 63 THEN 0 WHEN abs(b - 2 * v + f) > 1e-9 THEN greatest(-1, least(1, 0.5 * (b - f) / (b - 2 * v + f))) ELSE 0 END AS shift FROM n),
ridge AS (SELECT vec_id, coalesce(arg_min(i, (abs(o), i)) FILTER (i BETWEEN 1 AND 62 AND v >= b AND v >= f AND v >= lo + 0.6 * (hi - lo)), arg_max(i, (v, -i))) AS i, greatest(1, least(arg_max(i, (v, -i)), 62)) AS top FROM n GROUP BY vec_id),
sharp AS (SELECT *, max(v) OVER (PARTITION BY vec_id) AS strongest FROM n WHERE i BETWEEN 2 AND 61 AND v > b AND v > f),
centre AS (SELECT vec_id, arg_min(o, (abs(o), i)) FILTER (v >= lo + 0.75 * (strongest - lo)) AS centre, arg_min(o, (abs(o), i)) AS near FROM sharp GROUP BY vec_id),
sides AS (SELECT vec_id, max(centre) AS centre, min(o - centre) FILTER (o - centre > 2) AS positive, max(o - centre) FILTER (o - centre < -2) AS negative, min(abs(o - near)) FILTER (abs(o - near) > 2) AS winding FROM sharp JOIN centre USING (vec_id) GROUP BY vec_id),
halves AS (SELECT vec_id, avg(v - lo) FILTER (o > 0) AS p, avg(v - lo) FILTER (o < 0) AS m FROM n GROUP BY vec_id)"""


@query(f"""WITH {_PEAKS_SQL} SELECT r.vec_id, round(-31.5 + r.i + a.shift, 5) AS peak, centre, positive, negative, least(abs(positive), abs(negative)) AS spacing,
  round(coalesce(greatest(3, least(16, abs(centre) + 0.45 * least(abs(positive), abs(negative)))), 6), 6) AS radius, winding, round(r.top + c.shift, 5) AS top, round(coalesce(abs(p - m) / nullif(abs(p) + abs(m), 0), 0), 6) AS quality
FROM ridge r JOIN t a ON a.vec_id = r.vec_id AND a.i = r.i JOIN t c ON c.vec_id = r.vec_id AND c.i = r.top LEFT JOIN sides d ON d.vec_id = r.vec_id JOIN halves h ON h.vec_id = r.vec_id""")
def profile_peaks(spark, sf_dir):
    """Nearest ridge, neighbours and spacing of smoothed profiles."""
    smooth = profiles(spark, sf_dir).select("vec_id", pf.smoothed(F.col("profile"), 1.5).alias("curve"))
    rows = written(smooth, "curves").withColumn("along", pf.offsets(31.5, 1.0))
    curve, along = F.col("curve"), F.col("along")
    out = rows.select("vec_id", pf.peak_offset(curve, along).alias("peak"), pf.neighbour_ridges(curve, along).alias("n"), ranks.nan_to_null(pf.winding_spacing(curve, along)).alias("winding"), pf.subvoxel_peak(curve).alias("top"), pf.orientation_quality(curve, along).alias("quality"))
    return rounded(rounded(out.select("vec_id", "peak", "n.*", "winding", "top", "quality"), "radius", "quality"), "peak", "top", digits=5)


@query(f"""WITH {_PROFILE_SQL}, r AS (SELECT label, vec_id, max(v) - min(v) AS range FROM x GROUP BY ALL), m AS (SELECT label, median(range) AS m, count(*) AS n FROM r GROUP BY ALL), b AS (SELECT m FROM m WHERE label = (SELECT min(label) FROM m))
SELECT m.label, n, round(m.m, 6) AS median_range, CASE WHEN m.m / greatest(b.m, 1e-6) >= 0.5 THEN 'ON SHEET' WHEN m.m / greatest(b.m, 1e-6) >= 0.3 THEN 'marginal' ELSE 'OFF SHEET' END AS verdict FROM m, b""")
def sheet_verdict(spark, sf_dir):
    each = profiles(spark, sf_dir).select("label", pf.value_range(F.col("profile")).alias("range"))
    rows = each.groupBy("label").agg(F.median("range").alias("m"), F.count(F.lit(1)).alias("n"))
    base = rows.agg(F.min_by("m", "label").alias("base")).first()[0]
    return rows.select("label", "n", F.round("m", 6).alias("median_range"), corpus.verdict(F.col("m"), F.lit(base)).alias("verdict"))


# Voxels and surfaces


@query(f"""WITH {VOXELS_SQL}, p AS (SELECT l_orderkey * 10 + l_linenumber AS pid, concat(l_returnflag, CAST(l_suppkey // 500 AS VARCHAR)) AS volume, l_orderkey % 24 + l_discount AS z, l_partkey % 24 + l_tax AS y, l_suppkey % 24 + 0.25 AS x FROM lineitem),
d AS (SELECT DISTINCT ON (pid) * FROM p ORDER BY pid, volume, z, y, x),
c AS (SELECT pid, volume, floor(z) + dz AS z, floor(y) + dy AS y, floor(x) + dx AS x, (CASE dz WHEN 1 THEN z - floor(z) ELSE 1 - z + floor(z) END) * (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) AS w
  FROM d, range(0, 2) a(dz), range(0, 2) b(dy), range(0, 2) e(dx))
SELECT c.pid, round(sum(w * coalesce(v.value, 0)), 7) AS sample FROM c LEFT JOIN voxels v ON v.volume = c.volume AND v.z = c.z AND v.y = c.y AND v.x = c.x GROUP BY c.pid""")
def trilinear_gather(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    points = i.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pid"), F.concat("l_returnflag", F.floor(F.col("l_suppkey") / 500).cast("string")).alias("volume"), (F.col("l_orderkey") % 24 + F.col("l_discount")).alias("z"), (F.col("l_partkey") % 24 + F.col("l_tax")).alias("y"), (F.col("l_suppkey") % 24 + 0.25).alias("x"))
    points = points.groupBy("pid").agg(F.min(F.struct("volume", "z", "y", "x")).alias("p")).select("pid", "p.*")
    return rounded(voxels.trilinear(points, line_voxels(spark, sf_dir), "volume", "pid").select("pid", "sample"), "sample", digits=7)


@query(f"""WITH {VOXELS_SQL}, s AS (SELECT volume, z, y, x FROM voxels)
SELECT volume, z, y, x FROM s WHERE 6 = (SELECT count(*) FROM s n WHERE n.volume = s.volume AND abs(n.z - s.z) + abs(n.y - s.y) + abs(n.x - s.x) = 1)
  + (z = 0)::INT + (z = 23)::INT + (y = 0)::INT + (y = 23)::INT + (x = 0)::INT + (x = 23)::INT""")
def voxel_erosion(spark, sf_dir):
    return voxels.eroded(line_voxels(spark, sf_dir), "volume", dict.fromkeys("zyx", 24))


@query(f"""WITH {VOXELS_SQL}, g AS (SELECT volume, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM (SELECT DISTINCT volume FROM voxels), range(0, 24) a(z), range(0, 24) b(y), range(0, 24) c(x)),
o AS (SELECT * FROM g ANTI JOIN voxels USING (volume, z, y, x)),
d AS (SELECT v.volume, v.z, v.y, v.x, CAST(2 * min(abs(v.z - o.z) + abs(v.y - o.y) + abs(v.x - o.x)) AS DOUBLE) AS t FROM voxels v LEFT JOIN o ON v.volume = o.volume GROUP BY ALL)
SELECT volume, count(*) AS n, round(median(t), 6) AS median, round(quantile_cont(t, 0.95), 6) AS p95, max(t) AS max, round(avg(t), 6) AS mean, round(avg((t IS NULL)::INT), 6) AS saturated FROM d GROUP BY volume""")
def voxel_thickness(spark, sf_dir):
    """Erosion depths of every volume, each to its end; a depth is the city-block distance to the nearest background."""
    return rounded(voxels.thickness_stats(line_voxels(spark, sf_dir), "volume", dict.fromkeys("zyx", 24)), "median", "p95", "mean", "saturated")


def components_sql(least: int) -> str:
    """26-connected sets of the voxels of at least that value, named by their least voxel, as SQL."""
    return f"""{VOXELS_SQL}, s AS MATERIALIZED (SELECT volume, z, y, x, row_number() OVER (ORDER BY volume, z, y, x) AS id FROM voxels WHERE value >= {least}),
edges AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM s a, range(-1, 2) i(dz), range(-1, 2) j(dy), range(-1, 2) k(dx), s b WHERE b.volume = a.volume AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx),
reach AS (SELECT id AS node, id AS root FROM s UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
sets AS (SELECT s.*, r.root FROM s JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = s.id)"""


@query(f"""WITH RECURSIVE {components_sql(48)}, c AS (SELECT volume, root, count(*) AS n FROM sets GROUP BY ALL)
SELECT volume, count(*) AS n_components, count(*) FILTER (n >= 8) AS n_large, round(max(n) / sum(n), 6) AS largest_share, round(coalesce(sum(n) FILTER (n < 8), 0) / sum(n), 6) AS fragment_share FROM c GROUP BY volume""")
def voxel_components(spark, sf_dir):
    """26-connected sets of voxels of high quantity, with their shares."""
    labelled = voxels.components(line_voxels(spark, sf_dir).where("value >= 48"), "volume")
    return rounded(voxels.component_stats(labelled, "volume", 8), "largest_share", "fragment_share")


@query("""WITH p AS (SELECT o_orderkey AS pid, o_orderstatus AS s, o_custkey % 100 * 1.0 AS z, o_orderkey % 100 * 1.0 AS y, o_totalprice / 5000 AS x FROM orders),
j AS (SELECT a.s, a.pid, sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d FROM p a JOIN p b ON a.s = b.s)
SELECT s, pid, len(near) AS n, round(near[len(near)], 6) AS farthest FROM (SELECT s, pid, min(d, 5) AS near FROM j GROUP BY ALL)""")
def nearest_neighbours(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"), F.col("o_orderstatus").alias("s"), (F.col("o_custkey") % 100).cast("double").alias("z"), (F.col("o_orderkey") % 100).cast("double").alias("y"), (F.col("o_totalprice") / 5000).alias("x"))
    return voxels.nearest_neighbours(o, "s", "pid", 5).groupBy("s", "pid").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("distance"), 6).alias("farthest"))


@query(f"""WITH {VOXELS_SQL} SELECT volume, z, y, x, round(CASE WHEN b IS NOT NULL AND f IS NOT NULL THEN (f - b) / 2 WHEN f IS NOT NULL THEN f - value WHEN b IS NOT NULL THEN value - b ELSE 0 END, 6) AS gz
FROM (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS f FROM voxels WINDOW w AS (PARTITION BY volume, y, x ORDER BY z))""")
def voxel_gradient(spark, sf_dir):
    return rounded(voxels.gradient(line_voxels(spark, sf_dir), "volume").select("volume", "z", "y", "x", "gz"), "gz")


@query(f"""WITH {VOXELS_SQL}, b AS (SELECT volume, z // 8 AS bz, y // 8 AS by, x // 8 AS bx FROM voxels UNION SELECT volume, (z + 1) // 8, (y + 1) // 8, (x + 1) // 8 FROM voxels) SELECT * FROM b""")
def touched_blocks(spark, sf_dir):
    return voxels.touched_blocks(line_voxels(spark, sf_dir), 8, "volume")


_GRID_SQL = """g AS (SELECT o_orderstatus AS mesh, CAST(o_orderkey // 60 AS INTEGER) AS r, CAST(o_orderkey % 60 AS INTEGER) AS c, o_totalprice / 1000 AS z, o_orderkey // 60 * 3.0 AS y, o_orderkey % 60 * 3.0 AS x FROM orders)"""


def _grid(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("mesh"), F.floor(k / 60).cast("int").alias("r"), (k % 60).cast("int").alias("c"), (F.col("o_totalprice") / 1000).alias("z"), (F.floor(k / 60) * 3.0).alias("y"), (k % 60 * 3.0).alias("x"), F.lit(True).alias("valid"))


@query(f"""WITH {_GRID_SQL}, e AS (SELECT a.mesh, sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d FROM g a JOIN g b ON a.mesh = b.mesh AND ((a.r + 1 = b.r AND a.c = b.c) OR (a.r = b.r AND a.c + 1 = b.c)))
SELECT mesh, count(*) AS n_edges, round(median(d), 6) AS grid_step FROM e GROUP BY mesh""")
def grid_step(spark, sf_dir):
    return rounded(surfaces.grid_step(_grid(spark, sf_dir)), "grid_step")


@query(f"""WITH {_GRID_SQL}, w AS (SELECT mesh, r // 8 AS hr, c // 8 AS hc, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT a.mesh, a.hr * 8 AS r, a.hc * 8 AS c, sum(b.n) AS n FROM (SELECT DISTINCT mesh, hr - dr AS hr, hc - dc AS hc FROM w, range(0, 2) p(dr), range(0, 2) q(dc)) a JOIN w b ON a.mesh = b.mesh AND b.hr BETWEEN a.hr AND a.hr + 1 AND b.hc BETWEEN a.hc AND a.hc + 1 WHERE a.hr >= 0 AND a.hc >= 0 GROUP BY ALL)
SELECT mesh, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(n AS BIGINT) AS n FROM s QUALIFY row_number() OVER (PARTITION BY mesh ORDER BY n DESC, r, c) = 1""")
def best_window(spark, sf_dir):
    return surfaces.best_window(_grid(spark, sf_dir), 16)


@query(f"""WITH {_GRID_SQL} SELECT count(*) AS n_quads FROM g a JOIN g b ON a.mesh = b.mesh AND a.r = b.r AND a.c + 1 = b.c JOIN g d ON a.mesh = d.mesh AND a.r + 1 = d.r AND a.c = d.c JOIN g e ON a.mesh = e.mesh AND a.r + 1 = e.r AND a.c + 1 = e.c""")
def quad_triangles(spark, sf_dir):
    return surfaces.triangles(_grid(spark, sf_dir)).agg((F.count(F.lit(1)) / 2).cast("long").alias("n_quads"))


@query()
def sheet_switches(spark, sf_dir):
    """The seam detector on surfaces made of the orders in a volume made of the line items."""
    grid = _grid(spark, sf_dir).withColumn("z", F.col("z") % 24).withColumn("y", F.col("y") % 24).withColumn("x", F.col("x") % 24)
    volume = line_voxels(spark, sf_dir).groupBy("z", "y", "x").agg(F.max("value").alias("value"))
    return surfaces.sheet_switches(grid, volume)


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, round(sum(seg) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING), 4) AS arc FROM (
  SELECT *, coalesce(abs(l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice)), 0) AS seg FROM lineitem)""")
def arc_length(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    each = table(spark, sf_dir, "lineitem").withColumn("seg", F.coalesce(F.abs(F.col("l_extendedprice") - F.lag("l_extendedprice").over(w)), F.lit(0.0)))
    return each.select("l_orderkey", "l_linenumber", "l_extendedprice", F.round(F.sum("seg").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("arc"))


# Voxel-level leakage

_SEEN_SQL = """v AS (SELECT c_nationkey AS id, c_custkey % 40 AS z, c_custkey // 40 % 40 AS y, c_custkey // 1600 AS x FROM customer), b AS (SELECT s_nationkey AS id, s_suppkey % 30 AS z0, s_suppkey % 30 + 15 AS z1, s_suppkey % 20 AS y0, s_suppkey % 20 + 20 AS y1, 0 AS x0, 100000 AS x1 FROM supplier)"""


def _seen(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    v = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), (k % 40).alias("z"), (F.floor(k / 40) % 40).alias("y"), F.floor(k / 1600).alias("x"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"), (s % 30).alias("z0"), (s % 30 + 15).alias("z1"), (s % 20).alias("y0"), (s % 20 + 20).alias("y1"), F.lit(0).alias("x0"), F.lit(100000).alias("x1"))
    return leakage.seen_fraction(v, b)


@query(f"""WITH {_SEEN_SQL} SELECT id, count(*) AS n_labelled, count(*) FILTER (s) AS n_seen, round(count(*) FILTER (s) / count(*)::DOUBLE, 6) AS seen FROM (
  SELECT *, EXISTS (SELECT 1 FROM b WHERE b.id = v.id AND v.z >= z0 AND v.z < z1 AND v.y >= y0 AND v.y < y1 AND v.x >= x0 AND v.x < x1) AS s FROM v) GROUP BY id""")
def seen_fraction(spark, sf_dir):
    return rounded(_seen(spark, sf_dir), "seen")


@query(f"""WITH {_SEEN_SQL}, q AS (SELECT id, count(*) AS w, count(*) FILTER (s) / count(*)::DOUBLE AS f FROM (
  SELECT *, EXISTS (SELECT 1 FROM b WHERE b.id = v.id AND v.z >= z0 AND v.z < z1 AND v.y >= y0 AND v.y < y1 AND v.x >= x0 AND v.x < x1) AS s FROM v) GROUP BY id)
SELECT count(*) AS n, round(avg(f), 6) AS mean, round(median(f), 6) AS median, round(quantile_cont(f, 0.9), 6) AS p90, round(max(f), 6) AS max, round(sum(f * w) / sum(w), 6) AS weighted_mean,
  count(*) FILTER (f > 0) AS n_any, round(100.0 * count(*) FILTER (f > 0) / count(*), 6) AS pct_any, count(*) FILTER (f > 0.25) AS n_quarter FROM q""")
def seen_summary(spark, sf_dir):
    return rounded(leakage.seen_summary(_seen(spark, sf_dir)), "mean", "median", "p90", "max", "weighted_mean", "pct_any")


@query("""WITH l AS (SELECT l_suppkey % 8 AS id, l_orderkey % 60 AS z, l_partkey % 20 AS y, l_linenumber AS x, bool_or(l_quantity > 25) AS o FROM lineitem GROUP BY ALL)
SELECT a.id AS a, b.id AS b, count(*) AS n_voxels, round(CASE WHEN count(*) FILTER (a.o OR b.o) = 0 THEN 1 ELSE count(*) FILTER (a.o AND b.o) / count(*) FILTER (a.o OR b.o)::DOUBLE END, 6) AS iou,
  round(CASE WHEN count(*) FILTER (a.o) + count(*) FILTER (b.o) = 0 THEN 1 ELSE 2 * count(*) FILTER (a.o AND b.o) / (count(*) FILTER (a.o) + count(*) FILTER (b.o))::DOUBLE END, 6) AS dice,
  round(count(*) FILTER (a.o <> b.o) / count(*)::DOUBLE, 6) AS disagreement FROM l a JOIN l b ON a.z = b.z AND a.y = b.y AND a.x = b.x AND a.id < b.id GROUP BY ALL""")
def overlap_consistency(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    lab = i.groupBy((F.col("l_suppkey") % 8).alias("id"), (F.col("l_orderkey") % 60).alias("z"), (F.col("l_partkey") % 20).alias("y"), F.col("l_linenumber").alias("x")).agg(F.bool_or(F.col("l_quantity") > 25).alias("on"))
    return rounded(leakage.overlap_consistency(lab), "iou", "dice", "disagreement")
