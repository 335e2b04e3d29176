"""Registered queries on shapes: strips along arcs, foreign points, exact distances, junctions, spanning signs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import morphology, orientation, surfaces
from plumbline.plans.proxies import VOXELS_SQL, line_voxels, table
from plumbline.plans.registry import _GRID_SQL, _grid, query, rounded


@query(f"""WITH {_GRID_SQL}, s AS (SELECT *, coalesce(sqrt((z - lag(z) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (x - lag(x) OVER w) ** 2), 0) AS step FROM g WINDOW w AS (PARTITION BY mesh, r ORDER BY c)),
a AS (SELECT *, sum(step) OVER (PARTITION BY mesh, r ORDER BY c ROWS UNBOUNDED PRECEDING) AS arc FROM s), e AS (SELECT mesh, r, max(arc) AS total, greatest(2, CAST(floor(max(arc) / 40) AS BIGINT)) - 1 AS last FROM a GROUP BY ALL HAVING count(*) >= 8 AND max(arc) > 0),
p AS (SELECT mesh, r, unnest(range(0, last + 1)) AS i, total, last FROM e), n AS (SELECT *, lead(arc) OVER w AS arc1, lead(z) OVER w AS z1, lead(x) OVER w AS x1 FROM a WINDOW w AS (PARTITION BY mesh, r ORDER BY c)),
h AS (SELECT p.mesh, p.r, p.i, p.i * (total / last) AS want, n.arc, arc1, z, z1, x, x1 FROM p JOIN n ON p.mesh = n.mesh AND p.r = n.r AND arc1 > n.arc AND p.i * (total / last) <= arc1 * (1 + 1e-12) AND p.i * (total / last) >= n.arc * (1 - 1e-12))
SELECT mesh, r, i, round(any_value(want), 5) AS arc, round(avg(z + least(greatest((want - arc) / (arc1 - arc), 0), 1) * (z1 - z)), 5) AS z, round(avg(x + least(greatest((want - arc) / (arc1 - arc), 0), 1) * (x1 - x)), 5) AS x FROM h GROUP BY mesh, r, i""")
def strip_places(spark, sf_dir):
    """Rows of the orders' surfaces, sampled at even steps of arc length."""
    found = surfaces.strip_places(_grid(spark, sf_dir), ["mesh", "r"], "c", ["z", "x"], 40.0)
    return rounded(found, "arc", "z", "x", digits=5)


@query("""WITH p AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS g, o_custkey % 997 * 1.0 AS z, o_orderkey % 1009 * 1.0 AS y, o_totalprice / 500 AS x FROM orders),
j AS (SELECT a.s, a.g, min(struct_pack(d := (a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2, a := a.id, b := b.id)) AS m FROM p a JOIN p b ON a.s = b.s AND a.g <> b.g GROUP BY ALL)
SELECT s, g, m.a AS a, m.b AS b, round(sqrt(m.d), 6) AS distance FROM j""")
def nearest_foreign(spark, sf_dir):
    """Of each priority, the order that is nearest to one of another priority."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("g"), (F.col("o_custkey") % 997).cast("double").alias("z"), (F.col("o_orderkey") % 1009).cast("double").alias("y"), (F.col("o_totalprice") / 500).alias("x"))
    return rounded(orientation.nearest_foreign(o, "s", "g", "id"), "distance")


_CUBE = dict.fromkeys("zyx", 24)


@query(f"""WITH {VOXELS_SQL}, g AS (SELECT volume, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM (SELECT DISTINCT volume FROM voxels), range(0, 24) a(z), range(0, 24) b(y), range(0, 24) c(x)),
o AS (SELECT * FROM g ANTI JOIN voxels USING (volume, z, y, x)), f AS (SELECT volume, count(*) AS n FROM o GROUP BY volume),
d AS (SELECT v.volume, v.z, v.y, v.x, sqrt(min((v.z - o.z) ** 2 + (v.y - o.y) ** 2 + (v.x - o.x) ** 2)) AS distance FROM voxels v JOIN o ON v.volume = o.volume GROUP BY ALL)
SELECT volume, z, y, x, round(distance, 6) AS distance FROM d UNION ALL SELECT volume, z, y, x, 'inf'::DOUBLE FROM voxels ANTI JOIN f USING (volume)""")
def voxel_distances(spark, sf_dir):
    """The exact distance of each voxel of the line items' volumes to the nearest empty place."""
    return rounded(morphology.background_distance(line_voxels(spark, sf_dir), "volume", _CUBE), "distance")


@query(f"""WITH RECURSIVE {VOXELS_SQL}, s AS MATERIALIZED (SELECT volume, z, y, x, row_number() OVER () AS id FROM voxels WHERE value >= 40),
near AS MATERIALIZED (SELECT a.id AS a, b.id AS b, dz * dz + dy * dy + dx * dx AS d2 FROM s a, range(-2, 3) i(dz), range(-2, 3) j(dy), range(-2, 3) k(dx), s b WHERE b.volume = a.volume AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx AND dz * dz + dy * dy + dx * dx <= 6.25),
edges AS MATERIALIZED (SELECT a, b FROM near WHERE d2 <= 3 AND d2 > 0),
home AS (SELECT id AS c, id AS v FROM s UNION SELECT h.c, e.b FROM home h JOIN edges e ON e.a = h.v JOIN near n ON n.a = h.c AND n.b = e.b),
shell AS MATERIALIZED (SELECT h.c, h.v FROM home h JOIN near n ON n.a = h.c AND n.b = h.v WHERE n.d2 >= 2.25),
reach AS (SELECT c, v AS node, v AS root FROM shell UNION SELECT r.c, e.b, r.root FROM reach r JOIN edges e ON e.a = r.node JOIN shell t ON t.c = r.c AND t.v = e.b),
arms AS (SELECT c, count(DISTINCT root) AS n FROM (SELECT c, node, min(root) AS root FROM reach GROUP BY ALL) GROUP BY c)
SELECT volume, count(*) AS n_samples, count(*) FILTER (coalesce(n, 0) >= 2) AS junctions, round(count(*) FILTER (coalesce(n, 0) >= 2) / count(*), 6) AS junction_fraction FROM s LEFT JOIN arms ON c = id GROUP BY volume""")
def junction_share(spark, sf_dir):
    """Where voxels of a quantity of 40 or more (the set looked at) fork, in balls of radius two around each of them."""
    found = morphology.junctions(line_voxels(spark, sf_dir).where("value >= 40"), "volume", 2, None)
    return rounded(morphology.junction_density(found, "volume"), "junction_fraction")


@query()
def spanning_signs(spark, sf_dir):
    """Signs of parts and suppliers along the minimum spanning forest of their line items, whose discounts say where signs differ."""
    i = table(spark, sf_dir, "lineitem")
    edges = i.select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"), F.col("l_extendedprice").alias("weight"), (F.col("l_discount") > 0.05).alias("flip"))
    return orientation.spanning_signs(edges)
