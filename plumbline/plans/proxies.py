"""The given tables in the shapes that the operators take: boxes, folds, voxels, surfaces, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as boxes: the key gives the place on a lattice of half-overlapping boxes, the size the edge."""
    key = F.col("p_partkey")
    at = {"z0": key % 20 * 50, "y0": F.floor(key / 20) % 20 * 50, "x0": F.floor(key / 400) % 5 * 50}
    placed = table(spark, sf_dir, "part").select(key.alias("id"), F.concat_ws(":", "p_brand", (F.floor(key / 2000)).cast("string")).alias("volume"), *[c.cast("long").alias(n) for n, c in at.items()], (40 + F.col("p_size")).cast("long").alias("edge"))
    return placed.select("id", "volume", "z0", "y0", "x0", *[(F.col(f"{a}0") + F.col("edge")).alias(f"{a}1") for a in "zyx"])


BOXES_SQL = """
boxes AS (
  SELECT id, volume, z0, y0, x0, z0 + edge AS z1, y0 + edge AS y1, x0 + edge AS x1 FROM (
    SELECT p_partkey AS id, concat_ws(':', p_brand, CAST(p_partkey // 2000 AS VARCHAR)) AS volume, p_partkey % 20 * 50 AS z0,
           p_partkey // 20 % 20 * 50 AS y0, p_partkey // 400 % 5 * 50 AS x0, CAST(40 + p_size AS BIGINT) AS edge FROM part) p
)"""


def pairs_sql(buffer: int = 0) -> str:
    """Overlapping pairs and their fraction, as plain SQL over ``boxes``."""
    sign = "<=" if buffer else "<"
    side = " AND ".join(f"a.{x}0 {sign} b.{x}1 + {buffer} AND b.{x}0 {sign} a.{x}1 + {buffer}" for x in "yx")
    edge = " * ".join(f"greatest(0, least(a.{x}1, b.{x}1) - greatest(a.{x}0, b.{x}0))" for x in "zyx")
    own = " * ".join(f"(a.{x}1 - a.{x}0)" for x in "zyx")
    return f"""
pairs AS (
  SELECT a.id AS a, b.id AS b, ({edge}) / CAST({own} AS DOUBLE) AS fraction
  FROM boxes a JOIN boxes b ON a.volume = b.volume AND (a.z0 < b.z0 OR (a.z0 = b.z0 AND a.id < b.id)) AND b.z0 < a.z1 + {buffer} AND {side}
), graph AS (SELECT a, b, fraction FROM pairs UNION ALL SELECT b, a, fraction FROM pairs)"""


def hashed_fold(spark_col: str, k: int = 5):
    """A fold from md5 of the id: the same in every engine."""
    return (F.conv(F.substring(F.md5(F.col(spark_col).cast("string")), 1, 6), 16, 10).cast("long") % k).cast("int")


FOLDS_SQL = """
assigned AS (SELECT id, CAST(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 6)) AS BIGINT) % 5 AS f FROM boxes),
folds AS (SELECT CAST(k.fold AS INTEGER) AS fold, CASE WHEN f = k.fold THEN 'val' ELSE 'train' END AS role, id
          FROM assigned, (SELECT unnest(range(0, 5)) AS fold) k)"""


def line_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as voxels of one volume a return flag and supplier group, with the quantity as value."""
    i = table(spark, sf_dir, "lineitem")
    return i.select(
        F.concat("l_returnflag", F.floor(F.col("l_suppkey") / 500).cast("string")).alias("volume"), (F.col("l_orderkey") % 24).cast("int").alias("z"), (F.col("l_partkey") % 24).cast("int").alias("y"), (F.col("l_suppkey") % 24).cast("int").alias("x"), "l_quantity"
    ).groupBy("volume", "z", "y", "x").agg(F.max("l_quantity").alias("value"))


VOXELS_SQL = """
voxels AS (SELECT concat(l_returnflag, CAST(l_suppkey // 500 AS VARCHAR)) AS volume, CAST(l_orderkey % 24 AS INTEGER) AS z, CAST(l_partkey % 24 AS INTEGER) AS y,
                  CAST(l_suppkey % 24 AS INTEGER) AS x, max(l_quantity) AS value FROM lineitem GROUP BY ALL)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as profiles of 64 samples."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("profile"))


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as surface cells: event type the surface, user the grid line, value the dip."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("mesh"), F.col("user_id").alias("line"), F.col("event_id").alias("edge"), F.col("value").alias("dip"))
