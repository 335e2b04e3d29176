"""Small text tables: name lists, manifests, results, volume catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.corpus import last_per_name, number, truthy

RESULT_FLAGS = ("resolution_adequate", "dip_degenerate")


def names(spark: SparkSession, path: str) -> DataFrame:
    """(name): non-empty lines, without ``.tif``."""
    return spark.read.text(path).select(F.regexp_replace(F.trim("value"), r"\.tif$", "").alias("name")).where("name <> ''")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(scroll, um, mesh, volume) of a headerless TSV; rows that are short or have no numeric ``um`` are left out."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("w")).where(F.size("w") == 4)
    parsed = rows.select(F.col("w")[0].alias("scroll"), number(F.col("w")[1]).alias("um"), F.col("w")[2].alias("mesh"), F.col("w")[3].alias("volume"))
    return parsed.where("um is not null")


def results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Result rows, the last file's row for each name; flags as booleans, the rest as text."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path).withColumn("path", F.col("_metadata.file_path"))
    flags = {c: F.coalesce(truthy(c), F.lit(False)) for c in RESULT_FLAGS if c in rows.columns}
    return last_per_name(rows).withColumns(flags)


def results_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, baseline, result): the first result that is neither baseline nor error, and the baseline's row.

    ``schema``: of one entry of ``results``; it needs ``baseline boolean`` and ``error string``.
    """
    rows = spark.read.option("multiLine", True).schema(f"results array<struct<{schema}>>").json(path).select(F.col("_metadata.file_path").alias("path"), "results")
    is_base = lambda r: F.coalesce(r["baseline"], F.lit(False))
    good = F.filter("results", lambda r: ~is_base(r) & r["error"].isNull())
    return rows.select("path", F.get(F.filter("results", is_base), F.lit(0)).alias("baseline"), F.get(good, F.lit(0)).alias("result"))


def voxel_size(name: str = "name"):
    """Voxel size in a volume's name, ``-<number>um-``."""
    return F.nullif(F.regexp_extract(name, r"-(\d+\.?\d*)um-", 1), F.lit("")).cast("double")
