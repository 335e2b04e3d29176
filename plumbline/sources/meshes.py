"""OBJ and ASCII PLY meshes as vertex and face tables, through Spark's text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(mesh, at, line): trimmed lines with their number in the file."""
    content = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[a-z]+$", "")
    return content.select(name.alias("mesh"), F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("at", "line")).withColumn("line", F.trim("line"))


def _vertices(numbered: DataFrame, values) -> DataFrame:
    """Files have x, y, z; tables have z, y, x."""
    return numbered.select("mesh", "v", *[F.get(values, F.lit(k)).cast("double").alias(a) for k, a in ((2, "z"), (1, "y"), (0, "x"))])


def _fan(faces: DataFrame) -> DataFrame:
    """(mesh, f, a, b, c): each polygon as a fan of triangles around its first corner."""
    turns = F.when(F.size("ids") >= 3, F.sequence(F.lit(1), F.size("ids") - 2))
    each = faces.select("mesh", "f", "ids", F.explode(turns).alias("t"))
    return each.select("mesh", "f", F.get("ids", F.lit(0)).alias("a"), F.get("ids", F.col("t")).alias("b"), F.get("ids", F.col("t") + 1).alias("c"))


def obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (mesh, v, z, y, x) and faces (mesh, f, a, b, c) of the OBJ files; vertices count from 0.

    ``a/b/c`` keeps the vertex; an index below zero counts back from the
    vertices read so far.  The numbering needs a file's lines in order, so a
    file is one window; lines, not the mesh, are what it holds.
    """
    lines = _lines(spark, path, "*.obj").where(F.col("line").rlike("^[vf]\\s"))
    words = F.split(F.col("line"), r"\s+")
    order = Window.partitionBy("mesh").orderBy("at")
    is_v = F.col("line").rlike(r"^v\s")
    seen = lines.select("mesh", "at", words.alias("w"), is_v.alias("is_v"), F.sum(is_v.cast("int")).over(order).alias("seen"))
    vertices = _vertices(seen.where("is_v").select("mesh", (F.col("seen") - 1).alias("v"), F.slice("w", 2, 3).alias("p")), F.col("p"))
    index = F.transform(F.expr("slice(w, 2, size(w) - 1)"), lambda t: F.split(t, "/")[0].cast("int"))
    faces = seen.where("not is_v").select("mesh", F.col("at").alias("f"), "seen", index.alias("raw"))
    resolved = faces.select("mesh", "f", F.transform("raw", lambda i: F.when(i < 0, F.col("seen") + i).otherwise(i - 1).cast("int")).alias("ids"))
    return vertices, _fan(resolved)


def ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of the ASCII PLY files; binary ones are left to ``errors``."""
    lines = _lines(spark, path, "*.ply")
    count = lambda kind: F.max(F.nullif(F.regexp_extract("line", rf"^element {kind} (\d+)$", 1), F.lit("")).cast("int"))
    heads = lines.groupBy("mesh").agg(F.min(F.when(F.col("line") == "end_header", F.col("at"))).alias("head"), count("vertex").alias("nv"), count("face").alias("nf"), F.bool_or(F.col("line").startswith("format ascii")).alias("ascii"))
    body = lines.join(heads.where("ascii and head is not null"), "mesh").where("at > head").withColumn("i", F.col("at") - F.col("head") - 1).withColumn("w", F.split("line", r"\s+"))
    vertices = _vertices(body.where("i < nv").select("mesh", F.col("i").alias("v"), "w"), F.col("w"))
    faces = body.where("i >= nv and i < nv + nf").select("mesh", (F.col("i") - F.col("nv")).alias("f"), F.transform(F.slice("w", F.lit(2), F.get("w", F.lit(0)).cast("int")), lambda t: t.cast("int")).alias("ids"))
    return vertices, _fan(faces)


def errors(spark: SparkSession, path: str) -> DataFrame:
    """(mesh, error) of mesh files that give no table."""
    lines = _lines(spark, path, "*.ply")
    binary = lines.groupBy("mesh").agg(F.bool_or(F.col("line").startswith("format ascii")).alias("ascii")).where("not ascii").select("mesh", F.lit("format_unsupported: only ASCII PLY is read").alias("error"))
    objs = _lines(spark, path, "*.obj").groupBy("mesh").agg(F.count_if(F.col("line").rlike(r"^v\s")).alias("v"), F.count_if(F.col("line").rlike(r"^f\s")).alias("f"))
    return binary.union(objs.where("v = 0 or f = 0").select("mesh", F.lit("no vertices or no faces").alias("error")))
