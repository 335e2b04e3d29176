"""Token counts: a vectorised scan for end-of-document ids in flat token files.

The files hold ids of a fixed width, documents one after another, each closed by
an end id; there is no index.  Files are read in blocks.  Within a block the end
ids are found at once; a prefix scan over the blocks' summaries (tokens so far,
ends so far, last end so far) stitches documents that cross block boundaries.

Cases: two end ids in a row are a document of no tokens.  Tokens after the last
end id make a document with ``closed`` false.  An empty file gives no row.  A
trailing fraction of an id is an error.  A file of any length is read in blocks;
a document of any length only adds to two numbers.  Documents of equal texts, and
rows with a null id, are documents of their own; ties cannot occur, as a document
is named by its file and place.  Of a table only the id and the text are written.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.packing import tokenizer
from plumbline.llm.shared_files import AtomicFile
from plumbline.storage import written

BLOCK_TOKENS = 1 << 22
TEXT_END = 50256


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, end_id: int = TEXT_END, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every partition's texts as one flat file of ids; a null text is empty.

    A text that spells the end token is ordinary text, so it has no end id inside.

    Returns (doc_id, file, doc, n_tokens) of every document as the writer saw
    them, to check a scan against; files are written when it is evaluated.
    """
    kind = docs.schema[id_col].dataType

    def write(batches):
        tok = tokenizer(tokenizer_path, ranks_path, pattern, ordinary=True)
        end, name, doc = np.array([end_id], dtype).tobytes(), f"tokens-{TaskContext.get().partitionId():06d}.bin", 0
        with AtomicFile(os.path.join(folder, name)) as out:
            for batch in batches:
                sizes = []
                for text in batch.column(1):
                    ids = np.frombuffer(tok.ids(text.as_py() or ""), "<u4")
                    if len(ids) and ids.max() > np.iinfo(dtype).max:
                        raise ValueError(f"an id does not fit {dtype}")
                    out.write(ids.astype(dtype).tobytes())
                    out.write(end)
                    sizes.append(len(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(sizes), pa.string()), pa.array(np.arange(doc, doc + len(sizes)), pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "file", "doc", "n_tokens"])
                doc += len(sizes)

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("file", T.StringType()), T.StructField("doc", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(write, schema)


def blocks(spark: SparkSession, folder: str, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, start, n): the blocks of every token file, from the files' lengths alone."""
    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    files = files.where("length > 0").withColumn("tokens", F.expr(f"if(length % {width} = 0, length div {width}, raise_error(concat('not whole ids: ', path)))"))
    each = files.withColumn("block", F.explode(F.expr(f"sequence(0L, (tokens - 1) div {block_tokens})")))
    start = F.col("block") * block_tokens
    return each.select(F.element_at(F.split("path", "/"), -1).alias("file"), "block", start.alias("start"), F.least(F.lit(block_tokens), F.col("tokens") - start).alias("n"))


def scan_blocks(dealt: DataFrame, folder: str, end_id: int = TEXT_END, dtype: str = "<u2") -> DataFrame:
    """file, block, start, n and ``ends``: the places of the end ids, counted from the file's begin."""
    width = np.dtype(dtype).itemsize

    def scan(batches):
        for batch in batches:
            ends = []
            for row in batch.to_pylist():
                with open(os.path.join(folder, row["file"]), "rb") as tokens:
                    tokens.seek(row["start"] * width)
                    ids = np.frombuffer(tokens.read(row["n"] * width), dtype)
                ends.append(pa.array(np.flatnonzero(ids == end_id) + row["start"], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([e.to_numpy() for e in ends], pa.list_(pa.int64()))], names=["file", "block", "start", "n", "ends"])

    return dealt.mapInArrow(scan, "file string, block long, start long, n long, ends array<long>")


def count_tokens(spark: SparkSession, folder: str, end_id: int = TEXT_END, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, doc (from 0 in its file), start, n_tokens (without the end id), closed.

    ``folder`` is a mounted folder of ``*.bin`` files.
    """
    dealt = blocks(spark, "file://" + folder, dtype, block_tokens)
    found = scan_blocks(dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "block"), folder, end_id, dtype)
    found = written(found, "token-ends")
    # Only a block's number of ends and its last one go through the prefix scan.
    ended = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    brief = found.select("file", "block", (F.col("start") + F.col("n")).alias("stop"), F.size("ends").alias("n_ends"), ended.alias("last_end"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max("block").over(Window.partitionBy("file"))
    scanned = brief.select(
        "file", "block", "stop", "n_ends", "last_end", (F.col("block") == last).alias("final"),
        F.coalesce(F.sum("n_ends").over(earlier), F.lit(0)).alias("docs_before"), F.coalesce(F.max("last_end").over(earlier), F.lit(-1)).alias("end_before"),
    )
    each = found.select("file", "block", "ends").join(scanned.select("file", "block", "docs_before", "end_before"), ["file", "block"])
    closed = each.select("file", "docs_before", "end_before", "ends", F.posexplode("ends").alias("i", "end")).select(
        "file", (F.col("docs_before") + F.col("i")).alias("doc"),
        (F.when(F.col("i") == 0, F.col("end_before")).otherwise(F.get("ends", F.col("i") - 1)) + 1).alias("start"), "end", F.lit(True).alias("closed"),
    )
    tail = scanned.where("final").select("file", (F.col("docs_before") + F.col("n_ends")).alias("doc"), (F.coalesce("last_end", "end_before") + 1).alias("start"), F.col("stop").alias("end"), F.lit(False).alias("closed")).where("end > start")
    return closed.union(tail).select("file", "doc", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "closed")
