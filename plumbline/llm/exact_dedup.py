"""Exact duplicates: counting quotient filters, then a comparison of bytes.

1. Every text is normalised (each run of space or 0x09-0x0D becomes one space)
   and gets a 64-bit fingerprint and its SHA-256.
2. Each partition builds a counting quotient filter of its fingerprints: the
   high bits (quotient) give the run, the low bits (remainder) are kept sorted
   within the run, each with a count.  Filters of all partitions merge by
   sorted remainders without loss, shard by shard; there are as many shards as
   shuffle partitions, so that their size is the cluster's choice.
3. Fingerprints whose merged count is above one route their texts to byte
   verification: a grouping on the normalised bytes themselves.  All other
   texts are alone.

Cases: a null text counts as empty, and all empty texts are equal.  Repeated
rows (same id, same text) form a group in which one row is kept.  A null id is
kept where its text has no other row; ids are compared null-safely.  An empty
table gives an empty result.  A text of any length is hashed and compared as a
whole.  Ties cannot occur: the smallest id stays.  Extra columns of the input do
not matter, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.kit import begins, unused
from plumbline.llm.shared_files import HashSet, shard_bits, shared_folder, without_ids
from plumbline.storage import written

RUN_BITS = 5  #: quotient bits besides those that deal filters to shards: runs of a filter

_ONE_SPACE = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def normalised(text: bytes) -> bytes:
    """Each run of white space as one space."""
    text = text.translate(_ONE_SPACE)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def _prints(batches):
    begins("prints")
    for batch in batches:
        texts = batch.column(1)
        fps, shas, sizes = [], [], []
        for value in texts:
            norm = normalised(value.as_buffer().to_pybytes() if value.is_valid else b"")
            fps.append(xxhash.xxh3_64_intdigest(norm) - (1 << 63))
            shas.append(hashlib.sha256(norm).hexdigest())
            sizes.append(len(norm))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(fps, pa.int64()), pa.array(shas, pa.string()), pa.array(sizes, pa.int64())],
            names=["doc_id", "fp", "text_sha256", "n_bytes"],
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, text_sha256, n_bytes of every row."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("n_bytes", T.LongType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_prints, schema)


class QuotientFilter:
    """A counting quotient filter, as arrays: length of each run, remainders, counts.

    ``bits``: how many first bits of a key are the quotient; the runs begin at
    quotient ``first``.
    """

    def __init__(self, bits: int, first: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.bits, self.first, self.runs, self.remainders, self.counts = bits, first, runs, remainders, counts

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, bits: int, first: int, quotients: int) -> QuotientFilter:
        """From sorted distinct keys whose quotients lie in [first, first + quotients)."""
        rest = np.uint64(64 - bits)
        quotient = (keys >> rest).astype(np.int64) - first
        return cls(bits, first, np.bincount(quotient, minlength=quotients).astype(np.uint32), keys & ((np.uint64(1) << rest) - np.uint64(1)), counts.astype(np.int64))

    def keys(self) -> np.ndarray:
        """The fingerprints again; nothing is lost."""
        quotient = np.repeat(np.arange(self.first, self.first + len(self.runs), dtype=np.uint64), self.runs)
        return (quotient << np.uint64(64 - self.bits)) | self.remainders

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """All filters over the same quotients as one; counts of equal remainders add up."""
        keys = np.concatenate([f.keys() for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        summed = np.add.reduceat(counts, at) if len(at) else counts
        return cls.build(keys[at], summed, filters[0].bits, filters[0].first, len(filters[0].runs))


def _partition_filters(shards: int):
    """One filter for each of 2 ** ``shards`` shards from all fingerprints of a partition."""

    def build(batches):
        seen = [np.asarray(b.column(0)).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for b in batches]
        if not seen:
            return
        keys, counts = np.unique(np.concatenate(seen), return_counts=True)
        shard = (keys >> np.uint64(64 - shards)).astype(np.int64)
        rows = []
        for s in np.unique(shard):
            low, high = np.searchsorted(shard, [s, s + 1])
            f = QuotientFilter.build(keys[low:high], counts[low:high], shards + RUN_BITS, int(s) << RUN_BITS, 1 << RUN_BITS)
            rows.append((int(s), f.runs.tobytes(), f.remainders.tobytes(), f.counts.tobytes()))
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["shard", "runs", "remainders", "counts"]), schema=pa.schema([("shard", pa.int32()), ("runs", pa.binary()), ("remainders", pa.binary()), ("counts", pa.binary())]), preserve_index=False)

    return build


def _merge_shard(shards: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf.shard.iloc[0]) << RUN_BITS
        parts = [QuotientFilter(shards + RUN_BITS, first, np.frombuffer(r, np.uint32), np.frombuffer(m, np.uint64), np.frombuffer(c, np.int64)) for r, m, c in zip(pdf.runs, pdf.remainders, pdf.counts, strict=True)]
        merged = QuotientFilter.merge(parts)
        often = merged.counts > 1
        return pd.DataFrame({"fp": (merged.keys()[often] ^ np.uint64(1 << 63)).view(np.int64), "n": merged.counts[often]})

    return merge


def repeated(prints: DataFrame) -> DataFrame:
    """Fingerprints that all partitions together hold more than once, with counts."""
    bits = shard_bits(prints.sparkSession)
    filters = prints.select("fp").mapInArrow(_partition_filters(bits), "shard int, runs binary, remainders binary, counts binary")
    return filters.groupBy("shard").applyInPandas(_merge_shard(bits), "fp long, n long")


def _suspects(folder: str, bits: int):
    """Normalised texts whose fingerprint is stored, with it; all others end in the scan."""

    def run(batches):
        begins("prints")
        wanted = HashSet.opened(folder, bits)
        for batch in batches:
            norms = [normalised(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in batch.column(1)]
            fps = np.array([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in norms], np.int64)
            hit = np.flatnonzero(wanted.contains(fps.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), pa.array(fps[hit]), pa.array([norms[k] for k in hit], pa.binary())], names=["doc_id", "fp", "norm"])

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    ``keep_id`` is the smallest id of the rows with an equal text; of several
    rows with that id one is kept.
    """
    prints = written(fingerprints(docs, id_col, text_col), "prints")
    folder, bits = shared_folder(docs.sparkSession, "repeated"), shard_bits(docs.sparkSession)
    HashSet.write(repeated(prints).select(F.col("fp").alias("h")), folder, bits)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType()), T.StructField("norm", T.BinaryType())])
    suspects = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_suspects(folder, bits), schema)
    groups = (
        suspects.groupBy("fp", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("fp", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    joined = prints.join(groups, ["fp", "text_sha256"], "left").withColumn("in_group", F.col("group_size").isNotNull())
    out = joined.select(
        "doc_id",
        F.when(F.col("in_group"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        "text_sha256",
        "n_bytes",
    )
    turn = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.lit(1)))
    return out.withColumn("turn", turn).select(
        "doc_id", "keep_id", "group_size", ((F.col("turn") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256", "n_bytes"
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The ids that go are asked in the scan.  Only rows whose id is repeated and has
    rows of both kinds are told apart by their texts.
    """
    sha = unused("kept_sha", docs.columns)
    judged = exact_duplicates(docs, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("rows"))
    pairs = written(judged, "pairs")
    one = F.min("stays") & (F.sum("rows") == 1)
    fates = pairs.groupBy(F.col("doc_id").alias("id")).agg(F.when(one, "stays").when(~F.max("stays"), "goes").otherwise("looked at").alias("fate"))
    stay, doubtful = without_ids(docs, id_col, written(fates, "fates"))
    norm = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    keyed = doubtful.withColumn(sha, F.sha2(norm, 256))
    kept = pairs.where("stays").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    told = keyed.join(kept, keyed[id_col].eqNullSafe(kept["__id"]) & (keyed[sha] == kept["__sha"]), "left_semi").dropDuplicates([id_col, sha]).drop(sha)
    return stay.unionByName(told)
