"""Binary files in the shared folder, written and read inside tasks."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.storage import scratch_path


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder, as a path of the file system that driver and executors share.

    Files that workers map into memory need the shared folder to be mounted.
    """
    parts = urlsplit(scratch_path(spark, tag))
    if parts.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder here, not {parts.scheme}://")
    path = unquote(parts.path)
    os.makedirs(path, exist_ok=True)
    return path


class AtomicFile:
    """A file that appears under its name only when it is whole.

    A task that runs twice writes the same bytes twice; the last one stands.
    """

    def __init__(self, path: str):
        self.path, self.own = path, f"{path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.file = open(self.own, "wb")  # noqa: SIM115
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if kind is None:
            os.replace(self.own, self.path)
        else:
            os.unlink(self.own)


def save(path: str, array) -> None:
    with AtomicFile(path) as out:
        out.write(memoryview(array).cast("B") if array.nbytes else b"")


def shard_bits(spark: SparkSession) -> int:
    """Bits that deal hashes to shards: a shard is about a shuffle partition."""
    return max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


class HashSet:
    """A set of 64-bit hashes as sorted arrays in a shared folder, mapped by the workers that ask it.

    Hashes are dealt to files by their first bits, so that no task sorts them
    all and a look-up touches one array.
    """

    _open: dict[str, HashSet] = {}

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.maps = folder, bits, {}

    @classmethod
    def write(cls, hashes: DataFrame, folder: str, bits: int) -> int:
        """Store the distinct hashes of a (h long) table; returns how many there are."""

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            keys = np.sort(pdf["h"].to_numpy().view(np.uint64))
            save(f"{folder}/set-{int(pdf['shard'].iloc[0])}.key", keys)
            return pd.DataFrame({"n": [len(keys)]})

        shard = F.shiftrightunsigned("h", 64 - bits).cast("int")
        stored = hashes.select("h", shard.alias("shard")).groupBy("shard").applyInPandas(build, "n long")
        return int(stored.agg(F.sum("n")).first()[0] or 0)

    @classmethod
    def opened(cls, folder: str, bits: int) -> HashSet:
        """This process's mapping of the folder."""
        if folder not in cls._open:
            cls._open.clear()
            cls._open[folder] = cls(folder, bits)
        return cls._open[folder]

    def _hits(self, keys: np.ndarray):
        """For each shard that is asked: the shard, the keys that it holds, and where it holds them."""
        shard = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero(np.diff(edges)):
            own, mine = self._map(s, "key", "<u8"), order[edges[s] : edges[s + 1]]
            if len(own):
                at = np.minimum(np.searchsorted(own, keys[mine]), len(own) - 1)
                hit = own[at] == keys[mine]
                yield s, mine[hit], at[hit]

    def _map(self, shard: int, part: str, kind: str) -> np.ndarray:
        if (shard, part) not in self.maps:
            path = f"{self.folder}/set-{shard}.{part}"
            self.maps[shard, part] = np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)
        return self.maps[shard, part]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for _, mine, _ in self._hits(keys):
            out[mine] = True
        return out


def asked(folder: str, bits: int):
    """A function of a column of 64-bit hashes: whether the stored set holds them.

    Only the hashes go to Python; the rows' other columns stay where they are.
    """

    @F.pandas_udf(T.BooleanType())
    def contains(h: pd.Series) -> pd.Series:
        return pd.Series(HashSet.opened(folder, bits).contains(h.to_numpy().view(np.uint64)))

    return contains


def without_ids(docs: DataFrame, id_col: str, fates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` that stay, and those that have to be looked at again.

    ``fates`` (id, fate): one row for each id of ``docs``, which stays, goes or is looked
    at.  The hashes of ids that do not stay are stored and asked in the scan, so no text
    is shuffled, however many go; ids that stay but share such a hash come back by a join.
    """
    spark = docs.sparkSession
    bits, folder, looked_at = shard_bits(spark), shared_folder(spark, "gone"), shared_folder(spark, "looked-at")
    hashed = fates.select("id", "fate", F.xxhash64("id").alias("h"))
    HashSet.write(hashed.where("fate <> 'stays'").select("h").distinct(), folder, bits)
    own = F.xxhash64(id_col)
    stay = docs.where(~asked(folder, bits)(own))
    misled = hashed.where("fate = 'stays'").where(asked(folder, bits)("h")).select(F.col("id").alias("__id"))
    if not misled.isEmpty():
        stay = stay.unionByName(docs.join(misled, docs[id_col].eqNullSafe(misled["__id"]), "left_semi"))
    doubtful = hashed.where("fate = 'looked at'")
    if not HashSet.write(doubtful.select("h").distinct(), looked_at, bits):
        return stay, docs.limit(0)
    few = doubtful.select(F.col("id").alias("__id"))
    return stay, docs.where(asked(looked_at, bits)(own)).join(few, docs[id_col].eqNullSafe(few["__id"]), "left_semi")


class HashCounts(HashSet):
    """64-bit hashes with a count each, stored likewise."""

    _open: dict[str, HashCounts] = {}

    @classmethod
    def write(cls, counts: DataFrame, folder: str, bits: int) -> int:
        """Store a (h long, n long) table of distinct hashes; returns how many there are."""

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            keys, shard = pdf["h"].to_numpy().view(np.uint64), int(pdf["shard"].iloc[0])
            order = np.argsort(keys)
            save(f"{folder}/set-{shard}.key", keys[order])
            save(f"{folder}/set-{shard}.n", pdf["n"].to_numpy()[order].astype("<i8"))
            return pd.DataFrame({"n": [len(keys)]})

        shard = F.shiftrightunsigned("h", 64 - bits).cast("int")
        stored = counts.select("h", "n", shard.alias("shard")).groupBy("shard").applyInPandas(build, "n long")
        return int(stored.agg(F.sum("n")).first()[0] or 0)

    @classmethod
    def close(cls) -> None:
        cls._open.clear()

    @classmethod
    def histogram(cls, spark: SparkSession, folder: str, bits: int, step) -> DataFrame:
        """(step, n): how many hashes have a count of each step; ``step`` gives those of an array of counts."""

        def run(batches):
            counts = cls(folder, bits)
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    found, n = np.unique(step(np.asarray(counts._map(s, "n", "<i8"))), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["step", "n"])

        return spark.range(1 << bits).mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n"))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' counts; 0 for those that are not stored."""
        out = np.zeros(len(keys), np.int64)
        for s, mine, at in self._hits(keys):
            out[mine] = self._map(s, "n", "<i8")[at]
        return out
