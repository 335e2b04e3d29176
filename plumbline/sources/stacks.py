"""Label volumes written as TIFF stacks, one file a volume, through a data source with commit.

Tasks write under hidden names; only the commit gives files their own, so a task that
is lost, or runs twice, leaves no half file and no second one.  The folder must be
mounted on all nodes.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from plumbline.sources.tiff import BITS, COMPRESSION, COUNTS, HEIGHT, KINDS, OFFSETS, SAMPLE_FORMAT, SAMPLES, WIDTH

PAGE_SCHEMA = "volume string, z int, height int, width int, dtype string, data binary"


class StackFile:
    """A multi-page TIFF file, uncompressed, written page after page."""

    def __init__(self, path: str):
        self.file = open(path, "wb")  # noqa: SIM115
        self.file.write(struct.pack("<2sHI", b"II", 42, 0))
        self.link = 4  # where the place of the next directory goes

    def page(self, height: int, width: int, dtype: str, data: bytes) -> None:
        bits, kind = next(k for k, name in KINDS.items() if name == dtype)
        at = self.file.tell()
        self.file.write(data + b"\0" * (len(data) % 2))
        directory = self.file.tell()
        entries = [(WIDTH, 4, width), (HEIGHT, 4, height), (BITS, 3, bits), (COMPRESSION, 3, 1), (262, 3, 1), (OFFSETS, 4, at), (SAMPLES, 3, 1), (278, 4, height), (COUNTS, 4, len(data)), (SAMPLE_FORMAT, 3, kind)]
        self.file.write(struct.pack("<H", len(entries)))
        for tag, size, value in entries:
            self.file.write(struct.pack("<HHI", tag, size, 1) + (struct.pack("<HH", value, 0) if size == 3 else struct.pack("<I", value)))
        after = self.file.tell()
        self.file.write(struct.pack("<I", 0))
        self.file.seek(self.link)
        self.file.write(struct.pack("<I", directory))
        self.file.seek(0, os.SEEK_END)
        self.link = after

    def close(self) -> None:
        self.file.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  #: hidden and own path


class StackWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> Written:
        """Pages of this partition, sorted by volume and z."""
        done, stack, volume = [], None, None
        os.makedirs(self.folder, exist_ok=True)
        try:
            for r in iterator:
                if r.volume != volume:
                    if stack:
                        stack.close()
                    volume = r.volume
                    hidden = f"{self.folder}/.{volume}.{uuid.uuid4().hex}.part"
                    done.append((hidden, f"{self.folder}/{volume}.tif"))
                    stack = StackFile(hidden)
                stack.page(r.height, r.width, r.dtype, bytes(r.data))
        except BaseException:
            for hidden, _ in done:
                if os.path.exists(hidden):
                    os.unlink(hidden)
            raise
        finally:
            if stack:
                stack.close()
        return Written(done)

    def commit(self, messages: list) -> None:
        for message in messages:
            for hidden, own in message.files if message else []:
                os.replace(hidden, own)

    def abort(self, messages: list) -> None:
        for message in messages:
            for hidden, _ in message.files if message else []:
                if os.path.exists(hidden):
                    os.unlink(hidden)


class LabelStacks(DataSource):
    """``df.write.format("label_stacks").mode("append").save(folder)`` of PAGE_SCHEMA rows."""

    @classmethod
    def name(cls) -> str:
        return "label_stacks"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def writer(self, schema, overwrite: bool) -> StackWriter:
        return StackWriter(self.options["path"].removeprefix("file://"))


def pages(voxels: DataFrame, shapes: DataFrame, dtype: str = "uint8") -> DataFrame:
    """PAGE_SCHEMA rows of all planes of the volumes in ``shapes`` (volume, n_pages, height, width), from (volume, z, y, x, value).

    A plane is one row, so no task holds a volume; planes without a voxel are zero.
    """

    def dense(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                height, width = batch.column(2)[r].as_py(), batch.column(3)[r].as_py()
                plane = np.zeros((height, width), dtype)
                cells = batch.column(4)[r]
                if cells.is_valid:
                    y, x, v = (cells.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                    plane[y, x] = v
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(r, 1) for k in range(4)], pa.array([dtype]), pa.array([plane.tobytes()], pa.binary())], names=["volume", "z", "height", "width", "dtype", "data"])

    planes = shapes.select("volume", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1)).alias("z"), "height", "width")
    cells = voxels.groupBy("volume", "z").agg(F.collect_list(F.struct(F.col("y").cast("int"), F.col("x").cast("int"), F.col("value").cast("double"))).alias("cells"))
    return planes.join(cells, ["volume", "z"], "left").select("volume", "z", "height", "width", "cells").mapInArrow(dense, PAGE_SCHEMA)


def write_stacks(page_rows: DataFrame, folder: str) -> None:
    """A file ``<volume>.tif`` for each volume of PAGE_SCHEMA rows."""
    page_rows.sparkSession.dataSource.register(LabelStacks)
    page_rows.repartition("volume").sortWithinPartitions("volume", "z").write.format("label_stacks").mode("append").save(folder)
