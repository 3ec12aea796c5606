"""Page snapshots as a data source of their own: a batch reader and a stream whose offsets are snapshot numbers.

A snapshot is a folder ``snapshot=N`` of Parquet files that counts from the
moment its ``_SUCCESS`` mark is there.  A reader plans a partition per range of
row groups, and rows travel as Arrow batches.  The folder must be one that every
executor can reach through ``pyarrow.fs`` (a mounted folder, S3, HDFS).
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from reviewloom.schemas import PAGES

# the source travels by value: the driver plans it in a worker that knows of no shipped files
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "page_snapshots"
# Bytes of row groups that one partition reads, if the source is not told otherwise.
PART_BYTES = 64 << 20


@dataclass
class Part(InputPartition):
    """Row groups ``first`` to ``last`` (without) of one file."""

    file: str
    first: int
    last: int


class _Folder:
    """What both readers know of the folder."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.part_bytes = int(options.get("partBytes", PART_BYTES))

    def open(self) -> tuple[pa.fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return pa.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", self.path))
        return pa.fs.LocalFileSystem(), self.path

    def complete(self) -> dict[int, str]:
        """Complete snapshots by number."""
        store, root = self.open()
        listed = store.get_file_info(pa.fs.FileSelector(root, allow_not_found=True))
        named = {int(m[1]): i.path for i in listed if (m := re.fullmatch(r"snapshot=(\d+)", i.base_name))}
        marks = store.get_file_info([f"{p}/_SUCCESS" for p in named.values()])
        return {n: p for (n, p), mark in zip(named.items(), marks) if mark.type == pa.fs.FileType.File}

    def parts(self, snapshots: list[str]) -> list[Part]:
        store, _ = self.open()
        parts = []
        for folder in snapshots:
            for info in store.get_file_info(pa.fs.FileSelector(folder)):
                if not info.base_name.endswith(".parquet"):
                    continue
                meta = pq.read_metadata(info.path, filesystem=store)
                first = size = 0
                for group in range(meta.num_row_groups):
                    size += meta.row_group(group).total_byte_size
                    if size >= self.part_bytes or group + 1 == meta.num_row_groups:
                        parts.append(Part(info.path, first, group + 1))
                        first, size = group + 1, 0
        return parts

    def rows(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, _ = self.open()
        schema = to_arrow_schema(PAGES)
        with pq.ParquetFile(store.open_input_file(part.file)) as file:
            for batch in file.iter_batches(batch_size=256, row_groups=list(range(part.first, part.last)), columns=schema.names):
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in schema], schema=schema)


class SnapshotReader(DataSourceReader):
    """All complete snapshots, or only that of the option ``snapshot``."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.wanted = _Folder(options), options.get("snapshot")

    def partitions(self) -> list[InputPartition]:
        found = self.folder.complete()
        chosen = [p for n, p in sorted(found.items()) if self.wanted is None or n == int(self.wanted)]
        # a reader without partitions would be given one it knows nothing of
        return self.folder.parts(chosen) or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition) if partition.file else iter(())


class SnapshotStream(DataSourceStreamReader):
    """Snapshots in the order of their numbers; the offset is the last one that has been read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {"snapshot": -1}

    def latestOffset(self) -> dict:
        return {"snapshot": max(self.folder.complete(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = self.folder.complete()
        chosen = [p for n, p in sorted(found.items()) if start["snapshot"] < n <= end["snapshot"]]
        return self.folder.parts(chosen) or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition) if partition.file else iter(())

    def commit(self, end: dict) -> None:
        pass


class PageSnapshots(DataSource):
    """``spark.read.format("page_snapshots").load(path)``, and the same with ``readStream``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return SnapshotReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SnapshotStream(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Make the source known to the session."""
    spark.dataSource.register(PageSnapshots)
    return spark


def write_snapshot(pages, path: str, number: int) -> None:
    """Write one snapshot with all its partitions; it becomes visible as a whole."""
    pages.write.mode("overwrite").parquet(f"{path.rstrip('/')}/snapshot={number}")
