"""The review tables as versioned Parquet folders.

A version is a folder of parts, a part one or more attempts to write it; an
attempt is one Spark write and counts from the moment Spark puts its
``_SUCCESS`` mark there.  A reader sees the newest complete attempt of each part
of the newest version: the old contents or the new ones, also while a part is
written again, and a failed job leaves nothing visible.  Attempts that have been
replaced go at once, versions when two newer ones exist.  Writers are not
isolated from each other; where the tables live in a catalog with row-level
operations, :func:`merge_into` does the same in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.schemas import TABLES
from reviewloom.session import remove_folder


class ReviewStore:
    """Tables of :data:`reviewloom.schemas.TABLES` below one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def read(self, table: str, without_part: str | None = None) -> DataFrame:
        """Current contents; a table never written is empty.

        A batch that may be running again leaves its own earlier part out.
        """
        parts = [p for p in self._parts(table) if p[1] != without_part]
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        folders = [f"{self._folder(table, version)}/{part}/{attempt}" for version, part, attempt in parts]
        return self.spark.read.schema(TABLES[table]).parquet(*folders)

    def exists(self, table: str) -> bool:
        return bool(self._parts(table))

    def replace(self, table: str, rows: DataFrame) -> None:
        """Write the full contents as a new version; ``rows`` may be derived from the current one."""
        parts = self._parts(table)
        version = parts[0][0] + 1 if parts else 1
        self._write(rows, table, version, "all", 1)
        remove_folder(self.spark, self._folder(table, version - 2))

    def append(self, table: str, rows: DataFrame, part: str) -> None:
        """Add rows as a named part; repeating a name replaces that part, so retries do not double it."""
        parts = self._parts(table)
        version = parts[0][0] if parts else 1
        before = max((a for v, name, a in parts if name == part), default=0)
        self._write(rows, table, version, part, before + 1)
        if before:
            remove_folder(self.spark, f"{self._folder(table, version)}/{part}/{before}")

    def reject(self, table: str, rows: DataFrame, part: str) -> None:
        """Set rows aside that do not fit the table; repeating a part replaces it."""
        rows.write.mode("overwrite").parquet(self.rejected_folder(table, part))

    def rejected_folder(self, table: str, part: str) -> str:
        return f"{self.root}/rejected_{table}/{part}"

    def ensure(self, tables: Sequence[str] = tuple(TABLES)) -> None:
        """Create the tables that do not exist yet."""
        for table in tables:
            if not self.exists(table):
                self.replace(table, self.spark.createDataFrame([], TABLES[table]))

    def reset(self, tables: Sequence[str] = ("branches", "reviews", "insights_meta", "insights")) -> None:
        """Empty the named tables (normalised reviews stay unless named)."""
        for table in tables:
            self.replace(table, self.spark.createDataFrame([], TABLES[table]))

    def _folder(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/v{version:08d}"

    def _write(self, rows: DataFrame, table: str, version: int, part: str, attempt: int) -> None:
        shaped = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table]))
        shaped.write.mode("overwrite").parquet(f"{self._folder(table, version)}/{part}/{attempt}")

    def _parts(self, table: str) -> list[tuple[int, str, int]]:
        """(version, part, attempt) of the newest complete attempt of each part of the newest version."""
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path
        pattern = jvm_path(f"{self.root}/{table}/v*/*/*/_SUCCESS")
        marks = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        folders = [mark.getPath().getParent() for mark in marks]
        found = [(int(f.getParent().getParent().getName()[1:]), f.getParent().getName(), int(f.getName())) for f in folders]
        newest = max((version for version, _, _ in found), default=None)
        attempts: dict[str, int] = {}
        for version, part, attempt in found:
            if version == newest:
                attempts[part] = max(attempt, attempts.get(part, 0))
        return [(newest, part, attempt) for part, attempt in sorted(attempts.items())]

    def part_files(self, table: str, part: str) -> list[str]:
        """Folders that hold the rows of one part."""
        return [f"{self._folder(table, v)}/{name}/{attempt}" for v, name, attempt in self._parts(table) if name == part]


def merge_into(spark: SparkSession, target: str, batch: DataFrame, keys: Sequence[str]) -> None:
    """Upsert into a catalog table whose format supports MERGE."""
    view = "reviewloom_merge_batch"
    batch.createOrReplaceTempView(view)
    match = " AND ".join(f"t.{k} <=> s.{k}" for k in keys)
    spark.sql(
        f"MERGE INTO {target} t USING {view} s ON {match} "
        "WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *"
    )
