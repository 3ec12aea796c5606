"""Review tables in folders by a hash of their branch, so that a batch reads and writes its own buckets only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from reviewloom.functions.text import text_key
from reviewloom.operators.dedupe import keep_first, null_safe
from reviewloom.operators.upsert import upsert
from reviewloom.session import land

BUCKET, KEY = "bucket", "text_key"


class BucketTable:
    """One table below ``path``, in ``buckets`` folders by the hash of ``branch_id``.

    A batch's buckets are known before the table is opened, so the scan is cut
    down to their folders and only these are written again (dynamic partition
    overwrite).  New contents are written aside first: a job that fails leaves
    the table as it was, and applying a batch twice changes nothing.  Hash of
    the text and bucket are stored columns; nothing stored is hashed again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = 256, text_col: str | None = None) -> None:
        self.spark, self.path, self.buckets, self.text_col = spark, path.rstrip("/"), buckets, text_col
        extra = [StructField(KEY, StringType())] if text_col else []
        self.columns = [f.name for f in schema]
        self.schema = StructType([*schema.fields, *extra, StructField(BUCKET, IntegerType())])

    def bucket_of(self, branch: Column) -> Column:
        return F.pmod(F.xxhash64(branch.cast("long")), F.lit(self.buckets)).cast("int")

    def shaped(self, rows: DataFrame) -> DataFrame:
        """Rows with the table's columns and types, the hash of their text and their bucket."""
        made = rows.withColumn(BUCKET, self.bucket_of(F.col("branch_id")))
        if self.text_col:
            made = made.withColumn(KEY, text_key(F.col(self.text_col)))
        return made.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))

    def exists(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def stored(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows with hash and bucket, of the given buckets or of all; none before the first write."""
        if not self.exists():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows if buckets is None else rows.filter(F.col(BUCKET).isin(list(buckets)))

    def read(self) -> DataFrame:
        return self.stored().select(*self.columns)

    def touched(self, shaped: DataFrame) -> list[int]:
        """The buckets of a batch: at most ``buckets`` numbers."""
        return sorted(r[0] for r in shaped.select(BUCKET).distinct().collect())

    def upsert(self, batch: DataFrame, keys: Sequence[str], latest_last: Sequence[str | Column]) -> list[int]:
        """Put the batch's rows in place of those with the same key in the same bucket; returns the buckets written.

        The keys decide within a branch, so ``branch_id`` is always one of them.
        """
        shaped = land(self.shaped(batch), "bucket-batch")
        touched = self.touched(shaped)
        if touched:
            self._write(upsert(self.stored(touched), shaped, ["branch_id", *(k for k in keys if k != "branch_id")], latest_last))
        return touched

    def insert_absent(self, batch: DataFrame, order: Sequence[str | Column]) -> DataFrame:
        """Append rows whose branch and text are not stored yet, each once, and return them.

        Null branches and null texts are values like any other.
        """
        shaped = land(self.shaped(batch), "bucket-batch", "zstd")
        known = self.stored(self.touched(shaped)).select("branch_id", KEY)
        # stored rows go first, so that only new ones are moved again
        fresh = null_safe(shaped, known, ["branch_id", KEY], "left_anti")
        added = land(keep_first(fresh, ["branch_id", KEY], order), "bucket-added", "zstd")
        if not added.isEmpty():
            self._save(added, "append")
        return added.select(*self.columns)

    def delete(self, branches: DataFrame) -> list[int]:
        """Take the rows of the named branches out; returns the buckets written."""
        gone = land(branches.select(F.col("branch_id").cast("long").alias("branch_id")).distinct().withColumn(BUCKET, self.bucket_of(F.col("branch_id"))), "gone")
        touched = self.touched(gone)
        kept = land(null_safe(self.stored(touched), gone, ["branch_id"], "left_anti"), "bucket-kept")
        left = set(self.touched(kept))
        self._save(kept, "overwrite")
        for empty in set(touched) - left:
            # a bucket without rows is not among the folders that are overwritten
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={empty}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return touched

    def _write(self, rows: DataFrame) -> None:
        self._save(land(rows.select(*self.schema.names), "bucket-rows"), "overwrite")

    def _save(self, rows: DataFrame, mode: str) -> None:
        # rebalanced by bucket: one file for a small bucket, several tasks for a very large one
        rows.hint("rebalance", BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
