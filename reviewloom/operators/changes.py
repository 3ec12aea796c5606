"""Which branches have changed since a stage last ran, from order-free digests of their rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StructField, StructType

from reviewloom.operators.dedupe import null_safe
from reviewloom.session import land, remove_folder

DIGESTS = StructType(
    [
        StructField("branch_id", LongType()),
        StructField("rows", LongType()),
        StructField("hash_sum", DecimalType(38, 0)),
        StructField("hash_xor", LongType()),
    ]
)


def branch_digests(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``branch_id, rows, hash_sum, hash_xor``: equal for equal multisets of rows, in whatever order they come.

    The exclusive or alone would not see a row that comes twice more; the sum,
    kept exactly, and the number of rows do.  Nulls and empty texts differ.
    """
    columns = list(columns or (c for c in rows.columns if c != "branch_id"))
    # a null leaves a hash as it is, so which columns are null is hashed too
    nulls = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns))
    hashed = rows.select(F.col("branch_id").cast("long").alias("branch_id"), F.xxhash64(nulls, *columns).alias("h"))
    return hashed.groupBy("branch_id").agg(
        F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(20,0)")).cast("decimal(38,0)").alias("hash_sum"), F.bit_xor("h").alias("hash_xor")
    )


def changed_branches(now: DataFrame, before: DataFrame) -> DataFrame:
    """``branch_id, change``: ``new``, ``changed`` or ``gone``; branches with equal digests are left out."""
    same = ["branch_id", "rows", "hash_sum", "hash_xor"]
    moved = null_safe(now, before, same, "left_anti").select("branch_id")
    known = null_safe(moved, before, ["branch_id"], "left_semi").withColumn("change", F.lit("changed"))
    new = null_safe(moved, before, ["branch_id"], "left_anti").withColumn("change", F.lit("new"))
    gone = null_safe(before, now, ["branch_id"], "left_anti").select("branch_id", F.lit("gone").alias("change"))
    return known.unionByName(new).unionByName(gone)


class StageDigests:
    """The digests a stage has worked on, in a folder of its own below ``path``.

    Each run of a stage writes a numbered version; the newest complete one
    counts, so a stage that fails is simply run again.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, stage: str) -> list[int]:
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{stage}/v*/_SUCCESS")
        marks = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return sorted(int(mark.getPath().getParent().getName()[1:]) for mark in marks)

    def read(self, stage: str) -> DataFrame:
        versions = self._versions(stage)
        if not versions:
            return self.spark.createDataFrame([], DIGESTS)
        return self.spark.read.schema(DIGESTS).parquet(f"{self.path}/{stage}/v{versions[-1]}")

    def write(self, stage: str, digests: DataFrame) -> None:
        versions = self._versions(stage)
        new = versions[-1] + 1 if versions else 1
        digests.select(*(F.col(f.name).cast(f.dataType) for f in DIGESTS)).write.mode("overwrite").parquet(f"{self.path}/{stage}/v{new}")
        for old in versions[:-1]:
            remove_folder(self.spark, f"{self.path}/{stage}/v{old}")

    def run(self, stage: str, rows: DataFrame, work: Callable[[DataFrame, DataFrame], None], columns: Sequence[str] | None = None) -> DataFrame:
        """Hand the rows of changed branches, and the branches that are gone, to ``work``; returns the changes.

        The digests are written after the work is done: a run that fails is not
        remembered, and ``work`` has to bear being given the same rows again.
        """
        now = land(branch_digests(rows, columns), "digests")
        changes = land(changed_branches(now, self.read(stage)), "changes")
        if not changes.isEmpty():
            moved = changes.filter("change <> 'gone'")
            work(null_safe(rows, moved, ["branch_id"], "left_semi"), changes.filter("change = 'gone'").select("branch_id"))
            self.write(stage, now)
        return changes
