"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage here. A written Parquet table survives the loss of any executor, is computed
once (a checkpoint of the same plan runs its last stage twice) and can be dropped as soon as the next one exists.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a folder of our own, which only a local master may use."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL_ROOTS.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="weir-"))


class Scratch:
    """The tables of one run of an operator; what is left of them goes when the application ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/weir-{label}-{uuid.uuid4().hex[:12]}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path)
        self._fs.deleteOnExit(self._path)
        self._count = 0

    def keep(self, df: DataFrame, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Writes df and returns the written table, under the same schema."""
        self._count += 1
        at = f"{self.path}/{self._count}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(at)
        kept = self.spark.read.schema(df.schema).parquet(at)
        kept._weir_path = at  # noqa: SLF001
        return kept

    def keep_counted(self, df: DataFrame, of: Column | None = None) -> tuple[DataFrame, int]:
        """keep(), and how many rows there are (of which `of` holds), counted by the tasks that write them."""
        seen = Observation()
        kept = self.keep(df.observe(seen, F.count_if(F.lit(True) if of is None else of).alias("n")))
        return kept, seen.get["n"]

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables of keep() that nothing reads any more."""
        for table in tables:
            at = getattr(table, "_weir_path", None)
            if at:
                self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at), True)
