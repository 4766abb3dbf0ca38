"""Full history of changing attributes: insert-only satellites, and the validity periods as a view over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAST, SLOW, SEEN = "fast", "slow", "seen"
OPEN_END = "9999-12-31"


def change_rates(changes: DataFrame, *, key: str, attribute: str, fast_from: float = 1.5) -> DataFrame:
    """(attribute, reports, keys, satellite): attributes reported at least fast_from times a key go to the fast satellite.

    One row for each attribute of the schema. Distinct keys are counted exactly, as a rate may lie on the limit; a null
    key is none. The satellite only decides where rows are stored, never what the history says.
    """
    rate = F.col("reports") / F.greatest(F.col("keys"), F.lit(1))
    return (
        changes.filter(F.col(attribute).isNotNull())
        .groupBy(attribute)
        .agg(F.count("*").alias("reports"), F.count_distinct(key).alias("keys"))
        .withColumn("satellite", F.when(rate >= fast_from, FAST).otherwise(SLOW))
    )


class Satellites:
    """Insert-only satellites under a folder that all executors share, and the history as a view over them.

    A load appends; what is stored is never updated. The fast and the slow satellite hold the rows (k, a, on, at, h, v):
    a key's attribute, the date on which a value takes effect, the order of its report, and hash and value. A row is only
    appended where the hash differs from the one before it by date. Reports that repeat it leave their order and hash, without
    the value, in a third table (seen): a later load may bring another value for a date in between, or correct the one
    before, and then what they repeated is a version after all. So batches may come in any order and give what one would.

    A null value is a value of its own. Of several reports of a key, attribute and date the one last by `order` counts.
    Reports without key, attribute or date are left out. Exact repetitions change nothing, nor does loading a batch again.
    """

    def __init__(self, spark: SparkSession, folder: str, rates: DataFrame, *, key: str, attribute: str, effective: str, order: list[str]):
        """rates: the satellite of each attribute, as of change_rates; attributes that it lacks go to the slow one."""
        self.spark, self.folder, self.names, self.order = spark, folder, (key, attribute, effective), order
        self.rates = rates.select(F.col(attribute).alias("a"), "satellite")
        self.loads = 0
        self.schema = None

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder).filter(F.col("load") < self.loads)

    def load(self, reports: DataFrame, value: Column) -> None:
        """Appends what a batch of reports changes. Only the stored rows of its own keys and attributes are read along.

        A batch's reports are reduced to one a date by an aggregate before rows of a key and attribute meet, so that those are
        bounded by the number of dates, even where one key holds a third of all rows.
        """
        key, attribute, effective = self.names
        at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(self.order)])
        rows = reports.select(F.col(key).alias("k"), F.col(attribute).alias("a"), F.col(effective).alias("on"), at.alias("at"), value.alias("v"))
        rows = rows.filter("k is not null and a is not null and on is not null").withColumn("h", F.xxhash64(F.col("v").isNull(), "v"))
        states = rows.groupBy("k", "a", "on").agg(F.max(F.struct("at", "h", "v")).alias("w"))
        states = states.select("k", "a", "on", F.lit(False).alias("old"), "w.at", "w.h", "w.v", F.lit(None).cast("bigint").alias("told"))
        if self.loads:
            stored = self._stored()
            known = stored.join(states.select("k", "a").distinct(), ["k", "a"], "left_semi")
            kept = known.select("k", "a", "on", F.lit(True).alias("old"), "at", "h", "v", F.when(F.col("satellite") != SEEN, F.col("h")).alias("told"))
            both = states.unionByName(kept).repartition("k", "a").withColumn("v", F.max("v").over(Window.partitionBy("k", "a", "h")))
            # the winner of each date, and the hash that the view shows there so far
            told = F.max(F.when(F.col("told").isNotNull(), F.struct("at", "told"))).alias("told")
            states = both.groupBy("k", "a", "on").agg(F.max(F.struct("at", "h", "old", "v")).alias("w"), told).select("k", "a", "on", "w.old", "w.at", "w.h", "w.v", "told.told")
        before = F.lag("h").over(Window.partitionBy("k", "a").orderBy("on"))
        changes = F.when(F.col("told").isNull(), F.coalesce(before != F.col("h"), F.lit(True))).otherwise(F.col("told") != F.col("h"))
        marked = states.withColumn("changes", changes).filter("changes or not old").join(self.rates, "a", "left")
        satellite = F.when(F.col("changes"), F.coalesce("satellite", F.lit(SLOW))).otherwise(SEEN)
        out = marked.select("k", "a", "on", "at", "h", F.when(F.col("changes"), F.col("v")).alias("v"), satellite.alias("satellite"))
        out.write.partitionBy("satellite").parquet(f"{self.folder}/load={self.loads}")
        self.schema = out.schema.add("load", T.IntegerType())
        self.loads += 1

    def view(self, open_end: str = OPEN_END) -> DataFrame:
        """(key, attribute, value, satellite, valid_from, valid_to): a row for each version, which ends (exclusively) where the next starts.

        Rows that a later load made repeat the one before them, or corrected, are passed over here, not deleted. Nothing
        loaded gives no rows.
        """
        if not self.loads:
            raise ValueError("nothing was loaded")
        key, attribute, _ = self.names
        rows = self._stored().filter(F.col("satellite") != SEEN).repartition("k", "a")
        dated = rows.groupBy("k", "a", "on").agg(F.max(F.struct("at", "h", "v", "satellite")).alias("w")).select("k", "a", "on", "w.h", "w.v", "w.satellite")
        by = Window.partitionBy("k", "a").orderBy("on")
        versions = dated.withColumn("before", F.lag("h").over(by)).filter("before is null or before != h")
        ends = F.coalesce(F.lead("on").over(by), F.lit(open_end))
        return versions.select(F.col("k").alias(key), F.col("a").alias(attribute), F.col("v").alias("value"), "satellite", F.col("on").alias("valid_from"), ends.alias("valid_to"))
