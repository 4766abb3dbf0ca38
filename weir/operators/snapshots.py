"""What changed between consecutive full deliveries of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(measures: Sequence[str], decimals: int) -> Column:
    """Hash of the rounded measures. A null hashes unlike any number, and -0.0 like 0.0."""
    parts: list[Column] = []
    for name in measures:
        value = F.round(F.col(name).cast("double"), decimals) + F.lit(0.0)
        parts += [value.isNull(), F.coalesce(value, F.lit(0.0))]
    return F.xxhash64(*parts)


def delivery_chain(deliveries: DataFrame, run: str, version: str) -> DataFrame:
    """(run, prior, later): the deliveries in order of version, ties by run; deliveries has one row for each run.

    The list of runs is small by nature (one row for each delivery ever made), so that one window over it is fine.
    """
    order = Window.orderBy(version, run)
    return deliveries.select(F.col(run).alias("run"), F.lag(run).over(order).alias("prior"), F.lead(run).over(order).alias("later"))


def snapshot_changes(
    snapshots: DataFrame,
    deliveries: DataFrame,
    *,
    key: str,
    measures: Sequence[str],
    run: str,
    run_id: str,
    version: str,
    latest: str,
    decimals: int = 2,
) -> DataFrame:
    """(run, key, change): the keys added, removed or changed in each delivery but the first.

    Every row is tagged once as the new side of its own delivery and once as the old side of the next; one aggregation
    by (delivery, key) then holds both sides, and their row hashes classify the key. No delivery is joined with another.
    A key that holds a third of all rows shrinks to one state for each task before the shuffle.

    Nulls: rows without a key or of a run that isn't listed are left out; a null measure differs from any number.
    Of several rows of a run and key the latest counts, of equally late ones the one with the largest hash, so that
    exact repetitions change nothing. A listed delivery without rows removes every key. Empty tables give no rows.
    """
    chain = delivery_chain(deliveries, run_id, version)
    rows = snapshots.select(
        F.col(run).alias("run"), F.trim(F.col(key).cast("string")).alias("__key"), F.col(latest).alias("__at"), row_hash(measures, decimals).alias("__hash")
    ).filter("__key is not null and __key != ''")
    tagged = rows.join(chain, "run").select(
        F.explode(
            F.array(
                F.struct(F.when(F.col("prior").isNotNull(), F.col("run")).alias("of"), F.lit(True).alias("new")),
                F.struct(F.col("later").alias("of"), F.lit(False).alias("new")),
            )
        ).alias("side"),
        "__key",
        F.struct("__at", "__hash").alias("state"),
    )
    sides = (
        tagged.filter("side.of is not null")
        .groupBy(F.col("side.of").alias(run), F.col("__key").alias(key))
        .agg(F.max(F.when(F.col("side.new"), F.col("state"))).alias("new"), F.max(F.when(~F.col("side.new"), F.col("state"))).alias("old"))
    )
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("new.__hash") != F.col("old.__hash"), "changed")
    )
    return sides.select(run, key, change.alias("change")).filter("change is not null")
