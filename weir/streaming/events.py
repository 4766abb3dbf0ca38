"""The event log as a stream: late and future data, counts by window, pairing of dials and calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The Parquet files of a folder as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def plausible(events: DataFrame, now: str) -> DataFrame:
    """Events from 2015 to a day ahead; dropped before the watermark, as one future event would make all others late."""
    return events.filter((F.col("ts") >= F.lit("2015-01-01").cast("timestamp")) & (F.col("ts") <= F.lit(now).cast("timestamp") + F.expr("interval 1 day")))


def watermarked(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events with the bound on lateness that the operators below need; a stream has one."""
    return events.withWatermark("ts", late)


def once(events: DataFrame) -> DataFrame:
    """Each event of a watermarked stream once, however often it was delivered within the bound."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, about_users): counts by tumbling or sliding window; weeks start on Monday.

    Distinct users are a sketch, about 5 % off, as a stream can't keep all of them for as long as its windows are open.
    """
    start = "4 days" if size == "7 days" else "0 seconds"
    window = F.window("ts", size, slide or size, start)
    counted = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("about_users"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "about_users")


def paired_calls(events: DataFrame, minutes: int = 30) -> DataFrame:
    """(user_id, ts): calls ('view') that aren't the first within `minutes` of the person's last dial ('click').

    State is one timestamp a person; it goes when the watermark has passed the dial by the limit. Events of a person are
    taken in order within a micro-batch; one that arrives in a later batch than its successor is judged by what came first.
    """
    limit = pd.Timedelta(minutes=minutes)

    def pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        dialed = pd.Timestamp(state.get[0], unit="us") if state.exists and state.get[0] is not None else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        kept = []
        for at, kind in zip(rows["ts"], rows["event_type"]):
            if kind == "click":
                dialed = at
            elif kind == "view":
                if dialed is None or at - dialed > limit:
                    kept.append(at)
                dialed = None
        if dialed is not None:
            state.update((int(dialed.value // 1000),))
            state.setTimeoutTimestamp(int((dialed + limit).value // 1_000_000) + 1 if (dialed + limit).value // 1_000_000 > state.getCurrentWatermarkMs() else state.getCurrentWatermarkMs() + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"user_id": [key[0]] * len(kept), "ts": kept})

    return events.groupBy("user_id").applyInPandasWithState(pair, "user_id bigint, ts timestamp", "dialed bigint", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_each_batch(path: str, keys: list[str], order: str, buckets: int = 64):
    """For foreachBatch: merges a batch into the latest rows of path, of which it rewrites the buckets of its keys only.

    The newest row of a key by `order` stays, so that a batch that is run again, also after it broke off, changes nothing.
    What a batch makes is written beside the table first, and then put in the place of its buckets. path holds nothing else.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/table")
        if table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(table):
            kept = spark.read.schema(rows.schema).parquet(f"{path}/table").filter(F.col("bucket").isin(touched))
            rows = kept.select(*rows.columns).unionByName(rows)
        cols = [c for c in rows.columns if c not in (*keys, "bucket")]
        best = rows.groupBy("bucket", *keys).agg(F.max(F.struct(order, *[c for c in cols if c != order])).alias("r"))
        new = best.select(*keys, *[F.col(f"r.{c}") for c in cols], "bucket").select(*rows.columns)
        new.write.mode("overwrite").parquet(f"{path}/next")
        made = spark.read.schema(new.schema).parquet(f"{path}/next")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/table")

    return upsert
