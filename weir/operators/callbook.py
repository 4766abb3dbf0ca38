"""A phone system's export: which rows are fit to keep, and what they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.calls import answered, call_time, duration_seconds
from weir.functions.text import clean_text, national_number
from weir.operators.apply import first_failing

KEY = ["agent", "phone", "called_at"]


def read_calls(df: DataFrame, now: Column) -> DataFrame:
    """Rows (agent, phone, called_at, seconds, result, reason) of raw texts (phone, at, length, agent, result).

    reason is null where a row is fit; else it has no valid number, no valid time, or one before 2015 or over a day ahead.
    """
    seconds = duration_seconds(F.col("length"))
    rows = df.select(
        F.coalesce(F.left(clean_text(F.col("agent")), F.lit(80)), F.lit("")).alias("agent"), national_number(F.col("phone")).alias("phone"), call_time(F.col("at")).alias("called_at"),
        F.when(seconds.between(0, 86400), seconds).alias("seconds"), F.left(clean_text(F.col("result")), F.lit(40)).alias("result"),
    )
    out_of_range = (F.col("called_at") > now + F.expr("interval 1 day")) | (F.col("called_at") < F.lit("2015-01-01").cast("timestamp_ntz"))
    return rows.withColumn("reason", first_failing([("no valid phone number", F.col("phone").isNull()), ("no valid date", F.col("called_at").isNull()), ("date out of range", out_of_range)]))


def new_calls(calls: DataFrame, stored: DataFrame) -> DataFrame:
    """The fit rows of read_calls that aren't stored yet, each (agent, phone, time) once; of several the longest stays."""
    one = calls.filter("reason is null").groupBy(*KEY).agg(F.max(F.struct("seconds", "result")).alias("c")).select(*KEY, "c.seconds", "c.result")
    return one.join(stored.select(*KEY), KEY, "left_anti")


def call_totals(calls: DataFrame, by: Column | str) -> DataFrame:
    """(by, calls, answered, talk_minutes): calls by anything, those that a person answered, and how long these took."""
    picked = answered(F.col("seconds"), F.col("result"))
    named = by if isinstance(by, Column) else F.col(by)
    return calls.groupBy(named).agg(F.count("*").alias("calls"), F.count_if(picked).alias("answered"), F.floor(F.coalesce(F.sum(F.when(picked, F.col("seconds"))), F.lit(0)) / 60 + 0.5).alias("talk_minutes"))
