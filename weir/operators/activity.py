"""Call-log and event analytics as windows and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A log line, and the starts of lines that aren't calls.
LINE = r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2})(?: — (.+?))?: (.*)$"
KINDS = [("booked", "^meeting booked"), ("held", "^meeting held"), ("noShow", "^meeting no-show"), ("cancelled", "^meeting cancelled"), ("import", "^(imported from|reassigned by|disconnected by)"), ("dial", r"^dialed\b")]


def note_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, at, author, note, kind): the lines of a log that read 'YYYY-MM-DD HH:MM[ — author]: text'; others are left out.

    line counts from 0 over all lines. Times that don't exist give a null `at`. A null log has no lines.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw")).filter(F.col("raw").rlike(LINE))
    part = lambda i: F.regexp_extract("raw", LINE, i)
    note = F.trim(part(4))
    kind = F.lit("call")
    for name, pattern in reversed(KINDS):
        kind = F.when(F.lower(note).rlike(pattern), name).otherwise(kind)
    at = F.try_to_timestamp(F.concat_ws(" ", part(1), part(2)), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    return lines.select(key, "line", at.alias("at"), F.nullif(F.trim(part(3)), F.lit("")).alias("author"), note.alias("note"), kind.alias("kind"))


def calls_once(df: DataFrame, who: Sequence[str], at: str, tie: str, is_dial: Column, is_call: Column, minutes: int = 30) -> DataFrame:
    """df without the first call after a dial of the same person within `minutes`: both are one call.

    Dials number the stretches between them; within a stretch only its first call can belong to the dial. Windows over
    `who` replace the loop over events; ties in time go by `tie`.
    """
    order = Window.partitionBy(*who).orderBy(at, tie)
    counted = df.withColumn("__dials", F.sum(F.when(is_dial, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = Window.partitionBy(*who, "__dials").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    dialed = counted.withColumn("__dialed", F.max(F.when(is_dial, F.col(at))).over(stretch)).withColumn("__calls", F.sum(F.when(is_call, 1).otherwise(0)).over(stretch))
    same = is_call & (F.col("__dials") > 0) & (F.col("__calls") == 1) & (F.col(at) <= F.col("__dialed") + F.expr(f"interval {minutes} minutes"))
    return dialed.filter(~F.coalesce(same, F.lit(False))).drop("__dials", "__dialed", "__calls")


def time_grid(df: DataFrame, at: str, answered: Column, least: int = 4) -> DataFrame:
    """(weekday, hour, calls, answered, rate) of cells with at least `least` calls; Monday is 0; the rate is (answered + 1) / (calls + 2)."""
    cell = df.groupBy(F.weekday(at).alias("weekday"), F.hour(at).alias("hour")).agg(F.count("*").alias("calls"), F.count_if(answered).alias("answered"))
    return cell.filter(F.col("calls") >= least).withColumn("rate", (F.col("answered") + 1) / (F.col("calls") + 2))


def daily_series(df: DataFrame, at: str, measures: dict[str, Column], step: str = "day") -> DataFrame:
    """(period, measures): a row for each day, week (from Monday) or month from the first to the last, zero where nothing happened."""
    period = lambda c: F.date_trunc(step, c).cast("date")
    found = df.groupBy(period(F.col(at)).alias("period")).agg(*[m.alias(n) for n, m in measures.items()])
    ends = df.agg(period(F.min(at)).alias("a"), period(F.max(at)).alias("b"))
    days = ends.select(F.explode(F.expr(f"sequence(a, b, interval 1 {step})")).alias("period"))
    return days.join(found, "period", "left").fillna(0, subset=list(measures))


def streaks(df: DataFrame, who: str, at: str) -> DataFrame:
    """(who, first_day, last_day, days): the runs of consecutive days on which someone did something."""
    days = df.select(who, F.to_date(at).alias("d")).dropna().distinct()
    island = F.date_sub("d", F.row_number().over(Window.partitionBy(who).orderBy("d")))
    return days.withColumn("island", island).groupBy(who, "island").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("days")).drop("island")


def nearest_rank(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, one column for each share): the value at index min(n - 1, floor(share * n)) of the sorted values, without interpolation.

    Ranks come from the running count of each distinct value, so that what is sorted in one place are distinct values.
    """
    distinct = df.select(by, value).dropna(subset=[value]).groupBy(by, value).agg(F.count("*").alias("c"))
    up_to = F.sum("c").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("c").over(Window.partitionBy(by))
    ranked = distinct.withColumn("hi", up_to).withColumn("n", total)
    at = lambda q: F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n")))
    return ranked.groupBy(by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("hi") > at(q), F.col(value))).alias(name) for name, q in shares.items()])


def two_weeks(df: DataFrame, by: str, at: str, now: str) -> DataFrame:
    """(by, this_week, last_week, change_pct): events of the last seven days against the seven before; no percentage from zero."""
    end = F.lit(now).cast("timestamp_ntz")
    week, before = end - F.expr("interval 7 days"), end - F.expr("interval 14 days")
    t = F.col(at)
    counted = df.filter((t > before) & (t <= end)).groupBy(by).agg(F.count_if(t > week).alias("this_week"), F.count_if(t <= week).alias("last_week"))
    return counted.withColumn("change_pct", F.when(F.col("last_week") > 0, F.floor(100.0 * (F.col("this_week") - F.col("last_week")) / F.col("last_week") + 0.5)))


def top_with_other(df: DataFrame, by: str, amount: Column, top: int = 5, decimals: int = 2) -> DataFrame:
    """(label, amount, share): the largest groups, and the sum of the rounded rest as Other; ties go by label.

    The largest come from a top-k and the rest from an aggregate, so that any number of groups will do.
    """
    groups = df.groupBy(F.col(by).alias("label")).agg(F.round(F.sum(amount), decimals).cast("double").alias("amount"))
    largest = groups.orderBy(F.desc("amount"), "label").limit(top)
    rest = groups.join(largest.select(F.col("label").alias("__top")), F.col("label").eqNullSafe(F.col("__top")), "left_anti").agg(F.lit("Other").alias("label"), F.round(F.sum("amount"), decimals).alias("amount")).filter("amount is not null")
    folded = largest.unionByName(rest)  # at most top + 1 rows
    return folded.withColumn("share", F.round(F.col("amount") / F.sum("amount").over(Window.partitionBy()), 4))


def year_trend(df: DataFrame, by: str, at: str, amount: Column, up: float = 0.1, down: float = -0.2) -> DataFrame:
    """(by, year, amount, trend): each year against the group's year before: new, up, down or flat."""
    years = df.groupBy(by, F.year(at).alias("year")).agg(F.round(F.sum(amount), 2).alias("amount"))
    before = F.lag("amount").over(Window.partitionBy(by).orderBy("year"))
    change = (F.col("amount") - before) / before
    return years.withColumn("trend", F.when(before.isNull() | (before == 0), "new").when(change >= up, "up").when(change <= down, "down").otherwise("flat"))


def year_kinds(df: DataFrame, by: str, at: str, amount: Column, last: int, up: float = 0.1, down: float = -0.2) -> DataFrame:
    """(by, years, kind) of each group up to the year `last`: single, stopped (nothing in it), new, up, down or flat against the year before."""
    years = df.filter(F.year(at) <= last).groupBy(by, F.year(at).alias("year")).agg(F.sum(amount).alias("amount"))
    of = lambda y: F.coalesce(F.max(F.when(F.col("year") == y, F.col("amount"))), F.lit(0))
    both = years.groupBy(by).agg(F.count("*").alias("years"), of(last).cast("double").alias("now"), of(last - 1).cast("double").alias("before"))
    change = (F.col("now") - F.col("before")) / F.col("before")
    kind = F.when(F.col("now") == 0, "stopped").when(F.col("years") == 1, "single").when(F.col("before") == 0, "new").when(change >= up, "up").when(change <= down, "down").otherwise("flat")
    return both.select(by, "years", kind.alias("kind"))


def funnel(df: DataFrame, who: str, stage: Column, stages: Sequence[str]) -> DataFrame:
    """(stage, reached, of_previous): how many reached each stage; a later stage implies the ones before."""
    level = F.lit(None).cast("int")
    for i, name in enumerate(stages):
        level = F.when(stage == name, i).otherwise(level)
    furthest = df.groupBy(who).agg(F.max(level).alias("level")).dropna(subset=["level"])
    one = furthest.agg(*[F.count_if(F.col("level") >= i).alias(f"s{i}") for i in range(len(stages))])
    rows = [
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.col(f"s{i}").alias("reached"), (F.when(F.col(f"s{i - 1}") > 0, F.round(F.col(f"s{i}") / F.col(f"s{i - 1}"), 4)) if i else F.lit(None).cast("double")).alias("of_previous"))
        for i, name in enumerate(stages)
    ]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def sessions(df: DataFrame, who: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """(who, start, end, events): activity without a pause as long as the gap."""
    found = df.groupBy(who, F.session_window(F.col(at).cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("events"))
    return found.select(who, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "events")
