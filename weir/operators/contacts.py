"""Who was last in touch with whom, how fast and how often in vain, and what the answers have in common."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.operators.activity import streaks


def last_touch(sources: Mapping[str, DataFrame]) -> DataFrame:
    """(key, at, source): the newest time of each key over all sources of (key, at); of equal times the source that sorts first."""
    touches = [df.select("key", "at", F.lit(name).alias("source")) for name, df in sources.items()]
    newest = reduce(DataFrame.unionByName, touches).dropna().groupBy("key", "source").agg(F.max("at").alias("at"))  # a row for each source
    at = newest.groupBy("key").agg(F.max("at").alias("at"))
    return newest.join(at, ["key", "at"]).groupBy("key", "at").agg(F.min("source").alias("source"))


def current_streak(df: DataFrame, who: str, at: str, today: Column) -> DataFrame:
    """(who, days): consecutive days with something, up to today or yesterday; who has no such run has no row."""
    return streaks(df, who, at).filter(F.col("last_day").between(F.date_sub(today, 1), today)).select(who, "days")


def misses_in_a_row(df: DataFrame, who: str, at: str, tie: str, hit: Column, miss: Column) -> DataFrame:
    """(who, tries, last_at): the misses since someone's last hit, and when the newest was; who has none has no row.

    The last hit comes from an aggregate, so that someone with a third of all rows isn't one task.
    """
    rows = df.filter(hit | miss).select(who, F.struct(F.col(at).alias("at"), F.col(tie).alias("tie")).alias("when"), hit.alias("hit"))
    last = rows.filter("hit").groupBy(who).agg(F.max("when").alias("last_hit"))
    since = rows.join(last, who, "left").filter(~F.col("hit") & (F.col("last_hit").isNull() | (F.col("when") > F.col("last_hit"))))
    return since.groupBy(who).agg(F.count("*").alias("tries"), F.max("when")["at"].alias("last_at"))


def quiet(df: DataFrame, last: Column, now: Column, days: int, *, done: Column, ahead: Sequence[Column] = ()) -> DataFrame:
    """Rows with quiet_days, the whole days since `last`, where these are at least `days`; what is done or has a date ahead is left out."""
    waits = reduce(Column.__or__, [F.coalesce(a > now, F.lit(False)) for a in ahead], F.lit(False))
    since = F.floor((F.unix_timestamp(now) - F.unix_timestamp(last)) / 86400)
    return df.filter(~F.coalesce(done, F.lit(False)) & ~waits).withColumn("quiet_days", since).filter(F.col("quiet_days") >= days)


def first_response(starts: DataFrame, contacts: DataFrame, key: str, start: str, at: str) -> DataFrame:
    """(started, responded, median_hours, within_1d, within_3d) over all keys: hours from the start to the first contact.

    A key whose first contact lies before its start counts as started only.
    """
    first = contacts.groupBy(key).agg(F.min(at).alias("first"))
    hours = (F.unix_timestamp("first") - F.unix_timestamp(start)) / 3600
    rows = starts.select(key, start).join(first, key, "left").select(F.when(hours >= 0, hours).alias("h"))
    return rows.agg(
        F.count("*").alias("started"), F.count("h").alias("responded"), F.round(F.percentile("h", F.lit(0.5)), 1).alias("median_hours"), F.count_if(F.col("h") <= 24).alias("within_1d"), F.count_if(F.col("h") <= 72).alias("within_3d")
    )


def counts_by_label(df: DataFrame, label: Column, default: str, top: int | None = None) -> DataFrame:
    """(label, n): how many rows have each label, the default where there is none; with top the most frequent ones, ties by label."""
    found = df.groupBy(F.coalesce(F.nullif(F.trim(label), F.lit("")), F.lit(default)).alias("label")).agg(F.count("*").alias("n"))
    return found if top is None else found.orderBy(F.desc("n"), "label").limit(top)


def spelling_groups(df: DataFrame, key: Column, name: str, reason: str, reasons: int = 2) -> DataFrame:
    """(key, name, n, reasons): rows by a loose key, with the spelling most in use and the most frequent reasons.

    Of equally frequent spellings the longest, then the first by code point stays; reasons read 'reason:count', ties by text.
    Every step counts distinct values, so that a frequent key combines before it is shuffled.
    """
    rows = df.select(key.alias("key"), F.col(name).alias("name"), F.col(reason).alias("reason")).filter("key is not null and name is not null")
    spelled = rows.groupBy("key", "name").agg(F.count("*").alias("c"))
    best = spelled.groupBy("key").agg(F.sum("c").alias("n"), F.min(F.struct(-F.col("c"), -F.length("name"), F.col("name").alias("name")))["name"].alias("name"))
    told = rows.filter("reason is not null").groupBy("key", "reason").agg(F.count("*").alias("c"))
    ranked = told.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("c"), "reason"))).filter(F.col("r") <= reasons)
    listed = ranked.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "reason", "c"))), lambda x: F.concat_ws(":", x["reason"], x["c"])), ", ").alias("reasons"))
    return best.join(listed, "key", "left").select("key", "name", "n", "reasons")


def patterns(df: DataFrame, scope: str, label: str, least: int = 3, top: int = 3) -> DataFrame:
    """(scope, rows, label, n): the most frequent labels of each scope that has at least `least` rows; ties by label."""
    sizes = df.groupBy(scope).agg(F.count("*").alias("rows")).filter(F.col("rows") >= least)
    counted = df.dropna(subset=[scope, label]).groupBy(scope, label).agg(F.count("*").alias("n"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("n"), label))).filter(F.col("r") <= top).drop("r")
    return sizes.join(best, scope).select(scope, "rows", label, "n")


def group_kinds(df: DataFrame, group: str, name: str, official: str, share: float = 0.6, big: int = 12) -> DataFrame:
    """(group, members, names, kind, title, is_big): what the members of a group have in common.

    'name' if all have one name key, else 'official' if at least the share has the same official, else 'mixed'; the title is
    the most frequent name, or official, the first by code point among equals. Nulls are no name and no official.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("members"))

    def most(value: str) -> DataFrame:
        counted = df.dropna(subset=[value]).groupBy(group, value).agg(F.count("*").alias("c"))
        return counted.groupBy(group).agg(F.count("*").alias(f"{value}_n"), F.min(F.struct((-F.col("c")).alias("c"), F.col(value).alias("v"))).alias(f"{value}_top"))

    joined = sizes.join(most(name), group, "left").join(most(official), group, "left")
    names = F.coalesce(f"{name}_n", F.lit(0))
    together = -F.col(f"{official}_top.c") / F.col("members")
    kind = F.when(names == 1, "name").when(together >= share, "official").otherwise("mixed")
    title = F.when(kind == "official", F.col(f"{official}_top.v")).otherwise(F.col(f"{name}_top.v"))
    return joined.select(group, "members", names.alias("names"), kind.alias("kind"), title.alias("title"), ((F.col("members") >= big) | (names >= 3)).alias("is_big"))


def quota_page(df: DataFrame, variant: str, order: Sequence[Column], limit: int) -> DataFrame:
    """The first `limit` rows taken from the variants in turn: the first of each, then the second of each, and so on.

    Only the first `limit` rows of a variant can be on the page, which Spark cuts in each task before the shuffle.
    """
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(variant).orderBy(*order))).filter(F.col("turn") <= limit)
    return ranked.orderBy("turn", variant).limit(limit)


def sample_rows(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows at random, the same for the same seed whatever the partitions: those of the least MD5 of seed and key."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def capped_lists(df: DataFrame, lists: Mapping[str, tuple[Column, Sequence[Column], int]], columns: Sequence[str]) -> DataFrame:
    """(list, place, columns): for each named list the first rows that meet its condition, in its order, up to its cap.

    A row may be on several lists. Each is a top-k, so that only cap rows of a task reach the final step.
    """
    out = []
    for name, (fits, order, cap) in lists.items():
        first = df.filter(fits).orderBy(*order).limit(cap)
        place = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order))  # of cap rows
        out.append(first.select(F.lit(name).alias("list"), place.alias("place"), *columns))
    return reduce(DataFrame.unionByName, out)


def best_of(df: DataFrame, by: str, id: str, facts: Sequence[tuple[Column, int]]) -> DataFrame:
    """(by, id, score): the row of each group with the largest sum of the points of the facts that hold; ties by id."""
    score = reduce(Column.__add__, [F.when(F.coalesce(fact, F.lit(False)), points).otherwise(0) for fact, points in facts])
    best = df.groupBy(by).agg(F.min(F.struct((-score).alias("s"), F.col(id).alias("id"))).alias("b"))
    return best.select(by, F.col("b.id").alias(id), (-F.col("b.s")).alias("score"))
