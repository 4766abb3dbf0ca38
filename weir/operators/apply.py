"""Applying a delivery to a live table: field history, classification and alerts, as functions of snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.functions.canonical import canonical_value


def canonical(field: str, value: Column) -> Column:
    return canonical_value(F.lit(field), value.cast("string"))


def compared(live: DataFrame, staged: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Both sides of every key in one full join: old_<field>, new_<field>, and which sides there are."""
    side = lambda df, name: df.select(key, F.lit(True).alias(f"in_{name}"), *[F.col(f).alias(f"{name}_{f}") for f in fields])
    return side(live, "old").join(side(staged, "new"), key, "full")


def classify(both: DataFrame, fields: Sequence[str], form: Callable[[str, Column], Column] = canonical) -> DataFrame:
    """compared() with `action`: inserted, updated, unchanged, or absent from the delivery. Null equals null only."""
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~form(f, F.col(f"old_{f}")).eqNullSafe(form(f, F.col(f"new_{f}")))
    action = F.when(F.col("in_old").isNull(), "inserted").when(F.col("in_new").isNull(), "absent").when(differs, "updated").otherwise("unchanged")
    return both.withColumn("action", action)


def field_history(both: DataFrame, key: str, fields: Sequence[str], form: Callable[[str, Column], Column] = canonical, *, first_fill: Sequence[str] = ()) -> DataFrame:
    """(key, field_name, old_value, new_value): a row for each field that an update changes, and `record_created` for an insert.

    A field of first_fill that had no value before changes nothing by getting one.
    """
    text = lambda c: F.col(c).cast("string")
    structs = [
        F.struct(F.lit(f).alias("field_name"), text(f"old_{f}").alias("old_value"), text(f"new_{f}").alias("new_value"), (~form(f, F.col(f"old_{f}")).eqNullSafe(form(f, F.col(f"new_{f}"))) & (F.col(f"old_{f}").isNotNull() | F.lit(f not in first_fill))).alias("differs"))
        for f in fields
    ]
    changed = both.filter("in_old and in_new").select(key, F.explode(F.array(*structs)).alias("c")).filter("c.differs")
    created = both.filter("in_old is null").select(key, F.lit("record_created").alias("field_name"), F.lit(None).cast("string").alias("old_value"), F.lit('{"present":true}').alias("new_value"))
    return changed.select(key, "c.field_name", "c.old_value", "c.new_value").unionByName(created)


def upserted(live: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """The table after the delivery: staged rows, and live ones that it doesn't mention."""
    return staged.select(*live.columns).unionByName(live.join(staged.select(key), key, "left_anti"))


def deactivated(live: DataFrame, notices: DataFrame, key: str, date: str) -> DataFrame:
    """live with status and date of the keys that a notice names; a notice never adds a record nor touches other fields."""
    told = notices.groupBy(key).agg(F.max(date).alias("__off"))
    gone = F.col("__off").isNotNull()
    joined = live.join(told, key, "left")
    return joined.withColumn("status", F.when(gone, "deactivated").otherwise(F.col("status"))).withColumn(date, F.coalesce("__off", date)).drop("__off").select(*live.columns)


def drops(both: DataFrame, key: str, field: str, below: float = 0.5) -> DataFrame:
    """(key, old, new, drop_pct): keys whose value fell under a share of the old one, which must be positive."""
    old, new = F.col(f"old_{field}"), F.coalesce(F.col(f"new_{field}"), F.lit(0.0))
    return both.filter("in_old and in_new").filter((old > 0) & (new < old * below)).select(key, old.alias("old"), new.alias("new"), F.round((1 - new / old) * 100, 1).alias("drop_pct"))


def compacted(history: DataFrame) -> DataFrame:
    """history as it is kept: of a created record only that it is there, of a change only its own field of a JSON record."""
    created = F.col("field_name") == "record_created"
    own = lambda c: F.when(F.col(c).startswith("{"), F.try_element_at(F.from_json(c, "map<string,string>"), F.col("field_name"))).otherwise(F.col(c))
    return history.withColumns({"old_value": F.when(~created, own("old_value")), "new_value": F.when(created, '{"present":true}').otherwise(own("new_value"))})


def applied(both: DataFrame, key: str, fields: Sequence[str], known: DataFrame, watched: DataFrame, alert: str, form: Callable[[str, Column], Column] = canonical, below: float = 0.5) -> DataFrame:
    """(action, n, alerts): what applying a delivery does: rows of keys that aren't known are skipped, absent ones stay.

    A watched key whose `alert` field falls under a share of its old value, which must be positive, raises one alert.
    """
    flags = classify(both, fields, form).filter("in_new").join(known.select(key, F.lit(True).alias("__known")).dropna().distinct(), key, "left").join(watched.select(key, F.lit(True).alias("__watched")).dropna().distinct(), key, "left")
    action = F.when(F.col("__known").isNull(), "skipped").otherwise(F.col("action"))
    old, new = F.col(f"old_{alert}"), F.coalesce(F.col(f"new_{alert}"), F.lit(0.0))
    drop = F.col("__known") & F.col("__watched") & (old > 0) & (new < old * below)
    return flags.groupBy(action.alias("action")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(drop, F.lit(False))).alias("alerts"))


def alerts(history: DataFrame, watched: DataFrame, key: str, run: str, escalating: Sequence[str]) -> DataFrame:
    """(key, run, changes, list, escalates): one alert for each watched key and run, with its changed fields in order."""
    rows = history.dropna(subset=[key, run]).join(watched.select(key).dropna().distinct(), key, "left_semi").select(key, run, "field_name").distinct()
    return rows.groupBy(key, run).agg(F.count("*").alias("changes"), F.array_join(F.sort_array(F.collect_list("field_name")), ",").alias("list"), F.max(F.col("field_name").isin(*escalating)).alias("escalates"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by an explicit order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def first_failing(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule whose condition holds; null conditions don't."""
    out = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        out = F.when(fails, F.lit(name)).otherwise(out)
    return out


def validated(df: DataFrame, key: str, row: str, key_rules: Sequence[tuple[str, Column]], other_rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """df with `reason`, null where a row is accepted: the key's own rules come first, then `duplicate`, then the others.

    A row is a duplicate if an earlier row of its key passed all other rules; a rejected one blocks nothing. The least
    passing row of each key is the accepted one, which equals checking the rows one by one. It comes from an aggregate, so
    that a key (or a missing one) that holds a third of all rows never meets in one task.
    """
    checked = df.withColumn("__bad", first_failing(key_rules)).withColumn("__other", first_failing(other_rules))
    passes = F.when(F.col("__bad").isNull() & F.col("__other").isNull(), F.col(row))
    first = checked.filter(passes.isNotNull()).groupBy(key).agg(F.min(row).alias("__first"))
    earlier = checked.join(first, key, "left").select(*checked.columns, "__first")
    repeated = F.coalesce(F.col(row) > F.col("__first"), F.lit(False))
    reason = F.coalesce("__bad", F.when(repeated, F.lit("duplicate")), "__other")
    return earlier.withColumn("reason", reason).drop("__bad", "__other", "__first")
