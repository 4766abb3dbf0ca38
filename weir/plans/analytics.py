"""Call-log, event and billing analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.text import formula_safe, parse_date
from weir.operators import activity as V
from weir.sources.tables import table

NOW = "2024-01-29 00:00:00"
STAGES = ["signup", "view", "click", "purchase"]


def note_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all call logs by author's presence and kind."""
    lines = V.note_lines(table(spark, sf, "documents"), "doc_id", "text")
    return lines.groupBy(F.col("author").isNotNull().alias("signed"), "kind").agg(F.count("*").alias("lines"), F.countDistinct("doc_id").alias("documents"), F.max("at").alias("latest"))


def call_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of each user, without those that belong to a dial."""
    kind = F.col("event_type")
    rows = table(spark, sf, "events").filter(kind.isin("click", "view"))
    return V.calls_once(rows, ["user_id"], "ts", "event_id", kind == "click", kind == "view", 240).filter(kind == "view").groupBy("user_id").agg(F.count("*").alias("calls"))


def best_times(spark: SparkSession, sf: str) -> DataFrame:
    """Weekday and hour cells with the smoothed share of purchases."""
    grid = V.time_grid(table(spark, sf, "events"), "ts", F.col("event_type") == "purchase")
    return grid.withColumn("rate", F.round("rate", 6))


def daily_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events and users of each day, zero-filled."""
    return V.daily_series(table(spark, sf, "events"), "ts", {"n": F.count("*"), "users": F.countDistinct("user_id"), "errors": F.count_if(F.col("event_type") == "error")}).withColumn("period", F.col("period").cast("string"))


def weekly_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of each week from Monday, zero-filled."""
    return V.daily_series(table(spark, sf, "orders"), "o_orderdate", {"orders": F.count("*"), "customers": F.countDistinct("o_custkey")}, step="week").withColumn("period", F.col("period").cast("string"))


def activity_streaks(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of consecutive active days of each user."""
    return V.streaks(table(spark, sf, "events"), "user_id", "ts").select("user_id", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "days")


def value_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank median and 95th percentile of event values, by type."""
    return V.nearest_rank(table(spark, sf, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


def week_over_week(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the last seven days against the seven before, by type."""
    return V.two_weeks(table(spark, sf, "events"), "event_type", "ts", NOW)


def error_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Errors by their code: how many, how many users, and the latest event."""
    rows = table(spark, sf, "events").filter("event_type = 'error'").withColumn("code", F.get_json_object("props", "$.k").cast("int"))
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


def event_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """How many users reached each stage."""
    return V.funnel(table(spark, sf, "events"), "user_id", F.col("event_type"), STAGES)


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user with a pause of at least four hours between them."""
    return V.sessions(table(spark, sf, "events"), "user_id", "ts", "4 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"), F.min("start").alias("first_start"))


def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events in windows of a day that start every six hours."""
    w = F.window("ts", "1 day", "6 hours")
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def product_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The five largest part types by revenue, and the rest as Other."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return V.top_with_other(rows, "p_type", F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)")))


def nation_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue of each supplier nation by year, against the year before."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
    names = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("nation"))
    return V.year_trend(lines.join(names, "l_suppkey"), "nation", "l_shipdate", F.col("l_extendedprice").cast("decimal(12,2)")).withColumn("amount", F.col("amount").cast("double"))


def type_shifts(spark: SparkSession, sf: str) -> DataFrame:
    """The four part types whose quantity changed most between two years, among those that changed by at least two per cent."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").withColumn("year", F.year("l_shipdate"))
    year = lambda y, n: rows.filter(F.col("year") == y).groupBy("p_type").agg(F.sum("l_quantity").alias(n))
    both = year(1995, "before").join(year(1996, "after"), "p_type", "full").fillna(0.0)
    change = F.col("after") - F.col("before")
    moved = both.withColumn("change", change).filter((F.abs("change") >= 50) & ((F.col("before") == 0) | (F.abs("change") >= 0.02 * F.col("before"))))
    return moved.orderBy(F.desc(F.abs("change")), "p_type").limit(4)


def order_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with orders of several states, the states in order."""
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("states"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("list")).filter("states > 1")


def last_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The latest order of each customer, by an aggregate instead of a window."""
    latest = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("o")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(latest).select("o_custkey", "o.o_orderkey", "o.o_orderdate", "o.o_totalprice")


def usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Orders, spending and line items of each market segment, customers without orders included."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    orders = table(spark, sf, "orders").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"))
    rows = table(spark, sf, "customer").join(orders, "c_custkey", "left")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.count_if(F.col("orders").isNull()).alias("idle"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def fresh_cache(spark: SparkSession, sf: str) -> DataFrame:
    """The newest entry of each key that is at most an hour old, as a cache would serve it."""
    at = F.col("ts")
    now = F.lit(NOW).cast("timestamp_ntz")
    fresh = table(spark, sf, "events").filter((at <= now) & (at > now - F.expr("interval 12 hours")))
    return fresh.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("e")).select("user_id", "e.event_id", "e.value")


def export_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of phone cells that a spreadsheet would take for a formula, made safe."""
    rows = table(spark, sf, "search_providers").select("npi", "phone").distinct()
    return rows.select("npi", formula_safe(F.col("phone")).alias("cell")).filter("phone rlike '^[=@+-]'")


def parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """How the dates of the change log read: ISO, US or not at all, with their range."""
    v = F.regexp_replace(F.col("new_value"), '"', "")
    rows = table(spark, sf, "provider_field_history").filter("field_name = 'lastupdated' and new_value is not null").select(parse_date(v).alias("d"), F.when(v.contains("/"), "us").when(v.contains("T"), "time").otherwise("iso").alias("form"))
    return rows.groupBy("form").agg(F.count("*").alias("n"), F.count("d").alias("parsed"), F.min("d").cast("string").alias("earliest"), F.max("d").cast("string").alias("latest"))


def provider_changes(spark: SparkSession, sf: str) -> DataFrame:
    """For each provider and run, the changed fields in order."""
    rows = table(spark, sf, "provider_field_history").filter("refresh_run_id is not null").select("npi", "refresh_run_id", "field_name").distinct()
    return rows.groupBy("npi", "refresh_run_id").agg(F.count("*").alias("fields"), F.array_join(F.sort_array(F.collect_list("field_name")), ",").alias("list")).filter("fields > 1")


QUERIES = {
    f.__name__: f
    for f in (
        note_kinds, call_pairing, best_times, daily_events, weekly_orders, activity_streaks, value_percentiles, week_over_week, error_groups, event_funnel, user_sessions, sliding_windows, product_mix,
        nation_trend, type_shifts, order_conflicts, last_orders, usage_summary, fresh_cache, export_cells, parsed_dates, provider_changes,
    )
}

_LEVEL = " ".join(f"when '{s}' then {i}" for i, s in enumerate(STAGES))

ORACLE = {
    "note_kinds": r"""with l as (select doc_id, trim(unnest(string_split(text, chr(10))), ' ') raw from documents),
      m as (select doc_id, regexp_extract(raw, '^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2})(?: — (.+?))?: (.*)$', ['d', 't', 'a', 'n']) x from l where regexp_matches(raw, '^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2})(?: — (.+?))?: (.*)$')),
      k as (select doc_id, nullif(trim(x.a), '') is not null signed, try_cast(x.d || ' ' || x.t || ':00' as timestamp) ts, case when trim(x.n) ilike 'meeting booked%' then 'booked' when trim(x.n) ilike 'meeting held%' then 'held' when trim(x.n) ilike 'meeting no-show%' then 'noShow' when trim(x.n) ilike 'meeting cancelled%' then 'cancelled' when regexp_matches(lower(trim(x.n)), '^(imported from|reassigned by|disconnected by)') then 'import' when regexp_matches(lower(trim(x.n)), '^dialed\b') then 'dial' else 'call' end kind from m)
      select signed, kind, count(*) lines, count(distinct doc_id) documents, max(ts) latest from k group by all""",
    "call_pairing": """with e as (select *, count(*) filter (event_type = 'click') over (partition by user_id order by ts, event_id) g from events where event_type in ('click', 'view')),
      s as (select *, max(ts) filter (event_type = 'click') over (partition by user_id, g order by ts, event_id) d, count(*) filter (event_type = 'view') over (partition by user_id, g order by ts, event_id) c from e)
      select user_id, count(*) calls from s where event_type = 'view' and not (g > 0 and c = 1 and ts <= d + interval 240 minute) group by user_id""",
    "best_times": "select isodow(ts) - 1 weekday, hour(ts) \"hour\", count(*) calls, count(*) filter (event_type = 'purchase') answered, round((count(*) filter (event_type = 'purchase') + 1) / (count(*) + 2), 6) rate from events group by 1, 2 having count(*) >= 4",
    "daily_events": "with d as (select unnest(generate_series(min(ts)::date, max(ts)::date, interval 1 day))::date period from events), e as (select ts::date period, count(*) n, count(distinct user_id) users, count(*) filter (event_type = 'error') errors from events group by 1) select period::varchar period, coalesce(n, 0) n, coalesce(users, 0) users, coalesce(errors, 0) errors from d left join e using (period)",
    "weekly_orders": "with d as (select unnest(generate_series(date_trunc('week', min(o_orderdate)), date_trunc('week', max(o_orderdate)), interval 7 day))::date period from orders), e as (select date_trunc('week', o_orderdate)::date period, count(*) orders, count(distinct o_custkey) customers from orders group by 1) select period::varchar period, coalesce(orders, 0) orders, coalesce(customers, 0) customers from d left join e using (period)",
    "activity_streaks": "with d as (select distinct user_id, ts::date d from events), i as (select *, d - row_number() over (partition by user_id order by d)::int island from d) select user_id, min(d)::varchar first_day, max(d)::varchar last_day, count(*) as days from i group by user_id, island",
    "value_percentiles": "with s as (select event_type, list_sort(list(value)) v from events where value is not null group by 1) select event_type, len(v) n, v[least(len(v) - 1, floor(0.5 * len(v))::bigint) + 1] p50, v[least(len(v) - 1, floor(0.95 * len(v))::bigint) + 1] p95 from s",
    "week_over_week": f"with e as (select event_type, count(*) filter (ts > timestamp '{NOW}' - interval 7 day) this_week, count(*) filter (ts <= timestamp '{NOW}' - interval 7 day) last_week from events where ts > timestamp '{NOW}' - interval 14 day and ts <= timestamp '{NOW}' group by 1) select *, case when last_week > 0 then floor(100.0 * (this_week - last_week) / last_week + 0.5) end::bigint change_pct from e",
    "error_groups": "select (props ->> '$.k')::int code, count(*) n, count(distinct user_id) users, arg_max(event_id, (ts, event_id)) latest from events where event_type = 'error' group by 1",
    "event_funnel": f"with u as (select user_id, max(case event_type {_LEVEL} end) l from events group by 1), c as (" + " union all ".join(f"select {i} step, '{s}' stage, count(*) filter (l >= {i}) reached from u" for i, s in enumerate(STAGES)) + ") select *, case when lag(reached) over (order by step) > 0 then round(reached / lag(reached) over (order by step), 4) end of_previous from c",
    "user_sessions": "with e as (select *, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 4 hour then 1 else 0 end new from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(new) over (partition by user_id order by ts, event_id) g from e), c as (select user_id, g, count(*) n, min(ts) start from s group by all) select user_id, count(*) sessions, max(n) longest, min(start) first_start from c group by 1",
    "sliding_windows": "select time_bucket(interval 6 hour, ts) - to_hours(6 * k) as \"start\", event_type, count(*) n from events, (select unnest([0, 1, 2, 3]) k) group by all",
    "product_mix": "with g as (select p_type label, round(sum(l_extendedprice::decimal(12,2) * (1 - l_discount::decimal(4,2))), 2) amount from lineitem join part on p_partkey = l_partkey group by 1), r as (select *, row_number() over (order by amount desc, label) n from g), f as (select case when n <= 5 then label else 'Other' end label, sum(amount) amount from r group by 1) select label, amount::double amount, round(amount::double / sum(amount) over ()::double, 4) share from f",
    "nation_trend": "with y as (select n_name nation, year(l_shipdate)::int \"year\", round(sum(l_extendedprice::decimal(12,2)), 2) amount from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by all), b as (select *, lag(amount) over (partition by nation order by \"year\") b from y) select nation, \"year\", amount::double amount, case when b is null or b = 0 then 'new' when (amount - b) / b >= 0.1 then 'up' when (amount - b) / b <= -0.2 then 'down' else 'flat' end trend from b",
    "type_shifts": "with q as (select p_type, coalesce(sum(l_quantity) filter (year(l_shipdate) = 1995), 0) as \"before\", coalesce(sum(l_quantity) filter (year(l_shipdate) = 1996), 0) as \"after\" from lineitem join part on p_partkey = l_partkey where year(l_shipdate) in (1995, 1996) group by 1) select *, \"after\" - \"before\" as change from q where abs(\"after\" - \"before\") >= 50 and (\"before\" = 0 or abs(\"after\" - \"before\") >= 0.02 * \"before\") order by abs(\"after\" - \"before\") desc, p_type limit 4",
    "order_conflicts": "select o_custkey, count(distinct o_orderstatus) states, array_to_string(list_sort(list(distinct o_orderstatus)), ',') list from orders group by 1 having count(distinct o_orderstatus) > 1",
    "last_orders": "select o_custkey, o_orderkey, o_orderdate, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    "usage_summary": "with l as (select l_orderkey, count(*) n from lineitem group by 1), o as (select o_custkey, count(*) orders, sum(n) lines from orders left join l on l_orderkey = o_orderkey group by 1) select c_mktsegment, count(*) customers, count(*) filter (orders is null) idle, coalesce(sum(orders), 0)::bigint orders, coalesce(sum(lines), 0)::bigint lines from customer left join o on o_custkey = c_custkey group by 1",
    "fresh_cache": f"select user_id, event_id, value from events where ts <= timestamp '{NOW}' and ts > timestamp '{NOW}' - interval 12 hour qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "export_cells": r"select distinct npi, case when regexp_matches(phone, '^[=@]') or regexp_matches(phone, '^[+\-]') and not regexp_matches(phone, '^[+\-]?[0-9][0-9,]*\.?[0-9]*$') then '''' || phone else phone end as cell from search_providers where regexp_matches(phone, '^[=@+\-]')",
    "parsed_dates": r"with v as (select replace(new_value, chr(34), '') v from provider_field_history where field_name = 'lastupdated' and new_value is not null), d as (select case when contains(v, '/') then 'us' when contains(v, 'T') then 'time' else 'iso' end form, case when regexp_matches(trim(v), '^\d{4}-\d{2}-\d{2}') then try_cast(left(trim(v), 10) as date) when regexp_matches(trim(v), '^\d{1,2}/\d{1,2}/\d{4}$') then try_strptime(trim(v), '%m/%d/%Y')::date end d from v) select form, count(*) n, count(d) parsed, min(d)::varchar earliest, max(d)::varchar latest from d group by 1",
    "provider_changes": "select npi, refresh_run_id, count(distinct field_name) fields, array_to_string(list_sort(list(distinct field_name)), ',') list from provider_field_history where refresh_run_id is not null group by all having count(distinct field_name) > 1",
}
