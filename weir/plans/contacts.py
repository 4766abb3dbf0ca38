"""Queries over call logs, labels, pages and contacts, with the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions import calls as P
from weir.functions import labels as L
from weir.functions import pages as G
from weir.functions.text import LEGAL_SUFFIXES
from weir.operators import activity as V
from weir.operators import contacts as K
from weir.sources.tables import table

NOW = "2024-01-29 12:00:00"
#: Patterns and words that the queries below label titles with.
TITLE_RULES = [("chief executive", "^(ceo|chief executive( officer)?)$"), ("office manager", "^office (manager|mgr)$"), ("owner", "^(owner|managing member|sole member)$"), ("vice president", "^(vp|vice president)$")]
JUNK = ["test", "temp", "misc", "other", "unknown", "idk"]
ROLES = {"owner": ["owner", "member", "president", "ceo"], "executive": [" vp ", "chief"], "manager": ["manager", "director"], "admin": ["admin", "office"]}
DROP = ["llc", "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "lp", "pllc"]


def providers(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """search_providers, a row for each NPI."""
    return table(spark, sf, "search_providers").select("npi", *columns).distinct()


def call_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as a phone system would export them, in three formats, and read back: calls, answers and seconds by type."""
    form, at, sec = F.col("event_id") % 3, F.col("ts"), F.floor(F.col("value")).cast("bigint")
    shifted = F.concat(F.date_format(at + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    text = F.when(form == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(form == 1, F.date_format(at, "M/d/yyyy h:mm:ss a")).otherwise(shifted)
    length = F.when(form == 0, sec.cast("string")).when(form == 1, F.concat(F.floor(sec / 60), F.lit(":"), F.lpad((sec % 60).cast("string"), 2, "0"))).otherwise(F.format_string("%d:%02d:%02d", F.floor(sec / 3600), F.floor(sec / 60) % 60, sec % 60))
    said = F.when(F.col("event_type") == "purchase", "Spoke to the owner").when(F.col("event_type") == "error", "No answer - talked to nobody")
    raw = table(spark, sf, "events").select("event_type", text.alias("at"), length.alias("length"), said.alias("said"))
    read = raw.select("event_type", P.call_time(F.col("at")).alias("at"), P.duration_seconds(F.col("length")).alias("seconds"), "said")
    picked = P.answered(F.col("seconds"), F.col("said"))
    return read.groupBy("event_type").agg(F.count("at").alias("calls"), F.count_if(picked).alias("answered"), F.sum("seconds").alias("seconds"), F.min("at").alias("first"), F.max("at").alias("last"))


def local_call_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Signed log lines by the zone and the local hour of the provider concerned, and what that hour means."""
    lines = V.note_lines(table(spark, sf, "documents"), "doc_id", "text").filter("author is not null and at is not null")
    state = table(spark, sf, "npi_identity_keys").filter("name_key != '' and state_key != ''").groupBy("name_key").agg(F.min("state_key").alias("state"))
    known = table(spark, sf, "documents").select("doc_id", "name_key").join(state, "name_key").select("doc_id", P.zone_of_state(F.col("state")).alias("zone")).dropna()
    local = lines.join(known, "doc_id").withColumn("local", P.local_time(F.col("at"), F.col("zone")))
    return local.groupBy("zone", F.hour("local").alias("hour"), P.calling_window(F.col("local")).alias("window")).agg(F.count("*").alias("lines"))


def title_labels(spark: SparkSession, sf: str) -> DataFrame:
    """What each spelling of an official's title should become, and why."""
    found = table(spark, sf, "search_providers").filter("official_title is not null").groupBy("official_title").agg(F.count("*").alias("n"))
    return found.withColumn("s", L.settled_label(F.col("official_title"), TITLE_RULES, JUNK)).select("official_title", "n", "s.target", "s.why")


def title_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Providers by the class of their official's title."""
    return providers(spark, sf, "official_title").groupBy(L.first_containing(F.col("official_title"), ROLES, "staff", "unknown").alias("role")).agg(F.count("*").alias("providers"))


def page_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Mail addresses and phone numbers in each document that has any."""
    found = table(spark, sf, "documents").select("doc_id", G.emails(F.col("text")).alias("e"), G.phones(F.col("text")).alias("p"))
    return found.filter((F.size("e") > 0) | (F.size("p") > 0)).select("doc_id", F.array_join("e", ",").alias("emails"), F.size("p").alias("phones"))


def address_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The building key and the unit of each address line."""
    return providers(spark, sf, "address_line1").select("npi", L.building_key(F.col("address_line1")).alias("building"), L.suite_of(F.col("address_line1")).alias("unit"))


def same_building_counts(spark: SparkSession, sf: str) -> DataFrame:
    """For each provider how many others have its building key in the same city and state, and an equal or no ZIP.

    Counts come from aggregates by building and by building and ZIP, never from pairs.
    """
    code = F.left(F.regexp_replace(F.coalesce("postal_code", F.lit("")), r"\D", ""), F.lit(5))
    rows = providers(spark, sf, "address_line1", "city", "state", "postal_code").select("npi", F.col("state").alias("s"), F.upper(F.trim("city")).alias("c"), L.building_key(F.col("address_line1")).alias("b"), code.alias("z")).dropna()
    place = ["s", "c", "b"]
    every = rows.groupBy(*place).agg(F.count("*").alias("n"), F.count_if(F.col("z") == "").alias("blank"))
    joined = rows.join(every, place).join(rows.groupBy(*place, "z").agg(F.count("*").alias("same")), [*place, "z"])
    return joined.select("npi", (F.when(F.col("z") == "", F.col("n")).otherwise(F.col("same") + F.col("blank")) - 1).alias("others"))


def owner_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys by which owners and company names are grouped on screen."""
    rows = providers(spark, sf, "name", "official_first_name", "official_last_name", "state")
    owner = F.concat_ws(" ", "official_first_name", "official_last_name")
    return rows.select("npi", L.owner_state_key(owner, F.col("state")).alias("owner"), L.display_key(F.col("name"), LEGAL_SUFFIXES).alias("company"))


def last_touch(spark: SparkSession, sf: str) -> DataFrame:
    """The newest change of each NPI: joined a group, was reviewed, or a field changed."""
    members = table(spark, sf, "lead_group_members").withColumn("key", F.trim("npi"))
    changes = table(spark, sf, "provider_field_history").select(F.trim("npi").alias("key"), F.col("created_at").alias("at"))
    return K.last_touch({"joined": members.select("key", F.col("created_at").alias("at")), "reviewed": members.select("key", F.col("reviewed_at").alias("at")), "changed": changes}).withColumnRenamed("key", "npi")


def streaks_now(spark: SparkSession, sf: str) -> DataFrame:
    """Users with something to do each day up to the present one or the day before."""
    return K.current_streak(table(spark, sf, "events").filter(F.col("ts") <= F.lit(NOW).cast("timestamp_ntz")), "user_id", "ts", F.lit(NOW).cast("date"))


def misses_in_a_row(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of each user since the last purchase, and the newest."""
    kind = F.col("event_type")
    return K.misses_in_a_row(table(spark, sf, "events"), "user_id", "ts", "event_id", kind == "purchase", kind == "error")


def quiet_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that nobody touched for ninety days and whose review isn't over."""
    groups = table(spark, sf, "lead_groups").select("id", "review_status", "updated_at").distinct()
    return K.quiet(groups, F.col("updated_at"), F.lit("2026-01-01").cast("timestamp_ntz"), 90, done=F.col("review_status").isin("approved", "rejected")).select("id", "quiet_days")


def first_review(spark: SparkSession, sf: str) -> DataFrame:
    """From the start of a group to the first review of a member."""
    starts = table(spark, sf, "lead_groups").groupBy("id").agg(F.min("created_at").alias("start"))
    reviews = table(spark, sf, "lead_group_members").select(F.col("group_id").alias("id"), "reviewed_at").dropna()
    return K.first_response(starts, reviews, "id", "start", "reviewed_at")


def review_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Groups by review status, the most frequent first."""
    return K.counts_by_label(table(spark, sf, "lead_groups").select("id", "review_status").distinct(), F.col("review_status"), "(none)", 8)


def name_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """Names by a loose key, the spelling most in use, and the two specialties most often behind it."""
    rows = providers(spark, sf, "name", "taxonomy_description")
    return K.spelling_groups(rows, F.nullif(L.loose_name(F.col("name"), DROP), F.lit("")), "name", "taxonomy_description").filter("n > 1")


def state_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """The three most frequent titles in each state with enough providers."""
    return K.patterns(providers(spark, sf, "state", "official_title"), "state", "official_title")


def group_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """What the members of a lead group have in common."""
    told = providers(spark, sf, "name", "official_first_name", "official_last_name")
    official = F.nullif(L.owner_key(F.concat_ws(" ", "official_first_name", "official_last_name")), F.lit(""))
    told = told.select("npi", F.nullif(L.display_key(F.col("name"), LEGAL_SUFFIXES), F.lit("")).alias("name"), official.alias("official"))
    members = table(spark, sf, "lead_group_members").select("group_id", F.trim("npi").alias("npi")).distinct()
    return K.group_kinds(members.join(told, "npi"), "group_id", "name", "official").filter("members > 1")


def quota_page(spark: SparkSession, sf: str) -> DataFrame:
    """Forty providers taken from five states in turn, most claims first."""
    rows = providers(spark, sf, "state", "medicare_total_claims").filter(F.col("state").isin("CA", "FL", "ME", "OH", "TX"))
    return K.quota_page(rows, "state", [F.desc_nulls_last("medicare_total_claims"), F.asc("npi")], 40)


def best_leads(spark: SparkSession, sf: str) -> DataFrame:
    """The provider of each state about which most is known."""
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    facts = [(F.col("status") == "active", 4), (said("phone"), 3), (said("official_last_name"), 2), (F.col("medicare_total_claims") >= 100, 2)]
    rows = providers(spark, sf, "state", "status", "phone", "official_last_name", "medicare_total_claims").dropna(subset=["state"])
    return K.best_of(rows, "state", "npi", facts)


def feature_use(spark: SparkSession, sf: str) -> DataFrame:
    """Users of each kind of event, also of kinds that nobody used."""
    kinds = spark.createDataFrame([(k,) for k in ("signup", "view", "click", "purchase", "error", "export", "merge")], "feature string")
    used = table(spark, sf, "events").groupBy(F.col("event_type").alias("feature")).agg(F.count_distinct("user_id").alias("users"), F.max("ts").alias("latest"))
    return kinds.join(used, "feature", "left").fillna(0, subset=["users"])


def daily_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each day by kind, zero-filled."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return V.daily_series(table(spark, sf, "events"), "ts", {k: kind(k) for k in ("signup", "view", "click", "purchase", "error")}).withColumn("period", F.col("period").cast("string"))


def zero_results(spark: SparkSession, sf: str) -> DataFrame:
    """The eight most frequent combinations of state, specialty and status among providers without claims."""
    rows = providers(spark, sf, "state", "taxonomy_code", "status", "medicare_total_claims").filter("coalesce(medicare_total_claims, 0) = 0")
    shown = [F.coalesce(c, F.lit("-")).alias(c) for c in ("state", "taxonomy_code", "status")]
    return rows.groupBy(*shown).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "state", "taxonomy_code", "status").limit(8)


def call_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    """Events by weekday and three hours."""
    return table(spark, sf, "events").groupBy(F.weekday("ts").alias("weekday"), (F.floor(F.hour("ts") / 3) * 3).cast("int").alias("hour")).agg(F.count("*").alias("n"))


def strict_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of name, street, state and phone that several NPIs share; a row that lacks any of them shares nothing."""
    phone = F.nullif(F.right(F.regexp_replace(F.coalesce("phone", F.lit("")), r"\D", ""), F.lit(10)), F.lit(""))
    rows = providers(spark, sf, "name", "address_line1", "state", "phone").select("npi", F.nullif(L.display_key(F.col("name"), LEGAL_SUFFIXES), F.lit("")).alias("n"), L.building_key(F.col("address_line1")).alias("b"), "state", phone.alias("p"))
    return rows.dropna().groupBy("n", "b", "state", "p").agg(F.count_distinct("npi").alias("npis")).filter("npis > 1")


QUERIES = {
    f.__name__: f
    for f in (
        call_fields, local_call_hours, title_labels, title_roles, page_contacts, address_parts, same_building_counts, owner_keys, last_touch, streaks_now, misses_in_a_row, quiet_groups, first_review, review_labels,
        name_spellings, state_patterns, group_kinds, quota_page, best_leads, feature_use, daily_kinds, zero_results, call_heatmap, strict_duplicates,
    )
}

_LEGAL = "'llc', 'inc', 'corp', 'corporation', 'co', 'company', 'ltd', 'limited', 'lp', 'llp', 'pllc', 'pc', 'incorporated'"
_UNITS = "STE|SUITE|UNIT|APT|APARTMENT|RM|ROOM|FL|FLOOR|BLDG|BUILDING|DEPT|LOT|SPC"


def _display(c: str) -> str:
    text = f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[.''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    for apart, whole in (("p l l c", "pllc"), ("l l c", "llc"), ("l l p", "llp"), ("l p", "lp"), ("p c", "pc")):
        text = rf"regexp_replace({text}, '\b{apart}\b', '{whole}', 'g')"
    return f"array_to_string(list_filter(string_split({text}, ' '), lambda x: x <> '' and x not in ({_LEGAL})), ' ')"


def _owner(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z\s]', ' ', 'g'), '\b(dr|mr|mrs|ms|md|jr|sr|ii|iii|owner|ceo)\b', ' ', 'g'), '\s+', ' ', 'g'))"


def _building(c: str) -> str:
    key = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(coalesce({c}, '')), '[.,]', ' ', 'g'), '#.*$', ''), '\s+({_UNITS})\b.*$', ''), '\s+', ' ', 'g'))"
    return f"case when length({key}) >= 5 and regexp_matches({key}, '[0-9]') then {key} end"


_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(lower(official_title), '[_/-]+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g'))"
_ZONE_CASE = " ".join(f"when state in ({', '.join(repr(s) for s in states.split())}) then '{zone}'" for zone, states in P.ZONES.items())
_P = lambda *c: f"p as (select distinct npi, {', '.join(c)} from search_providers)"
_OFFICIAL = "concat_ws(' ', official_first_name, official_last_name)"

ORACLE = {
    "call_fields": "with e as (select event_type, date_trunc('second', ts) t, floor(value)::bigint s from events) select event_type, count(*) calls, count(*) filter (event_type = 'purchase' or event_type <> 'error' and s >= 15) answered, sum(s)::bigint as seconds, min(t) \"first\", max(t) \"last\" from e group by 1",
    "local_call_hours": rf"""with l as (select doc_id, name_key, trim(unnest(string_split(text, chr(10))), ' ') raw from documents),
      m as (select doc_id, name_key, regexp_extract(raw, '^(\d{{4}}-\d{{2}}-\d{{2}}) (\d{{2}}:\d{{2}}) — (.+?): (.*)$', ['d', 't', 'a', 'n']) x from l where regexp_matches(raw, '^(\d{{4}}-\d{{2}}-\d{{2}}) (\d{{2}}:\d{{2}}) — (.+?): (.*)$')),
      s as (select name_key, min(state_key) state from npi_identity_keys where name_key <> '' and state_key <> '' group by 1),
      z as (select case {_ZONE_CASE} end zone, try_cast(x.d || ' ' || x.t || ':00' as timestamp) t from m join s using (name_key) where trim(x.a) <> ''),
      h as (select zone, timezone(zone, timezone('UTC', t)) lt from z where zone is not null and t is not null)
      select zone, hour(lt) "hour", case when isodow(lt) > 5 then 'weekend' when hour(lt) < 9 then 'before' when hour(lt) >= 17 then 'after' when hour(lt) = 12 then 'lunch' else 'open' end "window", count(*) lines from h group by all""",
    "title_labels": f"""with t as (select official_title, count(*) n, {_PLAIN} pl from search_providers where official_title is not null group by 1),
      k as (select *, case when regexp_matches(pl, '^(ceo|chief executive( officer)?)$') then 'chief executive' when regexp_matches(pl, '^office (manager|mgr)$') then 'office manager' when regexp_matches(pl, '^(owner|managing member|sole member)$') then 'owner' when regexp_matches(pl, '^(vp|vice president)$') then 'vice president' end known,
        length(pl) < 3 or regexp_matches(pl, '^\\d+$') or pl = repeat(left(pl, 1), length(pl)) or pl in ('test', 'temp', 'misc', 'other', 'unknown', 'idk') little from t)
      select official_title, n, coalesce(known, case when not little then pl end) target, case when known = trim(official_title) then 'ok' when known is not null then 'same meaning' when little then 'meaningless' when pl = trim(official_title) then 'custom' else 'tidy spelling' end why from k""",
    "title_roles": f"with {_P('official_title')}, t as (select ' ' || lower(official_title) || ' ' t from p) select case when trim(coalesce(t, '')) = '' then 'unknown' when contains(t, 'owner') or contains(t, 'member') or contains(t, 'president') or contains(t, 'ceo') then 'owner' when contains(t, ' vp ') or contains(t, 'chief') then 'executive' when contains(t, 'manager') or contains(t, 'director') then 'manager' when contains(t, 'admin') or contains(t, 'office') then 'admin' else 'staff' end as role, count(*) providers from t group by 1",
    "page_contacts": r"""with d as (select doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), lambda x: lower(x)), lambda x: not regexp_matches(x, '\.(png|jpg|jpeg|gif|svg|webp)$')) e,
      len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '(?:\+?1[-.\s\v]?)?\(?\d{3}\)?[-.\s\v]?\d{3}[-.\s\v]?\d{4}'), lambda x: trim(x)))) phones from documents)
      select doc_id, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), ',') emails, phones from d where len(e) > 0 or phones > 0""",
    "address_parts": rf"with {_P('address_line1')} select npi, {_building('address_line1')} building, trim(regexp_replace(regexp_extract(regexp_replace(upper(coalesce(address_line1, '')), '[.,]', ' ', 'g'), '((?:#|\b(?:{_UNITS})\b).*)$', 1), '\s+', ' ', 'g')) unit from p",
    "same_building_counts": f"with {_P('address_line1', 'city', 'state', 'postal_code')}, r as (select npi, state s, upper(trim(city)) c, {_building('address_line1')} b, left(regexp_replace(coalesce(postal_code, ''), '[^0-9]', '', 'g'), 5) z from p), k as (select * from r where s is not null and c is not null and b is not null) select a.npi, count(*) filter (a.npi <> o.npi) others from k a join k o on a.s = o.s and a.c = o.c and a.b = o.b and (a.z = '' or o.z = '' or a.z = o.z) group by a.npi",
    "owner_keys": f"with {_P('name', 'official_first_name', 'official_last_name', 'state')}, k as (select npi, {_owner(_OFFICIAL)} o, upper(trim(state)) s, {_display('name')} company from p) select npi, case when contains(o, ' ') and s <> '' then o || '|' || s end as owner, company from k",
    "last_touch": "with t as (select trim(npi) npi, created_at as at, 'joined' source from lead_group_members union all select trim(npi), reviewed_at, 'reviewed' from lead_group_members union all select trim(npi), created_at, 'changed' from provider_field_history) select npi, t.at, source from t where npi is not null and t.at is not null qualify row_number() over (partition by npi order by t.at desc, source) = 1",
    "streaks_now": f"with d as (select distinct user_id, ts::date d from events where ts <= timestamp '{NOW}'), i as (select *, d - row_number() over (partition by user_id order by d)::int island from d), g as (select user_id, max(d) l, count(*) as days from i group by user_id, island) select user_id, days from g where l between date '2024-01-28' and date '2024-01-29'",
    "misses_in_a_row": "with e as (select *, max(case when event_type = 'purchase' then (ts, event_id) end) over (partition by user_id) h from events where event_type in ('purchase', 'error')) select user_id, count(*) tries, max(ts) last_at from e where event_type = 'error' and (h is null or (ts, event_id) > h) group by 1",
    "quiet_groups": "select distinct id, floor(epoch(timestamp '2026-01-01' - updated_at) / 86400)::bigint quiet_days from lead_groups where coalesce(review_status, '') not in ('approved', 'rejected') and floor(epoch(timestamp '2026-01-01' - updated_at) / 86400) >= 90",
    "first_review": "with s as (select id, min(created_at) a from lead_groups group by 1), r as (select group_id, min(reviewed_at) b from lead_group_members where reviewed_at is not null group by 1), h as (select case when date_diff('second', date_trunc('second', a), date_trunc('second', b)) >= 0 then date_diff('second', date_trunc('second', a), date_trunc('second', b)) / 3600.0 end h from s left join r on group_id = id) select count(*) started, count(h) responded, round(quantile_cont(h, 0.5), 1) median_hours, count(*) filter (h <= 24) within_1d, count(*) filter (h <= 72) within_3d from h",
    "review_labels": "select coalesce(nullif(trim(review_status), ''), '(none)') label, count(*) n from (select distinct id, review_status from lead_groups) group by 1 order by n desc, label limit 8",
    "name_spellings": rf"""with {_P('name', 'taxonomy_description')}, k as (select nullif(trim(regexp_replace(regexp_replace(lower(name), '\b(llc|inc|incorporated|corp|corporation|co|company|ltd|lp|pllc)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), '') key, name, taxonomy_description r from p),
      s as (select key, name, count(*) c, sum(count(*)) over (partition by key) n from k where key is not null group by key, name qualify row_number() over (partition by key order by count(*) desc, length(name) desc, name) = 1),
      t as (select key, r, count(*) c, row_number() over (partition by key order by count(*) desc, r) i from k where key is not null and r is not null group by key, r),
      l as (select key, string_agg(r || ':' || c, ', ' order by i) reasons from t where i <= 2 group by key)
      select key, name, n::bigint n, reasons from s left join l using (key) where n > 1""",
    "state_patterns": f"with {_P('state', 'official_title')}, z as (select state, count(*) as rows from p where state is not null group by 1 having count(*) >= 3), t as (select state, official_title, count(*) n from p where state is not null and official_title is not null group by state, official_title qualify row_number() over (partition by state order by count(*) desc, official_title) <= 3) select state, z.rows, official_title, n from z join t using (state)",
    "group_kinds": f"""with {_P('name', 'official_first_name', 'official_last_name')}, k as (select npi, nullif({_display('name')}, '') name, nullif({_owner(_OFFICIAL)}, '') official from p),
      m as (select group_id, k.* from (select distinct group_id, trim(npi) npi from lead_group_members) join k using (npi)), g as (select group_id, count(*) members, count(distinct name) names from m group by 1),
      n as (select group_id, name from m where name is not null group by group_id, name qualify row_number() over (partition by group_id order by count(*) desc, name) = 1),
      o as (select group_id, official, count(*) c from m where official is not null group by group_id, official qualify row_number() over (partition by group_id order by count(*) desc, official) = 1)
      select group_id, members, names, case when names = 1 then 'name' when c / members >= 0.6 then 'official' else 'mixed' end kind, case when names <> 1 and c / members >= 0.6 then official else name end title, members >= 12 or names >= 3 is_big from g left join n using (group_id) left join o using (group_id) where members > 1""",
    "quota_page": f"with {_P('state', 'medicare_total_claims')} select npi, state, medicare_total_claims, row_number() over (partition by state order by medicare_total_claims desc nulls last, npi) turn from p where state in ('CA', 'FL', 'ME', 'OH', 'TX') order by turn, state limit 40",
    "best_leads": f"with {_P('state', 'status', 'phone', 'official_last_name', 'medicare_total_claims')}, s as (select state, npi, case when status = 'active' then 4 else 0 end + case when trim(coalesce(phone, '')) <> '' then 3 else 0 end + case when trim(coalesce(official_last_name, '')) <> '' then 2 else 0 end + case when medicare_total_claims >= 100 then 2 else 0 end score from p where state is not null) select * from s qualify row_number() over (partition by state order by score desc, npi) = 1",
    "feature_use": "with f as (select unnest(['signup', 'view', 'click', 'purchase', 'error', 'export', 'merge']) feature) select feature, count(distinct user_id) users, max(ts) latest from f left join events on event_type = feature group by 1",
    "daily_kinds": "with d as (select unnest(generate_series(min(ts)::date, max(ts)::date, interval 1 day))::date period from events) select period::varchar period, " + ", ".join(f"count(*) filter (event_type = '{k}') {k}" for k in ("signup", '"view"', "click", "purchase", "error")).replace("'\"view\"'", "'view'") + " from d left join events on ts::date = period group by 1",
    "zero_results": f"with {_P('state', 'taxonomy_code', 'status', 'medicare_total_claims')} select coalesce(state, '-') state, coalesce(taxonomy_code, '-') taxonomy_code, coalesce(status, '-') status, count(*) n from p where coalesce(medicare_total_claims, 0) = 0 group by 1, 2, 3 order by n desc, 1, 2, 3 limit 8",
    "call_heatmap": "select isodow(ts) - 1 weekday, hour(ts) // 3 * 3 \"hour\", count(*) n from events group by 1, 2",
    "strict_duplicates": f"with {_P('name', 'address_line1', 'state', 'phone')}, k as (select npi, nullif({_display('name')}, '') n, {_building('address_line1')} b, state, nullif(right(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g'), 10), '') p from p) select n, b, state, p, count(distinct npi) npis from k where n is not null and b is not null and state is not null and p is not null group by all having count(distinct npi) > 1",
}
