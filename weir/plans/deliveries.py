"""Queries over deliveries, alerts, call books and builds, with the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions import text as X
from weir.operators import activity as V
from weir.operators import apply as A
from weir.operators import callbook as B
from weir.operators import criteria as C
from weir.operators import identity as I
from weir.operators import related as N
from weir.plans.search import MEASURES, last_deliveries, rounded
from weir.sources.tables import table

NOW = "2025-12-31 00:00:00"
AUTOMATIC = ["name+state+phone", "name+state+official", "state+official+phone", "official+phone"]
CODES = ["773X0017X", "774X0117X", "999X9999X"]


def members(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lead_group_members").select(F.trim("npi").alias("npi"), "group_id", "reviewed_by", "reviewed_at", "created_at").dropna(subset=["npi"]).distinct()


def delivery_applied(spark: SparkSession, sf: str) -> DataFrame:
    """What applying the last medicare delivery does: only known NPIs are written, and grouped ones raise alerts."""
    known = table(spark, sf, "search_providers").select("npi")
    return A.applied(last_deliveries(spark, sf), "npi", MEASURES, known, members(spark, sf), "total_claims", rounded)


def change_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """One alert for each grouped NPI and run, with the fields that changed."""
    history = table(spark, sf, "provider_field_history").withColumn("npi", F.trim("npi"))
    return A.alerts(history, members(spark, sf), "npi", "refresh_run_id", ["status", "name", "authorizedofficial_lastname"])


def compact_history(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the change log by whether they say a value came, went or changed, after compaction."""
    rows = A.compacted(table(spark, sf, "provider_field_history"))
    return rows.groupBy("field_name", F.col("old_value").isNull().alias("from_nothing"), F.col("new_value").isNull().alias("to_nothing")).agg(F.count("*").alias("n"))


def territory_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Providers by state for a list of codes; a code without any has one row without a state."""
    rows = table(spark, sf, "search_providers").select("npi", "state", "taxonomy_code").distinct().filter(F.col("taxonomy_code").isin(*CODES) & F.col("state").isNotNull())
    found = rows.groupBy("taxonomy_code", "state").agg(F.count("*").alias("total"))
    codes = spark.createDataFrame([(c,) for c in CODES], "taxonomy_code string")
    return codes.join(found, "taxonomy_code", "left").select("taxonomy_code", F.coalesce("state", F.lit("")).alias("state"), F.coalesce("total", F.lit(0)).alias("total"))


def raw_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Phone changes in the shape of a call book: the new value is the number that was called."""
    rows = table(spark, sf, "provider_field_history").filter("field_name like '%phone%'")
    return rows.select(
        F.regexp_replace("new_value", '"', "").alias("phone"), F.date_format("created_at", "M/d/yyyy h:mm a").alias("at"), F.when(F.col("source") == "nppes", "0:45").otherwise("12").alias("length"),
        F.col("field_name").alias("agent"), F.when(F.col("refresh_run_id").isNull(), "voice mail").alias("result"),
    )


def call_import(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a call book by why they can't be kept."""
    return B.read_calls(raw_calls(spark, sf), F.lit(NOW).cast("timestamp_ntz")).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def call_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, answers and minutes of each agent, without repeated rows and those of a number that is stored already."""
    calls = B.read_calls(raw_calls(spark, sf), F.lit(NOW).cast("timestamp_ntz"))
    stored = calls.filter("phone like '2%'").dropna(subset=B.KEY)
    return B.call_totals(B.new_calls(calls, stored), "agent")


def phone_tallies(spark: SparkSession, sf: str) -> DataFrame:
    """Calls to any of the numbers that each provider ever had."""
    calls = B.new_calls(B.read_calls(raw_calls(spark, sf), F.lit(NOW).cast("timestamp_ntz")), B.read_calls(raw_calls(spark, sf).limit(0), F.lit(NOW).cast("timestamp_ntz")))
    by_phone = B.call_totals(calls, "phone")
    told = table(spark, sf, "provider_field_history").filter("field_name like '%phone%'")
    number = lambda c: X.national_number(F.regexp_replace(c, '"', ""))
    numbers = told.select(F.trim("npi").alias("npi"), F.explode(F.array(number("old_value"), number("new_value"))).alias("phone")).dropna().distinct()
    return numbers.join(by_phone, "phone").groupBy("npi").agg(F.sum("calls").alias("calls"), F.sum("answered").alias("answered"))


def trend_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by how their spending of 1997 compares with the year before."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(14,2)").alias("price"))
    return V.year_kinds(rows, "o_custkey", "o_orderdate", F.col("price"), 1997).groupBy("kind").agg(F.count("*").alias("customers"))


def reviewer_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What each reviewer did, from four sources, zero where nothing."""
    rows = members(spark, sf)
    people = rows.select(F.col("reviewed_by").alias("who")).dropna().distinct()
    reviews = rows.groupBy(F.col("reviewed_by").alias("who")).agg(F.count("*").alias("reviews"), F.max("reviewed_at").alias("latest"))
    groups = rows.select(F.col("reviewed_by").alias("who"), "group_id").distinct().groupBy("who").agg(F.count("*").alias("groups"))
    pairs = table(spark, sf, "registry_match_candidates").select(F.col("left_npi").alias("npi"), "right_npi").dropna().distinct()
    matched = rows.join(pairs, "npi").groupBy(F.col("reviewed_by").alias("who")).agg(F.count("*").alias("pairs"))
    changes = table(spark, sf, "provider_field_history").select(F.trim("npi").alias("npi"), "id").distinct()
    changed = rows.join(changes, "npi").groupBy(F.col("reviewed_by").alias("who")).agg(F.count("*").alias("changes"))
    return people.join(reviews, "who", "left").join(groups, "who", "left").join(matched, "who", "left").join(changed, "who", "left").fillna(0, subset=["pairs", "changes"])


def match_maps(spark: SparkSession, sf: str) -> DataFrame:
    """For each NPI a JSON object of its matches and what they share, in order."""
    rows = table(spark, sf, "registry_match_candidates").select("left_npi", "right_npi", "matched_keys").dropna().groupBy("left_npi", "right_npi").agg(F.min("matched_keys").alias("keys"))
    return rows.groupBy("left_npi").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("right_npi", "keys"))))).alias("matches"))


def anniversaries(spark: SparkSession, sf: str) -> DataFrame:
    """Providers whose last update has an anniversary in the thirty days from New Year's Eve, and which."""
    day, today = X.parse_date(F.col("last_updated")), F.lit(NOW).cast("date")
    rows = table(spark, sf, "search_providers").select("npi", day.alias("d")).dropna().distinct()
    next_ = F.add_months("d", 12 * (F.year(today) - F.year("d")))
    next_ = F.when(next_ < today, F.add_months("d", 12 * (F.year(today) - F.year("d") + 1))).otherwise(next_)
    return rows.select("npi", (F.year(next_) - F.year("d")).alias("years"), F.datediff(next_, today).alias("days")).filter("days < 30 and years > 0")


def evidence_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Members by the rule of their evidence: read into known fields, others dropped; with the best score."""
    rows = table(spark, sf, "lead_group_members").select("id", F.from_json("evidence", "rule string, score double").alias("e")).distinct()
    return rows.groupBy(F.coalesce("e.rule", F.lit("-")).alias("rule")).agg(F.count("*").alias("members"), F.max("e.score").alias("best"))


def run_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with what their metadata says, after a note is merged in and a key is left out."""
    meta = F.from_json("metadata", "map<string,string>")
    runs = table(spark, sf, "refresh_runs").select("id", "status", "metadata").distinct()
    rows = runs.select("id", "status", F.coalesce(meta, F.create_map().cast("map<string,string>")).alias("m"))
    noted = F.map_concat(F.map_filter("m", lambda k, v: k != "note"), F.create_map(F.lit("note"), F.col("status")))
    return rows.select("id", F.map_contains_key("m", "staging_state").alias("staged"), F.element_at(noted, "note").alias("note"), F.size(noted).alias("keys"))


def state_heat(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of each state's providers and the share in a run, where there are at least five."""
    state = table(spark, sf, "search_providers").groupBy("npi").agg(F.max("state").alias("state"))
    rows = table(spark, sf, "provider_field_history").select("id", F.trim("npi").alias("npi"), "refresh_run_id").distinct()
    return rows.join(state, "npi").dropna(subset=["state"]).groupBy("state").agg(F.count("*").alias("n"), F.round(F.count("refresh_run_id") / F.count("*"), 4).alias("share")).filter("n >= 5")


def screen_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Providers clustered by a phone of at most 6, or an official in a state of at most 8, through any number of others."""
    official = F.nullif(X.official_key(F.col("official_first_name"), F.col("official_last_name")), F.lit(""))
    rows = table(spark, sf, "search_providers").select("npi", X.national_number(F.col("phone")).alias("p"), official.alias("o"), "state").distinct()
    return N.clusters(rows, "npi", [(["p"], 6), (["o", "state"], 8)])


def built_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The key table that a build makes of the provider table."""
    return I.built_keys(table(spark, sf, "search_providers")).select("npi", "name_key", "state_key", "official_key", F.array_join("phones", ",").alias("phones"), "keys_hash")


def build_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Stored pairs against those whose NPIs share a group today, standing for a new build."""
    m = members(spark, sf).select("npi", "group_id").distinct()
    left, right = m.select(F.col("npi").alias("left_npi"), "group_id"), m.select(F.col("npi").alias("right_npi"), "group_id")
    now = left.join(right, "group_id").filter("left_npi < right_npi").select("left_npi", "right_npi")  # groups are small
    return I.build_lifecycle(table(spark, sf, "registry_match_candidates"), now, "zz")


def automatic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Undecided pairs that may be merged without a person, in pages of fifty behind a cursor."""
    rows = I.undecided(table(spark, sf, "registry_match_candidates").filter(F.col("matched_keys").isin(*AUTOMATIC)), table(spark, sf, "lead_group_members"))
    return C.after(rows.select("left_npi", "right_npi"), ["left_npi", "right_npi"], ["21", ""], 50)


def group_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of at least twenty members of whole groups, by state."""
    rows = members(spark, sf).select("npi", "group_id").distinct().join(table(spark, sf, "lead_groups").select(F.col("id").alias("group_id"), "state").dropna().distinct(), "group_id")
    return N.group_pages(rows, "state", "group_id", ["group_id"], 20)


QUERIES = {
    f.__name__: f
    for f in (
        delivery_applied, change_alerts, compact_history, territory_codes, call_import, call_totals, phone_tallies, trend_kinds, reviewer_summary, match_maps, anniversaries, evidence_fields, run_metadata,
        state_heat, screen_clusters, built_keys, build_lifecycle, automatic_pairs, group_pages,
    )
}

_LAST = """runs as (select id, row_number() over (order by source_version desc, id) back from (select distinct id, source_version from refresh_runs where source = 'medicare' and status = 'applied')),
  s as (select back, trim(npi) npi, round(total_claims, 2) a, round(total_services, 2) b, round(total_beneficiaries, 2) c, round(medicare_payment, 2) d, round(medicare_allowed, 2) e, total_claims t from medicare_refresh_staging join runs on id = refresh_run_id where back <= 2
        qualify row_number() over (partition by back, trim(npi) order by created_at desc) = 1)"""
_CALLS = r"""v as (select nullif(regexp_extract(regexp_replace(replace(new_value, '"', ''), '[^0-9]', '', 'g'), '^1?([0-9]{10})$', 1), '') phone, date_trunc('minute', created_at) t, field_name agent, case when source = 'nppes' then 45 else 12 end s, refresh_run_id is null missed from provider_field_history where field_name like '%phone%'),
  r as (select *, case when phone is null then 'no valid phone number' when t is null then 'no valid date' when t > timestamp '2026-01-01' or t < timestamp '2015-01-01' then 'date out of range' else 'kept' end reason from v),
  c as (select agent, phone, t, max(s) s, arg_max(missed, (s, missed)) missed from r where reason = 'kept' group by agent, phone, t)"""
_TEXT = "trim(regexp_replace(lower(regexp_replace(coalesce({}, ''), '[.'']', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_NAME = f"array_to_string(list_filter(string_split({_TEXT.format('name')}, ' '), lambda x: x <> '' and x not in ('inc', 'incorporated', 'llc', 'ltd', 'limited', 'corp', 'corporation', 'co', 'company', 'pc', 'pllc', 'lp', 'llp')), ' ')"
_OFFICIAL = "array_to_string(list_filter(string_split(" + _TEXT.format("concat_ws(' ', official_first_name, official_last_name)") + ", ' '), lambda x: length(x) > 1), ' ')"
_TEN = lambda c, end="": f"nullif(regexp_extract(regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g'), '^1?([0-9]{{10}}){end}', 1), '')"
_M = "m as (select distinct trim(npi) npi, group_id, reviewed_by, reviewed_at, created_at from lead_group_members where npi is not null)"

ORACLE = {
    "delivery_applied": f"with {_LAST}, j as (select n.*, o.npi is not null had, (n.a, n.b, n.c, n.d, n.e) is distinct from (o.a, o.b, o.c, o.d, o.e) differs, o.t old from (select * from s where back = 1) n left join (select * from s where back = 2) o on o.npi = n.npi), k as (select *, npi in (select npi from search_providers) known, npi in (select trim(npi) from lead_group_members where npi is not null) held from j) select case when not known then 'skipped' when not had then 'inserted' when differs then 'updated' else 'unchanged' end \"action\", count(*) n, count(*) filter (known and held and old > 0 and coalesce(t, 0) < old * 0.5) alerts from k group by 1",
    "change_alerts": "with h as (select distinct trim(npi) npi, refresh_run_id, field_name from provider_field_history where npi is not null and refresh_run_id is not null and trim(npi) in (select trim(npi) from lead_group_members where npi is not null)) select npi, refresh_run_id, count(*) changes, array_to_string(list_sort(list(field_name)), ',') list, bool_or(field_name in ('status', 'name', 'authorizedofficial_lastname')) escalates from h group by 1, 2",
    "compact_history": "with h as (select field_name, case when field_name = 'record_created' then null when old_value like '{%' then old_value ->> ('$.' || field_name) else old_value end o, case when field_name = 'record_created' then 'x' when new_value like '{%' then new_value ->> ('$.' || field_name) else new_value end n from provider_field_history) select field_name, o is null from_nothing, n is null to_nothing, count(*) n from h group by all",
    "territory_codes": "with c as (select unnest(['773X0017X', '774X0117X', '999X9999X']) taxonomy_code), f as (select taxonomy_code, state, count(distinct npi) total from search_providers where state is not null group by all) select taxonomy_code, coalesce(state, '') state, coalesce(total, 0) total from c left join f using (taxonomy_code)",
    "call_import": f"with {_CALLS} select reason, count(*) n from r group by 1",
    "call_totals": f"with {_CALLS} select agent, count(*) calls, count(*) filter (not missed and s >= 15) answered, floor(coalesce(sum(s) filter (not missed and s >= 15), 0) / 60 + 0.5)::bigint talk_minutes from c where phone not like '2%' group by 1",
    "phone_tallies": f"with {_CALLS}, p as (select trim(npi) npi, {_TEN('old_value', '$')} phone from provider_field_history where field_name like '%phone%' union select trim(npi), {_TEN('new_value', '$')} from provider_field_history where field_name like '%phone%') select npi, count(*) calls, count(*) filter (not missed and s >= 15) answered from p join c using (phone) group by 1",
    "trend_kinds": "with y as (select o_custkey k, year(o_orderdate) y, sum(o_totalprice::decimal(14,2))::double a from orders where year(o_orderdate) <= 1997 group by all), b as (select k, count(*) n, coalesce(max(a) filter (y = 1997), 0) c, coalesce(max(a) filter (y = 1996), 0) p from y group by 1) select case when c = 0 then 'stopped' when n = 1 then 'single' when p = 0 then 'new' when (c - p) / p >= 0.1 then 'up' when (c - p) / p <= -0.2 then 'down' else 'flat' end kind, count(*) customers from b group by 1",
    "reviewer_summary": f"with {_M}, p as (select distinct left_npi npi, right_npi from registry_match_candidates where left_npi is not null and right_npi is not null), h as (select distinct trim(npi) npi, id from provider_field_history) select reviewed_by who, count(*) reviews, max(reviewed_at) latest, count(distinct group_id) \"groups\", coalesce(sum((select count(*) from p where p.npi = m.npi)), 0)::bigint pairs, coalesce(sum((select count(*) from h where h.npi = m.npi)), 0)::bigint changes from m where reviewed_by is not null group by 1",
    "match_maps": "with r as (select left_npi, right_npi, min(matched_keys) k from registry_match_candidates where left_npi is not null and right_npi is not null and matched_keys is not null group by 1, 2) select left_npi, '{' || string_agg(chr(34) || right_npi || chr(34) || ':' || chr(34) || k || chr(34), ',' order by right_npi) || '}' matches from r group by 1",
    "anniversaries": "with d as (select distinct npi, try_cast(left(last_updated, 10) as date) d from search_providers where last_updated is not null), n as (select npi, d, d + to_years(2025 - year(d)::int) a, d + to_years(2026 - year(d)::int) b from d where d is not null), x as (select npi, d, case when a < date '2025-12-31' then b else a end::date x from n) select npi, year(x) - year(d) as years, date_diff('day', date '2025-12-31', x) as days from x where date_diff('day', date '2025-12-31', x) < 30 and year(x) > year(d)",
    "evidence_fields": "with e as (select distinct id, evidence from lead_group_members) select coalesce(evidence ->> '$.rule', '-') as rule, count(*) members, max((evidence ->> '$.score')::double) best from e group by 1",
    "run_metadata": "with r as (select distinct id, status, coalesce(metadata, '{{}}') m from refresh_runs) select id, json_contains(json_keys(m)::json, '\"staging_state\"') staged, status note, len(list_filter(json_keys(m), lambda k: k <> 'note')) + 1 keys from r".replace("{{}}", "{}"),
    "state_heat": "with s as (select npi, max(state) state from search_providers group by 1), h as (select distinct id, trim(npi) npi, refresh_run_id from provider_field_history) select state, count(*) n, round(count(refresh_run_id) / count(*), 4) \"share\" from h join s using (npi) where state is not null group by 1 having count(*) >= 5",
    "screen_clusters": f"""with recursive q as (select distinct npi, {_TEN('phone', '$')} p, nullif({_OFFICIAL}, '') o, state s from search_providers),
      h as (select npi, 'p' || p k from q where p is not null union select npi, 'o' || o || '|' || s from q where o is not null and s is not null),
      l as (select k, min(npi) m from h group by k having count(*) between 2 and case when k like 'p%' then 6 else 8 end), t as (select distinct npi a, m b from h join l using (k) where npi <> m), e as (select a, b from t union select b, a from t),
      reach(s, v) as (select a, a from e union select s, b from reach join e on v = a where b > s), f as (select v, min(s) branch from reach group by v)
      select distinct npi, coalesce(branch, npi) branch from q left join f on v = npi""",
    "built_keys": f"with k as (select distinct trim(npi) npi, {_NAME} name_key, upper(regexp_replace(coalesce(state, ''), '[^A-Za-z]', '', 'g')) state_key, {_OFFICIAL} official_key, array_to_string(list_sort(list_distinct(list_filter([{_TEN('phone')}, {_TEN('official_phone')}], lambda x: x is not null))), ',') phones from search_providers where coalesce(is_organization, enumeration_type = 'NPI-2', false)) select *, md5(name_key || '|' || state_key || '|' || official_key || '|' || phones) keys_hash from k where name_key <> '' and (official_key <> '' or phones <> '')",
    "build_lifecycle": f"with {_M}, g as (select distinct npi, group_id from m), n as (select distinct a.npi left_npi, b.npi right_npi from g a join g b using (group_id) where a.npi < b.npi), o as (select left_npi, right_npi, min(first_build_id) f, max(last_build_id) l from registry_match_candidates where left_npi is not null and right_npi is not null group by 1, 2) select coalesce(o.left_npi, n.left_npi) left_npi, coalesce(o.right_npi, n.right_npi) right_npi, coalesce(f, 'zz') first_build_id, case when n.left_npi is not null then 'zz' else l end last_build_id, case when o.left_npi is null then 'new' when n.left_npi is null then 'dropped' else 'kept' end state from o full join n on o.left_npi = n.left_npi and o.right_npi = n.right_npi",
    "automatic_pairs": "with b as (select distinct least(left_npi, right_npi) l, greatest(left_npi, right_npi) r from registry_match_candidates where left_npi <> right_npi and matched_keys in ('name+state+phone', 'name+state+official', 'state+official+phone', 'official+phone')), g as (select npi, min(group_id) g from lead_group_members group by npi) select l left_npi, r right_npi from b left join g x on x.npi = l left join g y on y.npi = r where (x.g is null or y.g is null or x.g <> y.g) and (l, r) > ('21', '') order by 1, 2 limit 51",
    "group_pages": f"""with recursive {_M}, n as (select state, group_id, count(distinct m.npi) n from m join (select distinct id, state from lead_groups where state is not null) g on g.id = group_id group by 1, 2), o as (select *, row_number() over (partition by state order by group_id) r from n),
      w as (select state, group_id, r, 0 page, n filled from o where r = 1 union all select o.state, o.group_id, o.r, case when w.filled >= 20 then w.page + 1 else w.page end, case when w.filled >= 20 then o.n else w.filled + o.n end from w join o on o.state = w.state and o.r = w.r + 1)
      select state, group_id, page from w""",
}
