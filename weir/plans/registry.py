"""Queries over whole registry tables: heavy buckets, value history, delivery changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.canonical import canonical_value, json_scalar
from weir.operators.buckets import bucket_members
from weir.operators.history import Satellites, change_rates
from weir.operators.skew import distinct_items_by_key
from weir.operators.snapshots import snapshot_changes
from weir.scratch import Scratch
from weir.sources.tables import table

#: The largest bucket whose members are still paired with each other.
BUCKET_CAP = 25
MEASURES = ["total_claims", "total_services", "total_beneficiaries", "medicare_payment", "medicare_allowed"]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets with more than 25 distinct NPIs."""
    members = bucket_members(table(spark, sf, "npi_identity_keys"))
    return distinct_items_by_key(members, ["bucket_type", "bucket_key"], "npi", more_than=BUCKET_CAP).select("bucket_type", "bucket_key")


def p2_bucket_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The number of distinct NPIs of every bucket."""
    members = bucket_members(table(spark, sf, "npi_identity_keys"))
    return distinct_items_by_key(members, ["bucket_type", "bucket_key"], "npi").withColumnRenamed("n", "member_count")


def field_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Change rows of provider_field_history with the date on which they take effect."""
    runs = table(spark, sf, "refresh_runs").select(F.col("id").alias("run"), "source_version")
    rows = table(spark, sf, "provider_field_history").filter("field_name != 'record_created'")
    return rows.join(runs.dropDuplicates(["run"]), rows.refresh_run_id == runs.run, "left").select(
        F.nullif(F.trim("npi"), F.lit("")).alias("npi"), "field_name", "new_value", "created_at", "id",
        F.coalesce("source_version", F.date_format("created_at", "yyyy-MM-dd")).alias("effective"),
    )


def satellites(spark: SparkSession, sf: str) -> Satellites:
    """The history's satellites: what was reported by its date and what came later, as two loads."""
    reports = field_reports(spark, sf)
    rates = change_rates(reports, key="npi", attribute="field_name")
    store = Satellites(spark, Scratch(spark, "satellites").path, rates, key="npi", attribute="field_name", effective="effective", order=["created_at", "id"])
    late = F.coalesce(F.date_format("created_at", "yyyy-MM-dd") > F.date_format(F.date_add(F.to_date("effective"), 31), "yyyy-MM-dd"), F.lit(False))
    value = canonical_value(F.col("field_name"), json_scalar(F.col("new_value")))
    for batch in (reports.filter(~late), reports.filter(late)):
        store.load(batch, value)
    return store


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every version of every provider field, with the period in which it held."""
    return satellites(spark, sf).view().select("npi", "field_name", "valid_from", "valid_to")


def p3_satellites(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of each field, and the satellite that its change rate puts them in."""
    return satellites(spark, sf).view().groupBy("field_name", "satellite").agg(F.count("*").alias("versions"), F.count("value").alias("versions_with_value"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """NPIs added, removed or changed in each applied medicare delivery against the one before."""
    runs = table(spark, sf, "refresh_runs").filter("source = 'medicare' and status = 'applied'").dropDuplicates(["id"])
    return snapshot_changes(
        table(spark, sf, "medicare_refresh_staging"), runs, key="npi", measures=MEASURES,
        run="refresh_run_id", run_id="id", version="source_version", latest="created_at",
    )


def p4_change_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many NPIs each delivery added, removed and changed."""
    return p4_found(spark, sf).groupBy("refresh_run_id", "change").agg(F.count("*").alias("npis"))


QUERIES = {f.__name__: f for f in (p2_found, p2_bucket_counts, p3_found, p3_satellites, p4_found, p4_change_counts)}

_BUCKETS = """
with k as (select distinct trim(npi) npi, nullif(name_key, '') name, nullif(official_key, '') official, phones from npi_identity_keys where trim(npi) <> ''),
p as (select npi, name, official, unnest(phones) phone from k),
b as (select 'op' bucket_type, official || '|' || phone bucket_key, npi from p where phone <> ''
      union select 'np', name || '|' || phone, npi from p where phone <> ''
      union select 'no', name || '|' || official, npi from k),
n as (select bucket_type, bucket_key, count(distinct npi) member_count from b where bucket_key is not null group by all)
"""

_DIGITS = r"regexp_replace(regexp_replace(v, '\.0+$', ''), '[^0-9]', '', 'g')"
_VERSIONS = rf"""
with raw as (
  select nullif(trim(h.npi), '') npi, h.field_name, h.created_at, h.id, coalesce(r.source_version, strftime(h.created_at, '%Y-%m-%d')) effective,
    trim(case when h.new_value like '"%' and json_valid('{{"v":' || h.new_value || '}}') then json_extract_string('{{"v":' || h.new_value || '}}', '$.v')
              when trim(h.new_value) = 'null' then null else h.new_value end) v
  from provider_field_history h left join (select distinct id, source_version from refresh_runs) r on h.refresh_run_id = r.id where h.field_name <> 'record_created'),
dig as (select *, {_DIGITS} d from raw),
canon as (
  select npi, field_name, effective, created_at, id,
    case when v is null or v in ('', '{{}}') then null
      when regexp_matches(field_name, 'phone|fax') then nullif(case when regexp_matches(d, '^1?[0-9]{{10}}') then regexp_extract(d, '^1?([0-9]{{10}})', 1) else d end, '')
      when regexp_matches(field_name, 'postal') then nullif(case when length(d) in (4, 8) then '0' || d else d end, '')
      when regexp_matches(field_name, 'date|lastupdated') then
        case when regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then left(v, 10)
             when regexp_matches(v, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') then split_part(v, '/', 3) || '-' || lpad(split_part(v, '/', 1), 2, '0') || '-' || lpad(split_part(v, '/', 2), 2, '0')
             else upper(v) end
      when field_name = 'status' then case lower(v) when 'a' then 'active' when 'd' then 'deactivated' else lower(v) end
      else upper(regexp_replace(v, '\s+', ' ', 'g')) end value
  from dig),
last as (select * from canon where npi is not null qualify row_number() over (partition by npi, field_name, effective order by created_at desc, id desc) = 1),
lagged as (select *, lag(value) over w before, row_number() over w n from last window w as (partition by npi, field_name order by effective)),
versions as (select * from lagged where n = 1 or value is distinct from before)
"""

_CHANGES = """
with runs as (select id, lag(id) over (order by source_version, id) prior from (select distinct id, source_version from refresh_runs where source = 'medicare' and status = 'applied')),
s as (select refresh_run_id run, trim(npi) npi, round(total_claims, 2) a, round(total_services, 2) b, round(total_beneficiaries, 2) c, round(medicare_payment, 2) d, round(medicare_allowed, 2) e
      from medicare_refresh_staging where trim(npi) <> '' qualify row_number() over (partition by refresh_run_id, trim(npi) order by created_at desc) = 1),
n as (select r.id, s.* from runs r join s on s.run = r.id where r.prior is not null),
o as (select r.id, s.* from runs r join s on s.run = r.prior),
c as (select coalesce(n.id, o.id) refresh_run_id, coalesce(n.npi, o.npi) npi,
        case when o.npi is null then 'added' when n.npi is null then 'removed'
             when (n.a, n.b, n.c, n.d, n.e) is distinct from (o.a, o.b, o.c, o.d, o.e) then 'changed' end change
      from n full join o on n.id = o.id and n.npi = o.npi)
"""

ORACLE = {
    "p2_found": _BUCKETS + f"select bucket_type, bucket_key from n where member_count > {BUCKET_CAP}",
    "p2_bucket_counts": _BUCKETS + "select bucket_type, bucket_key, member_count from n",
    "p3_found": _VERSIONS
    + "select npi, field_name, effective valid_from, coalesce(lead(effective) over (partition by npi, field_name order by effective), '9999-12-31') valid_to from versions",
    "p3_satellites": _VERSIONS + """,
      rates as (select field_name, case when count(*) / greatest(count(distinct nullif(trim(npi), '')), 1) >= 1.5 then 'fast' else 'slow' end satellite
                from provider_field_history where field_name <> 'record_created' group by field_name)
      select v.field_name, count(*) versions, count(value) versions_with_value, r.satellite from versions v join rates r using (field_name) group by v.field_name, r.satellite""",
    "p4_found": _CHANGES + "select refresh_run_id, npi, change from c where change is not null",
    "p4_change_counts": _CHANGES + "select refresh_run_id, change, count(*) npis from c where change is not null group by all",
}
