"""Queries over groups of identical providers, search criteria and deliveries, with the SQL that each must agree with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions import labels as L
from weir.functions import text as X
from weir.operators import contacts as K
from weir.operators import criteria as C
from weir.operators import groups as U
from weir.operators import identity as I
from weir.operators import related as N
from weir.sources.tables import table

NOW = "2025-12-31"
LOOKUPS = [{"phone": "8980094192"}, {"q": "ann"}, {"city": " dunmarsh "}, {"organizationName": "w*n"}, {"taxonomyCodes": ["773X0017X", "775X0217X"], "states": ["TX"]}, {"lastUpdatedYears": ["2025"], "zipPrefix": "01", "activeMedicare": True}]
NARROW = {"states": ["CA", "TX", "FL", "OH"], "hasPhone": True, "hasDecisionMaker": True, "minMedicareClaims": 50, "nameContains": ["medical", "health"]}
TEAM = [{"newSupplier": True}, {"establishedSupplier": True}, {"untouched": True}, {"tag": "manual"}, {"objection": "pending"}, {"untouched": True, "hasPhone": True, "states": ["TX", "CA"]}]


def providers(spark: SparkSession, sf: str) -> DataFrame:
    """search_providers without exact repetitions, as far as criteria read it."""
    return table(spark, sf, "search_providers").select(C.COLUMNS).distinct()


def identities(spark: SparkSession, sf: str) -> DataFrame:
    """(npi, name, state, official, phone, identity_key) of the newest key row of each NPI; of several phones the least."""
    phone = F.array_min(F.filter("phones", lambda p: F.trim(p) != ""))
    rows = I.latest_keys(table(spark, sf, "npi_identity_keys")).select("npi", F.col("name_key").alias("name"), F.col("state_key").alias("state"), F.col("official_key").alias("official"), phone.alias("phone"))
    return rows.withColumn("identity_key", L.identity_key(F.col("npi"), F.col("name"), F.col("official"), F.col("phone")))


def members(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lead_group_members").select(F.trim("npi").alias("npi"), "group_id", "relationship_type", "reviewed_by", "reviewed_at").dropna(subset=["npi"]).distinct()


def owners(spark: SparkSession, sf: str) -> DataFrame:
    """(group_id, owner): who reviewed members of a group."""
    return members(spark, sf).select("group_id", F.col("reviewed_by").alias("owner")).dropna().distinct()


def identity_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The identity key of each NPI and the MD5 of its key row."""
    keys = I.latest_keys(table(spark, sf, "npi_identity_keys"))
    phones = F.array_join(F.array_sort(F.array_distinct("phones")), ",")
    hashed = keys.select("npi", L.row_md5(F.col("name_key"), F.col("state_key"), F.col("official_key"), phones).alias("row_hash"))
    return identities(spark, sf).select("npi", "identity_key").join(hashed, "npi")


def new_members(spark: SparkSession, sf: str) -> DataFrame:
    """NPIs without a group, the group of their identity key, and whether that is in several states."""
    return U.new_members(identities(spark, sf).select("npi", "identity_key", "state"), members(spark, sf))


def key_states(spark: SparkSession, sf: str) -> DataFrame:
    """The state of each shared identity key, if its members agree on one."""
    shared = identities(spark, sf).filter("identity_key like 'group:%'").withColumn("state", F.nullif("state", F.lit("")))
    return U.representative(shared, "identity_key", "state")


def group_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Unreviewed members whose identity key points to the group that most members of the key are in."""
    of = members(spark, sf).join(identities(spark, sf), "npi").filter("identity_key like 'group:%'")
    wanted = N.most_common(of, ["identity_key"], "group_id").select("identity_key", "group_id")
    goal = of.select("npi", "identity_key").distinct().join(wanted, "identity_key").select("npi", "group_id")
    return U.moves(members(spark, sf).groupBy("npi", "group_id").agg(F.max(F.col("reviewed_by").isNotNull()).alias("reviewed")), goal, F.col("reviewed"))


def owner_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Groups whose members several people reviewed."""
    return U.owner_conflicts(members(spark, sf), "reviewed_by")


def undecided_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of groups that matches of the second tier join and no match of the third names: both stand for decisions here."""
    pairs = table(spark, sf, "registry_match_candidates").select(F.trim("left_npi").alias("left_npi"), F.trim("right_npi").alias("right_npi"), "tier").dropna()
    return U.undecided_groups(pairs.filter("tier = 2"), members(spark, sf), pairs.filter("tier = 3"))


def merge_preview(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs of groups could be merged, and how many have more than one owner."""
    return U.merge_preview(undecided_groups(spark, sf), owners(spark, sf))


def merged_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The group of each member after all pairs of groups that second-tier matches join were merged."""
    pairs = table(spark, sf, "registry_match_candidates").filter("tier = 2").select(F.trim("left_npi").alias("left_npi"), F.trim("right_npi").alias("right_npi"), "tier").dropna()
    joined = U.with_groups(pairs, members(spark, sf)).filter("left_group not like 'npi:%' and right_group not like 'npi:%'")
    return U.merged_groups(members(spark, sf), joined.select(F.least("left_group", "right_group").alias("a"), F.greatest("left_group", "right_group").alias("b")))


def signals(spark: SparkSession, sf: str, how: str) -> DataFrame:
    """(npi, name, state, official, phone) of the providers that are in a group (left_semi) or in none (left_anti)."""
    rows = table(spark, sf, "search_providers").join(members(spark, sf).select("npi"), "npi", how)
    official = X.official_key(F.col("official_first_name"), F.col("official_last_name"))
    return rows.select("npi", X.name_key(F.col("name")).alias("name"), X.state_key(F.col("state")).alias("state"), official.alias("official"), X.national_number(F.col("phone")).alias("phone")).distinct()


def candidate_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Grouped providers that those without a group may be the same as, by rule, also with similar names."""
    return U.candidate_matches(signals(spark, sf, "left_anti"), signals(spark, sf, "left_semi"))


def exact_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The same with equal names only."""
    return U.candidate_matches(signals(spark, sf, "left_anti"), signals(spark, sf, "left_semi"), similar=False)


def preflight(spark: SparkSession, sf: str) -> DataFrame:
    """What each provider without a group would meet on import; those of the sheets count as taken."""
    taken = table(spark, sf, "pis_to_resolve_recheck").select(F.trim("candidate_npi").alias("npi")).dropna()
    return U.preflight(signals(spark, sf, "left_anti"), taken, candidate_matches(spark, sf), members(spark, sf), owners(spark, sf))


def import_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The sheets' candidates by what is known of them: in a group, deactivated, linked by a match, or new."""
    ids = table(spark, sf, "pis_to_resolve_recheck").select(F.trim("candidate_npi").alias("npi")).dropna()
    pairs = table(spark, sf, "registry_match_candidates")
    gone = table(spark, sf, "search_providers").filter(F.upper("status").isin("D", "DEACTIVATED")).select("npi")
    return U.verdicts(ids, "npi", [("grouped", members(spark, sf).select("npi")), ("deactivated", gone), ("linked", pairs.select("left_npi").union(pairs.select("right_npi")))], "new")


def filled_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates without an official's phone, filled from the registry: its name goes first, the sheet's own phone stays."""
    rows = table(spark, sf, "pis_to_resolve_recheck").filter("candidate_npi is not null").select(F.trim("candidate_npi").alias("npi"), F.col("candidate_legal_name").alias("name"), F.col("candidate_phone").alias("phone"), F.col("candidate_auth_phone").alias("official_phone")).distinct()
    known = table(spark, sf, "search_providers").select("npi", "name", "phone", "official_phone")
    return U.filled(rows, known, "npi", theirs_first=["name"], ours_first=["phone", "official_phone"], lacking=F.trim(F.coalesce("official_phone", F.lit(""))) == "")


def search_sorts(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten active organizations by each sort mode."""
    rows = providers(spark, sf)
    pages = [C.page(rows, {}, sort=mode, limit=10).select(F.lit(mode).alias("mode"), "npi") for mode in C.SORTS]
    return reduce(DataFrame.unionByName, pages)


def search_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of each lookup, all in one scan."""
    return C.quick_counts(providers(spark, sf), {f"lookup{i}": c for i, c in enumerate(LOOKUPS)})


def search_relaxations(spark: SparkSession, sf: str) -> DataFrame:
    """How many more a search would find without each one of its criteria."""
    return C.relaxations(providers(spark, sf), NARROW)


def team_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of the criteria that ask for what the team knows of a provider: changes stand for tags, reviews for objections."""
    rows = providers(spark, sf)
    found = table(spark, sf, "lead_group_members").select(F.trim("npi").alias("npi"), F.get_json_object("evidence", "$.rule").alias("tag"), F.col("review_status").alias("objection"))
    touched = [found.select("npi"), table(spark, sf, "registry_match_candidates").select(F.col("left_npi").alias("npi"))]
    notes = C.team_flags(rows, touched=touched, tags=found.select("npi", "tag"), objections=found.select("npi", "objection"))
    return C.quick_counts(notes, {f"team{i}": c for i, c in enumerate(TEAM)}, today=NOW, since="last_updated")


def page_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """NPIs that are on two consecutive pages: none."""
    rows = providers(spark, sf)
    first, second = (C.page(rows, {}, sort="name", limit=50, skip=skip).select("npi") for skip in (0, 50))
    return first.intersect(second).agg(F.count("*").alias("twice"))


def flat_providers(spark: SparkSession, sf: str) -> DataFrame:
    """Providers in the flat form of an export: codes filled in, dates as text, addresses in one."""
    rows = table(spark, sf, "search_providers").distinct()  # all of its columns are shown
    return rows.select(
        "npi", F.coalesce("enumeration_type", F.when(F.col("is_organization"), "NPI-2").otherwise("NPI-1")).alias("kind"), X.clean_text(F.col("name")).alias("name"),
        F.concat_ws(", ", *[X.clean_text(F.col(c)) for c in ("address_line1", "address_line2", "city", "state", "postal_code")]).alias("address"),
        F.date_format(X.parse_date(F.col("last_updated")), "MM/dd/yyyy").alias("updated"), X.clean_text(F.concat_ws(" ", "official_first_name", "official_last_name")).alias("official"), F.coalesce("medicare_total_claims", F.lit(0.0)).alias("claims"),
    )


def provider_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Forty providers at random."""
    return K.sample_rows(table(spark, sf, "search_providers").select("npi", "state").distinct(), "npi", 40, "seed")


def work_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Groups to look at: those that wait for a review, the largest tiers left open, and the ones longest without a change."""
    rows = table(spark, sf, "lead_groups").select("id", "review_status", "grouping_tier", "updated_at").distinct()
    pending = F.coalesce(F.col("review_status") == "pending", F.lit(False))
    lists = {
        "review": (pending, [F.asc_nulls_last("updated_at"), F.asc("id")], 50),
        "cross_state": (F.coalesce(F.col("grouping_tier") == "cross_state", F.lit(False)) & ~pending, [F.desc_nulls_last("updated_at"), F.asc("id")], 6),
        "quiet": (F.col("updated_at") < F.lit("2025-01-01").cast("timestamp_ntz"), [F.asc("updated_at"), F.asc("id")], 60),
    }
    return K.capped_lists(rows, lists, ["id"])


def group_rows(spark: SparkSession, sf: str, term: str) -> DataFrame:
    rows = table(spark, sf, "lead_groups").select("id", "canonical_name", "state", "authorized_official", "phone_key", "review_status", "updated_at").distinct()
    return rows.filter(C.text_matches(["canonical_name", "authorized_official", "state"], term, ["phone_key"]))


def group_list(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of ten groups that mention a word, the newest first."""
    return group_rows(spark, sf, " Medical ").orderBy(F.desc_nulls_last("updated_at"), "id").offset(10).limit(10).select("id", "canonical_name")


def group_list_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many groups mention it, by where they stand, in one scan."""
    status = F.coalesce("review_status", F.lit(""))
    rows = group_rows(spark, sf, " Medical ")
    return rows.agg(F.count("*").alias("found"), F.count_if(status == "pending").alias("pending"), F.count_if(status == "approved").alias("approved"), F.count_if(F.col("updated_at") < F.lit("2025-07-01").cast("timestamp_ntz")).alias("old"))


def listed_providers(spark: SparkSession, sf: str) -> DataFrame:
    """Providers whose name holds words of a list, or whose official is on one."""
    rows = table(spark, sf, "search_providers").select("npi", "name", F.concat_ws(" ", "official_first_name", "official_last_name").alias("official")).distinct()
    return C.listed(rows, "name", ["Health Supply", "OXYGEN"], "official", ["Katrin Undincalrel", "leoni grenotane"]).filter("listed").select("npi")


def stale_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Taxonomies of which no provider was updated in the last five days."""
    rows = table(spark, sf, "search_providers").select("taxonomy_code", F.col("last_updated").try_cast("timestamp_ntz").alias("at"))
    return C.stale(rows.select("taxonomy_code").dropna().distinct(), rows, "taxonomy_code", "at", f"{NOW} 00:00:00", 24 * 5)


def related_grouped_first(spark: SparkSession, sf: str) -> DataFrame:
    """Up to two others of each provider by phone or official and state, those in a group first."""
    rows = table(spark, sf, "search_providers").select("npi", X.national_number(F.col("phone")).alias("p"), F.nullif(X.official_key(F.col("official_first_name"), F.col("official_last_name")), F.lit("")).alias("o"), "state").distinct()
    return N.related(rows, "npi", {"phone": (["p"], 6), "owner": (["o", "state"], 8)}, top=2, first=members(spark, sf).select("npi"))


QUERIES = {
    f.__name__: f
    for f in (
        identity_rows, new_members, key_states, group_moves, owner_conflicts, undecided_groups, merge_preview, merged_groups, candidate_matches, exact_matches, preflight, import_verdicts, filled_candidates, search_sorts, search_lookups,
        search_relaxations, team_filters, page_overlap, flat_providers, provider_sample, work_lists, group_list, group_list_counts, listed_providers, stale_codes, related_grouped_first,
    )
}

_ORG = "coalesce(is_organization, enumeration_type = 'NPI-2', true) and deactivation_date is null and upper(coalesce(status, 'A')) in ('A', 'ACTIVE')"
_S = "s as (select distinct * from search_providers)"
_ID = """k as (select trim(npi) npi, arg_max({'n': name_key, 's': state_key, 'o': official_key, 'p': phones}, updated_at) k from npi_identity_keys group by 1),
  i as (select npi, k.n n, k.s s, k.o o, k.p ps, list_min(list_filter(k.p, lambda x: trim(x) <> '')) p from k),
  d as (select *, case when coalesce(n, '') <> '' and coalesce(o, '') <> '' and coalesce(p, '') <> '' then 'group:' || n || '|' || o || '|' || p else 'singleton:' || npi end identity_key from i)"""
_M = "m as (select distinct trim(npi) npi, group_id, relationship_type, reviewed_by from lead_group_members where npi is not null)"
_C = "c as (select distinct trim(left_npi) l, trim(right_npi) r, tier from registry_match_candidates where left_npi is not null and right_npi is not null and tier is not null)"
_PAIRS = f"{_M}, g as (select npi, min(group_id) g from m group by 1), {_C}, w as (select tier, coalesce(a.g, 'npi:' || l) x, coalesce(b.g, 'npi:' || r) y from c left join g a on a.npi = l left join g b on b.npi = r), u as (select distinct least(x, y) a, greatest(x, y) b, tier from w where x <> y)"
_OPEN = f"{_PAIRS}, e as (select a, b, min(tier) tier from u where tier = 2 and not exists (select 1 from u v where v.tier = 3 and v.a = u.a and v.b = u.b) group by a, b)"
_DIG = "regexp_replace(coalesce({}, ''), '[^0-9]', '', 'g')"
_CLAUSES = {"states": "upper(trim(state)) in ('CA', 'TX', 'FL', 'OH')", "hasPhone": "trim(coalesce(phone, '')) <> ''", "hasDecisionMaker": "trim(coalesce(official_last_name, '')) <> ''", "minMedicareClaims": "coalesce(medicare_total_claims, 0) >= 50", "nameContains": "(name ilike '%medical%' or name ilike '%health%')"}
_TEXT = "trim(regexp_replace(lower(regexp_replace(coalesce({}, ''), '[.'']', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_LEGAL = "'llc', 'inc', 'corp', 'corporation', 'co', 'company', 'ltd', 'limited', 'lp', 'llp', 'pllc', 'pc', 'incorporated'"
_SIGNALS = f"""q as (select distinct npi, nullif(array_to_string(list_filter(string_split({_TEXT.format('name')}, ' '), lambda x: x <> '' and x not in ({_LEGAL})), ' '), '') n, nullif(upper(regexp_replace(coalesce(state, ''), '[^A-Za-z]', '', 'g')), '') s,
  nullif(array_to_string(list_filter(string_split({_TEXT.format("concat_ws(' ', official_first_name, official_last_name)")}, ' '), lambda x: length(x) > 1), ' '), '') o, nullif(regexp_extract({_DIG.format('phone')}, '^1?([0-9]{{10}})$', 1), '') p from search_providers),
  a as (select * from q where npi not in (select npi from m)), b as (select * from q where npi in (select npi from m)),
  kn as (select n from b where n is not null group by n having count(*) <= 200), ko as (select o from b where o is not null group by o having count(*) <= 200), kp as (select p from b where p is not null group by p having count(*) <= 200),
  x as (select a.npi, b.npi other from a join b on a.n = b.n join kn on kn.n = b.n union select a.npi, b.npi from a join b on a.o = b.o join ko on ko.o = b.o union select a.npi, b.npi from a join b on a.p = b.p join kp on kp.p = b.p),
  f as (select x.npi, other, coalesce(a.n = b.n, false) n, coalesce(a.s = b.s, false) s, coalesce(a.o = b.o, false) o, coalesce(a.p = b.p, false) p from x join a using (npi) join b on b.npi = other)"""
_CLEAN = lambda c: f"nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '')"

ORACLE = {
    "identity_rows": f"with {_ID} select npi, identity_key, md5(concat_ws('|', coalesce(n, ''), coalesce(s, ''), coalesce(o, ''), coalesce(array_to_string(list_sort(list_distinct(ps)), ','), ''))) row_hash from d",
    "new_members": f"with {_ID}, {_M}, x as (select identity_key, count(distinct nullif(s, '')) > 1 cross_state from d group by 1) select npi, md5(identity_key) group_id, cross_state from d join x using (identity_key) where npi not in (select npi from m)",
    "key_states": f"with {_ID} select identity_key, case when count(distinct nullif(s, '')) <= 1 then min(nullif(s, '')) end state from d where identity_key like 'group:%' group by 1",
    "group_moves": f"with {_ID}, {_M}, z as (select m.*, d.identity_key from m join d using (npi) where identity_key like 'group:%'), b as (select identity_key, group_id from z group by all qualify row_number() over (partition by identity_key order by count(*) desc, group_id) = 1), t as (select distinct z.npi, b.group_id to_group from z join b using (identity_key)), f as (select npi, group_id, bool_or(reviewed_by is not null) reviewed from m group by all) select npi, f.group_id from_group, to_group from f join t using (npi) where not reviewed and f.group_id <> to_group".replace("group by all qualify", "group by identity_key, group_id qualify"),
    "owner_conflicts": f"with {_M} select group_id, count(distinct reviewed_by) owners, array_to_string(list_sort(list(distinct reviewed_by)), ',') list from m where reviewed_by is not null group by 1 having count(distinct reviewed_by) > 1",
    "undecided_groups": f"with {_OPEN} select * from e",
    "merge_preview": f"with {_OPEN}, o as (select distinct group_id, reviewed_by o from m where reviewed_by is not null), n as (select a, b, (select count(distinct o) from o where group_id in (e.a, e.b)) n from e) select count(*) pairs, count(*) filter (n > 1) blocked, count(*) filter (n <= 1) mergeable from n",
    "merged_groups": f"""with recursive {_PAIRS}, l as (select a, b from u where tier = 2 and a not like 'npi:%' and b not like 'npi:%'), f as (select a, b from l union select b, a from l),
      reach(s, v) as (select a, a from f union select s, f.b from reach join f on v = f.a), z as (select group_id, count(distinct npi) n from m group by 1),
      t as (select s, v from reach join z on group_id = v qualify row_number() over (partition by s order by n desc, v) = 1)
      select distinct npi, coalesce(v, group_id) group_id from m left join t on s = group_id""",
    "exact_matches": f"""with {_M}, {_SIGNALS}, r as (select npi, other, case when n and s and o and p then 1 when n and o and p then 2 when n and s and p then 3 when n and s and o then 4 when s and o and p then 5 when o and p then 6 when n and p then 7 when n and o then 8 end r from f)
      select npi, other, case when r = 1 then 1 when r <= 5 then 2 else 3 end tier, ['name+state+official+phone', 'name+official+phone', 'name+state+phone', 'name+state+official', 'state+official+phone', 'official+phone', 'name+phone', 'name+official'][r] keys, case when r not in (5, 6) then 'exact' end name_match, r <= 2 automatic from r where r is not null""",
    "import_verdicts": "with i as (select distinct trim(candidate_npi) npi from pis_to_resolve_recheck where candidate_npi is not null) select npi, case when npi in (select trim(npi) from lead_group_members where npi is not null) then 'grouped' when npi in (select npi from search_providers where upper(status) in ('D', 'DEACTIVATED')) then 'deactivated' when npi in (select left_npi from registry_match_candidates where left_npi is not null union select right_npi from registry_match_candidates where right_npi is not null) then 'linked' else 'new' end verdict from i",
    "filled_candidates": "with r as (select distinct trim(candidate_npi) npi, candidate_legal_name n, candidate_phone p, candidate_auth_phone o from pis_to_resolve_recheck where candidate_npi is not null), k as (select npi, min(nullif(trim(name), '')) kn, min(nullif(trim(phone), '')) kp, min(nullif(trim(official_phone), '')) ko from search_providers group by 1) select npi, case when trim(coalesce(o, '')) = '' then coalesce(kn, nullif(trim(n), '')) else n end as name, case when trim(coalesce(o, '')) = '' then coalesce(nullif(trim(p), ''), kp) else p end phone, case when trim(coalesce(o, '')) = '' then ko else o end official_phone from r left join k using (npi)",
    "search_sorts": f"with {_S}, a as (select * from s where {_ORG}) " + " union all ".join(f"select * from (select '{m}' \"mode\", npi from a order by {o} limit 10)" for m, o in {"medicare": "medicare_total_claims desc nulls last, npi", "updated": "last_updated desc nulls last, npi", "name": "name nulls last, npi", "npi": "npi"}.items()),
    "search_lookups": f"with {_S}, a as (select *, {_DIG.format('postal_code')} z, right({_DIG.format('phone')}, 10) p1, right({_DIG.format('official_phone')}, 10) p2 from s where {_ORG}) " + " union all ".join(f"select 'lookup{i}' pick, count(*) n from a where {w}" for i, w in enumerate(["p1 = '8980094192' or p2 = '8980094192'", "name ilike '%ann%' or concat_ws(' ', official_first_name, official_last_name) ilike '%ann%'", "upper(trim(city)) = 'DUNMARSH'", "name ilike 'w%n%'", "taxonomy_code in ('773X0017X', '775X0217X') and upper(trim(state)) = 'TX'", "last_updated >= '2025-01-01' and last_updated < '2026-01-01' and coalesce(medicare_total_claims, 0) >= 1"])),
    "search_relaxations": f"with {_S}, a as (select * from s where {_ORG}), f as (select count(*) n from a where {' and '.join(_CLAUSES.values())}) " + " union all ".join(f"select '{k}' dropped, (select count(*) from a where {' and '.join(v for j, v in _CLAUSES.items() if j != k)}) found, (select count(*) from a where {' and '.join(v for j, v in _CLAUSES.items() if j != k)}) - n more from f" for k in _CLAUSES),
    "team_filters": f"with {_S}, a as (select *, npi in (select trim(npi) from lead_group_members where npi is not null) or npi in (select left_npi from registry_match_candidates where left_npi is not null) t, npi in (select trim(npi) from lead_group_members where npi is not null and evidence ->> '$.rule' = 'manual') g, npi in (select trim(npi) from lead_group_members where npi is not null and review_status = 'pending') o from s where {_ORG}) " + " union all ".join(f"select 'team{i}' pick, count(*) n from a where {w}" for i, w in enumerate(["last_updated >= '2023-12-31'", "last_updated <= '2010-12-31'", "not t", "g", "o", "not t and trim(coalesce(phone, '')) <> '' and upper(trim(state)) in ('TX', 'CA')"])),
    "page_overlap": f"with {_S}, a as (select npi, row_number() over (order by name nulls last, npi) r from s where {_ORG}) select count(*) twice from (select npi from a where r <= 50 intersect select npi from a where r between 51 and 100)",
    "flat_providers": f"with {_S} select npi, coalesce(enumeration_type, case when is_organization then 'NPI-2' else 'NPI-1' end) kind, {_CLEAN('name')} as name, concat_ws(', ', {', '.join(_CLEAN(c) for c in ('address_line1', 'address_line2', 'city', 'state', 'postal_code'))}) address, strftime(try_cast(left(last_updated, 10) as date), '%m/%d/%Y') updated, {_CLEAN(chr(99) + 'oncat_ws(' + repr(' ') + ', official_first_name, official_last_name)')} official, coalesce(medicare_total_claims, 0) claims from s",
    "provider_sample": "select npi, state from (select distinct npi, state from search_providers) order by md5('seed|' || npi), npi limit 40",
    "work_lists": "with g as (select distinct id, review_status s, grouping_tier t, updated_at u from lead_groups), a as (select 'review' list, id, row_number() over (order by u nulls last, id) place from g where s = 'pending' union all select 'cross_state', id, row_number() over (order by u desc nulls last, id) from g where t = 'cross_state' and coalesce(s, '') <> 'pending' union all select 'quiet', id, row_number() over (order by u, id) from g where u < timestamp '2025-01-01') select list, place, id from a where place <= case list when 'review' then 50 when 'quiet' then 60 else 6 end",
    "group_list": "select id, canonical_name from (select distinct id, canonical_name, state, authorized_official, phone_key, review_status, updated_at from lead_groups where canonical_name ilike '%medical%' or authorized_official ilike '%medical%' or state ilike '%medical%') order by updated_at desc nulls last, id limit 10 offset 10",
    "group_list_counts": "select count(*) found, count(*) filter (review_status = 'pending') pending, count(*) filter (review_status = 'approved') approved, count(*) filter (updated_at < timestamp '2025-07-01') old from (select distinct id, canonical_name, state, authorized_official, phone_key, review_status, updated_at from lead_groups where canonical_name ilike '%medical%' or authorized_official ilike '%medical%' or state ilike '%medical%')",
    "listed_providers": "with p as (select distinct npi, ' ' || trim(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' n, trim(regexp_replace(lower(concat_ws(' ', official_first_name, official_last_name)), '[^a-z0-9]+', ' ', 'g')) o from search_providers) select npi from p where contains(n, ' health supply ') or contains(n, ' oxygen ') or o in ('katrin undincalrel', 'leoni grenotane')",
    "stale_codes": f"select distinct taxonomy_code from search_providers where taxonomy_code is not null and taxonomy_code not in (select taxonomy_code from search_providers where taxonomy_code is not null and try_cast(last_updated as timestamp) >= timestamp '{NOW}' - interval 5 day)",
    "related_grouped_first": f"""with {_M}, q as (select distinct npi, nullif(regexp_extract({_DIG.format('phone')}, '^1?([0-9]{{10}})$', 1), '') p, nullif(array_to_string(list_filter(string_split({_TEXT.format("concat_ws(' ', official_first_name, official_last_name)")}, ' '), lambda x: length(x) > 1), ' '), '') o, state s from search_providers),
      kp as (select p from q where p is not null group by 1 having count(distinct npi) between 2 and 6), ko as (select o, s from q where o is not null and s is not null group by 1, 2 having count(distinct npi) between 2 and 8),
      r as (select distinct a.npi, b.npi other, 'phone' why from q a join kp using (p) join q b on a.p = b.p where a.npi <> b.npi union all select distinct a.npi, b.npi, 'owner' from q a join ko using (o, s) join q b on a.o = b.o and a.s = b.s where a.npi <> b.npi),
      g as (select npi, other, string_agg(why, '+' order by why) why, count(*) n from r group by 1, 2)
      select npi, other, why from g qualify row_number() over (partition by npi order by other in (select npi from m) desc, n desc, other) <= 2""",
}
