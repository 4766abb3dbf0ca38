"""Search, counts, exclusion and identity queries over the registry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.functions import labels as L
from weir.functions import text as X
from weir.operators import apply as A
from weir.operators import criteria as C
from weir.operators import identity as I
from weir.operators import related as N
from weir.sources.release import npi_rules
from weir.sources.tables import table

CRITERIA = {"states": ["CA", "la ", "TX"], "state": "ME", "hasPhone": True, "excludeKeywords": ["pharmacy", "sleep"], "minMedicareClaims": 20}
PICKS = {
    "all": {},
    "phone": {"hasPhone": True},
    "owner_named": {"hasDecisionMaker": True},
    "recent": {"lastUpdatedYears": ["2025", "20x5"]},
    "zip_8": {"zipPrefix": "805"},
    "medical": {"nameContains": ["medical", "home care"]},
    "anyone": {"includeIndividuals": True, "includeInactive": True},
    "text": {"q": "an_ne%"},
}
TERMS = ["pharmacy", "home medical", "medical equipment", "home medical equipment", "sleep", "supply", "health supply", "care", "group"]


def providers(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """search_providers without exact repetitions: the NPI and these columns, or those that criteria read."""
    return table(spark, sf, "search_providers").select(["npi", *columns] if columns else C.COLUMNS).distinct()


def grouped(spark: SparkSession, sf: str) -> DataFrame:
    """NPIs that a lead group has."""
    return table(spark, sf, "lead_group_members").select(F.trim("npi").alias("npi")).distinct()


def search_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of matches, most Medicare claims first."""
    return C.page(providers(spark, sf), CRITERIA, sort="medicare", limit=25, skip=25).select("npi", "name", "state", "medicare_total_claims")


def search_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Matches, those in no group, and those of them that no pair names."""
    seen = table(spark, sf, "registry_match_candidates").select(F.col("left_npi").alias("npi"))
    return C.counts(providers(spark, sf), {"hasPhone": True}, grouped(spark, sf), seen)


def quick_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Eight criteria counted in one scan."""
    return C.quick_counts(providers(spark, sf), PICKS)


def territory_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Providers by state and taxonomy, with totals, and how many are in no group."""
    return C.territory(providers(spark, sf, "state", "taxonomy_code").dropna(), grouped(spark, sf), ["state", "taxonomy_code"])


def keyword_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """The longest excluded term in each provider's name, never for a grouped provider."""
    free = providers(spark, sf, "name").join(grouped(spark, sf), "npi", "left_anti")
    return C.longest_term(free, "name", TERMS).filter("term is not null").select("npi", "term")


def exclusion_audit(spark: SparkSession, sf: str) -> DataFrame:
    """For each term, the providers it names and how many of them are active or grouped."""
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    rows = providers(spark, sf, "name", "status").join(grouped(spark, sf).withColumn("held", F.lit(True)), "npi", "left")
    hit = rows.join(F.broadcast(terms), F.lower("name").contains(F.col("term")))  # the list of terms is a constant
    return hit.groupBy("term").agg(F.count("*").alias("named"), F.count_if(F.upper("status").isin("A", "ACTIVE")).alias("active"), F.count("held").alias("held"))


def keep_set_removable(spark: SparkSession, sf: str) -> DataFrame:
    """Deactivated providers that no group, pair or sheet protects."""
    gone = providers(spark, sf, "name", "status").filter(F.upper("status").isin("D", "DEACTIVATED"))
    pairs = table(spark, sf, "registry_match_candidates")
    keep = [grouped(spark, sf), pairs.select(F.col("left_npi").alias("npi")), pairs.select(F.col("right_npi").alias("npi")), table(spark, sf, "pis_to_resolve_recheck").select(F.col("candidate_npi").alias("npi"))]
    return C.removable(gone, "npi", keep).select("npi", "name")


def validation_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the provider table by the first rule they fail; of repeated NPIs the first accepted row passes."""
    rows = table(spark, sf, "search_providers").withColumn("row", F.row_number().over(Window.partitionBy("npi").orderBy("name", "phone")))
    other = [("missing_name", F.col("name").isNull() | (F.trim("name") == "")), ("individual", ~F.coalesce("is_organization", F.lit(True))), ("state", F.col("state").isNull())]
    return A.validated(rows, "npi", "row", npi_rules(F.col("npi")), other).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def check_digits(spark: SparkSession, sf: str) -> DataFrame:
    """How many NPIs, and the same with their last two digits swapped, carry a valid check digit."""
    npi = F.trim("npi")
    swapped = F.concat(F.left(npi, F.lit(8)), F.substring(npi, 10, 1), F.substring(npi, 9, 1))
    rows = table(spark, sf, "npi_identity_keys").select(npi.alias("npi"), swapped.alias("swapped")).distinct()
    return rows.agg(F.count("*").alias("n"), F.count_if(X.check_digit_ok(F.col("npi"))).alias("valid"), F.count_if(X.check_digit_ok(F.col("swapped"))).alias("valid_swapped"))


def phone_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Five ways in which phones are keyed; they differ on purpose."""
    p, o = F.col("phone"), F.col("official_phone")
    return providers(spark, sf, "phone", "official_phone").select("npi", X.phone_key(p, o).alias("phone_key"), X.national_number(p).alias("national"), X.last_ten(p).alias("last_ten"), X.first_phone(p, o).alias("first_phone"))


def name_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of names, officials, states, streets and codes."""
    return providers(spark, sf, "name", "official_first_name", "official_last_name", "state", "postal_code", "address_line1").select(
        "npi", X.name_key(F.col("name")).alias("name_key"), X.official_key(F.col("official_first_name"), F.col("official_last_name")).alias("official_key"),
        X.state_key(F.col("state")).alias("state_key"), X.normalize_name(F.col("name")).alias("normalized"), X.postal_code(F.col("postal_code")).alias("postal"), L.building_key(F.col("address_line1")).alias("street"),
    )


def identity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of NPIs in buckets of at most 25, with tier and matched keys."""
    return I.match_pairs(I.latest_keys(table(spark, sf, "npi_identity_keys")))


def match_build_delta(spark: SparkSession, sf: str) -> DataFrame:
    """The stored pairs against a build from today's keys."""
    return I.build_delta(table(spark, sf, "registry_match_candidates").filter("right_npi is not null"), identity_pairs(spark, sf))


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the last builds that aren't in one group already."""
    return I.undecided(table(spark, sf, "registry_match_candidates"), table(spark, sf, "lead_group_members"))


def same_owner(spark: SparkSession, sf: str) -> DataFrame:
    """Providers with an official of the same name, by how much else agrees."""
    return I.owner_counts(providers(spark, sf, "official_first_name", "official_last_name", "official_phone", "state"))


def duplicate_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the provider table by how often their NPI, name in a state, and phone occur; what is missing occurs once."""
    rows = table(spark, sf, "search_providers").select("npi", X.normalize_name(F.col("name")).alias("n"), "state", X.national_number(F.col("phone")).alias("p"))
    for name, keys in {"npi_twice": ["npi"], "name_twice": ["n", "state"], "phone_twice": ["p"]}.items():
        rows = N.with_key_size(rows, keys, name)
    flagged = rows.select(*[F.coalesce(F.col(name) > 1, F.lit(False)).alias(name) for name in ("npi_twice", "name_twice", "phone_twice")])
    return flagged.groupBy("npi_twice", "name_twice", "phone_twice").agg(F.count("*").alias("n"))


def latest_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The newest key row of each NPI."""
    rows = table(spark, sf, "npi_identity_keys")
    return A.latest_per_key(rows, ["npi"], [F.desc_nulls_last("updated_at"), F.asc("keys_hash")]).select("npi", "keys_hash", "updated_at")


def group_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Groups whose members are in several states, with states and members in order."""
    members = table(spark, sf, "lead_group_members").select("group_id", "npi").distinct()
    rows = members.join(providers(spark, sf, "state").dropna(), "npi")
    agg = rows.groupBy("group_id").agg(F.countDistinct("state").alias("states"), F.array_join(F.sort_array(F.collect_set("state")), ",").alias("state_list"), F.array_join(F.sort_array(F.collect_set("npi")), ",").alias("npis"))
    return agg.filter("states > 1")


def delivery_apply(spark: SparkSession, sf: str) -> DataFrame:
    """The last applied medicare delivery against the one before: keys by what applying it does."""
    return A.classify(last_deliveries(spark, sf), MEASURES, rounded).groupBy("action").agg(F.count("*").alias("n"))


def delivery_history(spark: SparkSession, sf: str) -> DataFrame:
    """Changed fields of that delivery, counted by field and by whether a value came, went or changed."""
    rows = A.field_history(last_deliveries(spark, sf), "npi", MEASURES, rounded)
    how = F.when(F.col("old_value").isNull(), "came").when(F.col("new_value").isNull(), "went").otherwise("changed")
    return rows.groupBy("field_name", how.alias("how")).agg(F.count("*").alias("n"))


def claims_drop(spark: SparkSession, sf: str) -> DataFrame:
    """Providers whose claims fell below half in that delivery."""
    return A.drops(last_deliveries(spark, sf), "npi", "total_claims").select("npi", F.round("old", 2).alias("old_claims"), F.round("new", 2).alias("new_claims"), "drop_pct")


MEASURES = ["total_claims", "total_services", "total_beneficiaries", "medicare_payment", "medicare_allowed"]


def rounded(_: str, value) -> F.Column:
    return F.round(value, 2)


def last_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides of the last two applied medicare deliveries."""
    order = Window.orderBy(F.desc("source_version"), "id")
    runs = table(spark, sf, "refresh_runs").filter("source = 'medicare' and status = 'applied'").select("id", "source_version").distinct().withColumn("back", F.row_number().over(order)).filter("back <= 2")
    rows = table(spark, sf, "medicare_refresh_staging").join(runs.select(F.col("id").alias("refresh_run_id"), "back"), "refresh_run_id")
    one = rows.groupBy("back", F.trim("npi").alias("npi")).agg(F.max(F.struct("created_at", *MEASURES)).alias("m")).select("back", "npi", *[f"m.{c}" for c in MEASURES])
    return A.compared(one.filter("back = 2").drop("back"), one.filter("back = 1").drop("back"), "npi", MEASURES)


def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page of pairs behind a cursor, with one row more."""
    pairs = table(spark, sf, "registry_match_candidates").select("left_npi", "right_npi").dropna().distinct()
    return C.after(pairs, ["left_npi", "right_npi"], ["25", ""], 50)


def plan_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in which two ways to find the latest keys differ: none."""
    keys = table(spark, sf, "npi_identity_keys").select(F.trim("npi").alias("npi"), "updated_at")
    a = keys.groupBy("npi").agg(F.max("updated_at").alias("at"))
    b = A.latest_per_key(keys, ["npi"], [F.desc_nulls_last("updated_at")]).select("npi", F.col("updated_at").alias("at"))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("differences"))


def same_address(spark: SparkSession, sf: str) -> DataFrame:
    """Providers by how many share their state, city and street line as written, units aside."""
    rows = providers(spark, sf, "state", "city", "address_line1").select("npi", "state", F.lower(F.trim("city")).alias("city"), L.building_key(F.col("address_line1")).alias("street"))
    return N.with_key_size(rows, ["state", "city", "street"], "there").groupBy(F.coalesce("there", F.lit(0)).alias("there")).agg(F.count("*").alias("providers"))


def related_providers(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three others of each provider by a phone of at most 6, or an official in a state of at most 8."""
    rows = providers(spark, sf, "phone", "official_first_name", "official_last_name", "state").select("npi", X.national_number(F.col("phone")).alias("p"), F.nullif(X.official_key(F.col("official_first_name"), F.col("official_last_name")), F.lit("")).alias("o"), "state")
    rows = rows.withColumn("p", F.when(F.length(F.replace("p", F.left("p", F.lit(1)), F.lit(""))) > 0, F.col("p")))
    return N.related(rows, "npi", {"phone": (["p"], 6), "owner": (["o", "state"], 8)})


def state_specialty(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent taxonomy of each state."""
    return N.most_common(providers(spark, sf, "state", "taxonomy_description").filter("state is not null"), ["state"], "taxonomy_description")


def name_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Listed candidates whose name equals the lead's, ranked by what else agrees."""
    rows = table(spark, sf, "pis_to_resolve_recheck").filter("candidate_npi is not null")
    phone = lambda c: X.national_number(F.col(c))
    last = lambda c: F.lower(F.element_at(F.split(F.trim(c), " "), -1))
    pairs = rows.select(
        "source_sheet", "source_row", "candidate_npi", (X.name_key(F.col("company_name")) == X.name_key(F.col("candidate_legal_name"))).alias("same_name"),
        F.coalesce((phone("source_phone") == phone("candidate_phone")) | (phone("source_phone") == phone("candidate_auth_phone")), F.lit(False)).alias("same_phone"),
        F.coalesce(last("authorized_person") == last("candidate_authorized_person"), F.lit(False)).alias("same_person"),
    ).distinct()
    one = pairs.groupBy("source_sheet", "source_row", "candidate_npi").agg(F.max("same_name").alias("same_name"), F.max("same_phone").alias("same_phone"), F.max("same_person").alias("same_person"))
    return N.ranked_candidates(one, ["source_sheet", "source_row"], [F.col("same_name"), F.col("same_phone"), F.col("same_person")], "candidate_npi")


def accepted_split(spark: SparkSession, sf: str) -> DataFrame:
    """Sheet leads with an accepted candidate, and those that remain, by sheet."""
    rows = table(spark, sf, "pis_to_resolve_recheck")
    leads = rows.groupBy("source_sheet", "source_row").agg(F.max(F.col("recommendation") == "Accept candidate").alias("accepted"))
    return leads.groupBy("source_sheet").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("remaining"))


def branches(spark: SparkSession, sf: str) -> DataFrame:
    """Providers merged into branches that share official and phone, or name and official, through any number of records."""
    keys = I.latest_keys(table(spark, sf, "npi_identity_keys"))
    phones = F.array_distinct(F.filter("phones", lambda p: F.trim(p) != ""))  # a null is no phone either
    rows = keys.select("npi", F.nullif("name_key", F.lit("")).alias("n"), F.nullif("official_key", F.lit("")).alias("o"), F.explode_outer(phones).alias("p"))
    return N.branches_merged(rows, [["o", "p"], ["n", "o"]], "npi")


QUERIES = {
    f.__name__: f
    for f in (
        search_page, search_counts, quick_counts, territory_grid, keyword_exclusion, exclusion_audit, keep_set_removable, validation_reasons, check_digits, phone_keys, name_keys, identity_pairs,
        match_build_delta, review_queue, same_owner, duplicate_flags, latest_keys, group_conflicts, delivery_apply, delivery_history, claims_drop, keyset_page, plan_equivalence,
        same_address, related_providers, state_specialty, name_audit, accepted_split, branches,
    )
}

_P = "with p as (select distinct * from search_providers), g as (select distinct trim(npi) npi from lead_group_members)"
_ORG = "coalesce(is_organization, enumeration_type = 'NPI-2', true)"
_ACTIVE = "deactivation_date is null and upper(coalesce(status, 'A')) in ('A', 'ACTIVE')"
_TERM_LIST = ", ".join(f"('{t}')" for t in TERMS)
_D = lambda c: f"regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g')"
_TEXT = lambda c: f"trim(regexp_replace(lower(regexp_replace(coalesce({c}, ''), '[.'']', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_NORM = lambda c: f"nullif(trim(regexp_replace(regexp_replace(upper({c}), '[^A-Z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')), '')"
_SUFFIXES = "'llc', 'inc', 'corp', 'corporation', 'co', 'company', 'ltd', 'limited', 'lp', 'llp', 'pllc', 'pc', 'incorporated'"
_LUHN = lambda c: "(24 + " + " + ".join((f"(case when substr({c}, {i}, 1)::int >= 5 then 2 * substr({c}, {i}, 1)::int - 9 else 2 * substr({c}, {i}, 1)::int end)" if i % 2 else f"substr({c}, {i}, 1)::int") for i in range(1, 11)) + ") % 10 = 0"
_TEN = lambda c: f"nullif(regexp_extract({_D(c)}, '^1?([0-9]{{10}})', 1), '')"
_KEYS = """with k as (select trim(npi) npi, arg_max({'n': name_key, 's': state_key, 'o': official_key, 'p': phones}, updated_at) k from npi_identity_keys group by 1),
  u as (select npi, k.n n, k.s s, k.o o, k.p p from k),
  ph as (select npi, n, o, unnest(list_distinct(p)) ph from u),
  b as (select 'op' t, o || '|' || ph k, npi from ph where o <> '' union select 'np', n || '|' || ph, npi from ph where n <> '' union select 'no', n || '|' || o, npi from u where n <> '' and o <> ''),
  z as (select t, k from b group by all having count(*) between 2 and 25),
  pr as (select distinct x.npi l, y.npi r from b x join z using (t, k) join b y using (t, k) where x.npi < y.npi),
  f as (select l, r, a.n = c.n n, a.s <> '' and a.s = c.s s, a.o <> '' and a.o = c.o o, list_has_any(a.p, c.p) p from pr join u a on a.npi = l join u c on c.npi = r),
  ruled as (select l left_npi, r right_npi, case when n and o and p then null when n and s and p or n and s and o or s and o and p then 2 when o and p or n and p or n and o then 3 end tier,
    case when n and o and p then null when n and s and p then 'name+state+phone' when n and s and o then 'name+state+official' when s and o and p then 'state+official+phone' when o and p then 'official+phone' when n and p then 'name+phone' when n and o then 'name+official' end matched_keys from f),
  m as (select * from ruled where tier is not null)"""
_LAST = """with runs as (select id, row_number() over (order by source_version desc, id) back from (select distinct id, source_version from refresh_runs where source = 'medicare' and status = 'applied')),
  s as (select back, trim(npi) npi, total_claims, total_services, total_beneficiaries, medicare_payment, medicare_allowed from medicare_refresh_staging join runs on id = refresh_run_id where back <= 2
        qualify row_number() over (partition by back, trim(npi) order by created_at desc) = 1),
  j as (select coalesce(o.npi, n.npi) npi, o.npi is not null o_in, n.npi is not null n_in, o, n from (select * from s where back = 2) o full join (select * from s where back = 1) n on o.npi = n.npi)"""
_DIFF = " or ".join(f"round(o.{m}, 2) is distinct from round(n.{m}, 2)" for m in MEASURES)

ORACLE = {
    "search_page": _P + f" select npi, name, state, medicare_total_claims from p where {_ORG} and {_ACTIVE} and upper(trim(state)) in ('CA', 'LA', 'TX', 'ME') and not (name ilike '%pharmacy%' or name ilike '%sleep%') and trim(coalesce(phone, '')) <> '' and coalesce(medicare_total_claims, 0) >= 20 order by medicare_total_claims desc nulls last, npi limit 25 offset 25",
    "search_counts": _P + f", m as (select npi, npi in (select npi from g) t, npi in (select left_npi from registry_match_candidates) s from p where {_ORG} and {_ACTIVE} and trim(coalesce(phone, '')) <> '') select least(count(*), 5000) matched, least(count(*) filter (not t), 5000) unclaimed, least(count(*) filter (not t and not s), 5000) \"left\" from m",
    "quick_counts": _P + f", a as (select * from p where {_ORG} and {_ACTIVE}) select 'all' pick, count(*) n from a union all select 'phone', count(*) from a where trim(coalesce(phone, '')) <> '' union all select 'owner_named', count(*) from a where trim(coalesce(official_last_name, '')) <> '' union all select 'recent', count(*) from a where last_updated >= '2025-01-01' and last_updated < '2026-01-01' union all select 'zip_8', count(*) from a where {_D('postal_code')} like '805%' union all select 'medical', count(*) from a where name ilike '%medical%' or name ilike '%home care%' union all select 'anyone', count(*) from p union all select 'text', count(*) from a where name ilike '%anne%' or concat_ws(' ', official_first_name, official_last_name) ilike '%anne%'",
    "territory_grid": _P + " select state, taxonomy_code, count(*) total, greatest(count(*) - count(g.npi), 0) unclaimed from p left join g using (npi) where state is not null and taxonomy_code is not null group by rollup (state, taxonomy_code)",
    "keyword_exclusion": _P + f", t(term) as (values {_TERM_LIST}) select npi, term from p join t on contains(lower(name), term) where npi not in (select npi from g) qualify row_number() over (partition by npi order by length(term) desc, term) = 1",
    "exclusion_audit": _P + f", t(term) as (values {_TERM_LIST}) select term, count(*) named, count(*) filter (upper(status) in ('A', 'ACTIVE')) active, count(g.npi) held from p left join g using (npi) join t on contains(lower(name), term) group by term",
    "keep_set_removable": _P + ", k as (select npi from g union select left_npi from registry_match_candidates union select right_npi from registry_match_candidates union select candidate_npi from pis_to_resolve_recheck) select npi, name from p where upper(status) in ('D', 'DEACTIVATED') and not exists (select 1 from k where k.npi = p.npi)",
    "validation_reasons": f"with r as (select *, row_number() over (partition by npi order by name nulls first, phone nulls first) rn, case when npi is null or npi = '' then 'missing_npi' when not regexp_full_match(npi, '[0-9]{{10}}') then 'bad_format' when not ({_LUHN('npi')}) then 'bad_check_digit' end bad, case when name is null or trim(name) = '' then 'missing_name' when not {_ORG.replace(', enumeration_type = ' + chr(39) + 'NPI-2' + chr(39), '')} then 'individual' when state is null then 'state' end other from search_providers), f as (select *, min(case when bad is null and other is null then rn end) over (partition by npi) ok from r) select coalesce(bad, case when rn > ok then 'duplicate' end, other, 'accepted') reason, count(*) n from f group by 1",
    "check_digits": f"with r as (select distinct trim(npi) npi, left(trim(npi), 8) || substr(trim(npi), 10, 1) || substr(trim(npi), 9, 1) swapped from npi_identity_keys) select count(*) n, count(*) filter ({_LUHN('npi')}) valid, count(*) filter ({_LUHN('swapped')}) valid_swapped from r",
    "phone_keys": _P + f", c as (select npi, phone, {_TEN('phone')} a, {_TEN('official_phone')} b, regexp_replace(phone, '[^0-9]', '', 'g') d, list_filter(list_transform(regexp_extract_all(regexp_replace(phone, '[()\\s.\\-]+', '', 'g'), '\\d+'), lambda x: case when length(x) = 11 and x like '1%' then substr(x, 2) else left(x, 10) end), lambda x: length(x) = 10 and not regexp_matches(x, '^[01]')) f, list_filter(list_transform(regexp_extract_all(regexp_replace(official_phone, '[()\\s.\\-]+', '', 'g'), '\\d+'), lambda x: case when length(x) = 11 and x like '1%' then substr(x, 2) else left(x, 10) end), lambda x: length(x) = 10 and not regexp_matches(x, '^[01]')) fo from p) select npi, coalesce(a, b, '') phone_key, nullif(regexp_extract(d, '^1?([0-9]{{10}})$', 1), '') national, right(coalesce(d, ''), 10) last_ten, coalesce(f[1], fo[1]) first_phone from c",
    "name_keys": _P + f" select npi, array_to_string(list_filter(string_split({_TEXT('name')}, ' '), lambda x: x <> '' and x not in ({_SUFFIXES})), ' ') name_key, array_to_string(list_filter(string_split({_TEXT('concat_ws(' + chr(39) + ' ' + chr(39) + ', official_first_name, official_last_name)')}, ' '), lambda x: length(x) > 1), ' ') official_key, upper(regexp_replace(coalesce(state, ''), '[^A-Za-z]', '', 'g')) state_key, {_NORM('name')} normalized, nullif(case when length({_D('postal_code')}) = 9 then left({_D('postal_code')}, 5) || '-' || right({_D('postal_code')}, 4) when length({_D('postal_code')}) >= 5 then left({_D('postal_code')}, 5) else {_D('postal_code')} end, '') postal, (select case when length(k) >= 5 and regexp_matches(k, '[0-9]') then k end from (select trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(coalesce(address_line1, '')), '[.,]', ' ', 'g'), '#.*$', ''), '\\s+(STE|SUITE|UNIT|APT|APARTMENT|RM|ROOM|FL|FLOOR|BLDG|BUILDING|DEPT|LOT|SPC)\\b.*$', ''), '\\s+', ' ', 'g')) k)) street from p",
    "identity_pairs": _KEYS + " select * from m",
    "match_build_delta": _KEYS + ", o as (select distinct left_npi, right_npi from registry_match_candidates where right_npi is not null) select count(m.left_npi) pairs, count(*) filter (o.left_npi is null) new_pairs, count(*) filter (m.left_npi is null) removed_pairs from o full join m on o.left_npi = m.left_npi and o.right_npi = m.right_npi",
    "review_queue": "with b as (select least(left_npi, right_npi) left_npi, greatest(left_npi, right_npi) right_npi, min(tier) tier from registry_match_candidates where left_npi <> right_npi group by 1, 2), g as (select npi, min(group_id) g from lead_group_members group by npi) select b.*, x.g left_group, y.g right_group from b left join g x on x.npi = left_npi left join g y on y.npi = right_npi where x.g is null or y.g is null or x.g <> y.g",
    "same_owner": _P + f", r as (select npi, nullif(lower(trim(concat_ws(' ', trim(official_first_name), trim(official_last_name)))), '') o, case when length(right({_D('official_phone')}, 10)) = 10 then right({_D('official_phone')}, 10) end p, state s from p), c as (select npi, count(*) over (partition by o) - 1 same_name, case when p is null then 0 else count(*) over (partition by o, p) - 1 end strong, case when s is null then 0 else count(*) over (partition by o, s) - 1 end - case when s is null or p is null then 0 else count(*) over (partition by o, s, p) - 1 end weak from r where o is not null) select *, strong = 0 and weak > 12 ambiguous from c",
    "duplicate_flags": f"with r as (select npi, {_NORM('name')} n, state, nullif(regexp_extract(regexp_replace(phone, '[^0-9]', '', 'g'), '^1?([0-9]{{10}})$', 1), '') p from search_providers), f as (select count(*) over (partition by npi) > 1 npi_twice, n is not null and state is not null and count(*) over (partition by n, state) > 1 name_twice, p is not null and count(*) over (partition by p) > 1 phone_twice from r) select npi_twice, name_twice, phone_twice, count(*) n from f group by all",
    "latest_keys": "select npi, keys_hash, updated_at from npi_identity_keys qualify row_number() over (partition by npi order by updated_at desc nulls last, keys_hash) = 1",
    "group_conflicts": _P + ", r as (select m.group_id, p.npi, p.state from (select distinct group_id, npi from lead_group_members) m join p using (npi) where state is not null) select group_id, count(distinct state) states, array_to_string(list_sort(list(distinct state)), ',') state_list, array_to_string(list_sort(list(distinct npi)), ',') npis from r group by group_id having count(distinct state) > 1",
    "delivery_apply": _LAST + f" select case when not o_in then 'inserted' when not n_in then 'absent' when {_DIFF} then 'updated' else 'unchanged' end action, count(*) n from j group by 1",
    "delivery_history": _LAST + " select field_name, case when a is null then 'came' when b is null then 'went' else 'changed' end how, count(*) n from (" + " union all ".join(f"select '{m}' field_name, o.{m} a, n.{m} b from j where o_in and n_in and round(o.{m}, 2) is distinct from round(n.{m}, 2)" for m in MEASURES) + ") group by all union all select 'record_created', 'came', count(*) from j where not o_in having count(*) > 0",
    "claims_drop": _LAST + " select npi, round(o.total_claims, 2) old_claims, round(coalesce(n.total_claims, 0), 2) new_claims, round((1 - coalesce(n.total_claims, 0) / o.total_claims) * 100, 1) drop_pct from j where o_in and n_in and o.total_claims > 0 and coalesce(n.total_claims, 0) < o.total_claims * 0.5",
    "keyset_page": "select distinct left_npi, right_npi from registry_match_candidates where left_npi is not null and right_npi is not null and (left_npi, right_npi) > ('25', '') order by 1, 2 limit 51",
    "same_address": _P + f", r as (select npi, state, lower(trim(city)) city, (select case when length(k) >= 5 and regexp_matches(k, '[0-9]') then k end from (select trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(coalesce(address_line1, '')), '[.,]', ' ', 'g'), '#.*$', ''), '\\s+(STE|SUITE|UNIT|APT|APARTMENT|RM|ROOM|FL|FLOOR|BLDG|BUILDING|DEPT|LOT|SPC)\\b.*$', ''), '\\s+', ' ', 'g')) k)) street from p), c as (select case when state is null or city is null or street is null then 0 else count(*) over (partition by state, city, street) end there from r) select there, count(*) providers from c group by 1",
    "related_providers": _P + f", r as (select npi, state, nullif(array_to_string(list_filter(string_split({_TEXT('concat_ws(' + chr(39) + ' ' + chr(39) + ', official_first_name, official_last_name)')}, ' '), lambda x: length(x) > 1), ' '), '') o, nullif(regexp_extract(regexp_replace(phone, '[^0-9]', '', 'g'), '^1?([0-9]{{10}})$', 1), '') p from p), q as (select *, case when length(replace(p, left(p, 1), '')) > 0 then p end pp from r), a as (select npi, pp k from q where pp is not null), b as (select npi, o || '|' || state k from q where o is not null and state is not null), sa as (select * from a where k in (select k from a group by k having count(*) between 2 and 6)), sb as (select * from b where k in (select k from b group by k having count(*) between 2 and 8)), u as (select x.npi, y.npi other, 'phone' why from sa x join sa y using (k) where x.npi <> y.npi union select x.npi, y.npi, 'owner' from sb x join sb y using (k) where x.npi <> y.npi), m as (select npi, other, array_to_string(list_sort(list(why)), '+') why, count(*) n from u group by 1, 2) select npi, other, why from m qualify row_number() over (partition by npi order by n desc, other) <= 3",
    "state_specialty": _P + ", c as (select state, taxonomy_description, count(*) n from p where state is not null and taxonomy_description is not null group by 1, 2) select state, taxonomy_description, n from c qualify row_number() over (partition by state order by n desc, taxonomy_description) = 1",
    "name_audit": f"with r as (select source_sheet, source_row, candidate_npi, array_to_string(list_filter(string_split({_TEXT('company_name')}, ' '), lambda x: x <> '' and x not in ({_SUFFIXES})), ' ') = array_to_string(list_filter(string_split({_TEXT('candidate_legal_name')}, ' '), lambda x: x <> '' and x not in ({_SUFFIXES})), ' ') a, nullif(regexp_extract(regexp_replace(source_phone, '[^0-9]', '', 'g'), '^1?([0-9]{{10}})$', 1), '') s, nullif(regexp_extract(regexp_replace(candidate_phone, '[^0-9]', '', 'g'), '^1?([0-9]{{10}})$', 1), '') p, nullif(regexp_extract(regexp_replace(candidate_auth_phone, '[^0-9]', '', 'g'), '^1?([0-9]{{10}})$', 1), '') q, coalesce(lower(string_split(trim(authorized_person), ' ')[-1]) = lower(string_split(trim(candidate_authorized_person), ' ')[-1]), false) c from pis_to_resolve_recheck where candidate_npi is not null), g as (select source_sheet, source_row, candidate_npi, bool_or(a) same_name, bool_or(coalesce(s = p or s = q, false)) same_phone, bool_or(c) same_person from r group by all), n as (select *, same_name::int + same_phone::int + same_person::int agreed from g) select *, row_number() over (partition by source_sheet, source_row order by agreed desc, candidate_npi) \"rank\" from n",
    "accepted_split": "with l as (select source_sheet, source_row, bool_or(recommendation = 'Accept candidate') a from pis_to_resolve_recheck group by all) select source_sheet, count(*) filter (a) accepted, count(*) filter (not a) remaining from l group by 1",
    "branches": _KEYS.replace("with k", "with recursive k", 1).split(",\n  ph as")[0] + """, ph as (select npi, n, o, unnest(list_distinct(p)) p from u),
      h as (select distinct npi, 'op|' || o || '|' || p k from ph where o <> '' and trim(p) <> '' union select npi, 'no|' || n || '|' || o from u where n <> '' and o <> ''),
      l as (select k, min(npi) m from h group by k), s as (select distinct npi a, m b from h join l using (k) where npi <> m), e as (select a, b from s union select b, a from s),
      reach(s, v) as (select a, a from e union select s, b from reach join e on v = a where b > s), f as (select v, min(s) branch from reach group by v)
      select npi, coalesce(branch, npi) branch from u left join f on v = npi""",
    "plan_equivalence": "select 0::bigint differences",
}
