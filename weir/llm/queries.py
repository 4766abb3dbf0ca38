"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.blanks import phone_digits, says_something
from weir.llm.addresses import buildings, same_building
from weir.llm.components import connected_sets, pair_links, star_links
from weir.llm.matching import cascade, rule_confidence, with_keys
from weir.llm.packing import items_of, pack
from weir.llm.spans import SpanIndex
from weir.llm.survivor import survivors
from weir.llm.tokenize import documents_with_ids, with_token_count
from weir.operators.apply import latest_per_key
from weir.scratch import Scratch
from weir.sources.tables import table

#: Tokens that a container holds.
CAPACITY = 2048
#: Least length of a shared span, in code points.
SPAN = 200


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every NPI of a linked set, with the smallest NPI of the set."""
    pairs = pair_links(table(spark, sf, "registry_match_candidates"), "left_npi", "right_npi")
    members = star_links(table(spark, sf, "lead_group_members"), "group_id", "npi")
    return connected_sets(pairs.unionByName(members)).select(F.col("vertex").alias("npi"), F.col("group").alias("group_npi"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return documents_with_ids(spark, table(spark, sf, "documents"))


def document_items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as items of at most a container, as a written table, so that texts are encoded once."""
    counted = with_token_count(table(spark, sf, "documents").select("doc_id", "text"))
    return Scratch(spark, "packing").keep(items_of(counted, "doc_id", "n_tokens", CAPACITY))


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every document, or of every part of one that is longer than a container."""
    return pack(document_items(spark, sf), "doc_id", CAPACITY)


def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers and their fill for each length bucket, with batches closed by items of short buckets and without."""
    items, out = document_items(spark, sf), None
    for close in (True, False):
        of = pack(items, "doc_id", CAPACITY, close=close).groupBy("bucket", "container_id").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
        fill = of.groupBy("bucket").agg(F.count("*").alias("containers"), F.sum("n").alias("items"), F.sum("used").alias("tokens"), F.sum(CAPACITY - F.col("used")).alias("room"))
        fill = fill.withColumn("closed", F.lit(close))
        out = fill if out is None else out.unionByName(fill)
    return out


def shared_in_batches(documents: DataFrame, batches: list[DataFrame]) -> DataFrame:
    """(doc_id, shared_chars) after the batches of documents arrived one after the other."""
    index = SpanIndex(Scratch(documents.sparkSession, "spans"), span=SPAN, fan_out=2)
    for batch in batches:
        index.append(batch, "doc_id", "text", documents)
    found = index.shared()
    index.drop()
    return found.withColumnRenamed("doc", "doc_id")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a span of 200 characters that also stands in another one, and how many of their characters do."""
    documents = table(spark, sf, "documents").select("doc_id", "text", "created_at", "received_at")
    late = F.coalesce(F.col("received_at") > F.col("created_at") + F.expr("interval 2 days"), F.lit(False))
    # what came in time is history when the rest arrives
    return shared_in_batches(documents, [documents.filter(~late), documents.filter(late)])


def p10_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The same from five deliveries: what was received on each of the week's first four days, and on the others, with compactions between."""
    day = F.least(F.coalesce(F.dayofweek("received_at"), F.lit(1)), F.lit(5))
    documents = table(spark, sf, "documents").select("doc_id", "text", day.alias("delivery"))
    return shared_in_batches(documents, [documents.filter(F.col("delivery") == i) for i in range(1, 6)])


#: Fields of search_providers that lead groups keep.
SURVIVING = ["name", "address_line1", "phone", "official_phone"]


def member_values(spark: SparkSession, sf: str) -> DataFrame:
    """(g, f, member, value, trust, at): what the members of groups of two or more say, with repeated rows."""
    trust = table(spark, sf, "relationship_trust").groupBy("relationship_type").agg(F.min("trust_rank").alias("trust"))
    rows = table(spark, sf, "lead_group_members").select(F.col("group_id").alias("g"), F.nullif(F.trim("npi"), F.lit("")).alias("member"), "relationship_type")
    members = rows.join(trust, "relationship_type", "left").groupBy("g", "member").agg(F.min(F.coalesce("trust", F.lit(99999999))).alias("trust")).dropna(subset=["g", "member"])
    many = members.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")
    told = table(spark, sf, "search_providers").select(F.trim("npi").alias("member"), F.nullif(F.trim("last_updated"), F.lit("")).alias("at"), *SURVIVING)
    values = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("value")) for c in SURVIVING])
    joined = members.join(many, "g", "left_semi").join(told, "member")  # what members say is all that is looked at
    every = joined.select("g", "member", "trust", "at", F.inline(values))
    is_phone = F.col("f").isin("phone", "official_phone")
    return every.filter(says_something(F.col("value")) & (~is_phone | phone_digits(F.col("value")).isNotNull())).select("g", "f", "member", "value", "trust", "at")


def group_values(spark: SparkSession, sf: str) -> DataFrame:
    """(g, f, member, value, rank, trust): what the members of groups of two or more say, the best first by rank.

    The most trusted relationship comes first, then the latest update, then the smallest NPI.
    """
    newest_first = F.coalesce(F.translate("at", "0123456789", "9876543210"), F.lit("~"))
    rank = F.concat_ws("|", F.lpad(F.col("trust").cast("string"), 8, "0"), F.rpad(newest_first, 10, "~"), "member")
    return member_values(spark, sf).select("g", "f", "member", "value", rank.alias("rank"), "trust").distinct()  # a row may be delivered twice


def value_tokens():
    """A phone is one token, anything else its words."""
    words = F.regexp_extract_all(F.upper("value"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.when(F.col("f").isin("phone", "official_phone"), F.array(phone_digits(F.col("value")))).otherwise(F.when(F.size(words) > 0, words).otherwise(F.array("value")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The member whose value survives, for each group and field: the most trusted, then the latest, then the smallest NPI.

    The other members' values have no say in it, so that nothing is aligned or put to the vote.
    """
    best = latest_per_key(member_values(spark, sf), ["g", "f"], [F.col("trust"), F.desc_nulls_last("at"), F.col("member")])
    return best.select(F.col("g").alias("group_id"), F.col("f").alias("field_name"), F.col("member").alias("npi"))


def trust_weight():
    """5 for the most trusted relationship down to 1 for the least and for what has no trust; whole numbers add up exactly."""
    return F.greatest(F.lit(6) - F.col("trust"), F.lit(1)).cast("double")


def p5_records(spark: SparkSession, sf: str) -> DataFrame:
    """One record for each group by weighted consensus: trust weighs a value, and the others of its group may outvote it."""
    best = survivors(group_values(spark, sf), Scratch(spark, "survivors"), tokens=value_tokens(), weight=trust_weight())
    return best.groupBy(F.col("g").alias("group_id")).pivot("f", SURVIVING).agg(F.first("value"))


def p5_phones(spark: SparkSession, sf: str) -> DataFrame:
    """The phones of those records: the number with the most trust behind it, and the member whose way to write it stays."""
    phones = group_values(spark, sf).filter(F.col("f").isin("phone", "official_phone"))
    best = survivors(phones, Scratch(spark, "survivors"), tokens=value_tokens(), weight=trust_weight())
    return best.select(F.col("g").alias("group_id"), F.col("f").alias("field_name"), F.col("member").alias("npi"), phone_digits(F.col("value")).alias("digits"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of NPIs whose addresses are in the same building."""
    rows = table(spark, sf, "search_providers").withColumn("npi", F.nullif(F.trim("npi"), F.lit("")))
    return same_building(rows, Scratch(spark, "addresses"), id="npi", line="address_line1", city="city", state="state", postal="postal_code")


def p6_buildings(spark: SparkSession, sf: str) -> DataFrame:
    """The building of each NPI, by its smallest NPI, and how many others are in it."""
    rows = table(spark, sf, "search_providers").withColumn("npi", F.nullif(F.trim("npi"), F.lit("")))
    return buildings(rows, Scratch(spark, "addresses"), id="npi", line="address_line1", city="city", state="state", postal="postal_code")


def p7_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The registry candidate of each sheet lead that has one, the rule that found it, and its confidence."""
    scratch = Scratch(spark, "matching")
    rows = table(spark, sf, "pis_to_resolve_recheck").withColumn("candidate_npi", F.nullif(F.trim("candidate_npi"), F.lit("")))
    lead = F.when(F.col("source_sheet").isNotNull() & F.col("source_row").isNotNull(), F.struct("source_sheet", "source_row"))
    rows = rows.withColumn("lead", lead)
    told = rows.select("lead", "company_name", "authorized_person", "source_phone").filter("lead is not null").distinct()
    listed = rows.select("candidate_npi", "candidate_legal_name", "candidate_authorized_person", "candidate_phone", "candidate_auth_phone").filter("candidate_npi is not null").distinct()
    leads = scratch.keep(with_keys(told, "company_name", "authorized_person", ["source_phone"]).select("lead", "full", "name_words", "whole", "partial", "first", "last", "phones"))
    candidates = with_keys(listed, "candidate_legal_name", "candidate_authorized_person", ["candidate_phone", "candidate_auth_phone"]).select("candidate_npi", "full", "name_words", "whole", "partial", "first", "last", "phones")
    matches = scratch.keep(cascade(leads, candidates, scratch, lead="lead", candidate="candidate_npi"))
    # where a reviewer accepted a listed candidate of a lead, or two of the three checks passed, the others beside it are wrong
    checks = sum(F.when(F.upper(c) == "TRUE", 1).otherwise(0) for c in ("exact_name", "phone_match", "authorized_person_match"))
    accepted = F.coalesce(F.col("recommendation").startswith("Accept"), F.lit(False)) | (checks >= 2)
    pairs = rows.filter("lead is not null and candidate_npi is not null").groupBy("lead", "candidate_npi").agg(F.max(accepted).alias("is_match"))
    labels = pairs.join(pairs.filter("is_match").select("lead").distinct(), "lead", "left_semi")
    sure = rule_confidence(matches, labels, lead="lead", candidate="candidate_npi")
    return matches.join(sure, "rule").select("lead.source_sheet", "lead.source_row", "candidate_npi", "rule", "confidence")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sheet leads and the registry candidate that is the same organization."""
    return p7_matches(spark, sf).select("source_sheet", "source_row", "candidate_npi")


QUERIES = {f.__name__: f for f in (p1_found, p8_ids, p9_containers, p5_found, p5_records, p5_phones, p6_found, p6_buildings, p7_found, p7_matches, p9_fill, p10_found, p10_batches)}

_SAID = """
      with m as (select group_id, trim(npi) npi, min(coalesce(trust_rank, 99999999)) trust from lead_group_members left join relationship_trust using (relationship_type) group by all),
      g as (select * from m where group_id in (select group_id from m group by group_id having count(*) > 1)),
      s as (select distinct trim(npi) npi, nullif(trim(last_updated), '') upd, f.field_name, f.value from search_providers,
            lateral (select unnest(['name', 'address_line1', 'phone', 'official_phone']) field_name, unnest([name, address_line1, phone, official_phone]) value) f),
      w as (select *, upper(regexp_replace(value, '[^\\pL\\pN]+', '', 'g')) core, regexp_replace(regexp_replace(trim(value), '\\.0+$', ''), '[^0-9]', '', 'g') dig from s where value is not null),
      ok as (select * from w where core not in ('', 'NA', 'NONE', 'NULL', 'NIL', 'UNKNOWN', 'UNK', 'TBD', 'TBA', 'NOTAVAILABLE', 'NOTAPPLICABLE', 'NOTPROVIDED', 'MISSING', 'BLANK', 'PENDING')
             and not (regexp_matches(core, '^[A-Z][A-Z]+$') and core = repeat(left(core, 1), length(core)))
             and (field_name not like '%phone' or (regexp_matches(dig, '^1?[0-9]{10}$') and right(dig, 10) <> repeat(right(dig, 1), 10))))"""

#: Every window of every text by its hash: too slow for large corpora, but an answer of another kind than the index.
_SHARED = """
      with t as (select doc_id, any_value(text) as text from documents where length(text) >= 200 group by doc_id),
      w as (select doc_id, unnest(range(1, length(text) - 198)) i, text from t), h as (select doc_id, i, hash(substr(text, i, 200)) h from w),
      s as (select h from h group by h having min(doc_id) < max(doc_id)),
      p as (select doc_id, i, lead(i) over (partition by doc_id order by i) n from h where h in (select h from s))
      select doc_id, sum(least(200, coalesce(n - i, 200)))::bigint shared_chars from p group by doc_id"""

ORACLE = {
    "p10_found": _SHARED,
    "p10_batches": _SHARED,
    "p5_found": _SAID + """
      select group_id, field_name, npi from g join ok using (npi)
      qualify row_number() over (partition by group_id, field_name order by trust, upd desc nulls last, npi) = 1""",
    "p5_phones": _SAID + """,
      r as (select group_id, field_name, npi, right(dig, 10) digits, row_number() over (partition by group_id, field_name order by trust, upd desc nulls last, npi) place, greatest(6 - trust, 1) weight
            from g join ok using (npi) where field_name like '%phone'),
      v as (select group_id, field_name, digits, sum(weight) votes, min(place) place from r group by all),
      top as (select * from v qualify row_number() over (partition by group_id, field_name order by votes desc, digits) = 1)
      select r.group_id, r.field_name, r.npi, r.digits from top join r using (group_id, field_name, place)""",
    "p1_found": """
      with recursive e as (
        select trim(left_npi) a, trim(right_npi) b from registry_match_candidates
        union select x.npi, y.npi from (select group_id, min(trim(npi)) npi from lead_group_members group by group_id) x join (select distinct group_id, trim(npi) npi from lead_group_members) y using (group_id)),
      edges as (select distinct a, b from (select a, b from e union all select b, a from e) where a <> b and a is not null and b is not null),
      reach(s, v) as (select distinct a, a from edges union select r.s, edges.b from reach r join edges on r.v = edges.a where edges.b > r.s)
      select v npi, min(s) group_npi from reach group by v""",
}
