"""Tiered identity matching: pairs from buckets of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.functions import text as X
from weir.operators.buckets import bucket_members

#: The tiers' rules, first match wins; n name, s state, o official, p phone.
TIERS = [("n and o and p", None, None), ("n and s and p", 2, "name+state+phone"), ("n and s and o", 2, "name+state+official"), ("s and o and p", 2, "state+official+phone"), ("o and p", 3, "official+phone"), ("n and p", 3, "name+phone"), ("n and o", 3, "name+official")]


def latest_keys(keys: DataFrame) -> DataFrame:
    """One row for each NPI, the one updated last."""
    cols = ["name_key", "state_key", "official_key", "phones"]
    return keys.groupBy(F.trim("npi").alias("npi")).agg(F.max(F.struct("updated_at", *cols)).alias("k")).select("npi", *[f"k.{c}" for c in cols])


def match_pairs(keys: DataFrame, cap: int = 25) -> DataFrame:
    """(left_npi, right_npi, tier, matched_keys) of NPIs that share a bucket of 2 to cap members.

    Larger buckets make no pairs, which bounds the pairs of a bucket; they are reported, not paired. Buckets are counted by an
    aggregate, members of large ones are left out, and only then do keys join the members, so that pairs need no
    further join. Rows are one for each NPI.
    """
    bucket = ["bucket_type", "bucket_key"]
    members = bucket_members(keys)
    sized = members.groupBy(*bucket).agg(F.count("*").alias("n")).filter(F.col("n").between(2, cap)).select(*bucket)
    small = members.join(sized, bucket, "left_semi").join(keys.select("npi", F.struct("name_key", "state_key", "official_key", "phones").alias("k")), "npi")
    groups = small.groupBy("bucket_type", "bucket_key").agg(F.sort_array(F.collect_list(F.struct("npi", "k"))).alias("m"))  # at most cap members
    left = groups.select(F.posexplode("m").alias("i", "a"), "m")
    pairs = left.select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    one = pairs.groupBy(F.col("a.npi").alias("left_npi"), F.col("b.npi").alias("right_npi")).agg(F.first("a.k").alias("a"), F.first("b.k").alias("b"))
    flags = one.select(
        "left_npi", "right_npi",
        F.coalesce(F.col("a.name_key") == F.col("b.name_key"), F.lit(False)).alias("n"),
        F.coalesce((F.col("a.state_key") != "") & (F.col("a.state_key") == F.col("b.state_key")), F.lit(False)).alias("s"),
        F.coalesce((F.col("a.official_key") != "") & (F.col("a.official_key") == F.col("b.official_key")), F.lit(False)).alias("o"),
        F.coalesce(F.arrays_overlap("a.phones", "b.phones"), F.lit(False)).alias("p"),
    )
    tier, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for rule, t, text in reversed(TIERS):
        tier, label = F.when(F.expr(rule), F.lit(t).cast("int")).otherwise(tier), F.when(F.expr(rule), F.lit(text).cast("string")).otherwise(label)
    return flags.select("left_npi", "right_npi", tier.alias("tier"), label.alias("matched_keys")).filter("tier is not null")


def build_delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """(pairs, new_pairs, removed_pairs) of a build against the pairs of the one before."""
    pair = ["left_npi", "right_npi"]
    old, new = before.select(*pair, F.lit(True).alias("old")).distinct(), now.select(*pair, F.lit(True).alias("new")).distinct()
    return old.join(new, pair, "full").agg(F.count("new").alias("pairs"), F.count_if(F.col("old").isNull()).alias("new_pairs"), F.count_if(F.col("new").isNull()).alias("removed_pairs"))


def built_keys(providers: DataFrame) -> DataFrame:
    """(npi, name_key, state_key, official_key, phones, keys_hash) of the organizations that can match: a name, and an official or a phone.

    providers has npi, name, state, the official's names and phone, phone, and is_organization or enumeration_type.
    """
    ten = lambda c: F.nullif(F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", ""), "^1?([0-9]{10})", 1), F.lit(""))
    rows = providers.filter(F.coalesce("is_organization", F.col("enumeration_type") == "NPI-2", F.lit(False))).select(
        F.trim("npi").alias("npi"), X.name_key(F.col("name")).alias("name_key"), X.state_key(F.col("state")).alias("state_key"), X.official_key(F.col("official_first_name"), F.col("official_last_name")).alias("official_key"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(ten(F.col("phone")), ten(F.col("official_phone")))))).alias("phones"),
    ).filter((F.col("name_key") != "") & ((F.col("official_key") != "") | (F.size("phones") > 0))).distinct()
    return rows.withColumn("keys_hash", F.md5(F.concat_ws("|", "name_key", "state_key", "official_key", F.array_join("phones", ","))))


def build_lifecycle(stored: DataFrame, now: DataFrame, build: str) -> DataFrame:
    """(left_npi, right_npi, first_build_id, last_build_id, state) of stored pairs and those of this build: new, kept or dropped."""
    pair = ["left_npi", "right_npi"]
    old = stored.dropna(subset=pair).groupBy(*pair).agg(F.min("first_build_id").alias("first"), F.max("last_build_id").alias("last"))
    both = old.withColumn("was", F.lit(True)).join(now.select(*pair, F.lit(True).alias("is")).distinct(), pair, "full")
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "dropped").otherwise("kept")
    return both.select(*pair, F.coalesce("first", F.lit(build)).alias("first_build_id"), F.when(F.col("is"), F.lit(build)).otherwise(F.col("last")).alias("last_build_id"), state.alias("state"))


def undecided(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs that aren't in one group already, each unordered pair once with its best tier, with the sides' groups."""
    unordered = pairs.select(F.least("left_npi", "right_npi").alias("left_npi"), F.greatest("left_npi", "right_npi").alias("right_npi"), "tier").filter("left_npi < right_npi")
    best = unordered.groupBy("left_npi", "right_npi").agg(F.min("tier").alias("tier"))
    group = members.groupBy("npi").agg(F.min("group_id").alias("g"))
    both = best.join(group.select(F.col("npi").alias("left_npi"), F.col("g").alias("left_group")), "left_npi", "left").join(group.select(F.col("npi").alias("right_npi"), F.col("g").alias("right_group")), "right_npi", "left")
    return both.filter("left_group is null or right_group is null or left_group != right_group")


def owner_counts(providers: DataFrame, most_weak: int = 12) -> DataFrame:
    """For each provider, how many others have an official of the same name: strong with the same phone, weak with the same state.

    Counts come from aggregates by owner, owner and phone, owner and state, never from pairs, so that a frequent name
    costs no more than its rows.
    """
    owner = F.nullif(F.lower(F.trim(F.concat_ws(" ", F.trim("official_first_name"), F.trim("official_last_name")))), F.lit(""))
    phone = F.right(F.regexp_replace(F.coalesce("official_phone", F.lit("")), r"\D", ""), F.lit(10))
    rows = providers.select("npi", owner.alias("owner"), F.when(F.length(phone) == 10, phone).alias("p"), F.col("state").alias("s")).filter("owner is not null")
    by = lambda *c: rows.dropna(subset=list(c)).groupBy(*c).agg(F.count("*").alias("n_" + c[-1]))
    joined = rows.join(by("owner"), "owner").join(by("owner", "p"), ["owner", "p"], "left").join(by("owner", "s"), ["owner", "s"], "left").join(by("owner", "s", "p").withColumnRenamed("n_p", "n_sp"), ["owner", "s", "p"], "left")
    strong = F.coalesce(F.col("n_p") - 1, F.lit(0))
    weak = F.coalesce(F.col("n_s") - 1, F.lit(0)) - F.coalesce(F.col("n_sp") - 1, F.lit(0))
    return joined.select("npi", (F.col("n_owner") - 1).alias("same_name"), strong.alias("strong"), weak.alias("weak"), ((strong == 0) & (weak > most_weak)).alias("ambiguous"))
