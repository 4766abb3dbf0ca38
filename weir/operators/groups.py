"""Groups of identical records as functions of snapshots: new members, moves, merges, conflicts, and what a candidate would meet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.operators.related import branches_merged, token_sort_ratio

#: What two records must share, in order; the first rule that holds decides.
RULES = [(1, "name+state+official+phone", True), (2, "name+official+phone", True), (2, "name+state+phone", False), (2, "name+state+official", False), (2, "state+official+phone", False), (3, "official+phone", False), (3, "name+phone", False), (3, "name+official", False)]
#: Fixed value: from this similarity on two names may be one.
FUZZY_NAME = 88


def group_id(key: Column) -> Column:
    return F.md5(key)


def new_members(keys: DataFrame, members: DataFrame) -> DataFrame:
    """(npi, group_id, cross_state) of keys (npi, identity_key, state) that have no group yet.

    The group is that of the identity key; cross_state where members of the key, old ones too, are in several states.
    """
    states = keys.groupBy("identity_key").agg((F.count_distinct(F.nullif("state", F.lit(""))) > 1).alias("cross_state"))
    new = keys.join(members.select("npi").dropna().distinct(), "npi", "left_anti")
    return new.join(states, "identity_key").select("npi", group_id(F.col("identity_key")).alias("group_id"), "cross_state")


def representative(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value): the value of each group if all members that have one agree, else null."""
    return df.groupBy(by).agg(F.when(F.count_distinct(value) <= 1, F.min(value)).alias(value))


def moves(members: DataFrame, wanted: DataFrame, fixed: Column) -> DataFrame:
    """(npi, from_group, to_group) of members (npi, group_id) whose wanted (npi, group_id) differs; members that are fixed stay."""
    goal = wanted.select("npi", F.col("group_id").alias("to_group"))
    return members.filter(~F.coalesce(fixed, F.lit(False))).join(goal, "npi").filter("group_id != to_group").select("npi", F.col("group_id").alias("from_group"), "to_group")


def owner_conflicts(members: DataFrame, owner: str) -> DataFrame:
    """(group_id, owners, list): groups whose members have several owners, in order; a null owns nothing."""
    found = members.dropna(subset=["group_id", owner]).groupBy("group_id").agg(F.count_distinct(owner).alias("owners"), F.array_join(F.sort_array(F.collect_set(owner)), ",").alias("list"))
    return found.filter("owners > 1")


def with_groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """pairs with left_group and right_group, where an NPI without a group is one of its own; pairs of one group are left out."""
    of = members.groupBy("npi").agg(F.min("group_id").alias("g"))
    side = lambda df, s: df.join(of.select(F.col("npi").alias(f"{s}_npi"), F.col("g").alias(f"{s}_group")), f"{s}_npi", "left").withColumn(f"{s}_group", F.coalesce(f"{s}_group", F.concat(F.lit("npi:"), f"{s}_npi")))
    return side(side(pairs, "left"), "right").filter("left_group != right_group")


def undecided_groups(pairs: DataFrame, members: DataFrame, decisions: DataFrame) -> DataFrame:
    """(a, b, tier): pairs of groups that matches join and no decision between any of their members names, in either order."""
    both = lambda df: with_groups(df, members).withColumns({"a": F.least("left_group", "right_group"), "b": F.greatest("left_group", "right_group")})
    open_ = both(pairs).groupBy("a", "b").agg(F.min("tier").alias("tier"))
    return open_.join(both(decisions).select("a", "b").distinct(), ["a", "b"], "left_anti")


def merge_preview(group_pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """(pairs, blocked, mergeable) of pairs of groups (a, b): a pair whose groups have more than one owner together is blocked.

    owners has (group_id, owner), a row for each owner of a group.
    """
    pairs = group_pairs.select("a", "b").distinct()
    told = owners.dropna().distinct()
    sides = [pairs.join(told.withColumnRenamed("group_id", side), side).select("a", "b", "owner") for side in ("a", "b")]
    owned = sides[0].unionByName(sides[1]).groupBy("a", "b").agg(F.count_distinct("owner").alias("n"))
    joined = pairs.join(owned, ["a", "b"], "left").agg(F.count("*").alias("pairs"), F.count_if(F.col("n") > 1).alias("blocked"))
    return joined.withColumn("mergeable", F.col("pairs") - F.col("blocked"))


def merged_groups(members: DataFrame, group_pairs: DataFrame) -> DataFrame:
    """(npi, group_id) after all pairs of groups (a, b) were merged: the largest group of each linked set stays, ties by id.

    Pairs link groups through any number of them, in whatever order they are taken.
    """
    ends = group_pairs.select(F.concat_ws("|", "a", "b").alias("pair"), F.explode(F.array("a", "b")).alias("g")).distinct()
    sets = branches_merged(ends, [["pair"]], "g")
    sizes = members.groupBy("group_id").agg(F.count_distinct("npi").alias("n"))
    sized = sets.join(sizes.withColumnRenamed("group_id", "g"), "g", "left")
    best = sized.groupBy("branch").agg(F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("n"), F.col("g").alias("g")))["g"].alias("kept"))
    kept = sets.join(best, "branch").select(F.col("g").alias("group_id"), "kept")
    return members.select("npi", "group_id").distinct().join(kept, "group_id", "left").select("npi", F.coalesce("kept", "group_id").alias("group_id"))


SIGNALS = ["name", "state", "official", "phone"]


def candidate_matches(candidates: DataFrame, existing: DataFrame, cap: int = 200, similar: bool = True) -> DataFrame:
    """(npi, other, tier, keys, name_match, automatic): existing records that a candidate may be the same as, by the first rule that holds.

    Both have npi, name, state, official, phone; '' and null share nothing. Pairs come from equal names, officials and
    phones, three joins instead of one on an OR, and are compared once. A similar name may stand for an equal one, unless `similar` is
    False, but then a person decides. A key of more than `cap` existing records joins nothing by itself, as it means nothing; a pair that
    also shares another key is found by that.
    """
    prepared = lambda df, p: df.select(F.col("npi").alias(f"{p}npi"), *[F.nullif(F.trim(c), F.lit("")).alias(f"{p}{c}") for c in SIGNALS]).distinct()
    left, right = prepared(candidates, ""), prepared(existing, "o_")
    blocks = []
    for key in ("name", "official", "phone"):
        small = right.dropna(subset=[f"o_{key}"]).groupBy(f"o_{key}").agg(F.count("*").alias("n")).filter(F.col("n") <= cap).select(F.col(f"o_{key}").alias(key))
        keyed = right.select("o_npi", F.col(f"o_{key}").alias(key)).join(small, key)
        blocks.append(left.select("npi", key).join(keyed, key).select("npi", "o_npi"))
    ids = reduce(DataFrame.unionByName, blocks).filter("npi != o_npi").distinct()
    pairs = ids.join(left, "npi").join(right, "o_npi")
    same = {c: F.coalesce(F.col(c) == F.col(f"o_{c}"), F.lit(False)) for c in SIGNALS}
    pairs = pairs.withColumns({f"same_{c}": test for c, test in same.items()})
    alike = F.when(~F.col("same_name") & (F.col("same_official") | F.col("same_phone")), token_sort_ratio(F.col("name"), F.col("o_name")) >= FUZZY_NAME) if similar else F.lit(False)
    pairs = pairs.withColumn("like_name", F.coalesce(alike, F.lit(False)))
    number = F.lit(None).cast("int")
    for i, (_, keys, _) in reversed(list(enumerate(RULES))):
        holds = reduce(Column.__and__, [F.col(f"same_{k}") | F.col("like_name") if k == "name" else F.col(f"same_{k}") for k in keys.split("+")])
        number = F.when(holds, i).otherwise(number)
    ruled = pairs.withColumn("rule", number).filter("rule is not null")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("rule") + 1)
    keys = pick([k for _, k, _ in RULES])
    by_name = keys.contains("name")
    match = F.when(by_name & F.col("like_name"), "fuzzy").when(by_name, "exact")
    ruled = ruled.select("npi", F.col("o_npi").alias("other"), pick([t for t, _, _ in RULES]).alias("tier"), keys.alias("keys"), match.alias("name_match"), (pick([a for _, _, a in RULES]) & ~F.coalesce(match == "fuzzy", F.lit(False))).alias("automatic"))
    return ruled.groupBy("npi", "other").agg(F.min(F.struct("tier", "keys", "name_match", "automatic")).alias("m")).select("npi", "other", "m.*")


def preflight(candidates: DataFrame, taken: DataFrame, matches: DataFrame, members: DataFrame, owners: DataFrame) -> DataFrame:
    """(npi, decision, group_id): what each candidate NPI would meet: invalid, duplicate, owned_conflict, needs_review or accept.

    Its group is its own, else that of its first automatic match that has one. An NPI that occurs several times gets one
    row; null and anything but ten digits is invalid.
    """
    ids = candidates.select(F.trim("npi").alias("npi")).distinct()
    of = members.groupBy("npi").agg(F.min("group_id").alias("g"))
    auto = matches.filter("automatic").join(of.withColumnRenamed("npi", "other"), "other").groupBy("npi").agg(F.min(F.struct("tier", "other", "g"))["g"].alias("auto_group"))
    review = matches.filter("not automatic").select("npi", F.lit(True).alias("review")).distinct()
    flags = ids.join(taken.select("npi", F.lit(True).alias("taken")).distinct(), "npi", "left").join(of, "npi", "left").join(auto, "npi", "left").join(review, "npi", "left")
    flags = flags.withColumn("group_id", F.coalesce("g", "auto_group")).join(owners.select("group_id", F.lit(True).alias("owned")).dropna().distinct(), "group_id", "left")
    decision = F.when(~F.coalesce(F.col("npi").rlike("^[0-9]{10}$"), F.lit(False)), "invalid").when(F.col("taken"), "duplicate").when(F.col("owned"), "owned_conflict").when(F.col("review"), "needs_review").otherwise("accept")
    return flags.select("npi", decision.alias("decision"), F.when(~decision.isin("invalid", "duplicate"), F.col("group_id")).alias("group_id"))


def verdicts(ids: DataFrame, key: str, lists: Sequence[tuple[str, DataFrame]], otherwise: str) -> DataFrame:
    """(key, verdict): the first of the named lists that each key is in, else the last word."""
    out, verdict = ids.select(key).distinct(), F.lit(otherwise)
    for i, (_, df) in enumerate(lists):
        out = out.join(df.select(F.col(df.columns[0]).alias(key), F.lit(True).alias(f"in_{i}")).dropna().distinct(), key, "left")
    for i, (name, _) in reversed(list(enumerate(lists))):
        verdict = F.when(F.col(f"in_{i}"), name).otherwise(verdict)
    return out.select(key, verdict.alias("verdict"))


def filled(df: DataFrame, reference: DataFrame, key: str, *, theirs_first: Sequence[str], ours_first: Sequence[str], lacking: Column) -> DataFrame:
    """df where rows that are lacking take their fields from reference: the reference's before ours, or only where ours is blank."""
    fields = [*theirs_first, *ours_first]
    told = reference.groupBy(key).agg(*[F.min(F.nullif(F.trim(c), F.lit(""))).alias(f"r_{c}") for c in fields])
    ours = lambda c: F.nullif(F.trim(c), F.lit(""))
    mixed = {c: F.when(lacking, F.coalesce(f"r_{c}", ours(c)) if c in theirs_first else F.coalesce(ours(c), f"r_{c}")).otherwise(F.col(c)) for c in fields}
    return df.join(told, key, "left").select(*[mixed[c].alias(c) if c in mixed else F.col(c) for c in df.columns])
