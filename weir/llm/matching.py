"""Matching entities of two tables without a common key, by a cascade of exact joins.

Both sides are reduced to keys: a canonical name, the phones, the person. Each rule joins on a combination of keys, the
strongest first, and a record leaves the cascade once it is matched: passes of a few rules run one after the other, and
the records that a pass resolved are anti-joined away before the next. What a rule's keys leave open (a
misspelt word, an initial) is compared on the joined pairs only. A match carries the confidence of its rule: the share of
the rule's pairs that labelled pairs confirm, smoothed towards a prior where there are few of them.

A match needs two of name, phone and person; one alone is shared by different organizations too often.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.blanks import phone_digits, says_something
from weir.scratch import Scratch

#: Legal forms, and abbreviations of the words that names of suppliers are made of.
LEGAL = ["llc", "inc", "lp", "ltd", "co", "corp", "incorporated", "corporation", "company", "limited", "pllc", "llp", "lllp", "pc", "pa", "dba"]
SHORT = {"resp": "respiratory", "med": "medical", "equip": "equipment", "svcs": "services", "svc": "services", "soln": "solutions", "solns": "solutions", "hlth": "health", "supplies": "supply", "prod": "products", "prods": "products", "rx": "pharmacy", "ctr": "center", "diab": "diabetic", "grp": "group", "ortho": "orthotics", "rehabilitation": "rehab"}
#: Titles and roles that are no part of a person's name, and entries that name no person.
TITLES = ["dr", "md", "mr", "mrs", "ms", "jr", "sr", "owner", "ceo", "president", "manager", "esq", "phd", "rn"]
NO_PERSON = ["front desk", "reception", "office", "office manager", "billing", "unknown", "none", "na", "owner"]


def all_words(name: Column) -> Column:
    """Words of an organization's name: without brackets, legal form and article; abbreviations written out."""
    low = F.regexp_replace(F.regexp_replace(F.lower(name), r"\(.*?(\)|$)", " "), r"[.']", "")
    words = F.split(F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")), " ")
    full = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])
    kept = F.filter(words, lambda w: ~w.isin(*LEGAL, "and", "the", ""))
    return F.when(says_something(name), F.transform(kept, lambda w: F.coalesce(F.try_element_at(full, w), w)))


def without_place(words: Column) -> Column:
    """Words of a name without what stands behind its first 'of', if at least two words stand before it."""
    place = F.array_position(words, "of").cast("int")
    return F.when(place > 2, F.slice(words, F.lit(1), F.greatest(place - 1, F.lit(1)))).otherwise(F.filter(words, lambda w: w != "of"))


def name_words(name: Column) -> Column:
    """Words of an organization's name as it is matched: all_words without_place."""
    return without_place(all_words(name))


def person_words(person: Column) -> Column:
    """First to last words of a person's name, 'Last, First' turned round, titles dropped; null for what names no person."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(person), r"\(.*?(\)|$)", " "), r"m\.\s*d\.", " ")
    turned = F.when(plain.contains(","), F.concat_ws(" ", F.substring_index(plain, ",", -1), F.substring_index(plain, ",", 1))).otherwise(plain)
    text = F.trim(F.regexp_replace(turned, "[^a-z]+", " "))
    words = F.filter(F.split(text, " "), lambda w: ~w.isin(*TITLES, ""))
    return F.when(says_something(person) & ~text.isin(*NO_PERSON) & (F.size(words) > 0), words)


def _without_one(words: Column) -> Column:
    """A name without each one of its words, whose first letter stays, and without its last one; and the whole name."""
    whole = F.array_join(words, " ")
    dropped = F.transform(words, lambda w, i: F.array_join(F.transform(words, lambda x, j: F.when(i == j, F.left(x, F.lit(1))).otherwise(x)), " "))
    cut = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " ")
    return F.array_distinct(F.concat(F.array(whole, cut), dropped))


def with_keys(df: DataFrame, name: str, person: str, phones: list[str]) -> DataFrame:
    """df with full (all words of the name), name_words, whole (those in one), partial (less a word), person, first, last and phones.

    What says nothing is null, or no phone.
    """
    return (
        df.withColumn("full", all_words(F.col(name)))
        .withColumn("name_words", without_place(F.col("full")))
        .withColumn("full", F.array_join("full", " "))
        .withColumn("name_words", F.when(F.size("name_words") > 0, F.col("name_words")))
        .withColumn("whole", F.array_join("name_words", " "))
        .withColumn("partial", _without_one(F.col("name_words")))
        .withColumn("person", person_words(F.col(person)))
        .withColumn("first", F.col("person")[0])
        .withColumn("last", F.when(F.size("person") > 1, F.element_at("person", -1)))
        .withColumn("phones", F.array_distinct(F.array_compact(F.array(*[phone_digits(F.col(p)) for p in phones]))))
    )


def names_agree(a: str, b: str) -> Column:
    """Equal names, names a few letters apart, or one cut off, also with a letter wrong."""
    x, y = F.col(a), F.col(b)
    few = F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.length(x) / 6))).cast("int")
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    cut = (F.length(short) >= 8) & (F.levenshtein(short, F.left(long, F.length(short))) <= F.least(F.lit(3), few))
    return F.coalesce((F.levenshtein(x, y) <= few) | cut, F.lit(False))


def persons_agree(a: str, b: str) -> Column:
    """The same first and last name, of which one may be an initial or a letter or two apart, but not both."""
    col = lambda side, part: F.col(f"{side}_{part}" if side else part)
    f1, l1, f2, l2 = col(a, "first"), col(a, "last"), col(b, "first"), col(b, "last")
    initial = ((F.length(f1) == 1) | (F.length(f2) == 1)) & (F.left(f1, F.lit(1)) == F.left(f2, F.lit(1)))
    near = lambda x, y: (F.levenshtein(x, y) <= 2) & (F.length(x) >= 4)
    return F.coalesce(((f1 == f2) & ((l1 == l2) | near(l1, l2))) | ((l1 == l2) & (initial | near(f1, f2))), F.lit(False))


@dataclass(frozen=True)
class Rule:
    """Keys to join on, each a column or an array of alternatives, and whether name and person must agree besides."""

    name: str
    keys: tuple[str, ...]
    names: bool = False
    persons: bool = False


RULES = [
    Rule("phone, name", ("phones", "whole")),
    Rule("name, person", ("whole", "first", "last")),
    Rule("phone, person", ("phones", "first", "last")),
    Rule("phone, name less a word", ("phones", "partial"), names=True),
    Rule("person, name less a word", ("first", "last", "partial"), names=True),
    Rule("phone, last name", ("phones", "last"), persons=True),
    Rule("phone, first name", ("phones", "first"), persons=True),
    Rule("name, last name", ("whole", "last"), persons=True),
    Rule("name, first name", ("whole", "first"), persons=True),
    Rule("last name, name less a word", ("last", "partial"), names=True, persons=True),
    Rule("first name, name less a word", ("first", "partial"), names=True, persons=True),
    Rule("phone, word of the name", ("phones", "name_words"), names=True),
    Rule("person, word of the name", ("first", "last", "name_words"), names=True),
    Rule("last name, word of the name", ("last", "name_words"), names=True, persons=True),
]


#: How many rules each pass takes; a pass is one join, in which a record goes by the first of its rules that finds any.
PASSES = (3, 4, 7)


def _keys(rules: list[tuple[int, Rule]]) -> Column:
    """An array (rule_no, key) of each combination of the alternatives of the rules' keys; what lacks a key has none."""
    arrays, out = {"phones", "partial", "name_words"}, []
    for number, rule in rules:
        combined = F.array(F.lit(""))
        for key in rule.keys:
            parts = F.array_distinct(key) if key in arrays else F.array(key)
            combined = F.flatten(F.transform(combined, lambda head: F.transform(parts, lambda part: F.concat(head, F.lit("|"), part))))  # noqa: B023
        known = F.filter(F.coalesce(combined, F.array().cast("array<string>")), lambda k: k.isNotNull())
        out.append(F.transform(known, lambda k: F.struct(F.lit(number).alias("rule_no"), k.alias("key"))))  # noqa: B023
    return F.concat(*out)


#: What the joined pairs are compared by.
EVIDENCE = ["whole", "full", "first", "last", "phones"]


def cascade(leads: DataFrame, candidates: DataFrame, scratch: Scratch, *, lead: str, candidate: str, rules: list[Rule] = RULES) -> DataFrame:
    """(lead, candidate, rule): at most one candidate for each lead, by the first rule that finds any.

    Of several candidates of the same rule the one with more agreeing evidence wins, then the closest name, then the
    closest full name, then the smallest id. leads and candidates have the columns of with_keys; both may have several rows
    of an id (other phones). Nulls never join. Empty tables give no rows.

    Leads that say the same are one, and candidates that say the same are the smallest of them, so that a name that a third
    of all rows have meets only the different ways to write it. Only keys are joined; two that several keys join are
    compared once, with the set of their rules. Adaptive execution splits the keys that are still frequent.
    """
    says = [*EVIDENCE, "name_words", "partial"]
    row = F.struct(F.xxhash64(*says).alias("a"), F.xxhash64(F.lit("b"), *says).alias("b"))
    leads = leads.withColumn("l_row", row)
    open_rows = scratch.keep(leads.select("l_row", *says).distinct())
    people = scratch.keep(candidates.withColumn("c_row", row).groupBy("c_row", *says).agg(F.min(candidate).alias(candidate)))
    told = people.select("c_row", candidate, *[F.col(c).alias(f"c_{c}") for c in EVIDENCE])
    numbered, found = list(enumerate(rules)), []
    for size in [*PASSES[:-1], len(rules)]:
        now, numbered = numbered[:size], numbered[size:]
        if not now:
            break
        left = open_rows.select("l_row", F.inline(_keys(now)))
        right = people.select("c_row", F.inline(_keys(now)))
        hits = left.join(right, ["rule_no", "key"]).select("l_row", "c_row", "rule_no").repartition("l_row")
        pairs = hits.groupBy("l_row", "c_row").agg(F.bit_or(F.expr("shiftleft(1L, rule_no)")).alias("rules"))
        both = pairs.join(open_rows.select("l_row", *EVIDENCE), "l_row").join(told, "c_row")
        both = both.withColumn("names", names_agree("whole", "c_whole")).withColumn("persons", persons_agree("", "c"))
        holds = lambda n, r: (F.col("rules").bitwiseAND(1 << n) != 0) & (F.col("names") if r.names else F.lit(True)) & (F.col("persons") if r.persons else F.lit(True))
        both = both.withColumn("rule_no", F.coalesce(*[F.when(holds(n, r), F.lit(n)) for n, r in now])).filter("rule_no is not null")
        agreeing = F.when(F.arrays_overlap("phones", "c_phones"), 1).otherwise(0) + F.when(F.col("persons"), 1).otherwise(0) + F.when(F.col("names"), 1).otherwise(0)
        far = lambda c: F.coalesce(F.levenshtein(c, f"c_{c}"), F.lit(999)).alias(c)
        order = F.struct("rule_no", (-agreeing).alias("a"), far("whole"), far("full"), F.col(candidate))
        best = scratch.keep(both.groupBy("l_row").agg(F.min(order).alias("b")))
        found.append(best)
        open_rows = open_rows.join(best, "l_row", "left_anti")
    # what another row of a lead found in an earlier pass goes first
    settled = leads.select(lead, "l_row").join(reduce(DataFrame.unionByName, found), "l_row").groupBy(lead).agg(F.min("b").alias("b"))
    label = F.element_at(F.array(*[F.lit(r.name) for r in rules]), F.col("b.rule_no") + 1)
    return settled.select(lead, F.col(f"b.{candidate}").alias(candidate), label.alias("rule"))


def rule_confidence(matches: DataFrame, labels: DataFrame, *, lead: str, candidate: str, prior: float = 0.7, weight: float = 10.0) -> DataFrame:
    """(rule, confidence): the share of a rule's labelled matches that the labels confirm, with `weight` pairs of the prior added.

    labels: (lead, candidate, is_match); a pair that is labelled both ways counts by its share. Few labels, or none, leave
    a rule near the prior.
    """
    shares = labels.groupBy(lead, candidate).agg(F.avg(F.col("is_match").cast("double")).alias("share"))
    seen = matches.join(shares, [lead, candidate], "left").groupBy("rule").agg(F.count("share").alias("n"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("yes"))
    return seen.select("rule", F.round((F.col("yes") + prior * weight) / (F.col("n") + weight), 4).alias("confidence"))
