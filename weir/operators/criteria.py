"""Search criteria as one predicate, and the pages, counts and grids over it."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.text import last_ten


def like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


#: The columns of search_providers that a predicate may read.
COLUMNS = ["npi", "name", "enumeration_type", "status", "is_organization", "city", "state", "postal_code", "phone", "taxonomy_code", "official_first_name", "official_last_name", "official_phone", "last_updated", "deactivation_date", "medicare_total_claims"]


def predicate(criteria: dict, *, today: str | None = None, since: str = "enumeration_date") -> Column:
    """The conjunction of the criteria's clauses over COLUMNS; an empty dict matches organizations that are active.

    npi alone decides everything; a phone or q keeps the clauses on organizations and activity and leaves out the rest.
    A null column never satisfies a clause that names it, nor the negation of one. newSupplier and establishedSupplier read
    the ISO date of column `since` (two years up to `today`, fifteen before it); untouched, tag and objection the columns of
    team_flags.
    """
    if npi := criteria.get("npi"):
        return F.col("npi") == str(npi)
    out: list[Column] = []
    if not criteria.get("includeIndividuals"):
        out.append(F.coalesce("is_organization", F.col("enumeration_type") == "NPI-2", F.lit(True)))
    if not criteria.get("includeInactive"):
        out.append(F.col("deactivation_date").isNull() & F.upper(F.coalesce("status", F.lit("A"))).isin("A", "ACTIVE"))
    if phone := criteria.get("phone"):
        return reduce(Column.__and__, out + [(last_ten(F.col("phone")) == phone) | (last_ten(F.col("official_phone")) == phone)])
    if q := criteria.get("q"):
        words = f"%{q.replace('%', '').replace('_', '')}%"
        return reduce(Column.__and__, out + [F.col("name").ilike(words) | F.concat_ws(" ", "official_first_name", "official_last_name").ilike(words)])
    if states := {s.strip().upper() for s in [*criteria.get("states", []), criteria.get("state") or ""] if s.strip()}:
        out.append(F.upper(F.trim("state")).isin(*sorted(states)))
    if codes := {c.strip() for c in [*criteria.get("taxonomyCodes", []), criteria.get("taxonomyCode") or ""] if c.strip()}:
        out.append(F.col("taxonomy_code").isin(*sorted(codes)))
    if city := criteria.get("city"):
        out.append(F.upper(F.trim("city")) == city.strip().upper())
    if name := criteria.get("organizationName"):
        out.append(F.col("name").ilike(name.replace("*", "%") + "%"))
    if words := criteria.get("nameContains"):
        out.append(reduce(Column.__or__, [F.col("name").ilike(f"%{w}%") for w in words]))
    if words := criteria.get("excludeKeywords"):
        out.append(~reduce(Column.__or__, [F.col("name").ilike(f"%{w}%") for w in words]))
    if years := criteria.get("lastUpdatedYears"):
        valid = [int(y) for y in map(str, years) if len(y) == 4 and y[:2] in ("19", "20") and y.isdigit()]
        ranges = [(F.col("last_updated") >= f"{y}-01-01") & (F.col("last_updated") < f"{y + 1}-01-01") for y in valid]
        out.append(reduce(Column.__or__, ranges) if ranges else F.lit(False))
    if criteria.get("hasPhone"):
        out.append(F.trim(F.coalesce("phone", F.lit(""))) != "")
    if criteria.get("hasDecisionMaker"):
        out.append(F.trim(F.coalesce("official_last_name", F.lit(""))) != "")
    if (least := criteria.get("minMedicareClaims")) is not None or criteria.get("activeMedicare"):
        out.append(F.coalesce("medicare_total_claims", F.lit(0.0)) >= (least if least is not None else 1))
    prefix = "".join(filter(str.isdigit, str(criteria.get("zipPrefix") or "")))
    if 3 <= len(prefix) <= 5:
        out.append(F.regexp_replace(F.coalesce("postal_code", F.lit("")), r"\D", "").startswith(prefix))
    if criteria.get("newSupplier"):
        out.append(F.col(since) >= F.add_months(F.to_date(F.lit(today)), -24).cast("string"))
    if criteria.get("establishedSupplier"):
        out.append(F.col(since) <= F.add_months(F.to_date(F.lit(today)), -180).cast("string"))
    if criteria.get("untouched"):
        out.append(~F.coalesce("touched", F.lit(False)))
    for one, many in (("tag", "tags"), ("objection", "objections")):
        if wanted := criteria.get(one):
            out.append(F.array_contains(many, wanted))
    return reduce(Column.__and__, out) if out else F.lit(True)


def team_flags(df: DataFrame, *, touched: Sequence[DataFrame], tags: DataFrame, objections: DataFrame) -> DataFrame:
    """df with what the team knows of each npi: touched, if any of the tables has it, and its distinct tags and objections."""
    seen = reduce(DataFrame.unionByName, [t.select("npi") for t in touched]).dropna().distinct().withColumn("touched", F.lit(True))
    sets = lambda t, one, many: t.dropna(subset=["npi", one]).groupBy("npi").agg(F.collect_set(one).alias(many))
    return df.join(seen, "npi", "left").join(sets(tags, "tag", "tags"), "npi", "left").join(sets(objections, "objection", "objections"), "npi", "left")


#: Criteria that are switches, lists, and texts; anything else a request holds is ignored.
SWITCHES = ["includeIndividuals", "includeInactive", "hasPhone", "hasDecisionMaker", "activeMedicare", "newSupplier", "establishedSupplier", "untouched"]
LISTS = {"states": "state", "taxonomyCodes": "taxonomyCode", "nameContains": "nameContains", "excludeKeywords": "excludeKeywords", "lastUpdatedYears": "lastUpdatedYear"}
#: A code that no specialty has: who asks for specialties without a code finds nothing.
NO_CODE = "none"


def cleaned(request: dict) -> dict:
    """A request's criteria: switches, trimmed lists without repetitions, ten digits of a phone, three to five of a ZIP, known sorts.

    Blank entries are left out. Wildcards and commas of a text are spaces. A specialty that was asked for by name only,
    without a code, becomes a code that nothing has.
    """
    one = lambda v: re.sub(r"\s+", " ", str(v if v is not None else "")).strip()
    out: dict = {name: True for name in SWITCHES if str(request.get(name)).lower() in ("true", "on", "1")}
    for many, single in LISTS.items():
        given = request.get(many) or request.get(single) or []
        if terms := list(dict.fromkeys(filter(None, map(one, [given] if isinstance(given, str) else given)))):
            out[many] = terms
    for name, most in (("city", 100), ("organizationName", 100), ("tag", 24), ("objection", 24), ("npi", 10)):
        if text := one(request.get(name))[:most]:
            out[name] = text.lower() if name in ("tag", "objection") else text
    if text := one(re.sub("[,%_]", " ", str(request.get("q") or "")))[:100]:
        out["q"] = text
    if len(digits := re.sub(r"\D", "", str(request.get("phone") or ""))) >= 10:
        out["phone"] = digits[-10:]
    if len(digits := re.sub(r"\D", "", str(request.get("zipPrefix") or ""))) >= 3:
        out["zipPrefix"] = digits[:5]
    claims = str(request.get("minMedicareClaims") or "")
    if re.fullmatch(r"\d+(\.\d+)?", claims) and float(claims) > 0:
        out["minMedicareClaims"] = float(claims)
    if (sort := one(request.get("sort")).lower()) in SORTS:
        out["sort"] = sort
    if one(request.get("specialty")) and "taxonomyCodes" not in out:
        out["taxonomyCodes"] = [NO_CODE]
    return out


def fingerprint(criteria: dict) -> str:
    """The same for the same criteria in any order, also of lists; the sort mode and the page are no part of it."""
    canonical = {k: sorted(v) if isinstance(v, list) else v for k, v in criteria.items() if k not in ("sort", "limit", "skip")}
    return hashlib.sha256(json.dumps(canonical, sort_keys=True).encode()).hexdigest()


#: The sort modes; the key always breaks ties, so that pages never overlap.
SORTS = {
    "medicare": lambda: [F.desc_nulls_last("medicare_total_claims"), F.asc("npi")],
    "updated": lambda: [F.desc_nulls_last("last_updated"), F.asc("npi")],
    "name": lambda: [F.asc_nulls_last("name"), F.asc("npi")],
    "npi": lambda: [F.asc("npi")],
}


def page(df: DataFrame, criteria: dict, *, sort: str = "npi", limit: int = 20, skip: int = 0) -> DataFrame:
    """One page of the matches, as a top-k: only limit + skip rows of each task reach the final step."""
    return df.filter(predicate(criteria)).orderBy(*SORTS[sort]()).offset(max(0, skip)).limit(min(200, max(1, limit)))


def counts(df: DataFrame, criteria: dict, taken: DataFrame, seen: DataFrame, *, cap: int = 5000) -> DataFrame:
    """(matched, unclaimed, left), each at most cap: all matches, those nobody has, and those of them not seen yet. One scan."""
    flags = df.filter(predicate(criteria)).select("npi").join(taken.select("npi", F.lit(True).alias("taken")).distinct(), "npi", "left").join(seen.select("npi", F.lit(True).alias("seen")).distinct(), "npi", "left")
    free = F.col("taken").isNull()
    up_to = lambda c: F.least(c, F.lit(cap))
    return flags.agg(up_to(F.count("*")).alias("matched"), up_to(F.count_if(free)).alias("unclaimed"), up_to(F.count_if(free & F.col("seen").isNull())).alias("left"))


def quick_counts(df: DataFrame, picks: dict[str, dict], **dates: str) -> DataFrame:
    """(pick, n): the matches of each criteria, all in one scan."""
    one = df.agg(*[F.count_if(predicate(c, **dates)).alias(name) for name, c in picks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("pick"), F.col(n).alias("n")) for n in picks])).alias("x")).select("x.*")


def relaxations(df: DataFrame, criteria: dict) -> DataFrame:
    """(dropped, found, more): the matches without each one of the criteria, and how many more those are, all in one scan."""
    loose = {name: {k: v for k, v in criteria.items() if k != name} for name in criteria}
    one = df.agg(F.count_if(predicate(criteria)).alias("__all"), *[F.count_if(predicate(c)).alias(name) for name, c in loose.items()])
    rows = [F.struct(F.lit(name).alias("dropped"), F.col(name).alias("found"), (F.col(name) - F.col("__all")).alias("more")) for name in loose]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def territory(df: DataFrame, taken: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Totals and what is free by the cells' rollup: every cell, each first column's total, and the grand total."""
    flags = df.join(taken.select("npi", F.lit(1).alias("taken")).distinct(), "npi", "left")
    return flags.rollup(*cells).agg(F.count("*").alias("total"), F.greatest(F.count("*") - F.count("taken"), F.lit(0)).alias("unclaimed"))


def longest_term(df: DataFrame, text: str, terms: Iterable[str]) -> DataFrame:
    """df with `term`: the longest of the terms that the text contains, the first by alphabet among equally long ones.

    The list of terms is a literal of the plan: one pass, no join.
    """
    ordered = sorted({t.strip().lower().replace("%", "").replace("_", "") for t in terms} - {""}, key=lambda t: (-len(t), t))
    hit = F.lit(None).cast("string")
    for term in reversed(ordered):
        hit = F.when(F.lower(F.col(text)).contains(term), F.lit(term)).otherwise(hit)
    return df.withColumn("term", hit)


def listed(df: DataFrame, name: str, companies: Iterable[str], official: str, officials: Iterable[str]) -> DataFrame:
    """df with `listed`: whether the name holds one of the companies as words, or the official is one of the officials.

    Both sides are compared in small letters and digits, words apart by one space; lists are literals of the plan.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    clean = lambda values: sorted({re.sub("[^a-z0-9]+", " ", v.lower()).strip() for v in values} - {""})
    text, hit = F.concat(F.lit(" "), plain(F.col(name)), F.lit(" ")), F.lit(False)
    for company in clean(companies):
        hit = hit | text.contains(f" {company} ")
    return df.withColumn("listed", hit | plain(F.col(official)).isin(clean(officials)))


def text_matches(columns: Sequence[str], term: str, phones: Sequence[str] = ()) -> Column:
    """Whether any of the columns holds a text, any case and wildcards taken as they are, or, if it has ten digits, a phone is that."""
    out = reduce(Column.__or__, [F.coalesce(F.contains(F.lower(c), F.lit(term.strip().lower())), F.lit(False)) for c in columns])
    digits = re.sub(r"\D", "", term)
    for c in phones if len(digits) >= 10 else ():
        out = out | (last_ten(F.col(c)) == digits[-10:])
    return out


def stale(codes: DataFrame, counted: DataFrame, key: str, at: str, now: str, hours: int) -> DataFrame:
    """The codes that were never counted, or longer than so many hours (one at least) before `now`."""
    fresh = counted.filter(F.col(at) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {max(1, hours)} hours"))
    return codes.join(fresh.select(key).dropna().distinct(), key, "left_anti")


def removable(df: DataFrame, key: str, keep: Sequence[DataFrame]) -> DataFrame:
    """Rows whose key is in none of the keep sets; a null key in a set protects nothing."""
    protected = reduce(DataFrame.unionByName, [k.select(key) for k in keep]).dropna().distinct()
    return df.join(protected, key, "left_anti")


def after(df: DataFrame, keys: Sequence[str], cursor: Sequence, limit: int) -> DataFrame:
    """The page of 1 to 200 rows behind a cursor of key values, with one row more that tells whether there is another page."""
    position = F.struct(*keys) > F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, cursor)])
    return df.filter(position).orderBy(*keys).limit(min(200, max(1, limit)) + 1)
