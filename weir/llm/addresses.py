"""Which address records mean the same building, by a gazetteer built from the records themselves.

1. Each address line is parsed into number, direction, street letters and street type; suites, units, floors and named
   buildings in front are set aside.
2. The gazetteer is built: spellings of cities are clustered within their state and postal codes point to their city;
   spellings of streets are clustered within their locality. Its entries are the buildings (locality, street, number)
   with each direction and type that occurs there, and how often.
3. Every address is resolved by a beam search over it: hypotheses for its locality (by its city, by its postal code) are
   extended by streets (what its spelling leads to, and what else its letters may mean there), of which the first `beam`
   are extended by number to entries that don't contradict what the address says, and the best supported stays.
4. Records with the same entry mean the same building.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.functions.blanks import FILLERS, says_something
from weir.llm.spelling import cluster_spellings
from weir.scratch import Scratch

#: Ways to write directions, street types and the words in front of a unit.
DIRECTIONS = {"n": "n", "no": "n", "north": "n", "s": "s", "so": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w", "ne": "ne", "northeast": "ne", "nw": "nw", "northwest": "nw", "se": "se", "southeast": "se", "sw": "sw", "southwest": "sw"}
STREET_TYPES = {"st": "st str street", "ave": "ave av avenue aven", "blvd": "blvd boul boulevard blv", "dr": "dr drv drive", "rd": "rd road", "ln": "ln lane", "ct": "ct court crt", "pl": "pl place plc", "pkwy": "pkwy pky parkway pkway", "hwy": "hwy highway hiway", "cir": "cir circle", "ter": "ter terrace", "trl": "trl trail", "sq": "sq square"}
UNITS = {"ste", "suite", "unit", "rm", "room", "fl", "floor", "bldg", "building", "apt", "apartment", "#"}
CITY_WORDS = {"ft": "fort", "mt": "mount", "st": "saint", "n": "north", "s": "south", "e": "east", "w": "west", "pt": "port", "lk": "lake"}
UNIT_NUMBERS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth"]
TEENS = ["tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth"]
TENS = ["twent", "thirt", "fort", "fift", "sixt", "sevent", "eight", "ninet"]

_TYPE_OF = {word: short for short, words in STREET_TYPES.items() for word in words.split()}
_WORD = re.compile(r"[a-z0-9#]+(?:-[a-z]+)?")
_UNIT_VALUE = re.compile(r"[a-z]?\d{1,5}[a-z]?|[a-z]")
_ORDINAL = re.compile(r"(\d+)(?:st|nd|rd|th)?")


def _ordinals() -> dict[str, str]:
    """Ordinals to 99 in words, also with a letter wrong or missing, to their digits."""
    words = {w: i + 1 for i, w in enumerate(UNIT_NUMBERS + TEENS)}
    for i, ten in enumerate(TENS, 2):
        words[f"{ten}ieth"] = 10 * i
        words |= {f"{ten}y{unit}": 10 * i + j for j, unit in enumerate(UNIT_NUMBERS, 1)}
    loose: dict[str, set[int]] = {}
    for word, value in words.items():
        for i in range(len(word)):
            loose.setdefault(word[:i] + word[i + 1 :], set()).add(value)
    return {k: str(min(v)) for k, v in loose.items() if len(v) == 1 and k not in words} | {k: str(v) for k, v in words.items()}


ORDINALS = _ordinals()


def _ordinal(letters: str) -> str | None:
    if letters in ORDINALS:
        return ORDINALS[letters]
    near = {ORDINALS[x] for i in range(len(letters)) if (x := letters[:i] + letters[i + 1 :]) in ORDINALS} if 5 < len(letters) < 15 and "th" in letters[-4:] else set()
    return near.pop() if len(near) == 1 else None


def parse_line(line: str | None) -> tuple[str, str, str, str] | None:
    """(number, direction, street, type) of an address line, '' where a part is missing; None without a number and street."""
    words = _WORD.findall((line or "").lower().replace("#", " # ").replace(".", "").replace("'", ""))
    kept, i = [], 0
    while i < len(words):
        if words[i] in UNITS and i + 1 < len(words) and _UNIT_VALUE.fullmatch(words[i + 1]):
            i += 2
        else:
            kept.append(words[i])
            i += 1
    if len(kept) > 1 and kept[0] in ("no", "#") and kept[1].isdigit():
        kept = kept[1:]
    numbers = [i for i, w in enumerate(kept) if w.isdigit()]
    if not numbers:
        return None
    if numbers[-1] == len(kept) - 1 and numbers[0] > 0:
        number, rest = kept[-1], kept[:-1]  # the number stands behind the street
    else:
        number, rest = kept[numbers[0]], kept[numbers[0] + 1 :]
    direction = kind = ""
    if len(rest) > 1 and rest[-1] in DIRECTIONS:
        direction, rest = DIRECTIONS[rest[-1]], rest[:-1]
    if len(rest) > 1 and rest[0] in DIRECTIONS:
        direction, rest = DIRECTIONS[rest[0]], rest[1:]
    if len(rest) > 1 and rest[-1] in _TYPE_OF:
        kind, rest = _TYPE_OF[rest[-1]], rest[:-1]
    if len(rest) > 1 and rest[-1] in DIRECTIONS and not direction:
        direction, rest = DIRECTIONS[rest[-1]], rest[:-1]
    street = "".join(rest).replace("-", "")
    if not street:
        return None
    if m := _ORDINAL.fullmatch(street):
        street = m.group(1).lstrip("0") or "0"
    else:
        street = _ordinal(street) or street
    return number.lstrip("0") or "0", direction, street, kind


def parse_city(city: str | None) -> str:
    """A city without its state, in small letters, with its first word written out; '' if it says nothing."""
    words = re.findall(r"[a-z]+", (city or "").split(",")[0].lower())
    core = "".join(words).upper()
    if core in FILLERS or len(set(core)) < 2:
        return ""
    if len(words) > 1:
        words[0] = CITY_WORDS.get(words[0], words[0])
    return " ".join(words)


def parse_zip(code: str | None) -> str:
    """Five digits; a lost zero in front is put back, all zeros and anything else are ''."""
    digits = re.sub(r"\D", "", re.sub(r"\.0+$", "", (code or "").strip()))
    digits = ("0" + digits if len(digits) in (4, 8) else digits)[:5]
    return digits if len(digits) == 5 and digits != "00000" else ""


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lines, cities, states, codes = (c.to_pylist() for c in batch.columns)
        out = [
            (i, *parsed, parse_city(c), re.sub(r"[^A-Z]", "", (s or "").upper())[:2], parse_zip(z))
            for i, line, c, s, z in zip(ids, lines, cities, states, codes)
            if (parsed := parse_line(line))
        ]
        names = ["id", "number", "direction", "street", "kind", "city", "state", "zip"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(len(names))], names=names)


PARSED = "id string, number string, direction string, street string, kind string, city string, state string, zip string"


def _localities(parsed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """By (state, city spelling), by postal code, and by city spelling alone: the locality 'STATE|city'."""
    counted = parsed.filter("city != '' and state != ''").groupBy("state", "city").agg(F.count("*").alias("n"))
    cities = scratch.keep(cluster_spellings(counted, "state", "city", "n", "n").withColumn("by_city", F.concat_ws("|", "state", "canonical")))
    named = parsed.filter("city != '' and state != '' and zip != ''").join(cities, ["state", "city"])
    votes = named.groupBy("zip", "by_city").agg(F.count("*").alias("n"))
    by_zip = votes.groupBy("zip").agg(F.max(F.struct("n", "by_city"))["by_city"].alias("by_zip"))
    alone = cities.groupBy("city").agg(F.countDistinct("by_city").alias("n"), F.max("by_city").alias("by_name")).filter("n = 1").select("city", "by_name")
    return cities.select("state", "city", "by_city"), by_zip, alone


def resolve(records: DataFrame, scratch: Scratch, *, id: str, line: str, city: str, state: str, postal: str, beam: int = 4) -> DataFrame:
    """(id, locality, street, number, direction, kind): the gazetteer entry of every record whose address line says something.

    beam is how many hypotheses (street and locality) of an address are looked up by number: first what its spelling leads
    to, in each of its localities, then the other streets that a misspelling may mean. An entry that other records have
    goes before one that none has, the likelier street before a less likely one, then the entry with more records. A
    record that leaves out its direction or street type is resolved to the entry there that has twice the support of any
    other it may mean; otherwise it keeps what it says.
    """
    rows = records.filter(says_something(F.col(line)) & F.col(id).isNotNull())
    source = rows.select(*[F.col(c).cast("string") for c in (id, line, city, state, postal)]).distinct()
    parsed = scratch.keep(source.mapInArrow(_parse, PARSED))
    cities, by_zip, alone = _localities(parsed, scratch)
    placed = parsed.join(cities, ["state", "city"], "left").join(by_zip, "zip", "left").join(alone, "city", "left")
    first = F.coalesce("by_city", F.when(F.col("state") == "", F.col("by_name")), "by_zip")
    located = scratch.keep(
        placed.select("id", "number", "direction", "street", "kind", F.array_distinct(F.array_compact(F.array(first, F.col("by_zip")))).alias("places")).filter(F.size("places") > 0)
    )
    counted = located.select(F.col("places")[0].alias("locality"), "street", "number").groupBy("locality", "street").agg(F.count("*").alias("n"), (F.min("number") == F.max("number")).alias("once"))
    counted = scratch.keep(counted)
    everywhere = counted.groupBy("street").agg(F.sum("n").alias("g"))
    streets = cluster_spellings(counted.join(everywhere, "street"), "locality", "street", "n", "g").withColumnRenamed("canonical", "known")
    # another street may be meant where the spelling is none, or was only ever seen at one number
    streets = streets.join(counted.select("locality", "street", "once"), ["locality", "street"])
    streets = streets.withColumn("others", F.when((F.col("known") != F.col("street")) | F.col("once"), F.col("others"))).drop("once")
    # hypotheses: the streets of each place, the cluster's spelling first; at and turn are their order
    guesses = located.select("id", "number", "direction", "street", "kind", F.posexplode("places").alias("at", "locality"))
    met = guesses.join(streets, ["locality", "street"], "left").filter("at = 0 or known is not null")
    may_mean = F.array_distinct(F.concat(F.array(F.coalesce("known", "street")), F.coalesce("others", F.array().cast("array<string>"))))
    spread = met.select("id", "number", "direction", "kind", "locality", "at", F.posexplode(may_mean).alias("turn", "street"))
    named = scratch.keep(spread.filter(2 * F.col("turn") + F.col("at") < beam))  # there are two places at most
    entries = named.filter("at = 0 and turn = 0").groupBy("locality", "street", "number", "direction", "kind").agg(F.count("*").alias("n"))
    buildings = entries.groupBy("locality", "street", "number").agg(F.sort_array(F.collect_list(F.struct("n", "direction", "kind")), asc=False).alias("variants"))
    joined = named.join(buildings, ["locality", "street", "number"], "left")
    may_be = F.filter(
        F.coalesce("variants", F.array().cast("array<struct<n:bigint,direction:string,kind:string>>")),
        lambda v: ((v["direction"] == F.col("direction")) | (F.col("direction") == "")) & ((v["kind"] == F.col("kind")) | (F.col("kind") == "")),
    )
    # what the record leaves out is taken from entries that have it, if any do: first the type, then the direction
    typed = F.filter(may_be, lambda v: (v["kind"] != "") | (F.col("kind") != ""))
    typed = F.when(F.size(typed) > 0, typed).otherwise(may_be)
    turned = F.filter(typed, lambda v: (v["direction"] != "") | (F.col("direction") != ""))
    fuller = F.when(F.size(turned) > 0, turned).otherwise(typed)
    said = F.struct(F.lit(0).cast("bigint").alias("n"), F.col("direction"), F.col("kind"))
    weighed = joined.withColumn("own", fuller).withColumn(
        "choice",
        F.when(F.size("own") == 0, said)
        .when(F.size("own") == 1, F.col("own")[0])
        .when(F.get("own", F.lit(0))["n"] >= 2 * F.get("own", F.lit(1))["n"], F.col("own")[0])
        .otherwise(said),
    )
    others = F.aggregate(may_be, F.lit(0).cast("bigint"), lambda a, v: a + v["n"]) - F.when((F.col("at") == 0) & (F.col("turn") == 0), 1).otherwise(0)
    support = F.struct((others > 0).alias("met"), (-F.col("turn")).alias("turn"), others.alias("others"), (-F.col("at")).alias("order"))
    best = weighed.select("id", F.struct(support.alias("support"), "locality", "street", "number", F.col("choice.direction").alias("direction"), F.col("choice.kind").alias("kind")).alias("h"))
    return best.groupBy("id").agg(F.max("h").alias("h")).select(F.col("id").alias(id), "h.locality", "h.street", "h.number", "h.direction", "h.kind")


ENTRY = ["locality", "street", "number", "direction", "kind"]


def buildings(records: DataFrame, scratch: Scratch, **columns: str) -> DataFrame:
    """(id, building, others): the smallest id of the building that each record is in, and how many others are there.

    One row for each record that same_building may pair, so that a building with a third of all records costs its rows only:
    it is reduced by an aggregate, and the join on it is left to adaptive skew handling.
    """
    id = columns["id"]
    found = scratch.keep(resolve(records, scratch, **columns))
    least = found.groupBy(*ENTRY).agg(F.min(id).alias("building"), (F.count("*") - 1).alias("others"))
    return found.join(least, ENTRY).select(id, "building", "others")


def same_building(records: DataFrame, scratch: Scratch, *, id: str, line: str, city: str, state: str, postal: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: records of different ids in the same building.

    The result is pairs, so that a building with many records costs as many rows as it has pairs; everything before grows
    with the records only. Address lines that say nothing, or hold no number or street, and records whose city and postal
    code both say nothing are in no pair. Repeated rows count once; of differing rows of an id the best supported counts.
    An empty table gives no rows.
    """
    found = scratch.keep(resolve(records, scratch, id=id, line=line, city=city, state=state, postal=postal))
    a, b = found.withColumnRenamed(id, f"{id}_a"), found.withColumnRenamed(id, f"{id}_b")
    return a.join(b, ENTRY).filter(F.col(f"{id}_a") < F.col(f"{id}_b")).select(f"{id}_a", f"{id}_b")
