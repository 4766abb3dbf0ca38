"""Fields of a phone system's call log: when, how long, what came of it, and the clock where the phone rings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How exports write times, and words of a result that say whether a person picked up.
ISO = r"(?i)^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?\s*(Z|[+-]\d{2}:?\d{2})?$"
US = r"(?i)^(\d{1,2})/(\d{1,2})/(\d{4})(?:[ ,]+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AP]M)?)?$"
MISSED = ["voicemail", "voice mail", "no answer", "no-answer", "noanswer", "not answered", "unanswered", "busy", "failed", "abandon", "cancel", "rejected", "missed"]
ANSWERED = ["answer", "answered", "connected", "spoke", "conversation", "talk", "talked", "completed", "human"]
ANSWERED_SECONDS = 15
#: The zone that most of a state keeps.
ZONES = {
    "America/New_York": "CT DE DC FL GA IN KY MA MD ME MI NC NH NJ NY OH PA RI SC VA VT WV",
    "America/Chicago": "AL AR IA IL KS LA MN MO MS ND NE OK SD TN TX WI",
    "America/Denver": "CO ID MT NM UT WY",
    "America/Phoenix": "AZ",
    "America/Los_Angeles": "CA NV OR WA",
    "America/Anchorage": "AK",
    "Pacific/Honolulu": "HI",
    "America/Puerto_Rico": "PR VI",
    "Pacific/Guam": "GU",
}


def call_time(value: Column) -> Column:
    """A time in UTC: ISO with or without a zone, or US with AM and PM; what has no zone is UTC. Anything else is null."""
    v = F.trim(value)
    part = lambda pattern, i: F.nullif(F.regexp_extract(v, pattern, i), F.lit(""))
    number = lambda pattern, i: F.coalesce(part(pattern, i).try_cast("int"), F.lit(0))
    made = F.try_make_timestamp_ntz
    iso = made(*[number(ISO, i) for i in range(1, 7)])
    zone = F.regexp_replace(F.upper(part(ISO, 7)), "[:Z]", "")
    minutes = F.when(F.length(zone) == 5, F.concat(F.left(zone, F.lit(1)), F.substring(zone, 2, 2)).cast("int") * 60 + F.concat(F.left(zone, F.lit(1)), F.substring(zone, 4, 2)).cast("int")).otherwise(0)
    iso = iso - F.make_dt_interval(mins=minutes)
    half = F.upper(part(US, 7))
    hour = F.when(half.isNull(), number(US, 4)).otherwise(number(US, 4) % 12 + F.when(half == "PM", 12).otherwise(0))
    us = made(number(US, 3), number(US, 1), number(US, 2), hour, number(US, 5), number(US, 6))
    return F.when(v.rlike(ISO), iso).when(v.rlike(US), us)


def duration_seconds(value: Column) -> Column:
    """Seconds, m:ss or h:mm:ss as whole seconds; anything else is null."""
    v, clock = F.trim(value), r"^(?:(\d+):)?(\d{1,2}):(\d{2})$"
    part = lambda i: F.coalesce(F.regexp_extract(v, clock, i).try_cast("bigint"), F.lit(0))
    return F.when(v.rlike(r"^\d+(\.\d+)?$"), F.floor(v.try_cast("double") + 0.5)).when(v.rlike(clock), part(1) * 3600 + part(2) * 60 + part(3))


def answered(seconds: Column, result: Column, least: int = ANSWERED_SECONDS) -> Column:
    """Whether a person picked up: a result that says no, then one that says yes, then a call of at least so many seconds."""
    says = F.lower(F.coalesce(result, F.lit("")))
    return F.when(says.rlike("|".join(MISSED)), False).when(says.rlike(rf"\b({'|'.join(ANSWERED)})\b"), True).otherwise(F.coalesce(seconds >= least, F.lit(False)))


def zone_of_state(state: Column) -> Column:
    """The zone of a state's code; null for anything else."""
    zones = F.create_map(*[F.lit(x) for zone, states in ZONES.items() for s in states.split() for x in (s, zone)])
    return F.try_element_at(zones, F.upper(F.trim(state)))


def local_time(at: Column, zone: Column) -> Column:
    """A UTC time on the clock of a zone, which may differ from row to row; null where the zone is."""
    return F.convert_timezone(F.lit("UTC"), zone, at.cast("timestamp_ntz"))


def calling_window(local: Column, first: int = 9, last: int = 17, lunch: int = 12) -> Column:
    """weekend, before, lunch, open or after, by a local time."""
    hour = F.hour(local)
    return F.when(F.weekday(local) >= 5, "weekend").when(hour < first, "before").when(hour >= last, "after").when(hour == lunch, "lunch").when(hour.isNotNull(), "open")
