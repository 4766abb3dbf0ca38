"""Which values of free-text fields say something."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing value, upper case, letters and digits only.
FILLERS = ["NA", "NONE", "NULL", "NIL", "UNKNOWN", "UNK", "TBD", "TBA", "NOTAVAILABLE", "NOTAPPLICABLE", "NOTPROVIDED", "MISSING", "BLANK", "PENDING"]


def says_something(value: Column) -> Column:
    """False for null, blank, punctuation only, one repeated letter, and words that stand for a missing value."""
    core = F.upper(F.regexp_replace(value, r"[\W_]+", ""))
    # one pattern, as each further use of core would replace anew
    return F.coalesce(~core.rlike(rf"^(?:|{'|'.join(FILLERS)}|([A-Z])\1+)$"), F.lit(False))


def phone_digits(value: Column) -> Column:
    """The ten digits of a phone, however written (also 8.58E9, '.0' and extensions); null if it isn't one.

    A number of one repeated digit is a filler.
    """
    v = F.trim(value)
    plain = F.when(v.rlike(r"^\d(\.\d+)?[eE]\+?\d{1,2}$"), F.format_string("%.0f", F.expr("cast(1 as double)") * v.try_cast("double"))).otherwise(v)
    digits = F.regexp_replace(F.regexp_replace(plain, r"(?i)(\.0+)?(\s*(ext|x)\.?\s*\d+\s*)?$", ""), r"\D", "")
    return F.nullif(F.regexp_extract(digits, r"^1?((?!(\d)\2{9}$)\d{10})$", 1), F.lit(""))
