"""Text keys of the registry, as Column expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms that a name key leaves out, and titles that an owner key leaves out.
LEGAL_SUFFIXES = ["inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "pc", "pllc", "lp", "llp"]


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def normalize_name(c: Column) -> Column:
    """Upper case, anything but letters, digits and spaces as a space, collapsed; empty is null."""
    return clean_text(F.regexp_replace(F.upper(c), "[^A-Z0-9 ]+", " "))


def normalize_text(c: Column) -> Column:
    """Lower-case words separated by one space; dots and apostrophes join, other characters separate. Null is ''."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[.']", "")), "[^a-z0-9]+", " "))


def name_key(c: Column) -> Column:
    """The words of a name in order, without legal forms."""
    return F.array_join(F.filter(F.split(normalize_text(c), " "), lambda w: (w != "") & ~w.isin(LEGAL_SUFFIXES)), " ")


def official_key(first: Column, last: Column) -> Column:
    """First and last name without initials."""
    both = normalize_text(F.concat_ws(" ", first, last))
    return F.array_join(F.filter(F.split(both, " "), lambda w: F.length(w) > 1), " ")


def state_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z]", ""))


def phone_key(phone: Column, official: Column) -> Column:
    """Ten digits of the phone, else of the official's phone, else ''; a leading 1 is dropped."""
    ten = lambda c: F.nullif(F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", ""), "^1?([0-9]{10})", 1), F.lit(""))
    return F.coalesce(ten(phone), ten(official), F.lit(""))


def national_number(c: Column) -> Column:
    """Exactly ten digits, or eleven that start with 1; else null."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, r"\D", ""), "^1?([0-9]{10})$", 1), F.lit(""))


def last_ten(c: Column) -> Column:
    """The last ten digits of a cell, however many it holds."""
    return F.right(F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", ""), F.lit(10))


def first_phone(*cells: Column) -> Column:
    """The first usable number of the cells, left to right: a chunk of ten or more digits, not starting with 0 or 1."""
    found = []
    for cell in cells:
        chunks = F.regexp_extract_all(F.regexp_replace(cell, r"[()\s.\-]+", ""), F.lit(r"(\d+)"), 1)
        plain = F.transform(chunks, lambda d: F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(F.left(d, F.lit(10))))
        found.append(F.get(F.filter(plain, lambda d: (F.length(d) == 10) & ~d.rlike("^[01]")), F.lit(0)))
    return F.coalesce(*found)


def postal_code(c: Column) -> Column:
    """Nine digits with a hyphen, five or more as five, fewer as they are; none is null."""
    d = F.regexp_replace(c, r"\D", "")
    return F.nullif(F.when(F.length(d) == 9, F.concat(F.left(d, F.lit(5)), F.lit("-"), F.right(d, F.lit(4)))).when(F.length(d) >= 5, F.left(d, F.lit(5))).otherwise(d), F.lit(""))


def formula_safe(c: Column) -> Column:
    """A cell that a spreadsheet would run as a formula, with a quote in front; signed numbers stay."""
    risky = c.rlike("^[=@]") | (c.rlike(r"^[+\-]") & ~c.rlike(r"^[+\-]?[0-9][0-9,]*\.?[0-9]*$"))
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def parse_date(c: Column) -> Column:
    """ISO (also with a time), US, or compact dates; anything else is null."""
    v = F.trim(c)
    return F.coalesce(
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(v, F.lit(10)).try_cast("date")),
        F.when(v.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(v, "M/d/yyyy")),
        F.when(v.rlike(r"^\d{8}$"), F.try_to_date(v, "yyyyMMdd")),
    )


def parse_number(c: Column) -> Column:
    """A number with thousands separators; blank or bad is null."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def check_digit_ok(npi: Column) -> Column:
    """Whether ten digits carry a valid Luhn check digit under the 80840 prefix; false for anything else, null for null."""
    digit = lambda i: F.substring(npi, i, 1).try_cast("int")
    total = F.lit(24)  # what the prefix adds
    for i in range(1, 10):
        d = digit(i)
        total = total + (F.when(d >= 5, 2 * d - 9).otherwise(2 * d) if i % 2 else d)
    return F.when(npi.isNotNull(), F.coalesce(npi.rlike("^[0-9]{10}$") & (F.pmod(total + digit(10), F.lit(10)) == 0), F.lit(False)))
