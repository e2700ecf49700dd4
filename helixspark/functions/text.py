"""Scalar text rules as column expressions. Missing strings are NULL inside the engine; sinks fill them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that mean "missing", compared without case.
MISSING = ["", "nan", "na", "none", "null"]
#: Micromolar per unit; other units have no molar value.
DOSE_UNITS = {"um": 1.0, "µm": 1.0, "nm": 1e-3, "pm": 1e-6, "mm": 1e3, "m": 1e6}
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def is_missing(x: Column) -> Column:
    return x.isNull() | F.lower(F.trim(x)).isin(MISSING)


def present(x: Column) -> Column:
    """The string, or NULL where it is missing."""
    return F.when(~is_missing(x), x)


def safe(x: Column, fill: str = "none") -> Column:
    return F.when(is_missing(x), F.lit(fill)).otherwise(x)


def to_number(x: Column) -> Column:
    """A double where the whole string is a decimal number, else NULL (suffixes such as 1d or 1f aren't numbers)."""
    s = x.cast("string")
    return F.when(F.regexp_like(s, F.lit(NUMBER)), F.trim(s).try_cast("double"))


def ensembl_id(x: Column) -> Column:
    """Trimmed, "" if missing, version suffix cut from ids that start with ENS."""
    t = F.trim(x)
    return F.when(is_missing(x), "").when(t.startswith("ENS"), F.substring_index(t, ".", 1)).otherwise(t)


def after_colon(x: Column) -> Column:
    """What follows the first colon; "" without one."""
    at = F.locate(":", x)
    return F.when(at > 0, F.substr(x, at + 1)).otherwise(F.lit(""))


def plain_separators(x: Column) -> Column:
    """Hyphens and underscores become spaces, white space collapses, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[-_]+", " "), r"\s+", " "))


def drug_doses(x: Column) -> Column:
    """"conc unit" of each (name, conc, unit) tuple of a printed list, joined by ", "; the string itself if it holds none."""
    pattern = r"""\((?:'[^']*'|"[^"]*"),\s*([^,()]+),\s*(?:'([^']*)'|"([^"]*)")\)"""
    conc = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
    one = F.regexp_extract_all(x, F.lit(pattern), F.lit(2))
    two = F.regexp_extract_all(x, F.lit(pattern), F.lit(3))
    unit = F.zip_with(one, two, lambda a, b: F.concat(a, b))
    return F.when(F.size(conc) > 0, F.array_join(F.zip_with(conc, unit, lambda c, u: F.concat_ws(" ", F.trim(c), u)), ", ")).otherwise(x)


DOSE = r"^\s*([\d.eE+\-]+)\s+(.+?)\s*$"


def dose_raw(x: Column) -> Column:
    return F.when(F.regexp_like(x, F.lit(DOSE)), to_number(F.regexp_extract(x, DOSE, 1)))


def dose_um(x: Column) -> Column:
    """Micromolar dose; NULL for mass, volume, percent and what doesn't parse."""
    unit = F.lower(F.regexp_extract(x, DOSE, 2))
    factor = F.coalesce(*(F.when(unit == u, F.lit(f)) for u, f in DOSE_UNITS.items()))
    return dose_raw(x) * factor


def hours(x: Column) -> Column:
    pattern = r"(?i)^\s*([\d.eE+\-]+)\s*h?\s*$"
    return F.when(F.regexp_like(x, F.lit(pattern)), to_number(F.regexp_extract(x, pattern, 1)))


def joined_domain(*parts: Column) -> Column:
    return F.concat_ws("|", *(safe(p) for p in parts))


def first_sentence(x: Column, most: int = 220) -> Column:
    """Up to the first ". " between places 20 and ``most`` (its full stop included), else the first ``most`` characters."""
    at = F.locate(". ", x) - 1
    return F.when((at > 20) & (at < most), F.left(x, at + 1)).otherwise(F.left(x, F.lit(most)))


def clean_description(x: Column) -> Column:
    """Without a leading "Label: ", a "[Source:...]" tail, and what follows a bar; then the first sentence."""
    t = F.trim(F.regexp_replace(x, r"^[A-Za-z0-9 _]+:\s*", ""))
    t = F.regexp_replace(t, r"(?s)\s*\[Source:.*?\]", "")
    return F.coalesce(first_sentence(F.trim(F.substring_index(t, "|", 1))), F.lit(""))


def shorten(x: Column) -> Column:
    return F.coalesce(first_sentence(F.trim(F.regexp_replace(x, r"\s+", " "))), F.lit(""))


def reversed_type(x: Column, prefix: str | None = None) -> Column:
    """A-B becomes B-A, cut at the first hyphen; types without one, or all with ``prefix``, get a prefix."""
    parts = F.split(x, "-", 2)
    named = F.concat(F.lit(prefix or "rev_"), x)
    return named if prefix else F.when(F.size(parts) == 2, F.concat_ws("-", parts[1], parts[0])).otherwise(named)


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def as_list(x: Column) -> Column:
    """An empty array for NULL."""
    return F.coalesce(x, F.array())


def shuffle_key(id_: Column, seed: int, times: int = 1, plus: Column | None = None) -> Column:
    """A hash of x = id_ * times + plus by whole-number arithmetic that any SQL engine can repeat: (((x * 1103515245 + seed * 12345) % m) * 48271) % m.

    Remainders have the sign of what is divided, as in SQL. They are taken before products, so none leaves 64 bits whatever the id.
    ``plus`` must not be negative.
    """
    m, a, c = 2147483647, 1103515245, seed * 12345
    x, plus = id_.cast("long"), F.lit(0).cast("long") if plus is None else plus.cast("long")
    rest = F.pmod(F.pmod(F.pmod(x, F.lit(m)) * (times % m) + plus, F.lit(m)) * a + c % m, F.lit(m))
    # x * a + c is negative where x is less than -(c // a), the least whole number that isn't below -c / a
    below = x < -F.floor((plus + c // a) / times)
    return (F.when(below & (rest > 0), rest - m).otherwise(rest) * 48271) % m
