"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters JavaScript's trim() removes beyond \s.
EXTRA_BLANKS = "\\u00a0\\ufeff\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Patterns of catalogue names and codes.
SEASON = r"(?i)^(.*?)\s+(?:S|Season\s*|v)(\d+(?:\.\d+)?)$"
SHARE_CODE = r"^KovaaKs[A-Za-z0-9]+$"
NUMERIC = r"^\s*-?\d+(?:\.\d+)?\s*$"
INTEGER_LIKE = r"^(?:0|[1-9]\d*)$"


def js_trim(text: Column) -> Column:
    """Trims what JavaScript's ``trim()`` does, not only spaces."""
    return F.regexp_replace(text, f"^[\\s{EXTRA_BLANKS}]+|[\\s{EXTRA_BLANKS}]+$", "")


def short_hash(text: Column) -> Column:
    return F.substring(text, 1, 8)


def family(name: Column) -> Column:
    trimmed = js_trim(name)
    return F.lower(F.when(trimmed.rlike(SEASON), F.regexp_extract(trimmed, SEASON, 1)).otherwise(trimmed))


def season(name: Column) -> Column:
    found = F.regexp_extract(js_trim(name), SEASON, 2)
    return F.when(found == "", F.lit(1.0)).otherwise(found.cast("double"))


def share_code(raw: Column) -> Column:
    trimmed = js_trim(raw)
    return F.when(trimmed.rlike(SHARE_CODE), trimmed)


def number(raw: Column) -> Column:
    """A numeric text as a double, anything else null."""
    return F.when(raw.rlike(NUMERIC), F.trim(raw).cast("double"))


def natural_key(name: Column) -> Column:
    """A sort key in which digit runs order by value and case does not matter.

    Approximates a locale collation: every run of digits is led by its number of places, without leading zeros.
    """
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))

    def keyed(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=\d)", "")
        return F.when(part.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(part)

    return F.array_join(F.transform(parts, keyed), "")


def words(query: str) -> list[str]:
    return [w for w in query.lower().split() if w]
