"""Strictly typed access to JSON records held as variants.

A field of another JSON type counts as absent: ``true`` is no string, ``"7"`` and 5.7
are no whole numbers.  Texts of objects have their keys in order and no white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode at both ends.
_ENDS = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"


def part(v: Column, path: str) -> Column:
    """The value at a path; null if it is absent, a variant null if it is JSON's null."""
    return F.try_variant_get(v, path, "variant")


def _first(found: list[Column]) -> Column:
    return found[0] if len(found) == 1 else F.coalesce(*found)


def text_at(v: Column, *paths: str) -> Column:
    """The first of the values that is a string."""
    return _first([F.when(F.schema_of_variant(part(v, p)) == "STRING", F.try_variant_get(v, p, "string")) for p in paths])


def bool_at(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(part(v, path)) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def number_at(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(part(v, path))
    return F.when((kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.try_variant_get(v, path, "double"))


def int_at(v: Column, *paths: str) -> Column:
    """The first of the values that is a whole number."""
    found = []
    for p in paths:
        n = number_at(v, p)
        found.append(F.when(n == F.floor(n), F.try_variant_get(v, p, "bigint")))
    return _first(found)


def list_at(v: Column, path: str) -> Column:
    """The elements of an array, null for anything else."""
    return F.try_variant_get(v, path, "array<variant>")


def is_object(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(part(v, path)).startswith("OBJECT"), F.lit(False))


def json_text(v: Column) -> Column:
    return F.to_json(v)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def preview(text: Column, most: int) -> Column:
    """The first characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def preview_head_tail(text: Column, most: int) -> Column:
    """Three fifths of ``most`` characters from the beginning and two from the end, with the
    number of those left out between them."""
    tail = most * 2 // 5
    head = most - tail
    left_out = (F.length(text) - most).cast("string")
    cut = F.concat(F.substring(text, 1, head), F.lit("\n[… "), left_out, F.lit(" chars omitted …]\n"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) > most, cut).otherwise(text)


def preview_omitted(text: Column) -> Column:
    """The number that ``preview_head_tail`` left out, null for a whole text."""
    return F.nullif(F.regexp_extract(text, r"\n\[… (\d+) chars omitted …\]\n", 1), F.lit("")).cast("long")


def epoch_seconds(timestamp: Column) -> Column:
    """Whole seconds of a UTC timestamp (``...T...Z``), null for any other."""
    whole = F.regexp_replace(timestamp, r"\.\d*Z$", "Z")
    return F.when(timestamp.endswith("Z") & timestamp.contains("T"), F.unix_seconds(F.try_to_timestamp(whole)))


def epoch_millis(timestamp: Column) -> Column:
    """Milliseconds of a UTC timestamp (``...T...Z``), rounded; null for any other."""
    micros = F.unix_micros(F.try_to_timestamp(timestamp))
    return F.when(timestamp.endswith("Z") & timestamp.contains("T"), F.floor(micros / 1000 + 0.5).cast("long"))


def millis_between(start: Column, end: Column) -> Column:
    """Null if either is missing or malformed, or the end comes first."""
    ms = F.unix_millis(F.try_to_timestamp(end)) - F.unix_millis(F.try_to_timestamp(start))
    return F.when(ms >= 0, ms)


def iso_utc(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
