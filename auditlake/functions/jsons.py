"""JSON in strings: best-effort extraction and presence of keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def best_effort_object(text: Column) -> Column:
    """The JSON object in a model's answer: the whole text, else from its first to its last brace; null if neither
    is one."""
    whole = F.trim(text)
    inner = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    usable = [F.when(F.json_object_keys(x).isNotNull(), x) for x in (whole, inner)]
    return F.coalesce(*usable)


def best_effort_field(text: Column, name: str) -> Column:
    """A field of the JSON in an answer; if none parses, the string after the field's name."""
    parsed = F.get_json_object(best_effort_object(text), f"$.{name}")
    loose = F.nullif(F.regexp_extract(text, rf'"{name}"\s*:\s*"([^"]*)"', 1), F.lit(""))
    return F.coalesce(parsed, F.when(best_effort_object(text).isNull(), loose))


def missing_keys(raw: Column, required: list[str]) -> Column:
    """The required keys that an object lacks; a key with a null value is present."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")))
